"""Irregular readings onto a regular grid (problem 2).

Each source's readings are cut into shards of SHARD periods. A shard is summarised by its first and last reading; a prefix
scan over the summaries (carry.prefix) brings into each shard the last reading before it; then every shard fills its own
periods: gaps inside from its own readings, the gap before its first reading from what was carried in. A source of any
length is thus many tasks, and an empty stretch of many shards is filled by the first shard after it.

Defined cases: null, NaN, infinite and negative timestamps are no readings, nor are those whose period is beyond 2**53 (not
exact in double); readings that fall into one period are one (`values` from the earliest by timestamp, then values); null
sources have no grid; readings whose source has no rate, or one that isn't above 0, have none; a source with one filled
period has that one row; an empty table gives no rows. Columns of `df` that aren't named play no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodelake.operators.carry import prefix
from episodelake.sources import table

#: Periods of a shard, and periods that are made at a time when a gap is filled.
SHARD, PIECE = 1024, 4096


def slots(seconds: Column, rate: Column) -> Column:
    """The period of a reading, in double arithmetic; null for what is no reading."""
    at = seconds.cast("double") * rate.cast("double") + 0.5
    ok = (seconds >= 0) & (seconds < float("inf")) & (rate > 0) & (at < 2.0**53)  # NaN isn't below infinity
    return F.when(ok, F.floor(at)).cast("long")


def regular_grid(readings: DataFrame, source: str, slot: str, values: tuple[str, ...] = (), rank: tuple[str, ...] = ()) -> DataFrame:
    """One row per period from a source's first to its last filled one: source, slot, is_reading, from_slot (the filled
    period whose values it has: its own, or the last before it) and values. Of several readings in a period the first by
    `rank`, then by values, counts."""
    cells = readings.where(F.col(source).isNotNull() & F.col(slot).isNotNull()).withColumn("_shard", F.floor(F.col(slot) / SHARD))
    cells = cells.select(source, "_shard", slot, *(F.struct(*rank, *values).alias("_v") for _ in values[:1])).repartition(source, "_shard")
    least = [F.min("_v").alias("_v")] if values else [F.lit(1).alias("_v")]
    cells = cells.groupBy(source, "_shard", slot).agg(*least)  # no further shuffle
    in_order = Window.partitionBy(source, "_shard").orderBy(slot)
    shards = cells.groupBy(source, "_shard").agg(F.min(slot).alias("_first"), F.max(F.struct(slot, "_v")).alias("_last"))
    carried = prefix(shards, [source], "_shard", lasts={"_in": F.col("_last")})
    gap = lambda df, at, v, upto: df.select(source, at.alias("_from"), v.alias("_v"), upto.alias("_upto")).where(F.col("_upto") > F.col("_from") + 1)
    inside = gap(cells.withColumn("_next", F.lead(slot).over(in_order)), F.col(slot), F.col("_v"), F.col("_next"))
    before = gap(carried, F.col("_in").getField(slot), F.col("_in").getField("_v"), F.col("_first"))
    pieces = inside.unionAll(before).withColumn("_start", F.explode(F.sequence(F.col("_from") + 1, F.col("_upto") - 1, F.lit(PIECE).cast("long"))))
    empty = pieces.select(source, F.explode(F.sequence("_start", F.least(F.col("_start") + (PIECE - 1), F.col("_upto") - 1))).alias(slot), F.lit(False).alias("is_reading"), F.col("_from").alias("from_slot"), "_v")
    filled = cells.select(source, slot, F.lit(True).alias("is_reading"), F.col(slot).alias("from_slot"), "_v")
    return filled.unionAll(empty).select(source, slot, "is_reading", "from_slot", *(F.col("_v").getField(v).alias(v) for v in values))


def frame_readings(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The frames with the slot that each fills by its robot's fps; `robots` has a fixed number of rows."""
    fps = table(spark, folder, "robots").groupBy("robot").agg(F.max("fps").alias("fps"))
    frames = table(spark, folder, "frames").select("episode_index", "robot", "timestamp", *columns)
    return frames.join(F.broadcast(fps), "robot").withColumn("slot", slots(F.col("timestamp"), F.col("fps")))


def empty_slots(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found: the grid's periods that no reading fills."""
    grid = regular_grid(frame_readings(spark, folder), "episode_index", "slot")
    return grid.where(~F.col("is_reading")).select("episode_index", "slot")


def frame_grid(spark: SparkSession, folder: str) -> DataFrame:
    """p2_grid: every period, marked, with the frame whose reading holds there."""
    readings = frame_readings(spark, folder, "frame_index")
    return regular_grid(readings, "episode_index", "slot", ("frame_index",), ("timestamp",))


FOUND_SQL = """
WITH filled AS (
  SELECT DISTINCT f.episode_index, CAST(floor(CAST(f.timestamp AS DOUBLE) * r.fps + 0.5) AS BIGINT) AS slot
  FROM frames f JOIN robots r ON f.robot = r.robot
  WHERE f.episode_index IS NOT NULL AND isfinite(f.timestamp) AND f.timestamp >= 0
), ends AS (SELECT episode_index, min(slot) AS lo, max(slot) AS hi FROM filled GROUP BY 1),
slots AS (SELECT episode_index, unnest(range(lo, hi + 1)) AS slot FROM ends)
SELECT s.episode_index, s.slot FROM slots s
WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.episode_index = s.episode_index AND f.slot = s.slot)
"""

GRID_SQL = """
WITH readings AS (
  SELECT f.episode_index, f.timestamp, f.frame_index, CAST(floor(CAST(f.timestamp AS DOUBLE) * r.fps + 0.5) AS BIGINT) AS slot
  FROM frames f JOIN robots r ON f.robot = r.robot
  WHERE f.episode_index IS NOT NULL AND isfinite(f.timestamp) AND f.timestamp >= 0
), filled AS (
  SELECT episode_index, slot, frame_index FROM readings
  QUALIFY row_number() OVER (PARTITION BY episode_index, slot ORDER BY timestamp, frame_index NULLS FIRST) = 1
), ends AS (SELECT episode_index, min(slot) AS lo, max(slot) AS hi FROM filled GROUP BY 1),
slots AS (SELECT episode_index, unnest(range(lo, hi + 1)) AS slot FROM ends)
SELECT s.episode_index, s.slot, f.slot = s.slot AS is_reading, f.slot AS from_slot, f.frame_index
FROM slots s ASOF JOIN filled f ON s.episode_index = f.episode_index AND s.slot >= f.slot
"""
