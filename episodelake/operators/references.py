"""References to records that do not exist (problem 3).

Every table gives long rows tagged with the parent table they speak of: (parent table, key, which child says so, when, what
it claims). Parents and children are in one union and one group by (parent table, key); a group's parent columns say if
the target is there, and each child of a group without one is an orphan. What arrives when is no matter, as nothing is
decided before the whole group is seen.

Tables that may hold many rows of a key (frames) are first brought to one row per key, by partial aggregation; a hot key
is then one row per map task. Defined cases: null keys make no case; a key's period is the month of its earliest row; a
current row is the latest by ingested_at; null is_deleted counts as not deleted; a null claim (num_frames, length)
makes no case; empty tables give no rows of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodelake.sources import table

LONG = "parent_table string, episode_index long, child_table string, at timestamp, deleted boolean, has long, claim long"


def tagged(df: DataFrame, parent: str, child: str | None, deleted=None, has=None, claim=None) -> DataFrame:
    """Rows of the long form. child null: the row is the parent's own. deleted: of an `episodes` row, ordered by arrival."""
    null = F.lit(None)
    return df.where("episode_index is not null").select(
        F.lit(parent).alias("parent_table"),
        F.col("episode_index").cast("long").alias("episode_index"),
        F.lit(child).cast("string").alias("child_table"),
        F.col("ingested_at").alias("at"),
        (null if deleted is None else deleted).cast("boolean").alias("deleted"),
        (null if has is None else has).cast("long").alias("has"),
        (null if claim is None else claim).cast("long").alias("claim"),
    )


def long_form(spark: SparkSession, folder: str) -> DataFrame:
    """All parents and children of the robot tables, each row once per parent table it speaks of."""
    t = {n: table(spark, folder, n) for n in ("episodes", "episode_meta", "sync", "episode_quality")}
    # One row per episode; count(frame_index) over distinct pairs counts the distinct non-null ones.
    frames = table(spark, folder, "frames").where("episode_index is not null").groupBy("episode_index", "frame_index").agg(F.min("ingested_at").alias("ingested_at"))
    frames = frames.groupBy("episode_index").agg(F.min("ingested_at").alias("ingested_at"), F.count("frame_index").alias("n"))
    alive = F.coalesce("is_deleted", F.lit(False))
    parts = [
        tagged(t["episodes"], "episodes", None, deleted=alive),
        tagged(t["episodes"], "episode_meta", "episodes", deleted=alive),
        tagged(t["episodes"], "frames", "episodes", deleted=alive, claim=F.col("num_frames")),
        tagged(t["episode_meta"], "episode_meta", None),
        tagged(t["episode_meta"], "episodes", "episode_meta"),
        tagged(t["episode_meta"], "frames", "episode_meta", deleted=F.lit(False), claim=F.col("length")),
        tagged(t["sync"], "episodes", "sync"),
        tagged(t["episode_quality"], "episodes", "episode_quality"),
        tagged(frames, "episodes", "frames"),
        tagged(frames, "frames", None, has=F.col("n")),
    ]
    return reduce(DataFrame.unionAll, parts)


CHILDREN = ("frames", "sync", "episode_quality", "episode_meta", "episodes")


def orphans(long: DataFrame) -> DataFrame:
    """child_table, parent_table, episode_index, period: one row per child whose target isn't there."""
    of = lambda c: F.col("child_table") == c
    own = F.col("child_table").isNull()
    parent = F.max(F.when(own, F.struct("at", "deleted", F.coalesce("has", F.lit(1)).alias("has"))))
    aggregates = [parent.alias("parent"), F.sum(F.when(own, F.col("has"))).alias("has")]
    for c in CHILDREN:
        aggregates += [F.min(F.when(of(c), F.col("at"))).alias(f"at_{c}"), F.max(F.when(of(c), F.struct("at", "deleted", "claim"))).alias(f"now_{c}")]
    groups = long.groupBy("parent_table", "episode_index").agg(*aggregates)

    there = F.col("parent").isNotNull() & ~F.coalesce(F.col("parent.deleted"), F.lit(False))

    def case(c: str):
        now = F.col(f"now_{c}")
        counted = F.col("parent_table") == "frames"
        lives = ~F.coalesce(now.getField("deleted"), F.lit(False))
        missing = F.when(counted, now.getField("claim") > F.coalesce("has", F.lit(0))).otherwise(~there)
        return F.when(now.isNotNull() & lives & missing, F.struct(F.lit(c).alias("child_table"), F.date_format(f"at_{c}", "yyyy-MM").alias("period")))

    cases = groups.select("parent_table", "episode_index", F.explode(F.array_compact(F.array(*(case(c) for c in CHILDREN)))).alias("x"))
    return cases.select("x.child_table", "parent_table", "episode_index", "x.period")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found."""
    return orphans(long_form(spark, folder))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """p3_counts: orphans by child, parent and period."""
    return found(spark, folder).groupBy("child_table", "parent_table", "period").agg(F.count("*").alias("n_orphans"))


FOUND_SQL = """
WITH e AS (
  SELECT episode_index, min(ingested_at) OVER (PARTITION BY episode_index) AS first_at, is_deleted, num_frames,
    row_number() OVER (PARTITION BY episode_index ORDER BY ingested_at DESC) AS n
  FROM episodes WHERE episode_index IS NOT NULL
), live AS (SELECT * FROM e WHERE n = 1 AND NOT coalesce(is_deleted, false)),
m AS (
  SELECT episode_index, min(ingested_at) OVER (PARTITION BY episode_index) AS first_at, "length",
    row_number() OVER (PARTITION BY episode_index ORDER BY ingested_at DESC) AS n
  FROM episode_meta WHERE episode_index IS NOT NULL
), meta AS (SELECT * FROM m WHERE n = 1),
f AS (SELECT episode_index, min(ingested_at) AS first_at, count(DISTINCT frame_index) AS n FROM frames GROUP BY 1),
keys AS (
  SELECT 'frames' AS t, episode_index, first_at FROM f
  UNION ALL SELECT 'sync', episode_index, min(ingested_at) FROM sync GROUP BY 2
  UNION ALL SELECT 'episode_quality', episode_index, min(ingested_at) FROM episode_quality GROUP BY 2
  UNION ALL SELECT 'episode_meta', episode_index, first_at FROM meta
), cases AS (
  SELECT t AS child_table, 'episodes' AS parent_table, episode_index, first_at FROM keys
  WHERE episode_index IS NOT NULL AND episode_index NOT IN (SELECT episode_index FROM live)
  UNION ALL SELECT 'episodes', 'episode_meta', episode_index, first_at FROM live
  WHERE episode_index NOT IN (SELECT episode_index FROM meta)
  UNION ALL SELECT 'episodes', 'frames', l.episode_index, l.first_at FROM live l LEFT JOIN f USING (episode_index)
  WHERE l.num_frames > coalesce(f.n, 0)
  UNION ALL SELECT 'episode_meta', 'frames', m.episode_index, m.first_at FROM meta m LEFT JOIN f USING (episode_index)
  WHERE m."length" > coalesce(f.n, 0)
)
SELECT child_table, parent_table, episode_index, strftime(first_at, '%Y-%m') AS period FROM cases
"""

COUNTS_SQL = f"SELECT child_table, parent_table, period, CAST(count(*) AS BIGINT) AS n_orphans FROM ({FOUND_SQL}) GROUP BY 1, 2, 3"
