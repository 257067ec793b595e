"""Video files shared by episodes: runs of episodes in one file group, and frames counted per episode's time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodelake.functions.arrays import video_path
from episodelake.operators.carry import islands, previous, running
from episodelake.operators.detectors import CLOCK
from episodelake.operators.warehouse import clocked
from episodelake.sources import current, table
from episodelake.sources.tables import quoted

CAMERA = "observation.images.cam_high"
#: Episodes of a shard; seconds of a time bucket.
SHARD, BUCKET = 1024, 8.0


def key_columns(cameras: tuple[str, ...]) -> list[str]:
    """What must be equal, for all cameras at once, for two episodes to lie in the same files."""
    return [f"videos/{c}/{part}" for c in cameras for part in ("chunk_index", "file_index")]


def file_groups(index: DataFrame, keys: list[str], on_hole: str = "raise") -> DataFrame:
    """Consecutive episodes (by episode_index) with equal keys: group_id, from_index, to_index, n_episodes, n_holes.

    Runs, not groups: a key that comes back later begins another. Within a run each episode must begin where the one before ended;
    on_hole="raise" fails where it doesn't, "count" counts it in n_holes."""
    if on_hole not in ("raise", "count"):
        raise ValueError(on_hole)
    shard = F.floor(F.col("episode_index") / SHARD)
    rows = index.select("episode_index", "dataset_from_index", "dataset_to_index", F.struct(*(quoted(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("key"))
    runs = islands(rows, [], ["episode_index"], {"_key": F.col("key")}, ~F.col("key").eqNullSafe(F.col("_key")), shard)
    told = previous(runs, [], ["episode_index"], {"_island": F.col("island"), "_to": F.col("dataset_to_index")}, shard)
    hole = (F.col("_island") == F.col("island")) & (F.col("_to") != F.col("dataset_from_index"))
    flag = F.when(F.coalesce(hole, F.lit(False)), F.lit(1) if on_hole == "count" else F.raise_error(F.format_string("episode %d shares a file group with the one before but begins elsewhere", "episode_index")).cast("int")).otherwise(0)
    return told.groupBy(F.col("island").alias("group_id")).agg(F.min("dataset_from_index").alias("from_index"), F.max("dataset_to_index").alias("to_index"), F.count("*").alias("n_episodes"), F.sum(flag).alias("n_holes"))


def open_counts(groups: DataFrame, cameras: int = 1) -> DataFrame:
    """Files opened once per episode against once per group, and the ratio (0 if there are none)."""
    return groups.agg((F.sum("n_episodes") * cameras).alias("naive_opens"), (F.count("*") * cameras).alias("grouped_opens")).select(
        F.coalesce("naive_opens", F.lit(0)).alias("naive_opens"), "grouped_opens", F.coalesce(F.round(F.try_divide("naive_opens", "grouped_opens"), 6), F.lit(0.0)).alias("reduction")
    )


def smallest(groups: DataFrame) -> DataFrame:
    """The group with the fewest frames; of equal ones the first."""
    return groups.where("to_index is not null").orderBy(F.col("to_index") - F.col("from_index"), "group_id").limit(1)


def window_counts(windows: DataFrame, times: DataFrame, group: str, ident: str, bucket: float = BUCKET) -> DataFrame:
    """How many times t of a group lie in each of its windows [lo, hi); windows without any are kept with 0.

    Joined on the group and a time bucket, so that a large group is many tasks; a window is there once per bucket it touches."""
    w = windows.select(ident, group, "lo", "hi")
    touched = w.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    t = times.select(group, "t", F.floor(F.col("t") / bucket).alias("_b"))
    hit = touched.join(t, [group, "_b"]).where("t >= lo and t < hi").groupBy(ident).agg(F.count("*").alias("n"))
    return w.select(ident).join(hit, ident, "left").select(ident, F.coalesce("n", F.lit(0)).alias("n_found"))


def verified(counts: DataFrame, expected: DataFrame, ident: str) -> DataFrame:
    """counts beside the expected `length`: OK or MISMATCH."""
    return counts.join(expected.select(ident, "length"), ident).withColumn("status", F.when(F.col("n_found") == F.col("length"), "OK").otherwise("MISMATCH"))


def episode_offsets(lengths: DataFrame, fps: float) -> DataFrame:
    """Frames in all earlier episodes, and their time in ns: an episode's offset in a log of the whole data set."""
    told = running(lengths.select("episode_index", "length"), [], ["episode_index"], {"prior_frames": F.col("length")}, F.floor(F.col("episode_index") / SHARD))
    return told.select("episode_index", "prior_frames", F.bround(F.col("prior_frames") / F.lit(float(fps)) * 1e9, 0).cast("long").alias("offset_ns"))


# Over the test tables.

FILE = f"videos/{CAMERA}/file_index"
FROM = f"videos/{CAMERA}/from_timestamp"


def index_now(spark: SparkSession, folder: str) -> DataFrame:
    return current(table(spark, folder, "episode_meta"), "episode_index", "length", "dataset_from_index", "dataset_to_index", FILE, FROM).drop("first_at")


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return file_groups(index_now(spark, folder), [FILE], on_hole="count")


def q_opens(spark, folder):
    return open_counts(groups(spark, folder))


def q_smallest(spark, folder):
    return smallest(groups(spark, folder)).select("group_id", "from_index", "to_index", "n_episodes")


def q_windows(spark, folder):
    """Windows end `length` periods after they begin, by the episode's fps; frames lie at the window's begin plus their timestamp."""
    index = index_now(spark, folder).select("episode_index", "length", quoted(FILE).alias("file"), quoted(FROM).alias("from"))
    frames = clocked(spark, folder).select("episode_index", "timestamp", "fps")
    rate = frames.groupBy("episode_index").agg(F.max("fps").alias("fps"))
    usable = index.join(rate, "episode_index").where("file is not null and from is not null and length >= 0")
    windows = usable.select("episode_index", "file", F.col("from").alias("lo"), (F.col("from") + F.col("length") / F.col("fps")).alias("hi"))
    times = frames.join(usable.select("episode_index", "file", "from"), "episode_index").select("file", (F.col("from") + F.col("timestamp").cast("double")).alias("t"))
    return verified(window_counts(windows, times, "file", "episode_index"), index, "episode_index")


def q_paths(spark, folder):
    index = index_now(spark, folder).where(quoted(FILE).isNotNull())
    return index.select("episode_index", video_path(F.lit(CAMERA), F.lit(0), quoted(FILE)).alias("path"))


def q_offsets(spark, folder):
    return episode_offsets(index_now(spark, folder).where("length is not null"), 50.0)


META = f"""mx AS (
  SELECT episode_index, "length", dataset_from_index AS a, dataset_to_index AS z, "{FILE}" AS file, "{FROM}" AS frm FROM episode_meta WHERE episode_index IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY ingested_at DESC, "length" DESC NULLS LAST, dataset_from_index DESC NULLS LAST, dataset_to_index DESC NULLS LAST, "{FILE}" DESC NULLS LAST, "{FROM}" DESC NULLS LAST) = 1)"""
GROUPS = f"""{META}, l AS (SELECT *, lag(file) OVER w AS pf, lag(z) OVER w AS pz, row_number() OVER w AS rn FROM mx WINDOW w AS (ORDER BY episode_index)
), i AS (SELECT *, sum(CASE WHEN rn > 1 AND file IS DISTINCT FROM pf THEN 1 ELSE 0 END) OVER (ORDER BY episode_index) AS island FROM l
), gr AS (SELECT CAST(island AS BIGINT) AS group_id, min(a) AS from_index, max(z) AS to_index, count(*) AS n_episodes, CAST(sum(CASE WHEN rn > 1 AND file IS NOT DISTINCT FROM pf AND pz <> a THEN 1 ELSE 0 END) AS BIGINT) AS n_holes FROM i GROUP BY 1)"""

QUERIES = {
    "file_groups": (groups, f"WITH {GROUPS} SELECT * FROM gr"),
    "open_counts": (q_opens, f"WITH {GROUPS} SELECT CAST(sum(n_episodes) AS BIGINT) AS naive_opens, count(*) AS grouped_opens, round(sum(n_episodes)::DOUBLE / count(*), 6) AS reduction FROM gr"),
    "smallest_file_group": (q_smallest, f"WITH {GROUPS} SELECT group_id, from_index, to_index, n_episodes FROM gr WHERE to_index IS NOT NULL ORDER BY to_index - from_index NULLS FIRST, group_id LIMIT 1"),
    "window_frame_counts": (q_windows, f"""WITH {CLOCK}, {META}, us AS (SELECT mx.*, frm + "length"::DOUBLE / rate.fps AS hi FROM mx JOIN (SELECT episode_index, max(fps) AS fps FROM c GROUP BY 1) rate USING (episode_index) WHERE file IS NOT NULL AND frm IS NOT NULL AND "length" >= 0
), ti AS (SELECT us.file, us.frm + CAST(c.timestamp AS DOUBLE) AS t FROM c JOIN us USING (episode_index)
), n AS (SELECT us.episode_index, us."length", count(ti.t) AS n_found FROM us LEFT JOIN ti ON us.file = ti.file AND ti.t >= us.frm AND ti.t < us.hi GROUP BY 1, 2) SELECT *, CASE WHEN n_found = "length" THEN 'OK' ELSE 'MISMATCH' END AS status FROM n"""),
    "video_paths": (q_paths, f"""WITH {META} SELECT episode_index, printf('videos/{CAMERA}/chunk-%03d/file-%03d.mp4', 0, file) AS path FROM mx WHERE file IS NOT NULL"""),
    "episode_offsets": (q_offsets, f"""WITH {META}, p AS (SELECT episode_index, CAST(coalesce(sum("length") OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_frames FROM mx WHERE "length" IS NOT NULL) SELECT *, CAST(round_even(prior_frames / 50.0::DOUBLE * 1e9::DOUBLE, 0) AS BIGINT) AS offset_ns FROM p"""),
}
