"""Detectors of faulty episodes: gaps, duplicates, held frames, command following, swapped arms, coverage.

All look at rows beside one another through shards of an episode (carry), or at sums per episode; none needs an episode whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodelake.functions.arrays import close, distance, swapped
from episodelake.operators.carry import islands, previous, running
from episodelake.operators.warehouse import FRAMES, clocked, frame_shard, frames_once
from episodelake.sources import table

WIDTH = 14
MODALITIES = ("observation.state", "action")


def is_modality(name: str) -> bool:
    """Cameras, the state and the action; effort and keys are none."""
    return name.startswith("observation.images.") or name in MODALITIES


# Clock.


def dropped_frames(frames: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Where a step to the next reading, in storage order (`index`), is more than `tolerance` periods: the position of the
    reading before the gap within its episode, from 0."""
    shard = F.floor(F.col("index") / 4096)
    told = previous(frames, ["episode_index"], ["index"], {"before": F.col("timestamp")}, shard)
    told = running(told, ["episode_index"], ["index"], {}, shard, count="position")
    wide = (F.col("timestamp") - F.col("before")).cast("double") > tolerance / F.col("fps")
    return told.where(wide).select("episode_index", (F.col("position") - 1).alias("position"), (F.col("timestamp") - F.col("before")).cast("double").alias("gap_s"))


def duplicate_keys(frames: DataFrame) -> DataFrame:
    """frame_index values that an episode has more than once."""
    return frames.where("frame_index is not null").groupBy("episode_index", "frame_index").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_timestamps(frames: DataFrame) -> DataFrame:
    """The other sense of duplicate: readings less than 1e-6 s after the one before."""
    told = previous(frames, ["episode_index"], ["frame_index", "timestamp"], {"before": F.col("timestamp")}, frame_shard())
    return told.where(F.abs(F.col("timestamp") - F.col("before")) < 1e-6).groupBy("episode_index").agg(F.count("*").alias("n"))


# Held frames.


def held_runs(frames: DataFrame, column: str = "action", atol: float = 1e-4) -> DataFrame:
    """Every run of readings close to the one before: episode_index, start_frame, run_length, single ones and the last included."""
    told = frames.select("episode_index", "frame_index", "index", F.col(f"`{column}`").alias("_now"))
    runs = islands(told, ["episode_index"], ["frame_index", "index"], {"_before": F.col("_now")}, ~close("_now", "_before", atol), frame_shard())
    return runs.groupBy("episode_index", "island").agg(F.min("frame_index").alias("start_frame"), F.count("*").alias("run_length")).drop("island")


def long_runs(runs: DataFrame, max_run: int = 3) -> DataFrame:
    return runs.where(F.col("run_length") > max_run)


# Command following.


def following_error(frames: DataFrame) -> DataFrame:
    """Mean distance of the state of a frame from the action of the frame before, per episode; the last action has no state."""
    told = previous(frames, ["episode_index"], ["frame_index", "index"], {"before": F.col("action")}, frame_shard())
    error = distance("`observation.state`", "before")
    return told.withColumn("_e", error).where("_e is not null and not isnan(_e) and _e < double('infinity')").groupBy("episode_index").agg(F.avg("_e").alias("action_error"))


def z_flags(errors: DataFrame, threshold: float = 2.0, exact: bool = True) -> DataFrame:
    """errors with z (distance from the median in sample deviations) and whether it is over the threshold. Spread 0: no flag.

    The median over episodes is exact; exact=False takes a mergeable summary (rank error 1/10,000)."""
    middle = F.median("action_error") if exact else F.percentile_approx("action_error", 0.5, 10_000)
    stats = errors.agg(middle.alias("_median"), F.stddev_samp("action_error").alias("_std"))
    z = F.try_divide(F.col("action_error") - F.col("_median"), F.col("_std"))
    return errors.crossJoin(F.broadcast(stats)).withColumn("z", z).withColumn("flagged", F.coalesce((F.col("z") > threshold) & ~F.isnan("z"), F.lit(False))).drop("_median", "_std")


def joint_means(frames: DataFrame, column: str = "action") -> DataFrame:
    """Each episode's mean per joint, as an array: WIDTH averages in one aggregation, not WIDTH times the rows."""
    each = [F.avg(F.get(F.col(f"`{column}`"), F.lit(j)).cast("double")).alias(f"_{j}") for j in range(WIDTH)]
    return frames.groupBy("episode_index").agg(*each).select("episode_index", F.array(*(F.col(f"_{j}") for j in range(WIDTH))).alias("means"))


def arm_flips(means: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Episodes whose joints' means are nearer the data set's medians with the two arms exchanged: mse_as_is, mse_swapped, flipped."""
    typical = means.agg(*(F.median(F.get("means", F.lit(j))).alias(f"_{j}") for j in range(WIDTH))).select(F.array(*(F.col(f"_{j}") for j in range(WIDTH))).alias("typical"))
    mse = lambda a: F.pow(distance(a, F.col("typical")), F.lit(2.0)) / WIDTH
    both = means.crossJoin(F.broadcast(typical)).select("episode_index", mse(F.col("means")).alias("mse_as_is"), mse(swapped("means")).alias("mse_swapped"))
    return both.withColumn("flipped", F.col("mse_swapped") < F.col("mse_as_is") / ratio)


# Coverage.


def even_positions(n: Column, k: int) -> Column:
    """k positions evenly from 0 to n - 1, rounded down; 0 k times if there's one."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i.cast("long") * (n - 1) / F.lit(max(k - 1, 1))))


def coverage(frames: DataFrame, modalities: tuple[str, ...], samples: int = 10, mode: str = "flattened", least: float = 1e-6) -> DataFrame:
    """episode_index, modality, status of every episode and modality over evenly spaced frames: `present`, `degenerate` (a population
    variance under `least`) or `absent` (no values).

    mode="flattened" takes the variance of all values of all dimensions together, so a frozen vector of unequal elements is present;
    mode="per_dim" the greatest variance of a dimension. Sums are of differences from the episode's first sampled vector."""
    if mode not in ("flattened", "per_dim"):
        raise ValueError(mode)
    counts = frames.groupBy("episode_index").agg(F.count("*").alias("_n"))
    placed = running(frames.select("episode_index", "frame_index", "index", *(F.col(f"`{m}`").cast("array<double>").alias(m.replace(".", "_")) for m in modalities)), ["episode_index"], ["frame_index", "index"], {}, frame_shard(), count="_at")
    sampled = placed.join(counts, "episode_index").where(F.array_contains(even_positions(F.col("_n"), samples), F.col("_at")))
    parts = []
    for m in modalities:
        c = F.col(m.replace(".", "_"))
        dims = [F.get(c, F.lit(j)) for j in range(WIDTH)]
        if mode == "flattened":
            values = F.explode_outer(F.slice(c, 1, WIDTH))
            v = sampled.select("episode_index", values.alias("v")).groupBy("episode_index").agg(F.var_pop("v").alias("variance"))
        else:
            v = sampled.groupBy("episode_index").agg(F.greatest(*(F.var_pop(d) for d in dims)).alias("variance"))
        status = F.when(F.col("variance").isNull(), "absent").when(F.col("variance") < least, "degenerate").otherwise("present")
        parts.append(v.select("episode_index", F.lit(m).alias("modality"), status.alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def coverage_matrix(covered: DataFrame, modalities: tuple[str, ...]) -> DataFrame:
    """A column per modality."""
    return covered.groupBy("episode_index").pivot("modality", list(modalities)).agg(F.first("status"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    share = lambda s: F.round(F.avg((F.col("status") == s).cast("double")) * 100, 6)
    return covered.groupBy("modality").agg(share("present").alias("pct_present"), share("degenerate").alias("pct_degenerate"))


def coverage_fraction(covered: DataFrame) -> DataFrame:
    return covered.groupBy("episode_index").agg(F.avg((F.col("status") == "present").cast("double")).alias("coverage_fraction"))


def block_outliers(frames: DataFrame, k: float = 3.0, size: int = 256) -> DataFrame:
    """Outliers against their own batch of `size` rows (by `index`), with the population's deviation: the mistake that a statistic per
    batch makes, kept for comparison with the one over all rows."""
    block = F.floor(F.col("index") / size)
    stats = frames.groupBy(block.alias("block")).agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std"))
    return frames.withColumn("block", block).join(stats, "block").withColumn("block_outlier", F.col("v") > F.col("_mean") + k * F.col("_std")).drop("_mean", "_std")


def descriptors(frames: DataFrame) -> DataFrame:
    """A card per episode: frames, dimensions of its first frame, and success as its last frame's next.done."""
    at = F.struct("frame_index", "index")
    return frames.groupBy("episode_index").agg(
        F.count("*").alias("num_frames"),
        F.min_by(F.size(F.col("`observation.state`")), at).alias("state_dim"),
        F.min_by(F.size("action"), at).alias("action_dim"),
        F.max_by(F.col("`next.done`"), at).alias("success"),
    )


# Over the test tables.


def regular(spark: SparkSession, folder: str) -> DataFrame:
    f = frames_once(spark, folder).where("frame_index is not null")
    return f.where("size(action) = 14 and size(`observation.state`) = 14 and forall(action, x -> x is not null and abs(x) < 1000) and forall(`observation.state`, x -> x is not null and abs(x) < 1000)")


def q_dropped(spark, folder):
    return dropped_frames(clocked(spark, folder))


def q_duplicate_keys(spark, folder):
    return duplicate_keys(frames_once(spark, folder))


def q_duplicate_timestamps(spark, folder):
    return duplicate_timestamps(clocked(spark, folder))


def q_held(spark, folder):
    return held_runs(regular(spark, folder))


def q_long(spark, folder):
    return long_runs(held_runs(regular(spark, folder)))


def q_following(spark, folder):
    return z_flags(following_error(regular(spark, folder))).select("episode_index", F.round("action_error", 6).alias("action_error"), F.round("z", 4).alias("z"), "flagged")


def q_flips(spark, folder):
    return arm_flips(joint_means(regular(spark, folder))).select("episode_index", F.round("mse_as_is", 6).alias("mse_as_is"), F.round("mse_swapped", 6).alias("mse_swapped"), "flipped")


def q_coverage(spark, folder):
    return coverage(regular(spark, folder), MODALITIES)


def q_coverage_per_dim(spark, folder):
    return coverage(regular(spark, folder), MODALITIES, mode="per_dim")


def q_coverage_summary(spark, folder):
    return coverage_summary(coverage(regular(spark, folder), MODALITIES))


def q_matrix(spark, folder):
    return coverage_matrix(coverage(regular(spark, folder), MODALITIES), MODALITIES).withColumnsRenamed({"observation.state": "state", "action": "action"})


def q_block(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("index"), F.col("value").alias("v"))
    return block_outliers(e).select("index", "block", "block_outlier")


def q_cards(spark, folder):
    return descriptors(regular(spark, folder))


CLOCK = f"""{FRAMES}, c AS (
  SELECT f.episode_index, f.frame_index, f."index", f.timestamp, r.fps FROM f JOIN r USING (robot) WHERE f.timestamp >= 0 AND isfinite(f.timestamp) AND r.fps > 0)"""
REGULAR = f"""{FRAMES}, g AS (
  SELECT * FROM f WHERE frame_index IS NOT NULL AND len(action) = 14 AND len("observation.state") = 14
    AND len(list_filter(action, lambda x: abs(x) < 1000)) = 14 AND len(list_filter("observation.state", lambda x: abs(x) < 1000)) = 14
)"""
HELD = f"""{REGULAR}, h AS (
  SELECT *, lag(action) OVER (PARTITION BY episode_index ORDER BY frame_index, "index") AS before FROM g
), b AS (
  SELECT *, CASE WHEN before IS NOT NULL AND len(list_filter(list_zip(action, before), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) <= 1e-4::DOUBLE + 1e-5::DOUBLE * abs(CAST(p[2] AS DOUBLE)))) < 14 THEN 1 ELSE 0 END AS brk FROM h
), i AS (SELECT *, sum(brk) OVER (PARTITION BY episode_index ORDER BY frame_index, "index") AS island FROM b),
runs AS (SELECT episode_index, min(frame_index) AS start_frame, count(*) AS run_length FROM i GROUP BY episode_index, island)"""
FOLLOW = f"""{REGULAR}, h AS (
  SELECT episode_index, "observation.state" AS st, lag(action) OVER (PARTITION BY episode_index ORDER BY frame_index, "index") AS before FROM g
), er AS (
  SELECT episode_index, avg(sqrt(list_sum(list_transform(list_zip(st, before), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)))) AS action_error
  FROM h WHERE before IS NOT NULL GROUP BY 1
), zs AS (SELECT er.*, (action_error - m) / nullif(d, 0) AS z FROM er, (SELECT median(action_error) AS m, stddev_samp(action_error) AS d FROM er))"""
_means = ", ".join(f"avg(CAST(action[{j + 1}] AS DOUBLE)) AS a{j}" for j in range(WIDTH))
_medians = ", ".join(f"median(a{j}) AS m{j}" for j in range(WIDTH))
_as_is = " + ".join(f"(a{j} - m{j}) ** 2" for j in range(WIDTH))
_swapped = " + ".join(f"(a{(j + 7) % 14} - m{j}) ** 2" for j in range(WIDTH))
FLIP = f"""{REGULAR}, jm AS (SELECT episode_index, {_means} FROM g GROUP BY 1), md AS (SELECT {_medians} FROM jm),
fl AS (SELECT episode_index, ({_as_is}) / 14 AS mse_as_is, ({_swapped}) / 14 AS mse_swapped FROM jm, md)"""


def _coverage_sql(variance: str) -> str:
    return f"""{REGULAR}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index, "index") - 1 AS pos, count(*) OVER (PARTITION BY episode_index) AS n FROM g
), sampled AS (SELECT * FROM placed WHERE list_contains(list_transform(range(10), lambda i: i * (n - 1) // 9), pos)),
vals AS (SELECT episode_index, 'action' AS modality, action AS v FROM sampled UNION ALL SELECT episode_index, 'observation.state', "observation.state" FROM sampled),
{variance}, cov AS (SELECT episode_index, modality, CASE WHEN variance < 1e-6::DOUBLE THEN 'degenerate' ELSE 'present' END AS status FROM va)"""


COVERAGE = _coverage_sql("va AS (SELECT episode_index, modality, var_pop(CAST(x AS DOUBLE)) AS variance FROM (SELECT episode_index, modality, unnest(v) AS x FROM vals) GROUP BY 1, 2)")
PER_DIM = _coverage_sql("va AS (SELECT episode_index, modality, greatest(" + ", ".join(f"var_pop(CAST(v[{j + 1}] AS DOUBLE))" for j in range(WIDTH)) + ") AS variance FROM vals GROUP BY 1, 2)")

QUERIES = {
    "dropped_frames": (q_dropped, f"""WITH {CLOCK}, d AS (SELECT episode_index, row_number() OVER w - 2 AS "position", CAST(timestamp - lag(timestamp) OVER w AS DOUBLE) AS gap_s, fps FROM c WINDOW w AS (PARTITION BY episode_index ORDER BY "index")) SELECT episode_index, "position", gap_s FROM d WHERE gap_s > 1.5::DOUBLE / fps"""),
    "duplicate_frame_index": (q_duplicate_keys, f"WITH {FRAMES} SELECT episode_index, frame_index, count(*) AS n FROM f WHERE frame_index IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"),
    "duplicate_timestamp": (q_duplicate_timestamps, f"WITH {CLOCK}, d AS (SELECT episode_index, timestamp - lag(timestamp) OVER (PARTITION BY episode_index ORDER BY frame_index NULLS FIRST, timestamp) AS dt FROM c) SELECT episode_index, count(*) AS n FROM d WHERE CAST(abs(dt) AS DOUBLE) < 1e-6::DOUBLE GROUP BY 1"),
    "held_runs": (q_held, f"WITH {HELD} SELECT * FROM runs"),
    "held_runs_long": (q_long, f"WITH {HELD} SELECT * FROM runs WHERE run_length > 3"),
    "action_following_error": (q_following, f"WITH {FOLLOW} SELECT episode_index, round(action_error, 6) AS action_error, round(z, 4) + 0.0::DOUBLE AS z, coalesce(z > 2, false) AS flagged FROM zs"),
    "arm_flip": (q_flips, f"WITH {FLIP} SELECT episode_index, round(mse_as_is, 6) AS mse_as_is, round(mse_swapped, 6) AS mse_swapped, mse_swapped < mse_as_is / 2.0::DOUBLE AS flipped FROM fl"),
    "sensor_coverage": (q_coverage, f"WITH {COVERAGE} SELECT * FROM cov"),
    "sensor_coverage_per_dim": (q_coverage_per_dim, f"WITH {PER_DIM} SELECT * FROM cov"),
    "sensor_coverage_summary": (q_coverage_summary, f"WITH {COVERAGE} SELECT modality, round(avg(CAST(status = 'present' AS DOUBLE)) * 100, 6) AS pct_present, round(avg(CAST(status = 'degenerate' AS DOUBLE)) * 100, 6) AS pct_degenerate FROM cov GROUP BY 1"),
    "sensor_coverage_matrix": (q_matrix, f"WITH {COVERAGE} SELECT episode_index, max(status) FILTER (modality = 'observation.state') AS state, max(status) FILTER (modality = 'action') AS action FROM cov GROUP BY 1"),
    "naive_block_outlier": (q_block, """WITH b AS (SELECT event_id, event_id // 256 AS block, value FROM events), st AS (SELECT block, avg(value) AS a, stddev_pop(value) AS d FROM b GROUP BY 1) SELECT event_id AS "index", b.block, value > a + 3.0::DOUBLE * d AS block_outlier FROM b JOIN st USING (block)"""),
    "episode_cards": (q_cards, f"""WITH {REGULAR} SELECT episode_index, count(*) AS num_frames, CAST(min_by(len("observation.state"), frame_index * 1000000 + "index") AS INT) AS state_dim, CAST(min_by(len(action), frame_index * 1000000 + "index") AS INT) AS action_dim, (list("next.done" ORDER BY frame_index DESC, "index" DESC))[1] AS success FROM g GROUP BY 1"""),
}
