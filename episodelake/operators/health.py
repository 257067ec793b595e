"""Health of episodes: independent checks joined, scored and gated.

Scorers are functions from a table of checks (episode_id, schema_ok, sensor_coverage, sync_ok, action_error) to the same with
`raw` and `decision`; health_table applies any of them. Scores are rounded (half to even, 4 places) after the decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodelake.operators import detectors, warehouse

WEIGHT, FAR, PASS_AT = 0.25, 0.15, 0.8


def following() -> Column:
    """1 for no error, 0 from FAR on; 0 for NaN; null if there's none."""
    e = F.col("action_error")
    share = F.when(F.isnan(e), F.lit(1.0)).otherwise(F.least(e / FAR, F.lit(1.0)))
    return F.when(e.isNotNull(), F.greatest(F.lit(0.0), 1 - share))


def ok(c: str) -> Column:
    return F.when(F.col(c), F.lit(1.0)).otherwise(F.lit(0.0))


def naive(checks: DataFrame) -> DataFrame:
    """Every component weighs the same, a missing one is 0."""
    raw = WEIGHT * ok("schema_ok") + WEIGHT * F.col("sensor_coverage") + WEIGHT * ok("sync_ok") + WEIGHT * F.coalesce(following(), F.lit(0.0))
    decision = F.when(~F.col("schema_ok"), "excluded").when(raw < PASS_AT, "flagged").otherwise("included")
    return checks.withColumn("raw", raw).withColumn("decision", decision)


def gated(checks: DataFrame) -> DataFrame:
    """A bad schema excludes; a missing action error is left out of the weights and leaves too little data to decide."""
    rest = WEIGHT + WEIGHT * F.col("sensor_coverage") + WEIGHT * ok("sync_ok")
    raw = F.when(~F.col("schema_ok"), F.lit(0.0)).when(F.col("action_error").isNull(), rest / (3 * WEIGHT)).otherwise(rest + WEIGHT * following())
    decision = (
        F.when(~F.col("schema_ok"), "excluded")
        .when(F.col("action_error").isNull(), "insufficient_data")
        .when(~F.col("sync_ok") | (F.col("sensor_coverage") < 1) | (raw < PASS_AT), "flagged")
        .otherwise("included")
    )
    return checks.withColumn("raw", raw).withColumn("decision", decision)


def health_table(checks: DataFrame, scorer: Callable[[DataFrame], DataFrame] = gated) -> DataFrame:
    return scorer(checks).withColumn("score", F.bround("raw", 4)).drop("raw")


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many were checked, the mean score of those not excluded, and how many have each issue."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    outlier = (F.col("decision") == "flagged") & F.col("action_error").isNotNull() & (F.col("score") < PASS_AT) & F.col("sync_ok") & (F.col("sensor_coverage") >= 1)
    return rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(F.col("decision") != "excluded", F.col("score"))), F.lit(0.0)).alias("mean_score"),
        count(~F.col("schema_ok")).alias("schema_failures"),
        count(F.col("sensor_coverage") < 1).alias("degenerate_coverage"),
        count(~F.col("sync_ok")).alias("sync_failures"),
        count(outlier).alias("action_outliers"),
        count(F.col("decision") == "insufficient_data").alias("insufficient_data"),
        count(F.col("decision").isin("flagged", "excluded")).alias("flagged_or_excluded"),
    )


def worst(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest scores of episodes not excluded; of equal ones the lower id."""
    return rows.where("decision <> 'excluded'").orderBy("score", "episode_id").limit(k)


def ci_gate(counted: DataFrame, most: float = 0.15) -> int:
    """Exit code: 1 if more than `most` of the episodes are flagged or excluded. No episodes pass."""
    r = counted.first()
    return int(bool(r["n"]) and r["flagged_or_excluded"] / r["n"] > most)


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """The independent checks of every episode of frames; what a check has nothing on takes its default."""
    f = detectors.regular(spark, folder)
    everyone = warehouse.frames_once(spark, folder).groupBy("episode_index").agg((F.min(F.size("action")) == 14).alias("a"), (F.max(F.size("action")) == 14).alias("b"))
    schema = everyone.select("episode_index", F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("schema_ok"))
    covered = detectors.coverage_fraction(detectors.coverage(f, detectors.MODALITIES))
    sync = warehouse.build_sync(warehouse.clocked(spark, folder)).select("episode_index", (~F.col("sync_error_flag")).alias("sync_ok"))
    errors = detectors.following_error(f)
    joined = schema.join(covered, "episode_index", "left").join(sync, "episode_index", "left").join(errors, "episode_index", "left")
    return joined.select(F.col("episode_index").alias("episode_id"), "schema_ok", F.coalesce("coverage_fraction", F.lit(0.0)).alias("sensor_coverage"), F.coalesce("sync_ok", F.lit(False)).alias("sync_ok"), F.round("action_error", 9).alias("action_error"))


def q_gated(spark, folder):
    return health_table(checks(spark, folder))


def q_naive(spark, folder):
    return health_table(checks(spark, folder), naive)


def q_summary(spark, folder):
    return summary(q_gated(spark, folder)).withColumn("mean_score", F.round("mean_score", 6))


def q_worst(spark, folder):
    return worst(q_gated(spark, folder)).select("episode_id", "score", "decision")




def _checks_sql() -> str:
    base = detectors.COVERAGE + ", " + detectors.FOLLOW[len(detectors.REGULAR) + 2 :]
    clock = warehouse.SYNC[len(warehouse.FRAMES) + 2 :]
    return f"""{base}, {clock}, ck AS (
  SELECT sc.episode_index AS episode_id, schema_ok, coalesce(cf, 0.0::DOUBLE) AS sensor_coverage, coalesce(NOT sync_error_flag, false) AS sync_ok, round(action_error, 9) AS action_error
  FROM (SELECT episode_index, coalesce(min(coalesce(len(action), -1)) = 14 AND max(coalesce(len(action), -1)) = 14, false) AS schema_ok FROM f GROUP BY 1) sc
  LEFT JOIN (SELECT episode_index, avg(CAST(status = 'present' AS DOUBLE)) AS cf FROM cov GROUP BY 1) USING (episode_index)
  LEFT JOIN sync_now USING (episode_index) LEFT JOIN er USING (episode_index)
), co AS (SELECT *, 0.25::DOUBLE * CAST(sync_ok AS INT) AS sy, greatest(0.0::DOUBLE, 1 - least(action_error / 0.15::DOUBLE, 1.0::DOUBLE)) AS ac FROM ck),
ga AS (SELECT *, CASE WHEN NOT schema_ok THEN 0.0::DOUBLE WHEN action_error IS NULL THEN (0.25::DOUBLE + 0.25::DOUBLE * sensor_coverage + sy) / 0.75::DOUBLE ELSE 0.25::DOUBLE + 0.25::DOUBLE * sensor_coverage + sy + 0.25::DOUBLE * ac END AS raw FROM co),
gated AS (SELECT episode_id, schema_ok, sensor_coverage, sync_ok, action_error, CASE WHEN NOT schema_ok THEN 'excluded' WHEN action_error IS NULL THEN 'insufficient_data'
  WHEN NOT sync_ok OR sensor_coverage < 1 OR raw < 0.8::DOUBLE THEN 'flagged' ELSE 'included' END AS decision, round_even(raw, 4) AS score FROM ga),
na AS (SELECT *, 0.25::DOUBLE * CAST(schema_ok AS INT) + 0.25::DOUBLE * sensor_coverage + sy + 0.25::DOUBLE * CASE WHEN action_error IS NULL THEN 0.0::DOUBLE ELSE ac END AS raw FROM co),
naive AS (SELECT episode_id, schema_ok, sensor_coverage, sync_ok, action_error, CASE WHEN NOT schema_ok THEN 'excluded' WHEN raw < 0.8::DOUBLE THEN 'flagged' ELSE 'included' END AS decision, round_even(raw, 4) AS score FROM na)"""


CHECKS = _checks_sql()
QUERIES = {
    "health_gated": (q_gated, f"WITH {CHECKS} SELECT * FROM gated"),
    "health_naive": (q_naive, f"WITH {CHECKS} SELECT * FROM naive"),
    "health_summary": (q_summary, f"""WITH {CHECKS} SELECT count(*) AS n, round(coalesce(avg(score) FILTER (decision <> 'excluded'), 0.0::DOUBLE), 6) AS mean_score, count_if(NOT schema_ok) AS schema_failures,
  count_if(sensor_coverage < 1) AS degenerate_coverage, count_if(NOT sync_ok) AS sync_failures, count_if(decision = 'flagged' AND action_error IS NOT NULL AND score < 0.8::DOUBLE AND sync_ok AND sensor_coverage >= 1) AS action_outliers,
  count_if(decision = 'insufficient_data') AS insufficient_data, count_if(decision IN ('flagged', 'excluded')) AS flagged_or_excluded FROM gated"""),
    "health_worst": (q_worst, f"WITH {CHECKS} SELECT episode_id, score, decision FROM gated WHERE decision <> 'excluded' ORDER BY score, episode_id LIMIT 5"),
}
