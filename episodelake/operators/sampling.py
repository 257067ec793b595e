"""Samples, shards and sets of episodes. Order by hash is that of md5(seed:id), so any engine gives the same sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodelake.operators import detectors, warehouse
from episodelake.operators.carry import running
from episodelake.sources import table


def place(ident: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))


def tiered_sample(everyone: DataFrame, suspects: DataFrame, ident: str = "episode_index", k: int = 10, seed: int = 0) -> DataFrame:
    """k ids for the dear check: suspects first, by id, then others in seeded order. Top-k, no full sort."""
    tagged = everyone.select(ident).distinct().join(suspects.select(ident).distinct().withColumn("_s", F.lit(True)), ident, "left")
    rank = [F.col("_s").isNull(), F.when(F.col("_s"), F.col(ident)), place(ident, seed), ident]
    return tagged.orderBy(*rank).limit(k).select(ident, F.coalesce("_s", F.lit(False)).alias("suspect"))


def never_checked(everyone: DataFrame, checked: DataFrame, ident: str = "episode_index") -> DataFrame:
    return everyone.select(ident).distinct().join(checked.select(ident), ident, "left_anti")


def tier_summary(everyone: DataFrame, suspects: DataFrame, checked: DataFrame, ident: str = "episode_index") -> DataFrame:
    """Shares (in %) that passed the cheap check and that had the dear one, and the verdict. 0 % of nobody."""
    j = everyone.select(ident).distinct().join(suspects.select(ident).distinct().withColumn("_s", F.lit(1)), ident, "left").join(checked.select(ident).distinct().withColumn("_c", F.lit(1)), ident, "left")
    pct = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c) * 100.0, F.count("*")), 6), F.lit(0.0))
    return j.agg(F.count("*").alias("n"), pct(F.col("_s").isNull()).alias("tabular_pct"), pct(F.col("_c").isNotNull()).alias("visual_pct"), F.when(F.count_if(F.col("_s").isNotNull()) > 0, "FAIL").otherwise("PASS").alias("verdict"))


def equal_shards(df: DataFrame, k: int, order: str, shard: Column) -> DataFrame:
    """df with `shard`: k shards of equal size by turns; the rows that remain at the end are dropped."""
    placed = running(df, [], [order], {}, shard, count="_at")
    total = placed.agg(F.count("*").alias("_n"))
    return placed.crossJoin(F.broadcast(total)).where(F.col("_at") < F.floor(F.col("_n") / k) * k).withColumn("shard", F.col("_at") % k).drop("_at", "_n")


def shuffled(df: DataFrame, ident: str, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Rows in seeded random order: partitioned by the order's hash and sorted within, no sort of the whole."""
    key = F.xxhash64(F.lit(seed), F.col(ident))
    return (df.repartition(parts, key) if parts else df.repartition(key)).sortWithinPartitions(key, ident)


def episode_range(spec: str | None, total: int) -> list[int]:
    """`all`, `a-b` (both ends in), `a,b,c` or one number; clamped to what there is. Raises ValueError where nothing remains."""
    if not spec or spec == "all":
        out = list(range(total))
    elif "-" in spec:
        a, b = (int(x) for x in spec.split("-", 1))
        out = list(range(max(a, 0), min(b, total - 1) + 1))
    else:
        out = [i for i in (int(x) for x in spec.split(",")) if 0 <= i < total]
    if not out:
        raise ValueError(f"no episodes in {spec!r}")
    return out


def suspect_sets(a: DataFrame, b: DataFrame, ident: str = "episode_index") -> DataFrame:
    """Each id of either list, once, with the set it is in: both, or only one."""
    x = a.select(ident).distinct().withColumn("_a", F.lit(1)).join(b.select(ident).distinct().withColumn("_b", F.lit(1)), ident, "full")
    return x.select(ident, F.when(F.col("_a").isNull(), "second only").when(F.col("_b").isNull(), "first only").otherwise("both").alias("in_set"))


# Over the test tables.


def everyone(spark, folder):
    return table(spark, folder, "frames").where("episode_index is not null").select("episode_index").distinct()


def clock_suspects(spark, folder):
    return warehouse.build_sync(warehouse.clocked(spark, folder)).where("n_dropped > 0 or n_duplicates > 0")


def error_suspects(spark, folder):
    return detectors.z_flags(detectors.following_error(detectors.regular(spark, folder))).where("flagged")


def q_sample(spark, folder):
    return tiered_sample(everyone(spark, folder), error_suspects(spark, folder), k=20)


def q_never(spark, folder):
    return never_checked(everyone(spark, folder), q_sample(spark, folder))


def q_tiers(spark, folder):
    return tier_summary(everyone(spark, folder), error_suspects(spark, folder), q_sample(spark, folder))


def q_shards(spark, folder):
    return equal_shards(table(spark, folder, "part").select("p_partkey"), 7, "p_partkey", F.floor(F.col("p_partkey") / 4096))


def q_sets(spark, folder):
    return suspect_sets(clock_suspects(spark, folder), error_suspects(spark, folder))


def q_positions(spark, folder):
    n = table(spark, folder, "frames").where("episode_index is not null").groupBy("episode_index").agg(F.count("*").alias("n"))
    return n.select("episode_index", F.posexplode(detectors.even_positions(F.col("n"), 10)).alias("i", "position"))


SAMPLE = f"""{detectors.FOLLOW}, fs AS (SELECT episode_index FROM zs WHERE coalesce(z > 2, false)), ev AS (SELECT DISTINCT episode_index FROM f),
tg AS (SELECT ev.episode_index, fs.episode_index IS NOT NULL AS suspect FROM ev LEFT JOIN fs USING (episode_index)),
sm AS (SELECT * FROM tg ORDER BY NOT suspect, CASE WHEN suspect THEN episode_index END NULLS FIRST, md5('0:' || episode_index), episode_index LIMIT 20)"""
QUERIES = {
    "tiered_sample": (q_sample, f"WITH {SAMPLE} SELECT * FROM sm"),
    "never_checked": (q_never, f"WITH {SAMPLE} SELECT episode_index FROM ev WHERE episode_index NOT IN (SELECT episode_index FROM sm)"),
    "tier_summary": (q_tiers, f"WITH {SAMPLE} SELECT count(*) AS n, round(count_if(NOT suspect) * 100.0::DOUBLE / count(*), 6) AS tabular_pct, round((SELECT count(*) FROM sm) * 100.0::DOUBLE / count(*), 6) AS visual_pct, CASE WHEN count_if(suspect) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM tg"),
    "shards": (q_shards, "SELECT p_partkey, rn % 7 AS shard FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part) WHERE rn < n // 7 * 7"),
    "suspect_sets": (q_sets, f"WITH {detectors.FOLLOW}, {warehouse.SYNC[len(warehouse.FRAMES) + 2:]}, xa AS (SELECT episode_index FROM sync_now WHERE n_dropped > 0 OR n_duplicates > 0), xb AS (SELECT episode_index FROM zs WHERE coalesce(z > 2, false)) SELECT coalesce(xa.episode_index, xb.episode_index) AS episode_index, CASE WHEN xa.episode_index IS NULL THEN 'second only' WHEN xb.episode_index IS NULL THEN 'first only' ELSE 'both' END AS in_set FROM xa FULL JOIN xb ON xa.episode_index = xb.episode_index"),
    "sample_positions": (q_positions, "SELECT episode_index, i, i * (n - 1) // 9 AS \"position\" FROM (SELECT episode_index, count(*) AS n FROM frames WHERE episode_index IS NOT NULL GROUP BY 1), (SELECT CAST(unnest(range(10)) AS INT) AS i)"),
}
