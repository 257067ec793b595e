"""Prefix scans over shard summaries, in two levels, so that no task sees more than a block of one key's summaries.

An ordered table is cut into shards (by time bucket or by range of the order key). Each shard is summarised on its own, the
summaries are scanned, and each shard then goes on by itself from what its predecessors carry into it. A window over the
rows of a whole key, or over a whole table, is never needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodelake.sources.tables import quoted

#: Summaries that one task scans at a time.
BLOCK = 1024


def prefix(summaries: DataFrame, keys: list[str], shard: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """summaries with, for each name of sums, the sum over all earlier shards of its key (0 for the first), and for each
    name of lasts the last non-null value of earlier shards (null if there's none).

    `shard` is a long that orders a key's shards; one row per key and shard. Nulls add nothing."""
    sums, lasts = sums or {}, lasts or {}
    own = summaries.withColumns({f"_{n}": c for n, c in (sums | lasts).items()}).withColumn("_block", F.floor(F.col(shard) / BLOCK))
    blocks = own.groupBy(*keys, "_block").agg(
        *(F.sum(f"_{n}").alias(f"_{n}") for n in sums),
        *(F.max_by(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), F.col(shard))).alias(f"_{n}") for n in lasts),
        F.lit(0).alias("_any"),
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *(F.sum(f"_{n}").over(before).alias(f"_of_{n}") for n in sums), *(F.last(f"_{n}", True).over(before).alias(f"_of_{n}") for n in lasts))
    inside = Window.partitionBy(*keys, "_block").orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"_in_{n}": F.sum(f"_{n}").over(inside) for n in sums} | {f"_in_{n}": F.last(f"_{n}", True).over(inside) for n in lasts})
    b = blocks.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col("_block").alias("_b"), *(f"_of_{n}" for n in (*sums, *lasts)))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return own.join(b, same, "left").select(
        *map(quoted, summaries.columns),
        *((F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_of_{n}", F.lit(0))).alias(n) for n in sums),
        *(F.coalesce(f"_in_{n}", f"_of_{n}").alias(n) for n in lasts),
    )


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], shard: Column, count: str | None = None) -> DataFrame:
    """df with, for each name of sums, the sum over all earlier rows of its key, and in `count` how many those are.

    `shard` puts rows into shards that follow the order: no row of a lower shard comes after one of a higher. Rows with the
    same order are taken as they come, so `order` should be unique within keys."""
    cut = df.withColumn("_shard", shard.cast("long"))
    ones = {count: F.lit(1).cast("long")} if count else {}
    sums = sums | ones
    by_shard = cut.groupBy(*keys, "_shard").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    carried = prefix(by_shard, keys, "_shard", sums={f"_c_{n}": F.col(f"_s_{n}") for n in sums})
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    c = carried.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_shard").alias("_ks"), *(f"_c_{n}" for n in sums))
    same = F.col("_shard").eqNullSafe(F.col("_ks"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cut.join(c, same, "left").select(*map(quoted, df.columns), *((F.col(f"_c_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums))


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], shard: Column) -> DataFrame:
    """df with, for each name of values, its value in the row before (null in a key's first row), and `has_previous`.

    `shard` puts a key's rows into shards that follow the order. Inside a shard it's a lag; a shard's first row gets what the
    prefix scan carries in. Ties of `order` are taken as they come."""
    own = df.withColumn("_shard", shard.cast("long"))
    inside = Window.partitionBy(*keys, "_shard").orderBy(*order)
    packed = F.struct(*(c.alias(n) for n, c in values.items()))
    own = own.withColumn("_packed", packed).withColumn("_lag", F.lag("_packed").over(inside)).withColumn("_n", F.row_number().over(inside))
    last = own.groupBy(*keys, "_shard").agg(F.max_by("_packed", F.col("_n")).alias("_last"))
    carried = prefix(last, keys, "_shard", lasts={"_before": F.col("_last")})
    c = carried.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_shard").alias("_ks"), "_before")
    same = F.col("_shard").eqNullSafe(F.col("_ks"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = own.join(c, same, "left").withColumn("_prev", F.coalesce("_lag", "_before"))
    return joined.select(*map(quoted, df.columns), *(F.col("_prev").getField(n).alias(n) for n in values), F.col("_prev").isNotNull().alias("has_previous"))


def islands(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], breaks: Column, shard: Column) -> DataFrame:
    """df with `island`: how many rows of its key up to and with it `breaks` off from the row before. In `breaks` the names
    of values are the previous row's; a key's first row never breaks off."""
    told = previous(df, keys, order, values, shard)
    flag = F.when(F.col("has_previous") & breaks, 1).otherwise(0)
    told = told.withColumn("_break", flag).drop(*values, "has_previous")
    before = running(told, keys, order, {"_before": F.col("_break")}, shard)
    return before.withColumn("island", F.col("_before") + F.col("_break")).drop("_before", "_break")
