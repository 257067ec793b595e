"""Tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """A top-level column by its name, whatever dots or slashes that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(df: DataFrame, arrival: str = "ingested_at") -> DataFrame:
    """Rows that differ in nothing or only in `arrival` are one record, which came when its first copy did.

    One shuffle on all other columns; copies of a hot record collapse before it (partial aggregation)."""
    return df.groupBy([quoted(c) for c in df.columns if c != arrival]).agg(F.min(arrival).alias(arrival))


def current(df: DataFrame, key: str, *fields: str, arrival: str = "ingested_at") -> DataFrame:
    """Each key's latest row and when its first row came: key, first_at, fields.

    Of rows that came at the same time the one with the greatest fields (in their order, null least) is taken. Null keys go."""
    last = F.max(F.struct(arrival, *(quoted(f) for f in fields)))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(last.alias("last"), F.min(arrival).alias("first_at"))
        .select(key, "first_at", *(F.col("last").getField(f).alias(f) for f in fields))
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where a session has none (tests), its own under the warehouse.

    Also makes DataFrame.checkpoint() usable."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: its lineage ends there, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
