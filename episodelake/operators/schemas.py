"""Differences between two schemas, and one path's schema as different readers give it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ROWS = "section string, key string, kind string, a string, b string"


def fields(t: T.DataType | None) -> dict[str, T.StructField]:
    """A struct's fields by name; none for anything else."""
    return {f.name: f for f in t.fields} if isinstance(t, T.StructType) else {}


def schema_diff(spark: SparkSession, a: T.StructType, b: T.StructType, sections: tuple[str, ...] = ("observation", "action"), compared: tuple[str, ...] = ("action",)) -> DataFrame:
    """Keys of each section that only one has, and keys of the `compared` sections whose types differ."""
    rows = []
    for s in sections:
        x, y = (fields(fields(t)[s].dataType) if s in fields(t) else {} for t in (a, b))
        rows += [(s, k, "only in a", x[k].dataType.simpleString(), None) for k in sorted(x.keys() - y.keys())]
        rows += [(s, k, "only in b", None, y[k].dataType.simpleString()) for k in sorted(y.keys() - x.keys())]
        if s in compared:
            rows += [(s, k, "mismatch", x[k].dataType.simpleString(), y[k].dataType.simpleString()) for k in sorted(x.keys() & y.keys()) if x[k].dataType != y[k].dataType]
    return spark.createDataFrame(rows, ROWS)


def leaf_dims(df: DataFrame, column: str) -> DataFrame:
    """The number of elements in all leaves of a struct or array column, by how many rows have it."""

    def size(t: T.DataType, c):
        if isinstance(t, T.StructType):
            out = F.lit(0)
            for f in t.fields:
                out = out + size(f.dataType, c.getField(f.name))
            return out
        return F.greatest(F.size(c), F.lit(0)) if isinstance(t, T.ArrayType) else F.lit(1)

    return df.groupBy(size(df.schema[column].dataType, F.col(f"`{column}`")).alias("dims")).agg(F.count("*").alias("n"))


def readers(spark: SparkSession, path: str) -> DataFrame:
    """Column types of a Parquet path as Spark, Arrow and pandas read them."""
    import pyarrow.parquet as pq

    by_spark = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    arrow = pq.read_schema(path)
    by_arrow = {f.name: str(f.type) for f in arrow}
    by_pandas = {n: str(t) for n, t in arrow.empty_table().to_pandas().dtypes.items()}
    return spark.createDataFrame([(n, by_spark.get(n), by_arrow.get(n), by_pandas.get(n)) for n in by_spark], "column string, spark string, arrow string, pandas string")


def q_dims(spark, folder):
    return leaf_dims(spark.read.parquet(f"{folder}/frames.parquet"), "action")


def q_diff(spark, folder):
    wrap = lambda n: T.StructType([T.StructField("columns", spark.read.parquet(f"{folder}/{n}.parquet").schema)])
    return schema_diff(spark, wrap("episodes"), wrap("episode_quality"), ("columns",), ("columns",))


QUERIES = {
    "action_dims": (q_dims, "SELECT CAST(greatest(coalesce(len(action), 0), 0) AS INT) AS dims, count(*) AS n FROM frames GROUP BY 1"),
    "schema_diff": (q_diff, None),
}
