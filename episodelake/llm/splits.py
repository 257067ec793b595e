"""Splits that keep related records together (problem 5).

Tasks that share an episode, and episodes that share a task, are one component. Links go from each episode's least task to its
other tasks (a star, not all pairs), distinct, after a count per (episode, task) has brought frames down to few rows.
Components are found by hooking larger roots on smaller and pointer jumping, until nothing changes; what is known from an
earlier run is a table on disk of members and of each component's split, and a run works on the new links between
those components only.

A component that has a split keeps it. New components are given out so that every split comes as near as may be to
its share of all rows: components of more than 1/LARGE of all rows one by one, the others by BUCKETS hash buckets, each
in turn to the split that lacks most; both lists are bounded whatever the data. New links between components of different
splits can't be kept without moving one of them: those merges are quarantined, that is, both components stay as they are, new
members and the episodes across them are marked `quarantine`, and the quarantine table lists them.

Defined cases: tasks null and -1 join nothing; episodes without a task are components of their own; rows without an episode go
with their task, rows without either are one component; empty tables give no rows and leave the state as it was; copies count
as rows; extra columns play no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from episodelake.sources import table
from episodelake.sources.tables import cut

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
LARGE, BUCKETS = 1000, 4096
QUARANTINE = "quarantine"


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of `edges` (a, b). Rounds until nothing changes, each checkpointed."""
    edges = cut(edges.where("a <> b").distinct())
    labels = cut(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct().withColumn("component", F.col("node")))
    while True:
        la = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        lb = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        apart = edges.join(la, "a").join(lb, "b").where("ca <> cb")
        hooks = cut(apart.groupBy(F.greatest("ca", "cb").alias("root")).agg(F.min(F.least("ca", "cb")).alias("to")))
        if hooks.isEmpty():
            return labels
        while True:  # pointer jumping: every root's path is halved
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            jumped = cut(hooks.join(up, "to", "left").select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            hooks = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = cut(labels.join(hooks.withColumnRenamed("root", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def units(frames: DataFrame) -> DataFrame:
    """episode_index, task_index (null if none), n rows, low: the node of the pair's episode, itself a task's if it has any."""
    task = F.when(F.col("task_index") != -1, F.col("task_index"))
    pairs = frames.groupBy("episode_index", task.alias("task_index")).agg(F.count("*").alias("n"))
    least = F.when(F.col("episode_index").isNull(), F.col("task_index")).otherwise(F.min("task_index").over(Window.partitionBy("episode_index")))
    low = F.coalesce(named("task", least), named("episode", F.col("episode_index")), F.lit("row"))
    return pairs.withColumn("low", low)


def named(kind: str, column: Column) -> Column:
    """A node's name; names of a kind sort as their numbers."""
    return F.when(column.isNotNull(), F.format_string(f"{kind}:%020d", column.cast("long")))


def task_links(pairs: DataFrame) -> DataFrame:
    return pairs.where("task_index is not null").select(F.col("low").alias("a"), named("task", F.col("task_index")).alias("b")).where("a <> b").distinct()


class State:
    """Members and components of earlier runs, in any folder that all executors reach. Each update writes a new version whole;
    an update that fails leaves the last one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        self.version = max((int(p.getName()[2:]) for p in done if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "splits/_SUCCESS"))), default=0)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v={self.version}/{name}") if self.version else self.spark.createDataFrame([], schema)

    def write(self, members: DataFrame, quarantined: DataFrame, splits: DataFrame) -> None:
        at = f"{self.folder}/v={self.version + 1}"
        for name, df in (("members", members), ("quarantine", quarantined), ("splits", splits)):  # splits last: it makes the version valid
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        self.version += 1


MEMBERS, SPLITS, QUARANTINED = "node string, component string", "component string, split string, n long", "merged string, component string, split string"


def given_out(parts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """component, split, n for `parts` (component, split or null, n)."""
    spark = parts.sparkSession
    have = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # a row per split
    total = sum(have.values())
    new = parts.where("split is null").drop("split").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)))
    large = F.col("n") * LARGE > total
    lots = [(r["n"], r["component"], None) for r in new.where(large).collect()]  # fewer than LARGE
    lots += [(r["n"], None, r["bucket"]) for r in new.where(~large).groupBy("bucket").agg(F.sum("n").alias("n")).collect()]  # at most BUCKETS
    lack = {s: share / sum(shares.values()) * total - have.get(s, 0) for s, share in shares.items()}
    chosen = []
    for n, component, bucket in sorted(lots, key=lambda x: (-x[0], x[1] or "", x[2] or 0)):
        split = max(lack, key=lambda s: (lack[s], s))
        lack[split] -= n
        chosen.append((component, bucket, split))
    table_ = spark.createDataFrame(chosen, "component string, bucket long, split string") if chosen else spark.createDataFrame([], "component string, bucket long, split string")
    one = new.where(large).join(F.broadcast(table_.where("component is not null").select("component", "split")), "component")
    rest = new.where(~large).join(F.broadcast(table_.where("component is null").select("bucket", "split")), "bucket")
    cols = ("component", "split", "n")
    return parts.where("split is not null").select(*cols).unionAll(one.select(*cols)).unionAll(rest.select(*cols))


def update(frames: DataFrame, state: str | None = None, shares: dict[str, float] = SHARES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (node, component), splits (component, split, n) and quarantine (merged, component, split) after `frames`.

    With `state` (a folder), frames are new records beside those of earlier runs, and the result is kept there. A component's n
    counts the rows of all runs."""
    spark = frames.sparkSession
    kept = State(spark, state) if state else None
    old = kept.read("members", MEMBERS) if kept else spark.createDataFrame([], MEMBERS)
    old_splits = kept.read("splits", SPLITS) if kept else spark.createDataFrame([], SPLITS)
    old_quarantine = kept.read("quarantine", QUARANTINED) if kept else spark.createDataFrame([], QUARANTINED)
    pairs = cut(units(frames))
    nodes = pairs.groupBy(F.col("low").alias("node")).agg(F.sum("n").alias("n"))
    links = task_links(pairs)
    # The graph of old components and new nodes: a node that is known stands for its component.
    known = old.withColumnRenamed("component", "was")
    through = lambda df, c: df.join(known.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("was", c)).drop("was")
    found_ = components(through(through(links, "a"), "b"))
    fresh = nodes.select("node").unionAll(links.select("b")).distinct().join(old, "node", "left_anti")
    stand = fresh.join(found_.withColumnRenamed("component", "merged"), "node", "left").select("node", F.coalesce("merged", "node").alias("merged"))
    touched = old_splits.join(found_.toDF("component", "merged"), "component", "left")
    touched = cut(touched.withColumn("merged", F.coalesce("merged", "component")))
    of = touched.groupBy("merged").agg(F.count_distinct("split").alias("kinds"), F.max("split").alias("split"), F.sum("n").alias("n"))
    conflict = of.where("kinds > 1").select("merged")
    quarantined = old_quarantine.unionAll(touched.join(conflict, "merged", "left_semi").select("merged", "component", "split")).distinct()
    # Old members: those of components that merge without conflict get the merged name, others keep theirs.
    to = touched.join(conflict, "merged", "left_anti").select("component", "merged")
    members = old.join(to, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    bad = stand.join(conflict, "merged", "left_semi").select("node", F.concat(F.lit(f"{QUARANTINE}:"), "merged").alias("component"))
    members = cut(members.unionAll(stand.join(conflict, "merged", "left_anti").select("node", F.col("merged").alias("component"))).unionAll(bad))
    rows = nodes.join(members, "node").groupBy("component").agg(F.sum("n").alias("more"))
    before = touched.join(conflict, "merged", "left_anti").groupBy(F.col("merged").alias("component")).agg(F.max("split").alias("split"), F.sum("n").alias("n"))
    before = before.unionAll(touched.join(conflict, "merged", "left_semi").select("component", "split", "n"))
    known_now = members.select("component").distinct().join(before, "component", "left").join(rows, "component", "left")
    kept_split = F.when(F.col("component").startswith(f"{QUARANTINE}:"), F.lit(QUARANTINE)).otherwise(F.col("split"))
    parts = cut(known_now.select("component", kept_split.alias("split"), (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n")))
    splits = cut(given_out(parts, shares))
    if kept and not pairs.isEmpty():
        kept.write(members, quarantined, splits)
    return members, splits, quarantined


def assigned(frames: DataFrame, members: DataFrame, splits: DataFrame) -> DataFrame:
    """frames with `split`: its episode's, which is that of all its tasks; an episode across two splits is quarantined."""
    pairs = units(frames.select("episode_index", "task_index"))
    by_node = members.join(splits, "component").select("node", "split")
    told = pairs.select("episode_index", "task_index", F.coalesce(named("task", F.col("task_index")), "low").alias("node")).join(by_node, "node")
    episodes = told.where("episode_index is not null").groupBy("episode_index").agg(F.when(F.min("split") == F.max("split"), F.min("split")).otherwise(F.lit(QUARANTINE)).alias("split"))
    alone = told.where("episode_index is null").select(F.coalesce("task_index", F.lit(-1)).alias("_task"), "split").distinct()
    whole = frames.where("episode_index is not null").join(episodes, "episode_index")
    lone = frames.where("episode_index is null").withColumn("_task", F.coalesce("task_index", F.lit(-1))).join(alone, "_task").drop("_task")
    return whole.unionByName(lone)


def frame_split(spark: SparkSession, folder: str) -> DataFrame:
    """p5_split: every frame's split."""
    frames = table(spark, folder, "frames").select("index", "episode_index", "frame_index", "task_index")
    members, splits, _ = update(frames)
    return assigned(frames, members, splits)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found: pairs of tasks in one component, made from the members only here."""
    frames = table(spark, folder, "frames").select("episode_index", "task_index")
    members = components(task_links(units(frames)))
    tasks = members.select(F.substring_index("node", ":", -1).cast("long").alias("task"), "component")
    other = tasks.withColumnRenamed("task", "task_b")
    return tasks.withColumnRenamed("task", "task_a").join(other, "component").where("task_a < task_b").select("task_a", "task_b")


FOUND_SQL = """
WITH RECURSIVE told AS (
  SELECT DISTINCT episode_index, task_index FROM frames
  WHERE episode_index IS NOT NULL AND task_index IS NOT NULL AND task_index <> -1
), near AS (
  SELECT DISTINCT a.task_index AS x, b.task_index AS y FROM told a JOIN told b USING (episode_index)
), reach AS (
  SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x
)
SELECT x AS task_a, y AS task_b FROM reach WHERE x < y
"""
