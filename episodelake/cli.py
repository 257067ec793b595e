"""python -m episodelake.cli COMMAND: exit code 0 if all is well, 1 if a check failed, 2 if the input can't be used (nothing is written)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from episodelake import sinks
from episodelake.operators import detectors, health, logs, partitions, sampling, warehouse
from episodelake.sources.dataset import Dataset


def fps_frames(data: Dataset, *columns: str):
    return data.frames("episode_index", "frame_index", *columns).withColumn("fps", F.lit(int(data.info()["fps"])))


def run_warehouse(spark: SparkSession, a: argparse.Namespace) -> int:
    """episodes, sync, robots and, with flags, episode_quality; gated by the dataset's own index."""
    data = Dataset(spark, a.root)
    info = data.info()
    frames = fps_frames(data, "task_index", "timestamp")
    robot = F.lit(str(info.get("robot_type")))
    episodes = warehouse.keyed(warehouse.build_episodes(frames, F.col("fps")).drop("span_s").withColumn("robot", robot))
    try:
        warehouse.gate(warehouse.reconcile(episodes, data.index()))
    except warehouse.ReconcileError as x:
        print(x, file=sys.stderr)
        return x.exit_code
    sync = warehouse.keyed(warehouse.build_sync(frames, a.strict).withColumn("robot", robot))
    warehouse.write(episodes, a.out, "episodes")
    warehouse.write(sync, a.out, "sync")
    warehouse.write(warehouse.robots_row(spark, info), a.out, "robots")
    if a.flags:
        flags = warehouse.rollup_flags(spark.read.parquet(a.flags).select("episode_index", "action_magnitude", "action_magnitude_outlier"))
        warehouse.write(warehouse.build_quality(episodes, sync.drop("robot"), flags), a.out, "episode_quality")
    return 0


def run_flags(spark: SparkSession, a: argparse.Namespace) -> int:
    """Frames with their magnitude and whether it is an outlier."""
    flagged = warehouse.build_flags(Dataset(spark, a.root).frames("episode_index", "frame_index", "action"), a.k)
    warehouse.write(flagged.drop("action"), a.out, "frame_flags", partition=False)
    return 0


def run_sync(spark: SparkSession, a: argparse.Namespace) -> int:
    frames = fps_frames(Dataset(spark, a.root), "timestamp", "index")
    suspects = detectors.dropped_frames(frames, a.gap).select("episode_index").union(detectors.duplicate_keys(frames).select("episode_index"))
    checked = sampling.tiered_sample(frames, suspects, k=a.sample, seed=a.seed)
    s = sampling.tier_summary(frames, suspects, checked).first()
    print(f"{s['n']} episodes, {s['tabular_pct']:.1f} % pass, {s['visual_pct']:.1f} % to be looked at: {s['verdict']}")
    if a.json:
        sinks.lines(checked, a.json)
    return int(s["verdict"] == "FAIL")


def run_trajectory(spark: SparkSession, a: argparse.Namespace) -> int:
    frames = Dataset(spark, a.root).frames("episode_index", "frame_index", "index", "observation.state", "action")
    far = detectors.z_flags(detectors.following_error(frames), a.z).where("flagged")
    flipped = detectors.arm_flips(detectors.joint_means(frames)).where("flipped")
    bad = far.select("episode_index").union(flipped.select("episode_index")).distinct().count()
    print(f"{bad} episodes with far actions or exchanged arms")
    return int(bad > 0)


def run_health(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = health.health_table(health.checks(spark, a.root), health.naive if a.naive else health.gated).persist()
    print(sinks.markdown(rows, a.root, "all"))
    return health.ci_gate(health.summary(rows), a.most)


def run_coverage(spark: SparkSession, a: argparse.Namespace) -> int:
    frames = Dataset(spark, a.root).frames()
    names = tuple(c for c in frames.columns if c in detectors.MODALITIES)
    sinks.csv(detectors.coverage_matrix(detectors.coverage(frames, names, mode=a.mode), names), a.out)
    return 0


def run_inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    """A message log written by sinks.log: 2 if it has no messages, 1 if it has gaps or steps back."""
    log = spark.read.parquet(f"{a.root}/messages")
    if log.isEmpty():
        print("no messages", file=sys.stderr)
        return 2
    stats = logs.topic_stats(log, a.factor)
    print(sinks.gap_text(stats, logs.flagged(logs.gaps(log), stats)))
    return int(not stats.where("n_flagged > 0 or non_monotonic > 0").isEmpty())


def run_partitions(spark: SparkSession, a: argparse.Namespace) -> int:
    groups = partitions.file_groups(Dataset(spark, a.root).index(), partitions.key_columns(tuple(a.cameras)))
    r = partitions.open_counts(groups, len(a.cameras)).first()
    print(f"{r['naive_opens']} -> {r['grouped_opens']} files opened, {r['reduction']:.1f} x")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, f, *options: tuple) -> None:
        s = sub.add_parser(name, help=f.__doc__)
        s.add_argument("root")
        s.set_defaults(run=f)
        for flag, kw in options:
            s.add_argument(flag, **kw)

    out = ("--out", {"required": True})
    command("warehouse", run_warehouse, out, ("--flags", {}), ("--strict", {"action": "store_true"}))
    command("flags", run_flags, out, ("--k", {"type": float, "default": 3.0}))
    command("sync", run_sync, ("--gap", {"type": float, "default": 1.5}), ("--sample", {"type": int, "default": 10}), ("--seed", {"type": int, "default": 0}), ("--json", {}))
    command("trajectory", run_trajectory, ("--z", {"type": float, "default": 2.0}))
    command("health", run_health, ("--most", {"type": float, "default": 0.15}), ("--naive", {"action": "store_true"}))
    command("coverage", run_coverage, out, ("--mode", {"default": "flattened", "choices": ["flattened", "per_dim"]}))
    command("inspect", run_inspect, ("--factor", {"type": float, "default": 1.5}))
    command("partitions", run_partitions, ("--cameras", {"nargs": "+", "required": True}))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
