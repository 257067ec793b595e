"""Writing results: tables, reports, logs. Everything overwrites, so that a second run doesn't append copies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

#: What a log's codec is called, and by Parquet.
CODECS = {"zstd": "zstd", "lz4": "lz4_raw", "none": "uncompressed"}


def csv(df: DataFrame, path: str) -> None:
    """One file per partition, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def lines(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def log(messages: DataFrame, path: str, provenance: dict, compression: str = "zstd", rows_per_file: int = 0) -> None:
    """A message log by topic, sorted by time within files, with where it came from beside it."""
    writer = messages.repartition("topic", F.floor(F.col("log_time") / (3_600 * 10**9))).sortWithinPartitions("topic", "log_time").write.mode("overwrite").option("compression", CODECS[compression])
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("topic").parquet(f"{path}/messages")
    messages.sparkSession.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")


ISSUES = {
    "schema_failures": "episodes with a bad schema, excluded",
    "degenerate_coverage": "episodes with sensors missing or constant",
    "sync_failures": "episodes with clock faults",
    "action_outliers": "episodes whose state doesn't follow the commands",
    "insufficient_data": "episodes with too little data for a score",
}


def markdown(rows: DataFrame, title: str, span: str) -> str:
    """A health report: counts and means are made by Spark, only a few rows come to the driver. Issues by number, of equal ones as listed."""
    from episodelake.operators.health import summary, worst

    s = summary(rows).first()
    found = sorted(((s[k], text) for k, text in ISSUES.items() if s[k]), key=lambda x: -x[0])
    out = [f"# Health of {title}", "", f"{s['n']} episodes ({span}), mean score {s['mean_score']:.2f} of those not excluded.", "", "## Issues", ""]
    out += [f"* {n} {text}" for n, text in found] or ["None."]
    out += ["", "## Lowest scores", "", "| episode | score | decision |", "|-|-|-|"]
    out += [f"| {r['episode_id']} | {r['score']:.2f} | {r['decision']} |" for r in worst(rows).collect()]
    excluded = rows.where("decision = 'excluded'").select("episode_id").orderBy("episode_id")
    shown = [r[0] for r in excluded.limit(101).collect()]
    if shown:
        out += ["", "## Excluded", "", ", ".join(map(str, shown[:100])) + (" and others" if len(shown) > 100 else "")]
    return "\n".join(out) + "\n"


def gap_text(stats: DataFrame, flagged: DataFrame, most: int = 10) -> str:
    """A log's topics by name, each with its first `most` gaps over the threshold."""
    out = []
    for r in stats.orderBy("topic").collect():  # a row per topic
        rate = f", {r['implied_hz']:.3f} Hz" if r["implied_hz"] else ""
        out.append(f"{r['topic']}: {r['count']} messages{rate}, {r['n_flagged']} gaps, {r['non_monotonic']} steps back")
        first = flagged.where(F.col("topic") == r["topic"]).orderBy("after_message_index").limit(most).collect() if r["n_flagged"] else []
        out += [f"  after message {g['after_message_index']}: {g['gap_ns']} ns, {g['gap_over_median']:.2f} x the median" for g in first]
        if r["n_flagged"] > most:
            out.append(f"  and {r['n_flagged'] - most} more")
    return "\n".join(out)
