"""Message logs: topics, gaps, connections, and messages made from frames.

A log is a table of messages (topic, log_time in ns, seq as they arrived, ...). Sorting is by shards of time or of
sequence within a topic, so a hot topic is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodelake.operators.carry import previous, running
from episodelake.sources import table

#: Nanoseconds and messages of a shard.
SPAN, RUN = 3_600 * 10**9, 1 << 16
NS = 1e9


def gaps(messages: DataFrame) -> DataFrame:
    """Each message after a topic's first by log_time: topic, position of the message before (from 0), gap_ns."""
    shard = F.floor(F.col("log_time") / SPAN)
    placed = running(messages.select("topic", "log_time"), ["topic"], ["log_time"], {}, shard, count="position")
    told = previous(placed, ["topic"], ["log_time", "position"], {"_before": F.col("log_time")}, shard)
    return told.where("has_previous").select("topic", (F.col("position") - 1).alias("after_message_index"), (F.col("log_time") - F.col("_before")).alias("gap_ns"))


def non_monotonic(messages: DataFrame) -> DataFrame:
    """How often a topic's log_time goes back, as messages arrived."""
    told = previous(messages.select("topic", "log_time", "seq"), ["topic"], ["seq"], {"_before": F.col("log_time")}, F.floor(F.col("seq") / RUN))
    return told.groupBy("topic").agg(F.count_if(F.coalesce(F.col("log_time") < F.col("_before"), F.lit(False))).alias("non_monotonic"))


def topic_stats(messages: DataFrame, factor: float = 1.5, exact: bool = True) -> DataFrame:
    """Per topic: count, bounds, gaps and their threshold (factor x median), rate and how many gaps are over it. With fewer than two
    messages the statistics of gaps are null; with a median of 0 there is no rate and no flag.

    The median is exact; exact=False takes a mergeable summary (rank error 1/10,000)."""
    g = gaps(messages)
    middle = F.median("gap_ns") if exact else F.percentile_approx("gap_ns", 0.5, 10_000).cast("double")
    of = g.groupBy("topic").agg(middle.alias("median_gap_ns"), F.min("gap_ns").alias("min_gap_ns"), F.max("gap_ns").alias("max_gap_ns"))
    of = of.withColumn("threshold_ns", F.col("median_gap_ns") * factor).withColumn("implied_hz", F.when(F.col("median_gap_ns") > 0, F.try_divide(F.lit(NS), F.col("median_gap_ns"))))
    over = flagged(g, of).groupBy("topic").agg(F.count("*").alias("n_flagged"))
    all_ = messages.groupBy("topic").agg(F.count("*").alias("count"), F.min("log_time").alias("start_ns"), F.max("log_time").alias("end_ns"))
    all_ = all_.withColumn("duration_s", (F.col("end_ns") - F.col("start_ns")) / F.lit(NS))
    out = all_.join(of, "topic", "left").join(over, "topic", "left").join(non_monotonic(messages), "topic", "left")
    return out.withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))


def flagged(g: DataFrame, stats: DataFrame) -> DataFrame:
    """Gaps over their topic's threshold, with their ratio to the median."""
    s = stats.select("topic", "median_gap_ns", "threshold_ns")
    return g.join(s, "topic").where("median_gap_ns > 0 and gap_ns > threshold_ns").select("topic", "after_message_index", "gap_ns", (F.col("gap_ns") / F.col("median_gap_ns")).alias("gap_over_median"))


def is_typed(msgtype: Column) -> Column:
    return F.coalesce(msgtype.contains("/") & ~msgtype.isin("unknown", ""), F.lit(False))


def connections(messages: DataFrame) -> DataFrame:
    """Per topic and message type: count, bounds, duration (0 without bounds), and how it would be written anew."""
    typed = is_typed(F.col("msgtype"))
    out = messages.groupBy("topic", "msgtype").agg(F.count("log_time").alias("count"), F.min("log_time").alias("start_ns"), F.max("log_time").alias("end_ns"))
    duration = F.coalesce((F.col("end_ns") - F.col("start_ns")) / F.lit(NS), F.lit(0.0))
    return out.withColumns({"duration_s": duration, "typed": typed, "schema_encoding": F.when(typed, "ros2msg").otherwise("jsonschema"), "message_encoding": F.when(typed, "cdr").otherwise("json")})


def file_summary(messages: DataFrame) -> DataFrame:
    """One row for a whole log, and its messages per topic as a map; topics are few."""
    per = messages.groupBy("topic").agg(F.count("*").alias("n"), F.min("log_time").alias("lo"), F.max("log_time").alias("hi"))
    return per.agg(F.sum("n").alias("message_count"), F.count("*").alias("channel_count"), F.min("lo").alias("start_ns"), F.max("hi").alias("end_ns"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "n")))).alias("channels"))


def messages(frames: DataFrame, split: bool = True, offset_ns: Column | None = None) -> DataFrame:
    """Messages of frames: state and action as two topics with JSON payloads, or together as /joint_state. log_time is the timestamp in
    ns, half to even, plus the episode's offset; seq counts a topic's messages by `index`."""
    at = F.bround(F.col("timestamp").cast("double") * NS, 0).cast("long") + (F.lit(0) if offset_ns is None else offset_ns)
    keys = [F.col("frame_index"), F.col("episode_index")]
    state, action = F.col("`observation.state`"), F.col("action")
    if split:
        one = lambda topic, v: F.struct(F.lit(topic).alias("topic"), F.to_json(F.struct(F.col("frame_index"), v.alias("values"))).alias("payload"))
        rows = frames.select(*keys, F.col("index").alias("seq"), at.alias("log_time"), F.explode(F.array(one("/observation/state", state), one("/action", action))).alias("m")).select("episode_index", "frame_index", "seq", "log_time", "m.topic", "m.payload")
    else:
        rows = frames.select(*keys, F.col("index").alias("seq"), at.alias("log_time"), F.lit("/joint_state").alias("topic"), F.to_json(F.struct(*keys, state.alias("state"), action.alias("action"))).alias("payload"))
    return running(rows, ["topic"], ["seq"], {}, F.floor(F.col("seq") / RUN), count="sequence")


# Over the test tables: events as a log.


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    msgtype = F.when(F.col("value") > 10, F.concat(F.lit("std/"), F.col("event_type"))).when(F.col("value") > 1, F.lit("unknown"))
    return e.select(F.col("event_type").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("log_time"), ((F.col("event_id") * 7919) % 100_003).alias("seq"), msgtype.alias("msgtype"))


def q_topics(spark, folder):
    return topic_stats(event_log(spark, folder)).withColumn("implied_hz", F.round("implied_hz", 9))


def q_flagged(spark, folder):
    log = event_log(spark, folder)
    return flagged(gaps(log), topic_stats(log)).withColumn("gap_over_median", F.round("gap_over_median", 6))


def q_connections(spark, folder):
    return connections(event_log(spark, folder))


def q_summary(spark, folder):
    return file_summary(event_log(spark, folder)).drop("channels")


def q_messages(spark, folder):
    from episodelake.operators.detectors import regular

    m = messages(regular(spark, folder).where("timestamp >= 0 and timestamp < 1e6 and index is not null"))
    return m.select("episode_index", "frame_index", "topic", "log_time", F.size(F.from_json("payload", "values array<double>")["values"]).alias("n_values"))


LOG = """lg AS (SELECT event_type AS topic, epoch_us(ts) * 1000 AS log_time, (event_id * 7919) % 100003 AS seq, CASE WHEN value > 10 THEN 'std/' || event_type WHEN value > 1 THEN 'unknown' END AS msgtype FROM events)"""
TOPICS = f"""{LOG}, gp AS (SELECT * FROM (SELECT topic, row_number() OVER w - 2 AS after_message_index, log_time - lag(log_time) OVER w AS gap_ns FROM lg WINDOW w AS (PARTITION BY topic ORDER BY log_time)) WHERE gap_ns IS NOT NULL
), gs AS (SELECT topic, median(gap_ns) AS median_gap_ns, min(gap_ns) AS min_gap_ns, max(gap_ns) AS max_gap_ns, median(gap_ns) * 1.5::DOUBLE AS threshold_ns FROM gp GROUP BY 1
), fl AS (SELECT gp.*, gap_ns / median_gap_ns AS gap_over_median FROM gp JOIN gs USING (topic) WHERE median_gap_ns > 0 AND gap_ns > threshold_ns
), nm AS (SELECT topic, count_if(log_time < b) AS non_monotonic FROM (SELECT topic, log_time, lag(log_time) OVER (PARTITION BY topic ORDER BY seq) AS b FROM lg) GROUP BY 1)"""

QUERIES = {
    "topic_gaps": (q_topics, f"""WITH {TOPICS} SELECT a.*, (end_ns - start_ns) / 1e9::DOUBLE AS duration_s, gs.* EXCLUDE (topic), CASE WHEN median_gap_ns > 0 THEN round(1e9::DOUBLE / median_gap_ns, 9) END AS implied_hz, coalesce(k.n, 0) AS n_flagged, nm.non_monotonic
      FROM (SELECT topic, count(*) AS count, min(log_time) AS start_ns, max(log_time) AS end_ns FROM lg GROUP BY 1) a LEFT JOIN gs USING (topic) LEFT JOIN (SELECT topic, count(*) AS n FROM fl GROUP BY 1) k USING (topic) LEFT JOIN nm USING (topic)"""),
    "topic_gaps_flagged": (q_flagged, f"WITH {TOPICS} SELECT topic, after_message_index, gap_ns, round(gap_over_median, 6) AS gap_over_median FROM fl"),
    "connections": (q_connections, f"""WITH {LOG} SELECT topic, msgtype, count(*) AS count, min(log_time) AS start_ns, max(log_time) AS end_ns, (max(log_time) - min(log_time)) / 1e9::DOUBLE AS duration_s, coalesce(contains(msgtype, '/'), false) AS typed,
      CASE WHEN contains(msgtype, '/') THEN 'ros2msg' ELSE 'jsonschema' END AS schema_encoding, CASE WHEN contains(msgtype, '/') THEN 'cdr' ELSE 'json' END AS message_encoding FROM lg GROUP BY 1, 2"""),
    "log_summary": (q_summary, f"WITH {LOG} SELECT count(*) AS message_count, count(DISTINCT topic) AS channel_count, min(log_time) AS start_ns, max(log_time) AS end_ns FROM lg"),
    "messages_split": (q_messages, None),
}
