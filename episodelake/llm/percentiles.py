"""Percentiles of very large numeric columns (problem 4).

Sketches of relative-rank compactors, after Cormode, Karnin, Liberty, Thaler and Vesely, "Relative Error Streaming
Quantiles" (2021). A level's buffer is sorted when full and every second of its unprotected end's items goes up a level with
twice the weight; the end that matters (the greatest values for the upper tail, the least for the lower) is compacted ever
more rarely, so the error in rank is in proportion to the distance from that end: at most EPSILON * (1 - p) of all values
at percentile p of the upper sketch, EPSILON * p of the lower, about three standard deviations. Up to 2 * SECTION * SECTIONS
values nothing is compacted and percentiles are exact.

Every map task makes a sketch per group of its rows, sketches are merged level by level in two rounds (salted, then whole), and
the merged sketch of a month is a row that can be kept and merged with others'. No group's values are ever in one
task. The coin of a compaction is a hash of the buffer's state and content, so the same input in the same partitions gives the same result.

Defined cases: null and NaN values count for nothing; infinite values are the greatest and least; copies (rows that differ
in nothing or only in ingested_at) count once, in the month they first came; equal values are kept as often as they come;
null groups are a group; groups without values and empty tables give no rows; extra columns play no part but in telling
copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodelake.sources import once, table

#: A level's first section size and number of sections. The stated error follows from them.
SECTION, SECTIONS = 64, 3
#: Three standard deviations of the relative error in rank, sqrt(0.0512 / SECTIONS) / SECTION each (public analysis of the sketch).
EPSILON = 3 * (0.0512 / SECTIONS) ** 0.5 / SECTION
#: Groups of the first merging round.
SALT = 32
PERCENTILES = (0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)

LEVELS = "level int, items array<double>, state long, section double, sections int"


class Sketch:
    """Relative-rank compactors that protect the greatest values; negate values to protect the least."""

    def __init__(self) -> None:
        self.levels: list[dict] = []

    def level(self, h: int) -> dict:
        while len(self.levels) <= h:
            self.levels.append({"items": np.empty(0), "state": 0, "section": float(SECTION), "sections": SECTIONS})
        return self.levels[h]

    @staticmethod
    def capacity(level: dict) -> int:
        return 2 * even(level["section"]) * level["sections"]

    def add(self, values: np.ndarray, h: int = 0) -> None:
        """Any number of values; compacted piece by piece."""
        level = self.level(h)
        room = max(self.capacity(level), 1)
        for i in range(0, len(values), room):
            level["items"] = np.concatenate([level["items"], values[i : i + room]])
            self.compact(h)

    def compact(self, h: int) -> None:
        while len(self.level(h)["items"]) > self.capacity(self.level(h)):
            level = self.levels[h]
            items = np.sort(level["items"])
            state, size, n = level["state"], even(level["section"]), level["sections"]
            ones = (~state & (state + 1)).bit_length() - 1  # trailing ones of the state
            # The protected half of the buffer and the sections that aren't due stay; the rest, made even, is compacted.
            stay = size * n + (n - min(ones + 1, n)) * size
            due = len(items) - stay
            due -= due % 2
            coin = (int(np.abs(items[:due]).sum() * 1e6) ^ (state * 0x9E3779B1) ^ h) if np.isfinite(items[:due]).all() else state
            coin = (coin * 0x2545F4914F6CDD1D >> 40) & 1
            up = items[coin:due:2]
            level["items"], level["state"] = items[due:], state + 1
            if level["state"] >= 1 << (level["sections"] - 1) and level["section"] / 2**0.5 >= 4:
                level["section"], level["sections"] = level["section"] / 2**0.5, level["sections"] * 2
            self.add(up, h + 1)

    def merge(self, rows: list[tuple]) -> None:
        """Levels of another sketch: (level, items, state, section, sections)."""
        for h, items, state, section, sections in sorted(rows, key=lambda r: r[0]):
            own = self.level(h)
            own["state"] |= int(state)
            if sections > own["sections"]:
                own["section"], own["sections"] = float(section), int(sections)
            own["items"] = np.concatenate([own["items"], np.asarray(items, float)])
        for h in range(len(self.levels)):
            self.compact(h)

    def rows(self) -> list[tuple]:
        return [(h, v["items"], v["state"], v["section"], v["sections"]) for h, v in enumerate(self.levels)]

    def quantiles(self, ps: list[float], negated: bool) -> tuple[int, list[float]]:
        """How many values, and for each p the least kept value with at least p of the weight up to it."""
        items = np.concatenate([v["items"] for v in self.levels]) * (-1 if negated else 1)
        weight = np.concatenate([np.full(len(v["items"]), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        below = weight[order].cumsum()
        n = int(below[-1])
        at = np.searchsorted(below, np.ceil(np.array(ps) * n - 1e-9).clip(1), side="left")
        return n, items[order][at.clip(0, len(items) - 1)].tolist()


def even(section: float) -> int:
    return max(4, 2 * round(section / 2))


KEYS = "robot string, metric string, month string, tail string"


def columns(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.string()] * 4 + [pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int32()]
    names = [c.split()[0] for c in f"{KEYS}, {LEVELS}".split(", ")]
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names


def sketches(values: DataFrame) -> DataFrame:
    """Sketches of `values` (robot, metric, month, value), a row per group, tail and level: KEYS and LEVELS."""
    schema = f"{KEYS}, {LEVELS}"

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: dict[tuple, Sketch] = {}
        for b in batches:
            value = b.column("value").to_numpy(zero_copy_only=False)
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(b.column(c).to_pylist() for c in ("robot", "metric", "month")))):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                own.setdefault((*k, "upper"), Sketch()).add(value[at])
                own.setdefault((*k, "lower"), Sketch()).add(-value[at])
        rows = [(*k, *r) for k, s in own.items() for r in s.rows()]
        if rows:
            arrays, names = columns(rows)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    value = F.col("value").cast("double")
    parts = values.where(value.isNotNull() & ~F.isnan(value)).select("robot", "metric", "month", value.alias("value")).mapInArrow(make, schema)
    return merged(parts, "robot", "metric", "month")


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Sketches merged by the keys given of robot, metric and month (others become null), in two rounds."""
    schema = f"{KEYS}, {LEVELS}"

    def merge(group):
        import pyarrow as pa

        c = {n: group.column(n).to_pylist() for n in group.column_names}
        s = Sketch()
        # Level by level, whatever sketch a level is from: compactors of one level are merged, not their sketches one by one.
        s.merge(list(zip(*(c[n] for n in ("level", "items", "state", "section", "sections")))))
        arrays, names = columns([(c["robot"][0], c["metric"][0], c["month"][0], c["tail"][0], *r) for r in s.rows()])
        return pa.Table.from_arrays(arrays, names=names)

    same = parts.withColumns({k: F.lit(None).cast("string") for k in ("robot", "metric", "month") if k not in keys})
    salted = same.withColumn("salt", F.pmod(F.xxhash64("items", "state"), F.lit(SALT)))
    # All levels of a merged sketch are then in one of SALT rows' groups; a level's rows may come from many sketches.
    once_ = salted.groupBy("robot", "metric", "month", "tail", "salt").applyInArrow(merge, schema)
    return once_.groupBy("robot", "metric", "month", "tail").applyInArrow(merge, schema)


def percentiles(sketched: DataFrame, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """robot, metric, month, n, percentile, value, rank_error from merged sketches: percentiles up to 0.5 from the lower, others from the upper."""
    schema = "robot string, metric string, month string, n long, percentile double, value double, rank_error double"

    def read(group):
        import pyarrow as pa

        c = {n: group.column(n).to_pylist() for n in group.column_names}
        s, upper = Sketch(), c["tail"][0] == "upper"
        for h, items in zip(c["level"], c["items"]):
            s.level(h)["items"] = np.asarray(items, float)
        mine = [p for p in ps if (p > 0.5) == upper]
        n, values = s.quantiles(mine, not upper)
        exact = len(s.levels) == 1
        k = len(mine)
        error = [0.0 if exact else EPSILON * min(p, 1 - p) for p in mine]
        return pa.Table.from_arrays(
            [pa.array([c[x][0]] * k, pa.string()) for x in ("robot", "metric", "month")] + [pa.array([n] * k, pa.int64()), pa.array(mine, pa.float64()), pa.array(values, pa.float64()), pa.array(error, pa.float64())],
            names=["robot", "metric", "month", "n", "percentile", "value", "rank_error"],
        )

    return sketched.groupBy("robot", "metric", "month", "tail").applyInArrow(read, schema)


def robot_values(spark: SparkSession, folder: str) -> DataFrame:
    """robot, metric, month, value of action_magnitude, max_gap_s and drift_ms, copies once."""

    def metric(name: str, *fields: str) -> DataFrame:
        rows = once(table(spark, folder, name))
        pairs = F.array(*(F.struct(F.lit(f"{name}.{f}").alias("metric"), F.col(f).cast("double").alias("value")) for f in fields))
        return rows.select("robot", F.date_format("ingested_at", "yyyy-MM").alias("month"), F.explode(pairs).alias("x")).select("robot", "x.metric", "month", "x.value")

    return metric("episode_quality", "action_magnitude").unionAll(metric("sync", "max_gap_s", "drift_ms"))


def by_month(spark: SparkSession, folder: str) -> DataFrame:
    """p4_months: percentiles of each month apart."""
    return percentiles(sketches(robot_values(spark, folder)))


def by_robot(spark: SparkSession, folder: str) -> DataFrame:
    """p4_percentiles: the months' sketches combined by robot."""
    return percentiles(merged(sketches(robot_values(spark, folder)), "robot", "metric")).drop("month")
