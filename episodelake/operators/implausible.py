"""Implausible readings in measured series (problem 1).

A robust autoregression per source (robot and joint) says how a series goes on: the next step is a mixture of the last two
steps. Its coefficients come from sums that are added up over all shards, each step weighted by a Huber weight that is
iterated within its shard; the sizes of steps and of residuals are counted in logarithmic bins, also added up, and their
quantiles are the source's normal behaviour. No source's rows are ever in one task: a series (an episode) is cut into
blocks of BLOCK readings with HALO readings of its neighbours on both sides.

With that, each block is scored by itself:
* limit: a reading that isn't a finite number or lies beyond the physical limit;
* spike: where the residual is far beyond the source's scale, an additive outlier (the series returns to its course
  within MOST readings, as far from it as SPIKE usual steps) is tested against a level shift (it doesn't return). An
  additive outlier is flagged and bridged, a level shift is accepted as the new course, and the test is run again until
  nothing more is found. An excursion that the measured state goes along with is a movement, not a spike;
* stuck: HOLD or more readings in a row that differ by no more than a sensor's jitter (NEAR usual steps). In a source that
  often stands still in normal work (coarse steps, grippers) a run is flagged only if something shows that it should have
  moved: the measured state is away from it for HOLD readings, or, where the state doesn't tell, a
  jump when it ends or begins, or HOLD_TOGETHER channels held over exactly the same stretch.

How closely the measured state follows the readings, at once or a reading later, is part of a source's normal behaviour.

Series that have no course (an episode's magnitude among a robot's episodes) use the same tests about the source's
level: deviation from the robust mean and its first-order autoregression in robust deviations (FAR_OFF), impossible values, and runs of SAME equal
values; there a level shift is no excuse.

Defined cases: null or not 14-wide actions, null episode_index or frame_index are no readings; null elements of an action are
not finite, so limit cases; copies count once; two different readings of one frame are both scored, in order of timestamp; an
episode of one frame can only be a limit case; robots whose joints never moved have no scale, their residuals are measured
against LEAST; null robots are a source of their own; null magnitudes are no case and are left out of runs; NaN magnitudes
are impossible; empty tables give no rows. Columns that aren't named play no part."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from episodelake.functions.batches import bounds, matrix, ragged, whole_groups
from episodelake.operators.carry import previous, running
from episodelake.sources import table
from episodelake.sources.tables import cut

JOINTS, GRIPPERS = 14, (6, 13)
#: Readings of a block, and how many of the neighbouring blocks it also sees.
BLOCK, HALO = 4096, 64
#: An additive outlier lasts MOST readings at most, departs SPIKE usual steps at its farthest and half as many throughout.
MOST, SPIKE = 4, 5.0
#: Residuals in units of the source's scale at which a test is made.
RESIDUAL = 4.0
#: Equal readings in a row that are no longer normal; channels held over the same stretch that leave no doubt.
HOLD, HOLD_TOGETHER = 7, 5
#: Usual steps by which readings of a stuck run differ at most from its middle: a stuck sensor may still jitter.
NEAR = 0.015
#: Deviations of the measured state from a reading at which it doesn't follow it.
LEFT = 3.0
#: Share of steps of size 0 from which a source is taken to stand still in normal work.
STILL = 0.3
#: Robust deviations of a level that are too many; equal values in a row that are too many.
FAR_OFF, SAME = 5.0, 6
#: The quantile of a source's steps that counts as its usual step, the bins' ratio and number on either side of 1, the smallest scale.
USUAL, BIN, WIDTH, LEAST = 0.99, 1.05, 400, 1e-3
LOG = math.log(BIN)
LIMIT = float(np.float32(np.pi))


def block_of(order: str) -> tuple[Column, Column]:
    """A reading's own block (the first also has what is below 0), and that and the neighbours within HALO of it."""
    at, own = F.col(order), F.greatest(F.floor(F.col(order) / BLOCK), F.lit(0))
    into = at - own * BLOCK
    return own, F.array_compact(F.array(own, F.when((own > 0) & (into < HALO), own - 1), F.when(into >= BLOCK - HALO, own + 1)))


def blocks(df: DataFrame, series: str, order: str) -> DataFrame:
    """df with `block` and `home`; readings within HALO of another block are there once more, not at home. Sorted within."""
    own, all_ = block_of(order)
    out = df.withColumn("block", F.explode(all_)).withColumn("home", F.col("block") == own)
    return out.repartition(series, "block").sortWithinPartitions(series, "block", order, *(c for c in ("timestamp",) if c in df.columns))


def forward(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Readings that aren't ok take the last that is, at the start the first."""
    if ok.all():
        return x.copy()
    at = np.where(ok, np.arange(len(x))[:, None], 0)
    at = np.maximum.accumulate(at, axis=0)
    first = np.where(ok.any(0), ok.argmax(0), 0)
    at = np.where(ok.cumsum(0) > 0, at, first)
    return np.where(ok.any(0), np.take_along_axis(x, at, axis=0), 0.0)


def bins(size: np.ndarray) -> np.ndarray:
    """0 for a size of 0, else a logarithmic bin from 1."""
    with np.errstate(all="ignore"):
        return np.where(size > 0, np.clip(np.ceil(np.log(size) / LOG), -WIDTH, WIDTH) + WIDTH + 1, 0).astype(np.int64)


def size_of(b: int | None) -> float:
    return 0.0 if not b else BIN ** (b - WIDTH - 1)


def fit_block(y: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of the steps' regression (5 per channel) and the residuals' sizes at home, after reweighting within the block."""
    d = np.diff(y, axis=0)
    if len(d) < 3:
        return np.zeros((5, y.shape[1])), np.empty((0, y.shape[1]))
    now, one, two = d[2:], d[1:-1], d[:-2]
    far = np.maximum(np.abs(one), np.abs(two)) / 2
    w = np.ones_like(now)
    for last in (False, False, True):
        wo, wt = w * one, w * two
        sums = np.stack([(wo * one).sum(0), (wo * two).sum(0), (wt * two).sum(0), (wo * now).sum(0), (wt * now).sum(0)])
        if last:
            return sums, left[home[3:]]
        a, b = solve(sums)
        left = np.abs(now - a * one - b * two)
        scale = np.maximum(1.4826 * np.median(left, axis=0), 1e-6)
        # Huber's weight, also for outlying regressors: a spike is in three residuals, and two of them have it as regressor.
        w = np.minimum(1.0, 3.0 * scale / np.maximum(np.maximum(left, far), 1e-12)) * home[3:, None]


def solve(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the last two steps from the five sums; 0 where there's no movement. Kept stable."""
    s11, s12, s22, t1, t2 = sums
    ridge = 1e-9 + 1e-6 * (s11 + s22)
    det = (s11 + ridge) * (s22 + ridge) - s12 * s12
    with np.errstate(all="ignore"):
        a, b = (t1 * (s22 + ridge) - t2 * s12) / det, (t2 * (s11 + ridge) - t1 * s12) / det
    a, b = (np.clip(np.where(np.isfinite(v), v, 0.0), -1.0, 1.0) for v in (a, b))
    return a, b


#: What is counted in bins: steps, residuals, deviations of the state of the same and of the next reading.
KINDS = ("step", "left", "state0", "state1")


def apart(x: np.ndarray, state: np.ndarray, later: int) -> np.ndarray:
    """How far the state `later` readings on is from each reading; the last `later` readings have none."""
    with np.errstate(all="ignore"):
        return np.abs(x[: len(x) - later] - state[later:])


def normal_behaviour(readings: DataFrame, channels: int, limit: float) -> dict[tuple[str | None, int], dict]:
    """By source and channel: usual step, share of steps that are 0, residual scale, coefficients, how the state follows
    (readings later, deviation; null without states). From all readings."""

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict = {}
        width = 2 * WIDTH + 2
        column = np.arange(channels) * width
        for source, x, home, _, state, _ in series(batches, channels):
            with np.errstate(all="ignore"):
                ok = np.abs(x) <= limit
                moved = np.abs(np.diff(x, axis=0))
            own, left = fit_block(forward(x, ok), home)
            if source not in total:
                total[source] = [np.zeros((5, channels)), *(np.zeros(channels * width, np.int64) for _ in KINDS)]
            told = ok[1:] & ok[:-1] & home[1:, None]
            t = total[source]
            t[0] += own
            t[1] += np.bincount((bins(moved) + column)[told], minlength=channels * width)
            t[2] += np.bincount((bins(left) + column).ravel(), minlength=channels * width)
            for later in (0, 1) if state is not None else ():
                off, told = apart(x, state, later), (ok & home[:, None])[: len(x) - later]
                t[3 + later] += np.bincount((bins(off) + column)[told & np.isfinite(off)], minlength=channels * width)
        rows = []
        for source, (ar, *counts) in total.items():
            rows += [(source, j, "ar", k, float(ar[k, j])) for j in range(channels) for k in range(5)]
            for kind, n in zip(KINDS, counts):
                rows += [(source, i // width, kind, i % width, float(n[i])) for i in np.flatnonzero(n).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64()))], names=["source", "channel", "kind", "bin", "v"])

    parts = readings.select("series", "at", "block", "home", "source", *(c for c in readings.columns if c in ("timestamp", "state")), "x").mapInArrow(sums, "source string, channel int, kind string, bin int, v double")
    whole = parts.groupBy("source", "channel", "kind", "bin").agg(F.sum("v").alias("v"))
    by = W.partitionBy("source", "channel", "kind")  # a few hundred bins each
    ranked = whole.withColumn("below", F.try_divide(F.sum("v").over(by.orderBy("bin")), F.sum("v").over(by)))
    of = lambda kind: F.col("kind") == kind
    at = lambda kind, q: F.min(F.when(of(kind) & (F.col("below") >= q), F.col("bin")))
    rows = ranked.groupBy("source", "channel").agg(
        at("step", USUAL).alias("step"),
        F.max(F.when(of("step") & (F.col("bin") == 0), F.col("below"))).alias("still"),
        at("left", 0.5).alias("left"),
        *(at(f"state{k}", 0.5).alias(f"state{k}") for k in (0, 1)),
        *(F.max(F.when(of("ar") & (F.col("bin") == k), F.col("v"))).alias(f"s{k}") for k in range(5)),
    )
    out = {}
    for r in rows.collect():  # a row per source and channel, of which there is a fixed number (robots x joints)
        a, b = solve(np.array([[r[f"s{k}"] or 0.0] for k in range(5)]))
        step = max(size_of(r["step"]), LEAST)
        out[r["source"], r["channel"]] = {"step": step, "still": r["still"] or 0.0, "scale": max(1.4826 * size_of(r["left"]), step / 4), "a": float(a[0]), "b": float(b[0])}
        follows = [(size_of(r[f"state{k}"]), k) for k in (0, 1) if r[f"state{k}"] is not None]
        off, later = min(follows, default=(None, 0))
        out[r["source"], r["channel"]] |= {"later": later, "follows": None if off is None else max(1.4826 * off, step / 20)}
    return out


def series(batches: Iterator, channels: int) -> Iterator[tuple]:
    """Of each block: source, readings, home, order, state, series."""

    def columns() -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            out = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("series", "at", "block", "home")}
            out["source"] = np.array(b.column("source").to_pylist(), dtype=object)
            out["x"] = matrix(b.column("x"), channels)
            if "state" in b.schema.names:
                out["state"] = ragged(b.column("state"), channels)
            yield out

    for b in whole_groups(columns(), ("series", "block"), ("series", "block", "at", "x")):
        for i, k in bounds(b, ("series", "block")):
            yield b["source"][i], b["x"][i:k], b["home"][i:k].astype(bool), b["at"][i:k], b["state"][i:k] if "state" in b else None, b["series"][i]


def outliers(y: np.ndarray, n: dict) -> np.ndarray:
    """Which readings of one channel are additive outliers; y is bridged there. Iterated until a pass finds none."""
    hit = np.zeros(len(y), bool)
    while True:
        d = np.diff(y, prepend=y[:1])
        guess = n["a"] * np.concatenate([[0.0], d[:-1]]) + n["b"] * np.concatenate([[0.0, 0.0], d[:-2]])[: len(d)]
        suspects = np.flatnonzero(np.abs(d - guess) > RESIDUAL * n["scale"])
        found, upto = False, 0
        for t in suspects.tolist():
            if t < max(1, upto):
                continue
            for k in range(t + 1, min(t + MOST, len(y) - 1) + 1):
                length = k - t
                course = y[t - 1] + (y[k] - y[t - 1]) * np.arange(1, length + 1) / (length + 1)
                off = np.abs(y[t:k] - course)
                back = abs(y[k] - y[t - 1])  # what a level shift would leave standing
                if off.max() > SPIKE * n["step"] and off.min() > 0.5 * SPIKE * n["step"] and back <= max((length + 1) * n["step"], 0.3 * off.min()):
                    hit[t:k], y[t:k], upto, found = True, course, k, True
                    break
        if not found:
            return hit


def followed(hit: np.ndarray, x: np.ndarray, course: np.ndarray, state: np.ndarray, n: dict) -> np.ndarray:
    """Which readings are in a stretch of hits that the measured state goes along with, and not with the course bridged there."""
    out = np.zeros(len(hit), bool)
    if n.get("follows") is None:
        return out
    near, told = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    off, end = apart(x, state, n["later"]), len(x) - n["later"]
    near[:end] = (off <= LEFT * n["follows"]) & (apart(course, state, n["later"]) > LEFT * n["follows"])
    told[:end] = np.isfinite(off)
    cuts = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    for a, z in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
        out[a:z] = 2 * near[a:z].sum() > told[a:z].sum()
    return out


def runs(y: np.ndarray, near: float) -> Iterator[tuple[int, int]]:
    """Stretches of HOLD or more readings of one channel within `near` of their middle."""
    cuts = np.concatenate([[0], np.flatnonzero(np.abs(np.diff(y)) > near) + 1, [len(y)]])
    for i in np.flatnonzero(np.diff(cuts) >= HOLD).tolist():
        a, z = int(cuts[i]), int(cuts[i + 1])
        # A normal reading at either end may be a small step away, and small steps may add up; what doesn't jitter has one value.
        off = np.abs(y[a:z] - np.median(y[a:z]))
        far = off > (0.0 if 2 * (off == 0).sum() > z - a else near)
        ends = np.concatenate([[-1], np.flatnonzero(far), [z - a]])
        k = int(np.diff(ends).argmax())
        if ends[k + 1] - ends[k] - 1 >= HOLD:
            yield a + int(ends[k]) + 1, a + int(ends[k + 1])


def held(y: np.ndarray, ok: np.ndarray, state: np.ndarray | None, normal: list[dict], resting: tuple[int, ...]) -> np.ndarray:
    """Which readings are in a stuck run of some channel; in y outliers are bridged, and readings that aren't ok filled."""
    n, out = len(y), np.zeros(len(y), bool)
    if n < HOLD:
        return out
    near = NEAR * np.array([v["step"] for v in normal])
    found: dict[tuple[int, int], list[int]] = {}
    for j in np.flatnonzero((np.abs(np.diff(y, axis=0)) <= near).sum(0) >= HOLD - 1).tolist():
        for a, z in () if j in resting else runs(y[:, j], near[j]):
            if ok[a:z, j].sum() >= HOLD:
                found.setdefault((a, z), []).append(j)
    left: dict[int, list[int]] = {}
    for (a, z), js in found.items():
        for j in js:
            if normal[j]["still"] <= STILL:
                out[a:z] = True
                break
            follows, later = normal[j].get("follows"), normal[j].get("later", 0)
            tells = state is not None and follows is not None and LEFT * follows <= 2 * normal[j]["step"]
            told = state[a + later : z + later, j] if tells else np.empty(0)
            told = told[np.isfinite(told)]
            if len(told) >= HOLD:
                if (np.abs(told - y[a:z, j].mean()) > LEFT * follows).sum() >= HOLD:
                    left.setdefault(z, []).append(a)
            elif len(js) >= HOLD_TOGETHER or max([0.0, *(abs(y[k, j] - y[a, j]) for k in (a - 1, z) if 0 <= k < n)]) > 1.5 * normal[j]["step"]:
                out[a:z] = True
                break
    for z, begins in left.items():
        out[max(begins) : z] = True  # channels stuck together have all of the stretch, and each its own rest before it
    return out


def judge(x: np.ndarray, state: np.ndarray | None, n: list[dict], limit: float, resting: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which readings of a block are beyond the limit, spikes, in stuck runs."""
    with np.errstate(all="ignore"):
        ok = np.abs(x) <= limit
    y = forward(x, ok)
    bad, spike = ~ok.all(1), np.zeros(len(x), bool)
    for j in np.flatnonzero((np.abs(np.diff(y, axis=0)) > np.array([v["step"] for v in n])).any(0)).tolist() if len(x) > 1 else ():
        own = outliers(c := y[:, j].copy(), n[j])
        if state is not None and own.any():
            own &= ~followed(own, x[:, j], c, state[:, j], n[j])
        y[own, j] = c[own]
        spike |= own
    return bad, spike, held(y, ok, state, n, resting)


def score(readings: DataFrame, normal: dict, channels: int, limit: float, resting: tuple[int, ...]) -> DataFrame:
    """series, at, reason of every implausible reading at home in its block."""
    unknown = {"step": LEAST, "still": 0.0, "scale": LEAST, "a": 0.0, "b": 0.0}

    def cases(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for source, x, home, at, state, which in series(batches, channels):
            bad, spike, stuck = judge(x, state, [normal.get((source, j), unknown) for j in range(channels)], limit, resting)
            reasons = [(r, at[f & home]) for r, f in (("limit", bad), ("spike", spike & ~bad), ("stuck", stuck & ~bad & ~spike))]
            total = sum(len(v) for _, v in reasons)
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(total, which), pa.int64()), pa.array(np.concatenate([v for _, v in reasons]), pa.int64()), pa.array([r for r, v in reasons for _ in v], pa.string())],
                    names=["series", "at", "reason"],
                )

    return readings.mapInArrow(cases, "series long, at long, reason string")


def frame_cases(frames: DataFrame) -> DataFrame:
    """episode_index, frame_index, reason of the frames with an implausible joint reading; once per frame."""
    x = frames.where((F.size("action") == JOINTS) & F.col("episode_index").isNotNull() & F.col("frame_index").isNotNull())
    ordered = lambda: blocks(x.select(F.col("episode_index").alias("series"), F.col("frame_index").alias("at"), F.col("robot").alias("source"), "timestamp", F.col("action").alias("x"), F.col("`observation.state`").alias("state")), "series", "at")
    # Sorted twice, not kept: the first one's shuffle can be cleared from the disks once the driver has collected its objects.
    normal = normal_behaviour(ordered(), JOINTS, LIMIT)
    cases = score(ordered(), normal, JOINTS, LIMIT, GRIPPERS)
    # Different readings of one frame may be implausible in different ways: the first reason by name stays.
    return cases.groupBy("series", "at").agg(F.min("reason").alias("reason")).select(F.col("series").alias("episode_index"), F.col("at").alias("frame_index"), "reason")


def level_cases(values: DataFrame, most: float) -> DataFrame:
    """source, at, reason for values in no course: `values` has source, at (order within the source), x (double).

    Levels and spreads per source are mergeable quantile summaries (relative accuracy 1/10,000 of the ranks)."""
    x = values.where(F.col("at").isNotNull() & F.col("x").isNotNull()).distinct()
    possible = (F.col("x") > 0) & (F.col("x") <= most)
    middle = x.where(possible).groupBy("source").agg(F.percentile_approx("x", 0.5, 10_000).alias("middle"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    named = lambda df: df.withColumnRenamed("source", "_s")
    off = x.join(named(middle), same, "left").drop("_s")
    spread = off.where(possible).groupBy("source").agg(F.percentile_approx(F.abs(F.col("x") - F.col("middle")), 0.5, 10_000).alias("spread"))
    off = off.join(named(spread), same, "left").drop("_s").withColumn("scale", F.greatest(1.4826 * F.col("spread"), 0.01 * F.col("middle")))
    z = F.when(possible, (F.col("x") - F.col("middle")) / F.col("scale"))
    capped = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))  # Huber's psi: an outlier's neighbour isn't judged by it
    off = off.withColumn("z", z).withColumn("psi", F.coalesce(capped, F.lit(0.0))).withColumn("possible", possible)
    off = cut(off.select("source", "at", "x", "z", "psi", "possible"))  # used many times below: each would be planned anew
    # A source's neighbours may be any distance apart in `at`, so they are carried over shards, not looked for in a halo.
    order, shard = (["source"], ["at", "x"]), F.floor(F.col("at") / BLOCK)
    off = previous(off, *order, {"before": F.col("x"), "past": F.col("psi")}, shard).withColumn("past", F.coalesce("past", F.lit(0.0)))
    off = off.withColumn("new", F.when(F.col("has_previous") & (F.col("x") == F.col("before")), 0).otherwise(1))
    off = cut(running(off, *order, {"earlier": F.col("new")}, shard).withColumn("run", F.col("earlier") + F.col("new")))
    slope = off.groupBy("source").agg(F.try_divide(F.sum(F.col("psi") * F.col("past")), F.sum(F.col("past") * F.col("past"))).alias("slope"))
    off = off.join(named(slope), same, "left").drop("_s")
    left = F.abs(F.col("z") - F.coalesce("slope", F.lit(0.0)) * F.col("past"))
    long_runs = off.groupBy("source", "run").agg(F.count_distinct("at").alias("length")).where(F.col("length") >= SAME).withColumnRenamed("run", "_run")
    off = off.join(named(long_runs), same & (F.col("run") == F.col("_run")), "left").drop("_s", "_run")
    reason = F.when(~F.col("possible"), "limit").when((left > FAR_OFF) & (F.abs("z") > FAR_OFF), "spike").when(F.col("length").isNotNull(), "stuck")
    return off.withColumn("reason", reason).where("reason is not null").select("source", "at", "reason")


def quality_cases(quality: DataFrame) -> DataFrame:
    """episode_index, reason of episodes with an implausible action_magnitude; once per episode."""
    most = math.sqrt(JOINTS) * math.pi  # of 14 joints within the limit
    cases = level_cases(quality.select(F.col("robot").alias("source"), F.col("episode_index").alias("at"), F.col("action_magnitude").cast("double").alias("x")), most)
    return cases.groupBy("at").agg(F.min("reason").alias("reason")).select(F.col("at").alias("episode_index"), "reason")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """p1_cases: source_table, episode_index, frame_index, reason."""
    frames = frame_cases(table(spark, folder, "frames")).select(F.lit("frames").alias("source_table"), "episode_index", "frame_index", "reason")
    quality = quality_cases(table(spark, folder, "episode_quality")).select(F.lit("episode_quality").alias("source_table"), "episode_index", F.lit(-1).cast("long").alias("frame_index"), "reason")
    return frames.unionAll(quality)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found."""
    return cases(spark, folder).drop("reason")
