"""Mixing sources to target weights (problem 7).

A text may be in several sources. The k-th copies of a text in its sources are one record, which counts to any one of them
each time it is taken; records with the same set of sources are a pattern. Sizes (tokens of byte_bpe_50k) are summed by
pattern, and a min-cost flow routes them: from patterns, whose first round costs nothing and each further round of
repetition one more than the last (convex), over sources, at most max_repeats rounds each, to the sources' quotas. The whole is the
largest at which the flow meets every quota, unless a total is given; where single large records don't fit their quota, smaller
wholes are tried, and the one nearest the targets is taken. There are at most 2**sources patterns (and no
more than records), so the flow is solved on the driver by successive shortest paths.

Records are then selected: those of more than 1/LARGE of their pattern (fewer than LARGE each) one by one, largest first; the
others in a seeded order of which every source takes a stretch, source after source around the whole, so that no
record is taken more than a round more often than another. Positions are a prefix scan over hash ranges, no pattern is ever in one task.

Defined cases: sources are compared without case and outer blanks; targets of one such name are added up (the greatest
max_repeats holds); null sources, sources without target, null and empty texts give nothing; sources with a target but no
tokens have part 0 and their whole weight as shortfall; weights of 0 or less, or null, and max_repeats below 1 or null give
nothing; repeated doc_ids count once; empty tables give no rows of the mixture and shortfalls in the report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodelake.llm.encode import TOKENIZERS, corpus_ids
from episodelake.operators.carry import running
from episodelake.sources import table
from episodelake.sources.tables import cut

SEED, LARGE = 20240305, 200
#: Wholes that are tried where large records don't fit, and the distance from the targets at which that ends.
TRIES, NEAR = 12, 1e-3


def source_name(column: str) -> Column:
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def targets(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.select(source_name("source").alias("source"), F.col("target_weight").cast("double").alias("weight"), F.col("max_repeats").cast("long").alias("max_repeats"))
    return t.where("source is not null").groupBy("source").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"), F.max("max_repeats").alias("max_repeats"))


def flow(capacity: dict[tuple[str, ...], int], repeats: dict[str, int], quota: dict[str, float], free: bool = False) -> dict[tuple[tuple[str, ...], str], float]:
    """Tokens from each pattern to each source, of least cost among the greatest flows. free: repetition costs nothing."""
    nodes = ["start", "end", *capacity, *quota]
    at = {n: i for i, n in enumerate(nodes)}
    edges: list[list] = []  # to, room, cost; its reverse is at index ^ 1
    out: list[list[int]] = [[] for _ in nodes]

    def edge(a, b, room: float, cost: float) -> int:
        out[at[a]].append(len(edges))
        edges.append([at[b], room, cost])
        out[at[b]].append(len(edges))
        edges.append([at[a], 0.0, -cost])
        return len(edges) - 2

    routes = {}
    for p, w in capacity.items():
        mine = [s for s in p if s in quota]
        rounds = max((repeats[s] for s in mine), default=0)
        for k in range(1 if free and rounds else rounds):
            edge("start", p, float(w * (rounds if free else 1)), 0.0 if free else float(k))
        for s in mine:
            routes[p, s] = edge(p, s, float(w * repeats[s]), 0.0)
    for s, q in quota.items():
        edge(s, "end", q, 0.0)
    least = 1e-9 * max(1.0, sum(quota.values()))
    while True:
        far, by = [math.inf] * len(nodes), [-1] * len(nodes)
        far[0], queue = 0.0, [0]
        while queue:  # Bellman and Ford with a queue: reverse edges have negative costs
            ahead = []
            for a in queue:
                for e in out[a]:
                    b, room, cost = edges[e]
                    if room > least and far[a] + cost < far[b] - 1e-12:
                        far[b], by[b] = far[a] + cost, e
                        ahead.append(b)
            queue = list(dict.fromkeys(ahead))
        if far[1] == math.inf:
            return {r: edges[e ^ 1][1] for r, e in routes.items()}
        path, b = [], 1
        while b:
            path.append(by[b])
            b = edges[by[b] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount


def largest_whole(capacity: dict, repeats: dict[str, int], share: dict[str, float]) -> float:
    """The greatest total of which the flow can give every source its share."""
    most = min(sum(w * repeats[s] for p, w in capacity.items() if s in p) / x for s, x in share.items())
    low, high = 0.0, float(most)
    for step in range(40):
        middle = high if step == 0 else (low + high) / 2
        quota = {s: x * middle for s, x in share.items()}
        if sum(flow(capacity, repeats, quota, free=True).values()) >= middle * (1 - 1e-7):
            low = middle
            if step == 0:
                break
        else:
            high = middle
        if high - low < 0.25:
            break
    return low


def large_copies(size: int, wanted: float, rest: int, most: int, even: float) -> int:
    """How often to take one large record for a source that still lacks `wanted`, when `rest` tokens of others may come `most` times."""
    need, room = max(0, math.ceil((wanted - most * rest) / size - 1e-9)), max(0, math.floor(wanted / size + 1e-9))
    if need <= room:
        return min(most, max(need, min(room, round(even))))
    over, short = room + 1, room  # neither fits: the nearer
    return min(most, over if over * size - wanted < wanted - short * size - most * rest else short)


def routed_large(whole: float, capacity: dict, repeats: dict[str, int], share: dict[str, float], large: list[tuple]) -> tuple[dict, dict, dict, list, dict]:
    """The flow of a whole; with its large records given out: what is left of patterns and of routes, the copies, and each source's tokens."""
    routed = flow(capacity, repeats, {s: x * whole for s, x in share.items()})
    rest, left, by_hand = dict(capacity), dict(routed), []
    for p, size, record in large:
        rest[p] -= size
        taken, most = 0, max(repeats[s] for s in p)
        for s in sorted(p, key=lambda s: (-left[p, s], s)):
            k = min(most - taken, large_copies(size, left[p, s], rest[p], repeats[s], routed[p, s] / capacity[p]))
            left[p, s] -= k * size
            taken += k
            by_hand.append((record, s, k))
    reached = {s: 0.0 for s in share}
    for (p, s), v in left.items():
        reached[s] += routed[p, s] - v + min(max(v, 0.0), float(rest[p] * repeats[s]))
    return routed, rest, left, by_hand, reached


def records(documents: DataFrame, wanted: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, record, pattern, n_tokens of the documents with tokens in wanted sources."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name("source").alias("source"), "text").where("length(text) > 0")
    own = texts.join(F.broadcast(wanted.select("source")), "source")  # a row per target: mix_targets is fixed
    sizes = corpus_ids(own.select("doc_id", "text"), tokenizers, sizes=True).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    key = F.concat_ws("-", F.xxhash64("text"), F.xxhash64("text", F.lit(1)), F.length("text"))
    docs = own.select("doc_id", "source", key.alias("key")).groupBy("doc_id").agg(F.min(F.struct("source", "key")).alias("x")).select("doc_id", "x.source", "x.key")
    docs = cut(docs.join(sizes, "doc_id").where("n_tokens > 0"))
    # A text may have any number of copies in a source: its copies are counted off over hash ranges of doc_id.
    ranked = counted(docs)
    together = ranked.groupBy("key", "copy").agg(F.array_sort(F.collect_set("source")).alias("pattern"))  # a row per source
    return cut(ranked.join(together, ["key", "copy"]).select("doc_id", "source", F.concat_ws("#", "key", "copy").alias("record"), "pattern", "n_tokens"))


def counted(docs: DataFrame) -> DataFrame:
    placed = docs.withColumn("place", F.xxhash64("doc_id"))
    return running(placed, ["key", "source"], ["place", "doc_id"], {}, F.shiftright("place", 54), count="copy").drop("place")


def plan(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, repeats) and the targets."""
    spark = documents.sparkSession
    wanted = targets(mix_targets)
    named = {r["source"]: (r["weight"] or 0.0, r["max_repeats"] or 0) for r in wanted.collect()}  # fixed, a row per source
    usable = [s for s, (w, k) in named.items() if w > 0 and k >= 1]
    recs = records(documents, wanted.where(F.col("source").isin(usable)), tokenizers)
    one = recs.groupBy("record").agg(F.first("pattern").alias("pattern"), F.max("n_tokens").alias("n_tokens"))
    capacity = {tuple(r["pattern"]): r["w"] for r in one.groupBy("pattern").agg(F.sum("n_tokens").alias("w")).collect()}  # at most 2**sources
    there = sorted({s for p in capacity for s in p})
    schema = "doc_id long, source string, n_tokens long, repeats long"
    if not there:
        return spark.createDataFrame([], schema), wanted
    weights = sum(named[s][0] for s in there)
    share, repeats = {s: named[s][0] / weights for s in there}, {s: named[s][1] for s in there}
    # Large records, one by one.
    weight = spark.createDataFrame([(list(p), w) for p, w in capacity.items()], "pattern array<string>, w long")
    is_large = F.col("n_tokens") * LARGE > F.col("w")
    large = [(tuple(r["pattern"]), r["n_tokens"], r["record"]) for r in one.join(F.broadcast(weight), "pattern").where(is_large).collect()]  # fewer than LARGE a pattern
    large.sort(key=lambda r: (-r[1], r[2]))
    whole = largest_whole(capacity, repeats, share) if total is None else float(total)
    best = None
    for _ in range(TRIES if total is None else 1):
        tried = routed_large(whole, capacity, repeats, share, large)
        reached = tried[4]
        off = max(abs(reached[s] / max(sum(reached.values()), 1e-9) - x) for s, x in share.items())
        if best is None or off < best[0] - 1e-4:
            best = (off, tried)
        part = min(reached[s] / (x * whole) if x * whole else 1.0 for s, x in share.items())
        if off < NEAR or not 0 < part < 1:
            break
        whole *= part  # whole records can't give a source its quota: a smaller whole, in which they may
    routed, rest, left, by_hand, _ = best[1]
    # The others: whole rounds, and a stretch of the pattern's order for what is left of a round.
    stretches = []
    for p, w in rest.items():
        begin = 0.0
        for s in p:
            f = min(max(0.0, left[p, s]), float(w * repeats[s]))
            rounds = int(f // w) if w else 0
            upto = begin + (f - rounds * w if w else 0.0)
            stretches.append((list(p), s, rounds, begin, upto, w))
            begin = upto % w if w else 0.0
    small = one.join(F.broadcast(weight), "pattern").where(~is_large).select("record", "pattern", "n_tokens", F.xxhash64("record", F.lit(SEED)).alias("place"))
    placed = running(small, ["pattern"], ["place", "record"], {"position": F.col("n_tokens")}, F.shiftright("place", 54))
    bounds = spark.createDataFrame(stretches, "pattern array<string>, source string, rounds long, begin double, upto double, w long")
    middle = F.col("position") + F.col("n_tokens") / 2
    within = lambda shift: (middle + shift >= F.col("begin")) & (middle + shift < F.col("upto"))
    docs = recs.select("doc_id", "source", "record", "n_tokens")
    positions = placed.select("record", "pattern", "position")
    ordinary = docs.join(positions, "record").join(F.broadcast(bounds), ["pattern", "source"])
    ordinary = ordinary.withColumn("repeats", F.col("rounds") + F.when(within(F.lit(0)) | within(F.col("w")), 1).otherwise(0))
    hand = spark.createDataFrame(by_hand, "record string, source string, repeats long") if by_hand else spark.createDataFrame([], "record string, source string, repeats long")
    single = docs.join(F.broadcast(hand), ["record", "source"])
    columns = ("doc_id", "source", "n_tokens", F.col("repeats").cast("long").alias("repeats"))
    return ordinary.select(*columns).unionAll(single.select(*columns)).where("repeats > 0"), wanted


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    """p7_mixture: the documents to take, and how often."""
    return plan(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def shares(mixed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each target's part of the mixture, actual and wanted. A row per target."""
    of = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeated"))
    joined = wanted.join(of, "source", "left").fillna(0, ["tokens", "documents", "most_repeated"])
    total = joined.agg(F.sum("tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    part = F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0))
    aim = F.coalesce(F.try_divide("weight", "all_weight"), F.lit(0.0))
    return joined.crossJoin(total).select("source", "weight", "max_repeats", "documents", "tokens", "most_repeated", aim.alias("target_part"), part.alias("actual_part"), (aim - part).alias("shortfall"))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """p7_report: targets against actual parts."""
    return shares(*plan(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))
