"""Problems 4 to 8 on small tables: known results, brute force, round trips, and the cases that the docstrings define."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from episodelake.llm import encode, mix, percentiles, personal, splits

AT = dt.datetime(2024, 3, 5)
FRAMES = "episode_index long, frame_index long, task_index long, index long"


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder()


# 4


def test_percentiles_exact_when_small_and_copies_once(run):
    months = [AT + dt.timedelta(days=31 * k) for k in range(3)]
    quality = [(e, "a", float(e), months[e % 3]) for e in range(1, 100)] + [(5, "a", 5.0, months[0]), (200, "a", math.nan, AT), (201, "a", None, AT), (202, None, 7.0, AT)]
    sync = [(1, "a", 0.5, -2.0, AT), (2, "a", None, None, AT)]
    tables = {
        "episode_quality": (quality, "episode_index long, robot string, action_magnitude float, ingested_at timestamp_ntz"),
        "sync": (sync, "episode_index long, robot string, max_gap_s double, drift_ms double, ingested_at timestamp_ntz"),
    }
    got = run("p4_percentiles", **tables)
    half = {(robot, metric): (n, value, error) for robot, metric, n, p, value, error in got if p == 0.5}
    assert half == {("a", "episode_quality.action_magnitude"): (99, 50.0, 0.0), (None, "episode_quality.action_magnitude"): (1, 7.0, 0.0), ("a", "sync.max_gap_s"): (1, 0.5, 0.0), ("a", "sync.drift_ms"): (1, -2.0, 0.0)}
    assert len(got) == 4 * len(percentiles.PERCENTILES)
    assert run("p4_percentiles", **{n: ([], s) for n, (_, s) in tables.items()}) == []


def test_percentiles_keep_the_stated_error_when_months_are_merged(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.lognormal(0, 3, 120_000), -r.lognormal(1, 2, 30_000), np.full(20_000, 3.0)])
    r.shuffle(values)
    # A hot robot with nearly all rows, and months that are sketched apart in several partitions.
    rows = [("hot", "m", f"2024-{1 + i % 4:02d}", float(v)) for i, v in enumerate(values)] + [("cold", "m", "2024-01", 1.0)]
    df = spark.createDataFrame(rows, "robot string, metric string, month string, value double").repartition(7)
    kept = percentiles.sketches(df).cache()
    assert kept.selectExpr("max(size(items))").first()[0] < 2000
    got = percentiles.percentiles(percentiles.merged(kept, "robot", "metric")).where("robot = 'hot'").collect()
    whole = np.sort(values)
    assert {g["n"] for g in got} == {len(values)} and len(got) == len(percentiles.PERCENTILES)
    for g in got:
        low, high = np.searchsorted(whole, g["value"], "left") / len(whole), np.searchsorted(whole, g["value"], "right") / len(whole)
        p = g["percentile"]
        off = max(0.0, low - p, p - high)
        assert off <= g["rank_error"] + 2 / len(whole), (p, off, g["rank_error"])
        assert g["rank_error"] == pytest.approx(percentiles.EPSILON * min(p, 1 - p))


# 5


def test_linked_tasks_and_splits(spark, run):
    rows = [(1, 0, 4, 0), (1, 1, 7, 1), (2, 0, 7, 2), (2, 1, 9, 3), (3, 0, -1, 4), (3, 1, 2, 5), (4, 0, -1, 6), (4, 1, 3, 7), (4, 2, None, 8), (5, 0, None, 9), (None, 0, 9, 10), (None, 1, None, 11)]
    tables = {"frames": (rows, FRAMES)}
    assert sorted(run("p5_found", **tables)) == [(4, 7), (4, 9), (7, 9)]
    got = run("p5_split", **tables)
    assert len(got) == len(rows)
    assert {r[-1] for r in got} <= set(splits.SHARES)
    assert run("p5_found", frames=([], FRAMES)) == [] and run("p5_split", frames=([], FRAMES)) == []


def test_components_of_a_long_chain(spark):
    n = 150
    order = list(range(n))
    random.Random(4).shuffle(order)
    chain = [(f"n{a:04d}", f"n{b:04d}") for a, b in zip(order[:-1], order[1:])] + [("x1", "x2")]
    got = splits.components(spark.createDataFrame(chain, "a string, b string")).collect()
    assert {r["component"] for r in got if r["node"].startswith("n")} == {"n0000"} and len(got) == n + 2


def test_splits_hold_proportions_and_keep_together(spark):
    r = random.Random(6)
    rows = [(e, f, (e % 40 if r.random() < 0.9 else -1) if e % 3 else None, e * 100 + f) for e in range(600) for f in range(1 + e % 7)]
    rows += [(10_000 + e, 0, 777, e) for e in range(900)]  # a task with a third of all rows
    frames = spark.createDataFrame(rows, FRAMES)
    members, parts, quarantined = splits.update(frames)
    got = splits.assigned(frames, members, parts).toPandas()
    assert len(got) == len(rows) and quarantined.isEmpty()
    assert got.groupby("episode_index")["split"].nunique().max() == 1
    known = got[got["task_index"].notna() & (got["task_index"] != -1)]
    assert known.groupby("task_index")["split"].nunique().max() == 1
    part = got["split"].value_counts(normalize=True)
    assert all(abs(part[s] - x) < 0.03 for s, x in splits.SHARES.items()), part


def test_increments_keep_splits_and_quarantine_conflicts(spark, tmp_path):
    state = str(tmp_path / "state")
    first = spark.createDataFrame([(e, f, e % 10, e * 10 + f) for e in range(100) for f in range(5)], FRAMES)
    members, parts, _ = splits.update(first, state)
    before = {r["node"]: r["split"] for r in members.join(parts, "component").collect()}
    task = lambda t: f"task:{t:020d}"
    train = [t for t in range(10) if before[task(t)] == "train"]
    other = next(t for t in range(10) if before[task(t)] != "train")
    # 500 and 501 are new episodes: one joins two train tasks and a new task, the other a train task, another split's and a new task.
    second = [(500, 0, train[0], 0), (500, 1, train[1], 1), (500, 2, 50, 2), (501, 0, train[2], 3), (501, 1, other, 4), (501, 2, 60, 5), (502, 0, 70, 6)]
    frames = spark.createDataFrame(second, FRAMES)
    members, parts, quarantined = splits.update(frames, state)
    after = {r["node"]: r["split"] for r in members.join(parts, "component").collect()}
    assert all(after[n] == s for n, s in before.items())
    assert after[task(50)] == "train" and after[task(60)] == splits.QUARANTINE and after[task(70)] in splits.SHARES
    assert {r["split"] for r in quarantined.collect()} == {"train", before[task(other)]}
    got = {r["episode_index"]: r["split"] for r in splits.assigned(frames, members, parts).collect()}
    assert got[500] == "train" and got[501] == splits.QUARANTINE
    # An update with nothing new changes nothing.
    again, parts_again, _ = splits.update(spark.createDataFrame([], FRAMES), state)
    assert {r["node"]: r["split"] for r in again.join(parts_again, "component").collect()} == after


# 6

TEXTS = ["", "Hello world", "<|endoftext|>", "a" * 3000, " " * 700 + "x", "\r\n\r\n  tab\t\tend  ", "it's we'll they're" * 50, "数据 naïve e\u0301 🙂👩‍👩‍👧 \u2028 end", "\x00\x1c nul", "1234567890" * 90 + "\n\n\n" + "=" * 500, "if x:\n        y = 'z'\n\n\n" * 60]


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'stremlvd1aé数.-_"), st.characters(exclude_categories=["Cs"])), max_size=200), st.integers(1, 40), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_joining_at_any_cut_gives_the_library_s_ids(text, leaf, window):
    e = encoder_once()
    old, encode.WINDOW = encode.WINDOW, window
    try:
        ids = e.encode(text, leaf)
    finally:
        encode.WINDOW = old
    assert ids.tolist() == e.library.encode_ordinary(text)
    assert e.decode(ids) == text


_kept = []


def encoder_once():
    if not _kept:
        _kept.append(encode.Encoder())
    return _kept[0]


@pytest.mark.parametrize("leaf", [1, 7, 64, 1000])
def test_hard_texts_at_fixed_cuts(encoder, leaf):
    for t in TEXTS:
        assert encoder.encode(t, leaf).tolist() == encoder.library.encode_ordinary(t), (t[:30], leaf)


def test_corpus_ids(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "long words and lines\n" * 9000, "x"), (91, "b" * 150_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode.corpus_ids(df, leaf=4096).collect()
    library = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    sizes = {r["doc_id"]: r["n_tokens"] for r in encode.corpus_ids(df.where("doc_id < 91"), leaf=4096, sizes=True).collect()}
    assert sizes == {i: len(x) for i, x in want if i < 91}
    assert encode.corpus_ids(df.where("doc_id < 0")).collect() == []


def test_corpus_ids_on_test_data(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.corpus_ids(docs, leaf=2048).collect()}
    want = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    assert got == want


# 7


def test_flow_meets_quotas_at_least_repetition():
    capacity, repeats = {("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 2, "b": 3}
    f = mix.flow(capacity, repeats, {"a": 120.0, "b": 60.0})
    assert sum(v for (p, s), v in f.items() if s == "a") == pytest.approx(120) and sum(v for (p, s), v in f.items() if s == "b") == pytest.approx(60)
    by = {p: sum(v for (q, s), v in f.items() if q == p) for p in capacity}
    assert by[("a",)] == pytest.approx(100) and by[("a", "b")] + by[("b",)] == pytest.approx(80)
    cost = lambda x, w: sum(k * max(0.0, min(w, x - (k - 1) * w)) for k in range(1, 9))
    best = min(cost(100 + d, 100) + cost(80 - d - e, 50) + cost(e, 10) for d in range(0, 60, 5) for e in range(0, 31, 5) if 80 - d - e >= 0)
    assert sum(cost(by[p], w) for p, w in capacity.items()) == pytest.approx(best)
    assert mix.largest_whole({("a",): 100, ("b",): 10}, {"a": 1, "b": 2}, {"a": 0.5, "b": 0.5}) == pytest.approx(40, abs=0.5)


def test_mixture(spark):
    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["tide", "joint", "x"]) for _ in range(5 + i % 40)), " A" if i % 3 else "b") for i in range(600)]
    texts += [(1000 + i, texts[i][1], "b" if i % 3 else "A ") for i in range(0, 90)]  # in both sources
    texts += [(5000, "gone " * 9, "c"), (5001, "no", None), (5002, None, "a"), (5003, "", "b"), (5004, "y " * 4000, "d"), (5005, "y", "d")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in texts], "doc_id long, text string, source string, n_tokens int")
    wanted = spark.createDataFrame([("a", 0.5, 3), ("B", 0.4, 4), ("none", 0.4, 5), ("d", 0.0, 2), ("", None, None)], "source string, target_weight double, max_repeats int")
    mixed, targets = mix.plan(docs, wanted)
    got = mixed.collect()
    assert len({g["doc_id"] for g in got}) == len(got)
    assert max(g["repeats"] for g in got if g["source"] == "a") <= 3 and max(g["repeats"] for g in got if g["source"] == "b") <= 4
    report = {x["source"]: x for x in mix.shares(mixed, targets).collect()}
    assert report["a"]["actual_part"] == pytest.approx(5 / 9, abs=0.01) and report["b"]["actual_part"] == pytest.approx(4 / 9, abs=0.01)
    assert report["none"]["actual_part"] == 0 and report["none"]["shortfall"] == pytest.approx(0.4 / 1.3)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix.plan(docs, wanted)[0].collect()))
    assert mix.plan(docs.where("doc_id < 0"), wanted)[0].collect() == []


def test_mixture_with_one_huge_document(spark):
    docs = spark.createDataFrame([(0, "x " * 30_000, "a"), *((i, "y " * 50, "a") for i in range(1, 100)), *((i, f"z{i} " * 60, "b") for i in range(100, 900))], "doc_id long, text string, source string")
    wanted = spark.createDataFrame([("a", 0.5, 5), ("b", 0.5, 1)], "source string, target_weight double, max_repeats int")
    mixed, targets = mix.plan(docs, wanted)
    report = {x["source"]: x["actual_part"] for x in mix.shares(mixed, targets).collect()}
    assert abs(report["a"] - 0.5) < 0.02, report


# 8

GIVEN, FAMILY = {"Veë", "Tador", "Nyvika", "Salisse", "Jormund"}, {"Umbbruck", "Moréval", "Okested", "Larachi"}


def corpus(n=400):
    """Texts with known mentions, each of them in several forms, and what only looks like one."""
    r = random.Random(12)
    out = []
    for i in range(n):
        first, last = r.choice(sorted(GIVEN)), r.choice(sorted(FAMILY))
        name = r.choice([f"{first} {last}", f"{last}, {first}", f"{first} K. {last}-{r.choice(sorted(FAMILY))}"])
        mail = r.choice([f"{first.lower()[:2]}.x{i}@tide.example", f"n{i} (at) kiln [dot] example", f"m{i} AT loom DOT example"])
        phone = r.choice(["+1-233-555-0122", "(270) 555-0189", "020 7946 0317", "07700 900786", "+33 1 99 00 15 08"])
        number = r.choice(["996-82-0390", "QQ 42 79 76 B", "QQ655664D", "00 876 749 761"])
        street = r.choice(["12 Thornlow Street", "Calle Fern 229", "Hazelweg 4", "318 rue de Rook"])
        parts = [
            ("# %% 🙂 In [3]:\nReviewed by Dr. ", None), (name, "person_name"), (" on a Tuesday.\r\nnotify(to=['", None), (mail, "email"), ("'])\ntel. ", None), (phone, "phone"),
            (", see\nrow 3: ssn=", None), (number, "id_number"), (f", balance 3.5\nlot = '{r.randrange(1, 9)}13-25-904{i % 10}'  # lot no. of the tide\nLab visits: ", None), (street, "street_address"),
            (f", Port Quellan 0341{i % 10}.\n!git clone git@code.loom.example:a/b.git kit@0.39.{i % 10}\nrun_id = 1281281287\nsee the Random Forest section. Rolling Windows\nEpoch 4/50 - loss: 87.1\n", None),
        ]
        text, truth = "", set()
        for t, kind in parts:
            if kind:
                truth.add((i, kind, len(text)))
            text += t
        out.append((i, text, truth))
    return out


def test_personal_information(spark):
    cases = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in cases] + [(900, None, "x"), (901, "", "x"), (902, "nothing here", "x")], "doc_id long, text string, kind string")
    names = spark.createDataFrame([("given", n) for n in GIVEN] + [("family", n) for n in FAMILY] + [("family", None)], "role string, name_part string")
    truth = set().union(*(t for _, _, t in cases))
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in personal.mentions(docs, names).collect()}
    for kind in personal.KINDS:
        t, g = {x for x in truth if x[1] == kind}, {x for x in got if x[1] == kind}
        assert len(t & g) / len(t) >= 0.9 and len(t & g) / len(g) >= 0.9, (kind, len(t & g), len(t), len(g))
    red = {r["doc_id"]: r["text"] for r in personal.redaction(docs, names).collect()}
    assert red[900] is None and red[901] == "" and red[902] == "nothing here" and len(red) == len(cases) + 3
    ends = personal.mentions(docs, names).where("doc_id = 0").collect()
    text = cases[0][1]
    for r in sorted(ends, key=lambda r: -r["start_pos"]):
        text = text[: r["start_pos"]] + f"[{r['kind'].upper()}]" + text[r["end_pos"] :]
    assert red[0] == text and "[PERSON_NAME]" in text and "git@code.loom.example:a/b.git" in text
    assert personal.mentions(docs.where("doc_id < 0"), names).collect() == []


def test_labels_of_the_next_line_are_of_something_else():
    find = personal.Finder(GIVEN, FAMILY)
    votes = lambda text: next(v for _, _, kind, v in find.candidates(text) if kind == "id_number")
    assert votes("cfg['dni'] = 'QQ 37 43 78 C'\nlot = '8'")[1] == 0 and votes("x = '813-28-9048'  # lot no. of the tide")[1] == -1


def test_reliabilities_find_the_better_labeler():
    r = np.random.default_rng(3)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.3
        vote = lambda right, tell: "0" if r.random() > tell else "+" if (r.random() < right) == y else "-"  # noqa: B023, E731
        code = vote(0.95, 0.9) + vote(0.6, 0.9) + vote(0.9, 0.5) + vote(0.85, 0.8)
        counts[code] = counts.get(code, 0) + 1
    soft, labelers, prior = personal.reliabilities(counts)
    assert 0.2 < prior < 0.45 and labelers[0, 1, 2] > labelers[1, 1, 2] and labelers[0, 0, 0] > labelers[1, 0, 0]
    score = personal.classifier(counts)
    assert score["++++"] > 0.95 and score["----"] < 0.05


def test_found_against_sql(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW frames AS SELECT * FROM '{folder}/frames.parquet'")
    assert sorted(map(tuple, entry.queries()["p5_found"](spark, folder).collect())) == sorted(c.sql(entry.oracle_sql()["p5_found"]).fetchall())
