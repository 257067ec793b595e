"""The operators beside the dealt problems: goldens, edge rows, and each query against its SQL."""

import json
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from episodelake import cli, plans, sinks, streaming
from episodelake.functions import arrays, udfs
from episodelake.operators import detectors, health, logs, partitions, sampling, schemas, warehouse
from episodelake.sources import containers
from episodelake.sources.dataset import Dataset, motor_names

TOY = [(0, i, t, 50) for i, t in enumerate([0.0, 0.02, 0.04, 0.08, 0.10])] + [(1, i, t, 50) for i, t in enumerate([0.0, 0.02, 0.02, 0.04])]


def test_sync_toy(spark):
    df = spark.createDataFrame(TOY + [(2, 0, 0.0, 50)], "episode_index long, frame_index long, timestamp double, fps long")
    got = {r["episode_index"]: r for r in warehouse.build_sync(df).collect()}
    assert (got[0]["n_dropped"], got[0]["n_duplicates"], got[0]["sync_error_flag"]) == (1, 0, True)
    assert got[0]["max_gap_s"] == pytest.approx(0.04) and got[0]["drift_ms"] == pytest.approx(20) and got[1]["drift_ms"] == pytest.approx(-20)
    assert (got[1]["n_dropped"], got[1]["n_duplicates"], got[1]["sync_error_flag"]) == (0, 1, True)
    assert got[2]["n_dropped"] is None and got[2]["sync_error_flag"] is None and got[2]["drift_ms"] == 0
    strict = {r["episode_index"]: r for r in warehouse.build_sync(df, strict=True).collect()}
    assert strict[2]["n_dropped"] == 0 and strict[2]["sync_error_flag"] is False
    one = warehouse.build_sync(df.repartition("episode_index"))
    assert one._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 0


def test_reconcile_keeps_all_three_kinds(spark):
    a = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 1)], "episode_index long, num_frames long")
    b = spark.createDataFrame([(1, 5), (2, 6), (3, None), (5, 1)], "episode_index long, length long")
    assert sorted(r[0] for r in warehouse.reconcile(a, b).collect()) == [2, 3, 4, 5]
    assert sorted(r[0] for r in warehouse.reconcile_inner(a, b).collect()) == [2]
    with pytest.raises(warehouse.ReconcileError):
        warehouse.gate(warehouse.reconcile(a, b))


def test_arrays(spark):
    v = [float(i) for i in range(14)]
    df = spark.createDataFrame([(v, v), ([1.0], v), (None, v)], "a array<float>, b array<float>")
    got = df.select(arrays.norm("a").alias("n"), arrays.distance("a", "b").alias("d"), arrays.swapped("b").alias("s"), arrays.close("a", "b").alias("c"), arrays.vector("a", on_mismatch="null").alias("v"), arrays.first_or_null("a").alias("f")).collect()
    assert got[0]["n"] == pytest.approx(math.sqrt(819)) and got[0]["d"] == 0 and got[0]["s"] == v[7:] + v[:7] and got[0]["c"] and got[0]["f"] == 0.0
    assert got[1]["d"] is None and got[1]["c"] is False and got[1]["v"] is None and got[2]["n"] is None and got[2]["v"] is None and got[2]["f"] is None
    with pytest.raises(PySparkException):
        df.select(arrays.vector("a")).collect()
    for f in (udfs.batch_norm(), udfs.row_norm()):
        assert [r[0] for r in df.select(f("b")).collect()] == pytest.approx([math.sqrt(819)] * 3, rel=1e-6)
    sizes = udfs.map_batches(spark.range(1000), lambda b: b, "id long", rows=256)
    assert sizes.count() == 1000
    import pyarrow as pa

    assert np.isnan(udfs.Collate(2)(pa.record_batch([pa.array([[1.0, 2.0], [3.0], None])], ["x"]))["x"]).sum() == 4
    shown = spark.range(1).select(arrays.video_path(F.lit("observation.images.top"), F.lit(2), F.lit(11)), arrays.camera(F.lit("observation.images.top"))).first()
    assert tuple(shown) == ("videos/observation.images.top/chunk-002/file-011.mp4", "top")


def test_outliers_and_z(spark):
    rows = [(i, [1.0] * 14) for i in range(50)] + [(99, [50.0] * 14)]
    flagged = warehouse.build_flags(spark.createDataFrame(rows, "episode_index long, action array<float>"))
    assert [r["episode_index"] for r in flagged.where("action_magnitude_outlier").collect()] == [99]
    errors = "episode_index long, action_error double"
    assert detectors.z_flags(spark.createDataFrame([(1, 0.3)], errors)).first()["flagged"] is False
    assert detectors.z_flags(spark.createDataFrame([(i, 0.3) for i in range(5)], errors)).where("flagged").isEmpty()
    assert [r[0] for r in detectors.z_flags(spark.createDataFrame([(i, 0.3) for i in range(9)] + [(9, 0.9)], errors)).where("flagged").collect()] == [9]


def test_held_runs_and_gaps(spark):
    x = [0, 0, 0, 1, 1, 1, 1, 2]
    rows = [(1, i, i, [float(v)] * 3) for i, v in enumerate(x)]
    runs = sorted(tuple(r) for r in detectors.held_runs(spark.createDataFrame(rows, "episode_index long, frame_index long, index long, action array<float>")).collect())
    assert runs == [(1, 0, 3), (1, 3, 4), (1, 7, 1)]
    df = spark.createDataFrame([(e, i, i, t, f) for e, i, t, f in TOY], "episode_index long, frame_index long, index long, timestamp double, fps long")
    assert [(r[0], r[1]) for r in detectors.dropped_frames(df).collect()] == [(0, 2)]


def test_arm_flip_and_following(spark):
    r = np.random.default_rng(0)
    base = np.concatenate([np.full(7, 1.0), np.full(7, -1.0)])
    rows = []
    for e in range(7):
        b = np.concatenate([base[7:], base[:7]]) if e == 3 else base
        a = [(b + r.normal(0, 0.01, 14)).tolist() for _ in range(12)]
        rows += [(e, i, i, a[max(0, i - 1)], a[i]) for i in range(12)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, index long, `observation.state` array<double>, action array<double>")
    assert [x[0] for x in detectors.arm_flips(detectors.joint_means(df)).where("flipped").collect()] == [3]
    assert all(x["action_error"] == pytest.approx(0) for x in detectors.following_error(df).collect())


def test_coverage_modes(spark):
    frozen = [float(i) for i in range(14)]
    rows = [(1, i, i, frozen, [0.5] * 14) for i in range(9)] + [(2, i, i, None, [float(i)] * 14) for i in range(9)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, index long, `observation.state` array<float>, action array<float>")
    status = lambda mode: {(r[0], r[1]): r[2] for r in detectors.coverage(df, detectors.MODALITIES, mode=mode).collect()}
    assert status("flattened") == {(1, "observation.state"): "present", (1, "action"): "degenerate", (2, "observation.state"): "absent", (2, "action"): "present"}
    assert status("per_dim")[1, "observation.state"] == "degenerate"
    for n in (1, 2, 7, 40):
        got = spark.range(1).select(detectors.even_positions(F.lit(n).cast("long"), 10)).first()[0]
        assert got == np.linspace(0, n - 1, 10, dtype=int).tolist()
    assert detectors.is_modality("observation.images.top") and not detectors.is_modality("observation.effort")


def test_health(spark):
    rows = [(1, True, 1.0, True, 0.03), (2, False, 1.0, True, 0.0), (3, True, 1.0, False, None), (4, True, 0.5, True, 0.0), (5, True, 1.0, True, 0.15), (6, True, 1.0, True, None), (7, True, 1.0, True, math.nan)]
    df = spark.createDataFrame(rows, "episode_id long, schema_ok boolean, sensor_coverage double, sync_ok boolean, action_error double")
    got = {r["episode_id"]: (r["score"], r["decision"]) for r in health.health_table(df).collect()}
    assert got == {1: (0.95, "included"), 2: (0.0, "excluded"), 3: (0.6667, "insufficient_data"), 4: (0.875, "flagged"), 5: (0.75, "flagged"), 6: (1.0, "insufficient_data"), 7: (0.75, "flagged")}
    table = health.health_table(df)
    assert health.summary(table).first()["action_outliers"] == 2 and [r[0] for r in health.worst(table).collect()][0] == 3
    assert health.ci_gate(health.summary(table)) == 1 and health.ci_gate(health.summary(table.where("episode_id = 1"))) == 0 and health.ci_gate(health.summary(table.where("episode_id = 0"))) == 0
    assert {r["episode_id"]: r["decision"] for r in health.health_table(df, health.naive).collect()}[6] == "flagged"
    text = sinks.markdown(table, "toy", "all")
    assert "7 episodes" in text and "## Excluded\n\n2\n" in text


def index(keys, holes=()):
    return [(e, e * 10 + (5 if e in holes else 0), e * 10 + 10, k) for e, k in enumerate(keys)]


INDEX = "episode_index long, dataset_from_index long, dataset_to_index long, k string"


def test_file_groups_are_runs(spark):
    groups = partitions.file_groups(spark.createDataFrame(index("AABAA"), INDEX), ["k"])
    assert sorted((r["from_index"], r["to_index"], r["n_episodes"]) for r in groups.collect()) == [(0, 20, 2), (20, 30, 1), (30, 50, 2)]
    assert partitions.open_counts(groups, 3).first()["reduction"] == pytest.approx(15 / 9, abs=1e-6) and partitions.smallest(groups).first()["from_index"] == 20
    with pytest.raises(PySparkException):
        partitions.file_groups(spark.createDataFrame(index("AAB", holes=[1]), INDEX), ["k"]).collect()
    assert partitions.key_columns(("c",)) == ["videos/c/chunk_index", "videos/c/file_index"]


def test_windows_are_half_open(spark):
    w = spark.createDataFrame([(1, "f", 0.0, 10.0), (2, "f", 10.0, 30.0), (3, "f", 50.0, 60.0), (4, "g", 0.0, 9.0)], "ep long, file string, lo double, hi double")
    t = spark.createDataFrame([("f", x) for x in (-1.0, 0.0, 9.9, 10.0, 29.99, 30.0)] + [("g", 8.0)], "file string, t double")
    assert {r[0]: r[1] for r in partitions.window_counts(w, t, "file", "ep").collect()} == {1: 2, 2: 2, 3: 0, 4: 1}
    lengths = spark.createDataFrame([(e, 50) for e in range(3)], "episode_index long, length long")
    assert sorted((r[1], r[2]) for r in partitions.episode_offsets(lengths, 50).collect()) == [(0, 0), (50, 10**9), (100, 2 * 10**9)]


def test_logs(spark):
    rows = [("a", t, i, None) for i, t in enumerate([0, 10, 20, 50, 60])] + [("b", 7, 9, "std/x")] + [("c", 5, 20, "unknown"), ("c", 5, 21, "unknown"), ("d", 9, 30, "m/s"), ("d", 3, 31, "m/s")]
    log = spark.createDataFrame(rows, "topic string, log_time long, seq long, msgtype string")
    got = {r["topic"]: r for r in logs.topic_stats(log).collect()}
    assert (got["a"]["median_gap_ns"], got["a"]["n_flagged"], got["a"]["non_monotonic"]) == (10.0, 1, 0)
    assert got["b"]["median_gap_ns"] is None and got["b"]["implied_hz"] is None and got["b"]["count"] == 1 and got["b"]["non_monotonic"] == 0 and got["b"]["duration_s"] == 0.0
    assert got["c"]["n_flagged"] == 0 and got["c"]["implied_hz"] is None and got["d"]["non_monotonic"] == 1
    assert [(r[1], r[2]) for r in logs.flagged(logs.gaps(log), logs.topic_stats(log)).collect()] == [(2, 30)]
    kinds = {(r["topic"]): (r["typed"], r["message_encoding"]) for r in logs.connections(log).collect()}
    assert kinds == {"a": (False, "json"), "b": (True, "cdr"), "c": (False, "json"), "d": (True, "cdr")}
    assert logs.file_summary(log).first()["channels"] == {"a": 5, "b": 1, "c": 2, "d": 2}
    assert "and" in sinks.gap_text(logs.topic_stats(log), logs.flagged(logs.gaps(log), logs.topic_stats(log)), 0)


def test_messages(spark, tmp_path):
    frames = spark.createDataFrame([(1, i, i, i / 50, [1.0, 2.0], [3.0]) for i in range(3)], "episode_index long, frame_index long, index long, timestamp double, `observation.state` array<float>, action array<float>")
    m = logs.messages(frames)
    assert m.count() == 6 and {r["sequence"] for r in m.collect()} == {0, 1, 2}
    assert json.loads(logs.messages(frames, split=False).where("seq = 1").first()["payload"]) == {"frame_index": 1, "episode_index": 1, "state": [1.0, 2.0], "action": [3.0]}
    sinks.log(m, str(tmp_path / "log"), {"source": "toy"}, "lz4")
    assert cli.main(["inspect", str(tmp_path / "log")], spark) == 0


@given(st.integers(0, 60), st.integers(1, 9))
@settings(max_examples=6, deadline=None)
def test_shards_are_equal(spark, n, k):
    got = sampling.equal_shards(spark.range(n).toDF("i"), k, "i", F.floor(F.col("i") / 8)).groupBy("shard").count().collect()
    assert {r["count"] for r in got} <= {n // k} and sum(r["count"] for r in got) == n // k * k


def test_sampling(spark):
    all_, bad = spark.range(30).toDF("episode_index"), spark.createDataFrame([(7,), (3,)], "episode_index long")
    sample = sampling.tiered_sample(all_, bad, k=10)
    got = [(r[0], r[1]) for r in sample.collect()]
    assert got[:2] == [(3, True), (7, True)] and len(got) == 10 and got == [tuple(r) for r in sampling.tiered_sample(all_, bad, k=10).collect()]
    assert sampling.never_checked(all_, sample).count() == 20
    s = sampling.tier_summary(all_, bad, sample).first()
    assert s["verdict"] == "FAIL" and s["visual_pct"] == pytest.approx(100 / 3, abs=1e-5) and sampling.tier_summary(all_.limit(0), bad.limit(0), sample).first()["tabular_pct"] == 0.0
    assert sampling.episode_range("3-99", 5) == [3, 4] and sampling.episode_range("all", 2) == [0, 1] and sampling.episode_range("1,4", 3) == [1]
    with pytest.raises(ValueError):
        sampling.episode_range("9", 3)
    assert sorted(r[0] for r in sampling.shuffled(all_, "episode_index").collect()) == list(range(30))


def test_schemas_and_containers(spark, tmp_path):
    step = lambda action, cam: T.StructType([T.StructField("observation", T.StructType([T.StructField(cam, T.BinaryType())])), T.StructField("action", action)])
    a = step(T.StructType([T.StructField("xyz", T.ArrayType(T.FloatType())), T.StructField("grip", T.FloatType())]), "top")
    b = step(T.StructType([T.StructField("xyz", T.ArrayType(T.DoubleType()))]), "side")
    got = {(r["section"], r["key"], r["kind"]) for r in schemas.schema_diff(spark, a, b).collect()}
    assert got == {("observation", "top", "only in a"), ("observation", "side", "only in b"), ("action", "grip", "only in a"), ("action", "xyz", "mismatch")}
    assert schemas.schema_diff(spark, step(T.ArrayType(T.FloatType()), "top"), b).where("section = 'action'").count() == 1
    df = spark.createDataFrame([(([1.0, 2.0], 3.0),)], "action struct<xyz:array<float>,grip:float>")
    assert schemas.leaf_dims(df, "action").first()["dims"] == 3
    (tmp_path / "c").mkdir()
    (tmp_path / "c/good.log").write_bytes(b"1\n2\n")
    (tmp_path / "c/bad.log").write_bytes(b"x\n")
    rows, bad = containers.read(spark, str(tmp_path / "c"), "t double", lambda data: [(float(x),) for x in data.split()])
    assert sorted(r["t"] for r in rows.collect()) == [1.0, 2.0] and "ValueError" in bad.first()["error"]
    with pytest.raises(containers.MissingReader):
        containers.decoder("mcap")
    assert motor_names({"motors": ["a"]}) == motor_names(["a"]) == ["a"] and motor_names(None) == []


@pytest.fixture
def dataset(spark, tmp_path):
    rows = [(e, i, e * 20 + i, 3, i / 50, [float(i), 0.1], [float(i), 0.1], i == 19) for e in range(3) for i in range(20)]
    root = str(tmp_path / "ds")
    spark.createDataFrame(rows, "episode_index long, frame_index long, index long, task_index long, timestamp float, `observation.state` array<float>, action array<float>, `next.done` boolean").write.parquet(f"{root}/data/chunk-000")
    spark.createDataFrame([(e, 20, e * 20, e * 20 + 20, 0, e // 2) for e in range(3)], "episode_index long, length long, dataset_from_index long, dataset_to_index long, `videos/top/chunk_index` long, `videos/top/file_index` long").write.parquet(f"{root}/meta/episodes/chunk-000")
    (tmp_path / "ds/meta/info.json").write_text(json.dumps({"fps": 50, "robot_type": "007", "codebase_version": "v3.0"}))
    return root


def test_dataset_and_commands(spark, dataset, tmp_path):
    d = Dataset(spark, dataset)
    assert d.count() == 60 and d.frames("observation.state").columns == ["observation.state"] and d.rows(5, 9, "action").count() == 4
    assert [r["frame_index"] for r in d.trajectory(1).collect()] == list(range(20)) and d.bounds(2) == (40, 60) and sorted(r["index"] for r in d.first_frames().collect()) == [0, 20, 40]
    with pytest.raises(ValueError):
        d.trajectory(9)
    with pytest.raises(ValueError):
        d.bounds(9)
    out = str(tmp_path / "out")
    assert cli.main(["flags", dataset, "--out", out], spark) == 0
    assert cli.main(["warehouse", dataset, "--out", out, "--flags", f"{out}/frame_flags"], spark) == 0
    assert cli.main(["warehouse", dataset, "--out", out], spark) == 0  # again: no copies
    episodes = warehouse.keyed(spark.read.parquet(f"{out}/episodes"))
    assert episodes.count() == 3 and dict(episodes.dtypes)["robot"] == "string" and spark.read.parquet(f"{out}/robots").count() == 1
    assert spark.read.parquet(f"{out}/episode_quality").where("any_flag = false").count() == 3
    assert cli.main(["sync", dataset, "--json", f"{out}/checked"], spark) == 0 and cli.main(["partitions", dataset, "--cameras", "top"], spark) == 0
    assert cli.main(["coverage", dataset, "--out", f"{out}/coverage"], spark) == 0
    spark.createDataFrame([(9, 5, 60, 65, 0, 2)], spark.read.parquet(f"{dataset}/meta/episodes/chunk-000").schema).write.mode("append").parquet(f"{dataset}/meta/episodes/chunk-000")
    assert cli.main(["warehouse", dataset, "--out", str(tmp_path / "none")], spark) == 2 and not (tmp_path / "none").exists()


def test_stream(spark, tmp_path):
    schema = "episode_index long, frame_index long, timestamp double, fps long, action array<float>"
    rows = [(e, i, t, f, [0.0] * 14) for e, i, t, f in TOY] + [(None, 0, 0.0, 50, [0.0] * 14), (5, 0, -1.0, 50, [0.0] * 14), (5, 0, 1.0, 50, [0.0])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = streaming.collect(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/frames")).count() == 9 and spark.read.parquet(str(tmp_path / "out/rejected")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out/sync")).where("sync_error_flag").count() == 2


def test_every_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("frames", "robots", "episodes", "episode_meta", "sync", "episode_quality", "events", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    shown = lambda r: tuple("nan" if isinstance(v, float) and v != v else v for v in r)
    for name, (query, text) in plans.registry.registered().items():
        if name.startswith("p"):
            continue
        df = query(spark, folder)
        columns = sorted(df.columns)
        rows = sorted(map(repr, (shown(r) for r in df.select(columns).collect())))
        if text:
            names = ", ".join('"' + x + '"' for x in columns)
            assert rows == sorted(map(repr, (shown(r) for r in c.sql(f"SELECT {names} FROM ({text})").fetchall()))), name
