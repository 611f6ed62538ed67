"""Operators on hand-made rows with hand-computed answers, and invariants."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from skyloom.functions import text as t
from skyloom.operators import advice as a
from skyloom.operators import checks as c
from skyloom.operators import detectors as d
from skyloom.operators import fusion as fu
from skyloom.operators import grading as gr
from skyloom.operators import grid as g
from skyloom.operators import imagery as im
from skyloom.operators import metrics as m
from skyloom.operators import sampling as k
from skyloom.operators import sequences as s
from skyloom.operators import windows as w
from skyloom.shared import clear_tables, stored, tables_dir
from skyloom.sources import io

T0 = dt.datetime(2024, 1, 1)


def telemetry(spark, points):
    """points: (minutes after T0, value)"""
    return spark.createDataFrame([("Mission1", "c1", T0 + dt.timedelta(minutes=x), v, None) for x, v in points], "mission string, channel string, ts timestamp, value double, raw string")


def hourly(spark, values):
    return telemetry(spark, [(60 * i, v) for i, v in enumerate(values)])


def column(df, name, order="idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def spans(spark, rows, channel="c1"):
    return spark.createDataFrame([("Mission1", channel, *r) for r in rows], "mission string, channel string, start long, end long")


def intervals(spark, rows):
    return spark.createDataFrame([("Mission1", f"e{i}", "c1", T0 + dt.timedelta(minutes=x), T0 + dt.timedelta(minutes=y)) for i, (x, y) in enumerate(rows)], "mission string, id string, channel string, start_time timestamp, end_time timestamp")


def test_resample_fills_gaps_and_ends(spark):
    assert column(g.resample(hourly(spark, [None, 1.0, None, None, 4.0, None])), "value") == [1, 1, 2, 3, 4, 4]
    assert column(g.resample(telemetry(spark, [(10, 1.0), (50, 3.0), (185, 8.0)])), "value") == [2, 4, 6, 8]
    assert column(g.resample(hourly(spark, [float("nan"), 2.0])), "value") == [2, 2]


def test_resample_odd_cadence_starts_at_midnight(spark):
    out = g.resample(telemetry(spark, [(60 * 8, 1.0), (60 * 15, 3.0)]), 7 * 3600)
    assert [r["ts"].hour for r in out.orderBy("idx").collect()] == [7, 14]
    assert g.resample(hourly(spark, [])).count() == 0


def test_labels_use_the_bucket_start_with_closed_ends(spark):
    grid = g.resample(hourly(spark, [1.0, 2.0]))
    assert column(g.in_intervals(grid, intervals(spark, [(10, 50)])), "is_anomaly") == [False, False]
    assert column(g.in_intervals(grid, intervals(spark, [(0, 60), (30, 45)])), "is_anomaly") == [True, True]
    far = g.resample(hourly(spark, [1.0] * 72))
    assert sum(column(g.in_intervals(far, intervals(spark, [(60 * 20, 60 * 50)])), "is_anomaly")) == 31


@pytest.mark.parametrize("n,starts", [(64, [0, 16, 32]), (63, [0, 16]), (31, [])])
@pytest.mark.parametrize("stride", [16])
def test_windows_are_complete(spark, n, starts, stride):
    grid = g.resample(hourly(spark, [float(i) for i in range(n)])).withColumn("is_anomaly", F.col("idx") == 40)
    out = w.make_windows(grid, 32, stride)
    assert column(out, "start_idx", "start_idx") == starts
    assert all(r["values"] == [float(i) for i in range(r["start_idx"], r["end_idx"])] for r in out.collect())


def test_windows_with_a_stride_that_does_not_divide(spark):
    grid = g.resample(hourly(spark, [float(i) for i in range(40)])).withColumn("is_anomaly", F.lit(False))
    out = w.make_windows(grid, 32, 5)
    assert column(out, "start_idx", "start_idx") == [0, 5]
    assert [r["values"][0] for r in out.orderBy("start_idx").collect()] == [0.0, 5.0]


def test_revin_inverse_restores(spark):
    grid = g.resample(hourly(spark, [1.0, 5.0, 2.5]))
    assert np.allclose(column(g.revin_inverse(g.revin(grid).drop("value")), "value"), [1, 5, 2.5])
    flat = g.standardize(g.resample(hourly(spark, [2.0, 2.0])))
    assert column(flat, "value_std") == [0, 0]


def test_ordinal_encode(spark):
    rows = spark.createDataFrame([("value_12",), ("none",), (None,), ("1.5",)], "raw string")
    assert [r[0] for r in rows.select(g.ordinal_encode(F.col("raw"))).collect()] == [12, None, None, 5]


def test_runs_and_merge(spark):
    rows = spark.createDataFrame([("Mission1", "c1", i, x) for i, x in enumerate([0, 1, 1, 0, 1])], "mission string, channel string, i int, f int").withColumn("f", F.col("f") == 1)
    assert sorted((r["start"], r["end"]) for r in s.contiguous_runs(rows, "f").collect()) == [(1, 2), (4, 4)]
    merged = s.merge_intervals(spans(spark, [(0, 32), (16, 48), (64, 96), (200, 232)]), 16)
    assert sorted((r["start"], r["end"]) for r in merged.collect()) == [(0, 96), (200, 232)]
    inner = s.merge_intervals(spans(spark, [(0, 100), (10, 20), (110, 120)]), 16)
    assert [(r["start"], r["end"]) for r in inner.collect()] == [(0, 120)]


def test_ewma(spark):
    rows = spark.createDataFrame([("Mission1", "c1", i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "mission string, channel string, i int, error double")
    assert column(s.ewma(rows, 3), "ewma", "i") == [1, 1.5, 2.25]
    assert column(s.ewma(rows, 1), "ewma", "i") == [1, 2, 3]


@pytest.mark.parametrize("rows_a_frame", ["10000", "7", "1"])
def test_ewma_of_segments_is_that_of_whole_keys(spark, monkeypatch, rows_a_frame):
    """Frames that hold many segments, and segments that go over many frames."""
    monkeypatch.setattr(s, "SEGMENT", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_frame)
    x = np.random.default_rng(5).normal(size=400)
    x[[0, 1, 30, 399]] = np.nan
    rows = spark.createDataFrame([("Mission1", c, i, None if np.isnan(v) else float(v)) for c in ("c1", None) for i, v in enumerate(x[: 400 if c else 9])], "mission string, channel string, i int, error double")
    try:
        got = s.ewma(rows.repartition(6), 5).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, n in (("c1", 400), (None, 9)):
        mine = got[got["channel"] == c] if c else got[got["channel"].isna()]
        want = pd.Series(x[:n]).ewm(span=5, adjust=False, ignore_na=True).mean()
        assert np.allclose(mine.sort_values("i")["ewma"].to_numpy(float), want, equal_nan=True)
    assert s.ewma(rows.limit(0), 5).count() == 0


def test_affinity(spark):
    assert m.affinity_f1(spans(spark, [(0, 32)]), spans(spark, [(64, 96)])).first()["affinity_f1"] == 1
    assert m.affinity_f1(spans(spark, [(0, 31)]), spans(spark, [(64, 96)])).first()["affinity_f1"] == 0
    same = spans(spark, [(0, 32), (100, 132)])
    assert m.affinity_f1(same, same).first()["affinity_f1"] == 1
    assert m.affinity_f1(spans(spark, []), same).first()["affinity_f1"] == 0


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_golden_arithmetic(spark):
    assert round(one(spark, m.cef(F.lit(0.8368), F.lit(0.4325))), 4) == 0.705
    assert round(one(spark, m.f_beta(F.lit(1123 / 4500), F.lit(1.0))), 4) == 0.3994
    assert round(one(spark, m.f_beta(F.lit(0.8684), F.lit(0.5493))), 4) == 0.6729
    assert one(spark, m.cef(F.lit(0.0), F.lit(0.0))) == 0


def scored(spark, rows):
    return spark.createDataFrame([(float(x), bool(y)) for x, y in rows], "score double, is_anomaly boolean")


def test_average_precision(spark):
    assert round(m.average_precision(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)]), "score").first()[0], 4) == 0.8333
    tied = scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1)])
    assert m.average_precision(tied, "score").first()[0] == 0.5
    assert m.average_precision(scored(spark, [(0.5, 0)]), "score").first()[0] == 0
    assert m.pr_curve(tied, "score").count() == 2


@settings(max_examples=5, deadline=None)
@given(hs.lists(hs.tuples(hs.integers(0, 10), hs.booleans()), min_size=1, max_size=30))
def test_sweep_counts_add_up(spark, rows):
    df = scored(spark, [(x / 10, y) for x, y in rows])
    curve = m.sweep(df, "score", m.unit_grid()).collect()
    for r in curve:
        assert r["tp"] == sum(x / 10 >= r["threshold"] and y for x, y in rows)
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(rows)
    assert 0 <= m.average_precision(df, "score").first()[0] <= 1 + 1e-9


def test_range_grid_without_range(spark):
    assert m.range_grid(scored(spark, [(0.3, 1), (0.3, 0)]), "score")[-1] == 0.5


def test_verdicts(spark):
    texts = ["NOMINAL but ANOMALY DETECTED", " ANOMALY", "nominal", "anomaly!", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in rows.select(t.parse_verdict(F.col("x"))).collect()] == ["ANOMALY", "UNKNOWN", "NOMINAL", "ANOMALY", "UNKNOWN"]
    v = spark.createDataFrame([(True, "UNKNOWN", 1.0), (True, "ANOMALY", 1.0), (False, "UNKNOWN", 1.0), (False, "NOMINAL", 1.0)], "is_anomaly boolean, predicted string, elapsed_s double")
    r = m.verdict_summary(v).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy"], r["unknown_responses"]) == (1, 0, 1, 1, 0.5, 2)


def test_pattern_rules_in_order(spark):
    cases = [((0.8, 2.5, 9, 9, 9), "sustained_offset"), ((0.8, 1, 2.6, 9, 9), "sustained_oscillation"), ((0.8, 1, 1, 9, 9), "persistent_anomaly"), ((0.1, 9, 1, 6.1, 9), "spike"), ((0.1, 0, 1, 1, -1.6), "drift"), ((0.1, 0, 1.9, 1, 0), "oscillation"), ((0.1, 0, 1, 1, 0), "subtle_deviation")]
    for shape, want in cases:
        assert one(spark, a.classify_pattern(*[F.lit(float(x)) for x in shape])) == want
    assert one(spark, a.pattern_desc(*[F.lit(x) for x in (0.799, 2.5, 0.0, 0.0, 0.0)])) == "persistent offset (mean=2.50σ) throughout 79% of the window"


def test_flat_threshold(spark):
    rows = spark.createDataFrame([("Mission1", "c1", 0, 0, 1.0, False), ("Mission1", "c1", 1, 16, 3.0, False), ("Mission1", "c1", 2, 32, 4.0, True), ("Mission1", "c1", 3, 48, 4.1, True), ("Mission1", "c2", 0, 0, 5.0, True)], "mission string, channel string, i int, start_idx int, error double, is_anomaly boolean")
    out = d.flat_threshold(rows, 2.0).orderBy("channel", "i").collect()
    assert out[0]["threshold"] == 4 and [r["flag"] for r in out] == [False, False, False, True, False]


def test_isolation_forest_ranks_outliers_first():
    x = np.random.default_rng(1).normal(size=(300, 4))
    x[7] += 12
    one_, two = (d.isolation_scores(x, *d.grow_forest(x, 5), 256) for _ in range(2))
    assert (one_ == two).all() and one_.argmax() == 7 and (one_ > 0).all() and (one_ < 1).all()
    assert (d.isolation_scores(x[:1], *d.grow_forest(x[:1], 5), 1) > 0).all()


def by_walk(point, axis, cut, depth):
    node = 0
    while axis[node] >= 0:
        node = 2 * node + (2 if point[axis[node]] >= cut[node] else 1)
    return depth[node]


def test_isolation_scores_against_a_walk():
    x = np.round(np.random.default_rng(2).normal(size=(90, 3)), 1)
    axis, cut, depth = d.grow_forest(x, 3, trees=7, sample=32)
    want = [2 ** (-np.mean([by_walk(p, axis[t], cut[t], depth[t]) for t in range(7)]) / d._harmonic(np.array(32))) for p in x]
    assert np.allclose(d.isolation_scores(x, axis, cut, depth, 32), want)


def test_isolation_forest_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(300, 4))
    x[7] += 12
    rows = windows_of(spark, x)
    whole = {r["start_idx"]: (r["score"], r["flag"]) for r in d.isolation_forest(rows).collect()}
    monkeypatch.setattr(d, "BLOCK", 37 * 16)
    assert {r["start_idx"]: (r["score"], r["flag"]) for r in d.isolation_forest(rows.repartition(5)).collect()} == whole
    scores = np.array([s for s, _ in whole.values()])
    assert {i for i, (s, f) in whole.items() if f} == {i for i, (s, _) in whole.items() if s > np.percentile(scores, 90)}
    assert max(whole, key=lambda i: whole[i][0]) == 7 * 16
    monkeypatch.setattr(d, "POOL", 64)
    few = {r["start_idx"]: r["score"] for r in d.isolation_forest(rows).collect()}
    assert len(few) == 300 and max(few, key=few.get) == 7 * 16
    assert d.isolation_forest(rows.limit(0)).count() == 0


def windows_of(spark, x, anomalous=()):
    return spark.createDataFrame([("Mission1", "c1", 16 * i, [float(y) for y in v], i in anomalous) for i, v in enumerate(x)], "mission string, channel string, start_idx int, values array<double>, is_anomaly boolean")


def test_reconstruction(spark):
    x = np.random.default_rng(2).normal(size=(120, 8))
    full = d.reconstruction_errors(windows_of(spark, x), k=8).toPandas()
    assert len(full) == 120 and full["error"].max() < 1e-18
    line = np.outer(np.arange(120), np.ones(8)) + np.random.default_rng(3).normal(size=(120, 8)) * 0.01
    line[50, 3] += 40
    out = d.reconstruction_errors(windows_of(spark, line, {50}), k=1).toPandas()
    assert out.sort_values("error")["i"].iloc[-1] == 50
    assert d.reconstruction_errors(windows_of(spark, x[:50])).count() == 0


def test_reconstruction_in_blocks_is_that_of_whole_channels(spark, monkeypatch):
    x = 1000 + np.cumsum(np.random.default_rng(4).normal(size=(150, 6)), axis=1)
    rows = windows_of(spark, x, {3, 70})
    rows = rows.union(rows.where("start_idx < 1920").withColumn("channel", F.lit(None).cast("string"))).repartition(7)
    monkeypatch.setattr(d, "BLOCK", 16 * 16)
    monkeypatch.setattr(d, "CHANNELS_AT_ONCE", 1)
    key = lambda r: (r["channel"] or "", r["i"], r["start_idx"], r["is_anomaly"])
    got, want = ({key(r): r["error"] for r in df.collect()} for df in (d.reconstruction_errors(rows, k=2), d.reconstruction_errors(rows, d.pca_fit(2))))
    assert len(got) == 270 and got.keys() == want.keys() and all(np.isclose(got[c], want[c]) for c in got)
    assert d.reconstruction_errors(rows.limit(0)).count() == 0


def test_score_windows_survives_failures(spark):
    def predict(batch):
        if (batch["start_idx"] == 16).any():
            raise ValueError("bad row")
        return batch.assign(l_anom=1.0, l_nom=0.0)

    out = d.score_windows(windows_of(spark, np.zeros((3, 4))), predict, ["start_idx"]).orderBy("start_idx").collect()
    assert [r["argmax"] for r in out] == ["ANOMALY", "ERROR", "ANOMALY"] and out[1]["score"] == 0


def labelled(spark, n, pos):
    return spark.createDataFrame([(i, i < pos) for i in range(n)], "id long, is_anomaly boolean")


def test_samples_have_exact_sizes(spark):
    rows = labelled(spark, 100, 7)
    assert k.balance(rows, ["id"]).count() == 28
    assert k.cap(rows, 30, ["id"]).count() == 30
    picked = k.stratified_sample(labelled(spark, 28, 7), 10, "is_anomaly", ["id"]).collect()
    assert sum(r["is_anomaly"] for r in picked) == 2 and len(picked) == 10
    parts = k.split(rows, ["id"]).collect()
    by = {p: sorted(r["index"] for r in parts if r["split"] == p) for p in ("train", "val", "test")}
    assert [len(by[p]) for p in ("train", "val", "test")] == [70, 15, 15] and all(v == list(range(len(v))) for v in by.values())
    again = {r["id"]: r["split"] for r in k.split(rows.repartition(3), ["id"]).collect()}
    assert again == {r["id"]: r["split"] for r in parts}
    assert k.holdout(labelled(spark, 1, 0), 0.2, ["id"]).where("is_val").count() == 0
    assert k.holdout(labelled(spark, 3, 0), 0.01, ["id"]).where("is_val").count() == 1


def matrix(spark, n=60):
    rng = np.random.default_rng(4)
    y = rng.random(n) < 0.3
    return spark.createDataFrame([(i, bool(y[i]), float(rng.random() + y[i]), float(rng.random()), float(rng.random() * 5)) for i in range(n)], "index long, is_anomaly boolean, text double, vision double, error double")


def test_vote_lies_between_all_and_any(spark):
    r = {x["rule"]: x for x in fu.vote(matrix(spark), ["text", "vision", "error"]).collect()}
    assert r["all"]["recall"] <= r["vote"]["recall"] <= r["any"]["recall"]


def test_stacker_matches_newton(spark):
    rows = matrix(spark, 80)
    got = {r["name"]: r["weight"] for r in fu.stack_weights(rows, ["text", "vision"]).collect()}
    p = rows.toPandas()
    x = p[["text", "vision"]].to_numpy()
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    y = p["is_anomaly"].to_numpy().astype(float)
    s_ = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (s_ * q * (1 - q))[:, None]) + ridge, x.T @ (s_ * (q - y)) + ridge @ b)
    assert np.allclose([got["text"], got["vision"], got["intercept"]], b, atol=2e-3)


def test_oof_covers_every_row_once(spark):
    rows = matrix(spark, 40)
    out = fu.oof_stack(rows, ["text", "vision"]).collect()
    assert sorted(r["index"] for r in out) == list(range(40)) and {r["fold"] for r in out} == {0, 1, 2, 3, 4}
    assert all(0 <= r["stacked"] <= 1 for r in out)


def test_arrays(spark):
    arr = lambda x: F.array(*[F.lit(float(v)) for v in x])
    assert abs(one(spark, im.gini(arr([2, 2, 2])))) < 1e-12
    assert abs(one(spark, im.gini(arr([0, 0, 0, 5]))) - 0.75) < 1e-12
    assert one(spark, im.gini(arr([0, 0]))) == 0
    assert one(spark, im.top_decile_mass(arr([1, 1, 1, 7]))) == 0.7
    assert one(spark, im.faithfulness(arr([1, 2]), F.lit(3.0005))) and not one(spark, im.faithfulness(arr([1, 2]), F.lit(3.1)))
    img = spark.createDataFrame([(0, [float(i) for i in range(16)])], "id int, v array<double>")
    assert [r["mean"] for r in im.avg_pool(img, ["id"], "v", 4, 2).orderBy("patch_id").collect()] == [2.5, 4.5, 10.5, 12.5]
    small = img.select(im.resize_bilinear(F.col("v"), 1, 4, 4, 2, 2)).first()[0]
    assert np.allclose(small, [2.5, 4.5, 10.5, 12.5])


def test_regression_without_variance(spark):
    r = im.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "pred double, truth double")).first()
    assert (r["mae"], r["bias"], r["pearson"]) == (1, -1, 0)


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "raw" / "Mission2"
    folder.mkdir(parents=True)
    (folder / "channels.csv").write_text("Channel,Subsystem,Physical Unit,Group,Target\nc1,subsystem_1,physical_unit_1,1,YES\nc2,subsystem_2,physical_unit_2,1,NO\nc3,subsystem_2,physical_unit_2,1,YES\n")
    (folder / "labels.csv").write_text("ID,Channel,StartTime,EndTime\na1,c1,2024-01-01T00:00:00Z,2024-01-01T02:00:00Z\n")
    channels = io.read_channels(spark, str(tmp_path / "raw"))
    assert [(r["mission"], r["channel"], r["ordinal"]) for r in channels.orderBy("ordinal").collect()] == [("Mission2", "c1", 0), ("Mission2", "c3", 2)]
    assert io.cap_channels(channels, 1).count() == 1
    assert io.filter_missions(channels, "1").count() == 0 and io.filter_missions(channels, "2").count() == 2
    assert io.read_intervals(spark, str(tmp_path / "raw")).first()["end_time"] == dt.datetime(2024, 1, 1, 2)
    for c in ("c1", "c2"):
        hourly(spark, [1.0, 2.0]).select("ts", "value").toPandas().to_parquet(folder / f"{c}.parquet")
    got = io.read_telemetry(spark, str(tmp_path / "raw"), channels)
    assert {r["channel"] for r in got.collect()} == {"c1"} and got.count() == 2
    assert sorted((r["ts"], r["value"]) for r in got.collect()) == [(T0, 1.0), (T0 + dt.timedelta(hours=1), 2.0)]
    with pytest.raises(Exception, match="(?i)exist"):
        io.read_telemetry(spark, str(tmp_path / "none"), channels)


@pytest.mark.parametrize("unit", ["ns", "us", "ms"])
def test_telemetry_of_any_unit_and_layout(spark, tmp_path, unit):
    channels = spark.createDataFrame([("Mission1", "c1"), ("Mission2", "c9")], "mission string, channel string")
    frame = hourly(spark, [1.0, 2.5, -3.0]).select("ts", "value").toPandas()
    frame["ts"] = frame["ts"].astype(f"datetime64[{unit}]")
    for place in ("Mission1/c1.parquet", "Mission2/c9.parquet/part-0.parquet", "Mission2/c3.parquet", "Mission1/.c1.parquet"):
        (tmp_path / "raw" / place).parent.mkdir(parents=True, exist_ok=True)
        frame.to_parquet(tmp_path / "raw" / place)
    got = io.read_telemetry(spark, str(tmp_path / "raw"), channels).orderBy("mission", "ts").collect()
    assert [(r["mission"], r["channel"], r["value"], r["raw"]) for r in got] == [(x, y, v, None) for x, y in (("Mission1", "c1"), ("Mission2", "c9")) for v in (1.0, 2.5, -3.0)]
    assert [r["ts"] for r in got[:3]] == [T0 + dt.timedelta(hours=i) for i in range(3)]
    rows = spark.createDataFrame([("Mission1", "c1", T0, 4.0, "value_3")], "mission string, channel string, ts timestamp, value double, raw string")
    rows.write.partitionBy("mission", "channel").parquet(str(tmp_path / "hive"))
    assert tuple(io.read_telemetry(spark, str(tmp_path / "hive"), channels).first()) == ("Mission1", "c1", T0, 4.0, "value_3")


def test_overlaps_across_days_and_stretches(spark):
    """Pairs that share many buckets count once, and pairs in one bucket only if they meet."""
    hours = lambda x: T0 + dt.timedelta(hours=x)
    windows = spark.createDataFrame([(i, "Mission1", "c1", hours(a), hours(b)) for i, (a, b) in enumerate([(0, 100), (23, 25), (30, 31), (200, 201)])], "index long, mission string, channel string, start_time timestamp, end_time timestamp")
    refs = spark.createDataFrame([(n, "Mission1", "c1", hours(a), hours(b)) for n, a, b in (("x", 20, 90), ("y", 24, 24.5), ("z", 31, 40), ("w", 1, 60))], "id string, mission string, channel string, start_time timestamp, end_time timestamp")
    got = {r["index"]: (r["ref_id"], r["overlap_s"]) for r in gr.best_overlap(windows, refs).collect()}
    assert got == {0: ("x", 70 * 3600), 1: ("w", 2 * 3600), 2: ("w", 3600), 3: (None, None)}
    rng = np.random.default_rng(1)
    p, q = ([(int(a), int(a + n)) for a, n in zip(rng.integers(0, 9000, 40), rng.integers(1, 3000, 40))] for _ in range(2))
    pairs = {(r["ps"], r["pe"], r["gs"], r["ge"]) for r in m.interval_matches(spans(spark, p), spans(spark, q), 32).collect()}
    assert pairs == {(*a, *b) for a in p for b in q if a[0] <= b[1] + 32 and a[1] >= b[0] - 32}
    assert m.interval_matches(spans(spark, p), spans(spark, q), 32).count() == sum(a[0] <= b[1] + 32 and a[1] >= b[0] - 32 for a in p for b in q)


def test_median_folds_and_large_samples(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3 == 0, float(x) if x is not None else None) for i, x in enumerate([5, 1, None, 9, 3])], "index long, is_anomaly boolean, error double")
    assert fu.median(rows, "error") == 4 and fu.median(rows.where("index < 2"), "error") == 3 and fu.median(rows.limit(0), "error") is None
    folds = fu.with_folds(matrix(spark, 43)).groupBy("is_anomaly", "fold").count().toPandas()
    assert all(g["count"].max() - g["count"].min() <= 1 and set(g["fold"]) == set(range(5)) for _, g in folds.groupby("is_anomaly"))
    few = {r["id"] for r in k.cap(labelled(spark, 100, 7), 30, ["id"]).collect()}
    monkeypatch.setattr(k, "TOP_K", 10)
    assert {r["id"] for r in k.cap(labelled(spark, 100, 7), 30, ["id"]).collect()} == few
    assert k.balance(labelled(spark, 100, 7), ["id"]).count() == 28
    with pytest.raises(ValueError, match="101 rows wanted"):
        k.take_bounded(labelled(spark, 100, 7), 101, ["id"])
    assert k.take_bounded(labelled(spark, 3, 1), 5, ["id"], strict=False).count() == 3


def test_window_shape_in_one_pass(spark):
    x = np.random.default_rng(6).normal(1e6, 3, size=(5, 33))
    got = w.with_stats(windows_of(spark, x)).orderBy("start_idx").toPandas()
    assert np.allclose(got["mean"], x.mean(1)) and np.allclose(got["std"], x.std(1)) and np.allclose(got["p2p"], np.ptp(x, axis=1)) and np.allclose(got["trend"], x[:, -9:].mean(1) - x[:, :8].mean(1))
    plan = w.with_stats(windows_of(spark, x))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(values") <= 3  # the moments once, and the two quarters of the trend


def test_comparison_and_gates(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.5, 0.5, 0.6, 1.0, None, 60.0), ("b", 0.4, 0.5, 0.4, 0.7, 0.9, 0.5, 10.0), ("t", 0.2, 1.0, 0.3, 0.2, None, None, None)], "approach string, precision double, recall double, f1 double, cef double, format_compliance double, advice_structured_frac double, advice_avg_chars double")
    got = {r["approach"]: r for r in gr.compare(rows, "b", "t").collect()}
    assert got["a"]["delta_f1"] == 0.1 and got["a"]["delta_format_compliance"] == 0.1 and got["a"]["delta_advice_structured_frac"] is None and got["b"]["delta_precision"] == 0 and got["a"]["best_f1"] and got["b"]["best_cef"] and not got["t"]["above_trivial"]
    passed = lambda df: {r["check"]: r["passed"] for r in df.collect()}
    assert passed(c.check_comparison(rows.withColumn("error", F.lit(None).cast("string")), "a")) == {"rows": True, "errors": True, "bounds": True, "advice_length": True}
    assert passed(c.check_comparison(rows.withColumn("error", F.when(F.col("approach") == "t", "broken")), "b")) == {"rows": True, "errors": False, "bounds": True, "advice_length": False}
    runs = spark.createDataFrame([(0.5, 0.5, 0.5, 2.0, 1.0), (0.5, 0.5, 0.5, None, 3.0)], "precision double, recall double, f1 double, first_loss double, last_loss double")
    assert passed(c.check_detector(runs))["loss_fell"] and not passed(c.check_detector(runs.where("first_loss is null")))["loss_fell"]
    assert not passed(c.check_regression(spark.createDataFrame([(0.1, 0.3, 0.9, 26.0)], "mae double, baseline_mae double, pearson double, cost double")))["cost"]
    units = spark.createDataFrame([("Mission1", "c1"), ("Mission1", "c2")], "mission string, channel string")
    loss = {r["channel"]: r["loss"] for r in gr.carry_prior(units, spark.createDataFrame([("Mission1", "c2", 1.5)], "mission string, channel string, loss double"), "loss").collect()}
    assert loss["c2"] == 1.5 and np.isnan(loss["c1"])


def test_tables_between_jobs_can_be_cleared(spark):
    table = stored(labelled(spark, 5, 2))
    assert table.count() == 5
    clear_tables(spark)
    assert not os.path.isdir(tables_dir(spark).removeprefix("file:"))
