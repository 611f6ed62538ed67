"""Operators that spread one key over tasks, against plain loops over the whole key."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import advice as ad
from skyloom.operators import checks as c
from skyloom.operators import detectors as d
from skyloom.operators import fusion as fu
from skyloom.operators import grading as gr
from skyloom.operators import grid as g
from skyloom.operators import imagery as im
from skyloom.operators import metrics as m
from skyloom.operators import overlaps
from skyloom.operators import sequences as s
from skyloom.operators import windows as w
from skyloom.shared import new_path
from skyloom.sources import io
from skyloom.streaming import jobs as st

T0 = dt.datetime(2024, 1, 1)
NAMES = [("Mission1", "hot"), ("Mission1", "c2"), ("Mission2", None)]


@pytest.fixture
def many_parts(spark):
    """Seven range partitions, so that a key of many rows has borders inside."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def by_key(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault((r["mission"], r["channel"]), []).append(tuple(r[x] for x in cols))
    return {k: sorted(v) for k, v in out.items()}


# ---------------------------------------------------------------- W6, W7


def merged(rows, gap):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intervals_merge_across_partitions(many_parts, seed):
    rng = random.Random(seed)
    spans = {n: [(x := rng.randrange(3000), x + rng.choice([0, 3, 40])) for _ in range(k)] for n, k in zip(NAMES, (400, 9, 30))}
    spans[NAMES[0]] += [(5, 1900), (5, 1900), (2500, 2500)]  # one that spans most partitions, twice
    df = many_parts.createDataFrame([(*n, *x) for n, v in spans.items() for x in v], "mission string, channel string, start long, end long").repartition(5)
    for gap in (0, 16):
        assert by_key(s.merge_intervals(df, gap), "start", "end") == {n: merged(v, gap) for n, v in spans.items()}
    assert s.merge_intervals(df.limit(0)).count() == 0


def test_short_keys_merge_in_one_task_and_long_ones_in_fragments(many_parts, monkeypatch):
    rng = random.Random(9)
    spans = {n: [(x := rng.randrange(3000), x + rng.choice([0, 3, 40])) for _ in range(k)] for n, k in zip([*NAMES, ("M", None)], (400, 9, 30, 12))}
    df = many_parts.createDataFrame([(*n, *x) for n, v in spans.items() for x in v], "mission string, channel string, start long, end long").repartition(5)
    fragments = []
    spread = s._merged_in_fragments
    monkeypatch.setattr(s, "_merged_in_fragments", lambda rows, *a: fragments.append(rows.count()) or spread(rows, *a))
    want = {n: merged(v, 16) for n, v in spans.items()}
    assert by_key(s.merge_intervals(df, 16), "start", "end") == want and not fragments
    for most, rows in ((30, 400), (10, 442), (5, 451)):
        monkeypatch.setattr(s, "WHOLE", most)
        assert by_key(s.merge_intervals(df, 16), "start", "end") == want and fragments.pop() == rows


def test_runs_across_partitions(many_parts):
    rng = random.Random(4)
    flags = {NAMES[0]: [rng.random() < 0.9 for _ in range(500)], NAMES[1]: [True] * 300, NAMES[2]: [False, True, True, False]}
    df = many_parts.createDataFrame([(*n, i, x) for n, v in flags.items() for i, x in enumerate(v)], "mission string, channel string, i int, f boolean").repartition(5)
    want = {n: [(a, b, b - a + 1) for a, b in runs_of(np.array(v))] for n, v in flags.items()}
    assert by_key(s.contiguous_runs(df, "f"), "start", "end", "n") == want


# ---------------------------------------------------------------- W1


@pytest.mark.parametrize("seconds", [3600, 7000, None])
def test_resample_spreads_a_channel(many_parts, seconds):
    rng = np.random.default_rng(8)
    rows = []
    for n, size in zip(NAMES[:2], (600, 5)):
        for x in sorted(rng.choice(600 * 60, size, replace=False).tolist()):
            rows.append((*n, T0 + dt.timedelta(minutes=x), None if rng.random() < 0.1 else float(rng.normal())))
    rows += [("Mission3", "none", T0, None), ("Mission3", "none", T0 + dt.timedelta(hours=9), float("nan"))]
    df = many_parts.createDataFrame(rows, "mission string, channel string, ts timestamp, value double").repartition(6)
    got = g.resample(df, seconds).toPandas()
    assert set(got["channel"]) == {"hot", "c2"}
    for (mission, channel), own in pd.DataFrame(rows, columns=["mission", "channel", "ts", "value"]).groupby(["mission", "channel"]):
        x = own.set_index("ts")["value"].sort_index()
        if seconds:
            x = x.resample(f"{seconds}s", origin="start_day").mean().interpolate("linear").bfill().ffill()
        x = x.dropna()
        mine = got[got["channel"] == channel].sort_values("idx")
        assert mine["idx"].tolist() == list(range(len(x))) and mine["ts"].tolist() == x.index.tolist() and np.allclose(mine["value"], x)
    plan = g.resample(df, seconds)._jdf.queryExecution().executedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if line.lstrip(" +-:*()0123456789").startswith("Window [row_number") or "lead(" in line)  # no window over a whole channel


# ---------------------------------------------------------------- P2 to P4, D1, D2


def test_moments_without_windows(many_parts):
    rng = np.random.default_rng(9)
    values = {n: (rng.normal(5, 2, k) if k > 1 else np.array([3.0])) for n, k in zip(NAMES, (300, 1, 40))}
    df = many_parts.createDataFrame([(*n, i, float(x)) for n, v in values.items() for i, x in enumerate(v)], "mission string, channel string, i int, value double").repartition(5)
    assert by_key(g.revin(df), "i", "value_norm").keys() == values.keys()
    for n, got in by_key(g.revin(df), "i", "value_norm").items():
        assert np.allclose([x for _, x in got], (values[n] - values[n].mean()) / (values[n].std() + 1e-5))
    for n, got in by_key(g.standardize(df), "i", "value_std").items():
        assert np.allclose([x for _, x in got], (values[n] - values[n].mean()) / (values[n].std() or 1.0))
    errors = df.select("mission", "channel", "i", F.col("value").alias("error"), (F.col("i") % 7 == 0).alias("is_anomaly"))
    for n, got in by_key(d.flat_threshold(errors, 1.5), "i", "threshold", "flag").items():
        calm = values[n][np.arange(len(values[n])) % 7 != 0]
        limit = calm.mean() + 1.5 * calm.std() if len(calm) else None
        assert all((t is None and not f) if limit is None else (np.isclose(t, limit) and f == (values[n][i] > limit)) for i, t, f in got)
    for out in (g.revin(df), g.standardize(df), d.flat_threshold(errors), d.z_sweep(errors)):
        assert "partitionBy" not in str(out._jdf.queryExecution().analyzed()) and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_positions_meet_their_moments(spark):
    x = np.random.default_rng(10).normal(size=(90, 6))
    x[:, 2] = 4.0
    df = spark.createDataFrame([("Mission1", "c1", i, v.tolist()) for i, v in enumerate(x)], "mission string, channel string, start_idx int, values array<double>")
    got = {(r["start_idx"], r["pos"]): r["value"] for r in g.standardize_positions(df).collect()}
    std = np.where(x.std(0) == 0, 1, x.std(0))
    want = (x - x.mean(0)) / std
    assert len(got) == x.size and all(np.isclose(got[i, j], want[i, j]) for i in range(90) for j in range(6))


# ---------------------------------------------------------------- D3 to D5


def runs_of(flag):
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def plain_epsilon(smooth):
    m_, s_ = smooth.mean(), smooth.std()
    choices = [(-np.inf, m_ + 3 * s_)]
    for z in np.arange(2.5, 12.25, 0.5) if s_ else ():
        high = smooth >= m_ + z * s_
        if 0 < high.sum() < len(smooth) / 2:
            left = smooth[~high]
            gain = ((m_ - left.mean()) / m_ if m_ else 0.0) + (s_ - left.std()) / s_
            choices.append((gain / (len(runs_of(high)) ** 2 + high.sum()), m_ + z * s_))
    return max(choices, key=lambda x: x[0])[1]


def plain_pruned(errors, found, p):
    outside = np.ones(len(errors), bool)
    for a, b in found:
        outside[a : b + 1] = False
    ranked = sorted(((errors[a : b + 1].max(), a, b) for a, b in found), reverse=True)
    peaks = [x[0] for x in ranked] + [errors[outside].max() if outside.any() else 0.0]
    large = [i for i in range(len(found)) if ((peaks[i] - peaks[i + 1]) / peaks[i] if peaks[i] > 0 else 0) >= p]
    return [(a, b) for _, a, b in ranked[: large[-1] + 1]] if large else []


def plain_dynamic(errors, span=5, p=0.13):
    smooth = np.log(errors + 1e-12)
    if span > 1:
        smooth = pd.Series(smooth).ewm(span=span, adjust=False).mean().to_numpy()
    epsilon, out = plain_epsilon(smooth), np.zeros(len(errors), bool)
    for a, b in plain_pruned(errors, runs_of(smooth >= epsilon), p):
        out[a : b + 1] = True
    return out, np.exp(epsilon)


def test_flags_are_counted_by_runs(spark, monkeypatch):
    """Counts are those of the flags, also of channels without a run and of runs over borders of segments, and no position is joined for them."""
    monkeypatch.setattr(s, "SEGMENT", 20)
    monkeypatch.setattr(d, "SEGMENT", 20)
    rng = np.random.default_rng(12)
    errors = {("Mission1", f"c{k}"): np.exp(rng.normal(-2, 0.4, 90 if k else 15)) for k in range(5)} | {("Mission2", None): np.exp(rng.normal(-2, 0.4, 70)), ("Mission2", "flat"): np.full(30, 1 - 1e-12)}
    for k in (1, 2, 3):
        errors["Mission1", f"c{k}"][17 : 17 + 3 * k] *= 40
        errors["Mission1", f"c{k}"][60:62] *= 41
    errors["Mission1", "c4"][30:34] *= 40_000
    df = spark.createDataFrame([(*n, i, float(x)) for n, v in errors.items() for i, x in enumerate(v)], "mission string, channel string, i int, error double").repartition(5)
    rows = d.dynamic_runs(df)
    got = d.flag_counts(rows, {"a": 0.0, "b": 0.99})
    want = {}
    for name, p in (("a", 0.0), ("b", 0.99)):
        for r in d.flag_runs(rows, p).collect():
            want.setdefault((r.mission, r.channel), {"a": 0, "b": 0})[name] += r.flag
    assert {(r.mission, r.channel): {"a": r.a, "b": r.b} for r in got.collect()} == want and len(want) == len(errors)
    assert any(x["a"] > x["b"] for x in want.values()) and any(x["b"] > 0 for x in want.values()) and {"a": 0, "b": 0} in want.values()
    assert not any("Join" in x and "_segment" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("span, p", [(5, 0.13), (1, 0.0)])
def test_dynamic_thresholds_by_segments(spark, monkeypatch, span, p):
    rng = np.random.default_rng(11)
    errors = {}
    for k in range(7):
        x = np.exp(rng.normal(-2, 0.4, rng.integers(60, 240)))
        for _ in range(k % 4):
            at, n = rng.integers(0, len(x) - 30), rng.integers(1, 30)
            x[at : at + n] *= np.exp(rng.uniform(1, 4))
        x[18:23] *= 40 if k % 2 else 1  # a run on a border of segments
        errors["Mission1", f"c{k}"] = x
    errors |= {("Mission2", None): errors["Mission1", "c3"], ("Mission2", "flat"): np.full(30, 1 - 1e-12), ("Mission2", "one"): np.array([2.0]), ("Mission2", "zero"): np.zeros(1)}
    monkeypatch.setattr(s, "SEGMENT", 20)
    monkeypatch.setattr(d, "SEGMENT", 20)
    df = spark.createDataFrame([(*n, i, float(x)) for n, v in errors.items() for i, x in enumerate(v)], "mission string, channel string, i int, error double").repartition(5)
    got = by_key(d.detect_dynamic(df, span, p), "i", "flag", "epsilon")
    assert got.keys() == errors.keys()
    found = 0
    for n, rows in got.items():
        flags, epsilon = plain_dynamic(errors[n], span, p)
        assert [f for _, f, _ in rows] == flags.tolist() and np.allclose([e for *_, e in rows], epsilon)
        found += flags.sum()
    assert found > 5 and d.detect_dynamic(df.limit(0)).count() == 0
    assert "FlatMapGroupsInPandas" not in d.detect_dynamic(df)._jdf.queryExecution().executedPlan().toString()


def test_pruning_of_runs(spark):
    def kept(peaks, outside, p=0.13):
        df = spark.createDataFrame([("Mission1", "c1", i, float(x), i, outside) for i, x in enumerate(peaks)], "mission string, channel string, g int, peak double, start int, outside double")
        return sorted(r["g"] for r in d.pruned(df, p).collect())

    assert kept([10, 9.5], 5.0) == [0, 1] and kept([10, 5.2], 5.0) == [0] and kept([10, 10], None) == [0, 1] and kept([0.0], None) == [] and kept([1, 1], 1.0, 0.0) == [0, 1]


# ---------------------------------------------------------------- W3

@pytest.mark.parametrize("window, stride", [(32, 16), (6, 2), (4, 4), (5, 2), (9, 1)])
def test_windows_over_chunks(spark, monkeypatch, window, stride):
    """Windows that cross chunks, a missing channel name, channels that are too short and one that lacks a point."""
    monkeypatch.setattr(w, "CHUNK", 3)
    lengths = {"c1": 400, None: 131, "short": 3, "hole": 90}
    idx = {k: [i for i in range(n) if (k, i) != ("hole", 40)] for k, n in lengths.items()}
    rows = [("Mission1", k, T0 + dt.timedelta(hours=i), float(i * i % 17), i, i % 23 == 0) for k, at in idx.items() for i in at]
    df = spark.createDataFrame(rows, "mission string, channel string, ts timestamp, value double, idx int, is_anomaly boolean").repartition(5)
    out = w.make_windows(df, window, stride)
    got = {(r["channel"], r["start_idx"]): (r["end_idx"], r["values"], r["is_anomaly"], r["anomaly_ratio"], r["start_time"], r["end_time"]) for r in out.collect()}
    want = {}
    for k, n in lengths.items():
        for start in range(0, n - window + 1, stride):
            at = range(start, start + window)
            if k == "hole" and 40 in at:
                continue
            hits = sum(i % 23 == 0 for i in at)
            hour = [T0 + dt.timedelta(hours=i) for i in (at[0], at[-1])]
            want[k, start] = (start + window, [float(i * i % 17) for i in at], hits > 0, hits / window, *hour)
    assert got == want and w.make_windows(df.limit(0), window, stride).count() == 0
    if window % stride == 0 and window > stride:  # the window function sees a chunk at most, and points are exchanged once
        plan = w.make_windows(df.coalesce(1), window, stride)._jdf.queryExecution().executedPlan().toString()
        assert "_c#" in plan.split("windowspecdefinition(")[1].split(" ASC")[0] and plan.count("REPARTITION_BY_COL") == 1 and "ENSURE_REQUIREMENTS" not in plan


# ---------------------------------------------------------------- D12, D13


def newton(x, y):
    x = np.column_stack([(x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0)), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    b, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (w * q * (1 - q))[:, None]) + ridge, x.T @ (w * (q - y)) + ridge @ b)
    return b


def test_all_folds_in_one_pass_are_separate_fits(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(3, 5, (200, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 4, 200) > 1).astype(float)
    x[:, 2] = 7.0  # a signal that doesn't vary
    df = spark.createDataFrame([(i, bool(y[i]), *map(float, x[i])) for i in range(200)], "index long, is_anomaly boolean, a double, b double, c double").repartition(3)
    out = fu.oof_stack(df, ["a", "b", "c"]).toPandas().sort_values("index")
    for fold in range(5):
        train, held = (out["fold"] != fold).to_numpy(), (out["fold"] == fold).to_numpy()
        b = newton(x[train], y[train])
        spread = np.where(x[train].std(0) == 0, 1, x[train].std(0))
        want = 1 / (1 + np.exp(-((x[held] - x[train].mean(0)) / spread @ b[:-1] + b[-1])))
        assert np.abs(out["stacked"][held].to_numpy() - want).max() < 1e-6


def test_stacking_of_odd_rows(spark):
    kind = "index long, is_anomaly boolean, a double, b double"
    assert fu.oof_stack(spark.createDataFrame([], kind), ["a", "b"]).count() == 0
    one = fu.oof_stack(spark.createDataFrame([(i, False, float(i), 1.0) for i in range(12)], kind), ["a", "b"]).toPandas()  # a single class
    assert (one["stacked"] < 0.01).all()
    holes = fu.oof_stack(spark.createDataFrame([(i, i % 2 == 0, None if i == 3 else float(i % 5), 1.0) for i in range(20)], kind), ["a", "b"]).toPandas()
    assert holes["stacked"].isna().sum() == 1 and len(holes) == 20
    easy = fu.oof_stack(spark.createDataFrame([(i, i >= 20, 100.0 * (i >= 20), 1.0) for i in range(40)], kind), ["a", "b"]).toPandas()  # classes that a line parts
    assert ((easy["stacked"] > 0.5) == easy["is_anomaly"]).all()


# ---------------------------------------------------------------- J7, J8


def test_long_spans_meet_by_level(spark):
    rng = random.Random(13)
    span = lambda: (a := rng.randrange(-4000, 4000), a + rng.choice([-1, 0, 1, 3, 17, 200, 3650, 9000]))
    rows = [[(rng.choice(["x", "x", "y", None]), *span(), i) for i in range(n)] for n in (80, 60)]
    a, b = (spark.createDataFrame(r, "k string, s long, e long, id int").repartition(3) for r in rows)
    got = [(r["a.id"], r["b.id"]) for r in overlaps.meeting(a, b, ["k"], (F.col("s"), F.col("e")), (F.col("s"), F.col("e"))).collect()]
    want = [(p[3], q[3]) for p in rows[0] for q in rows[1] if p[0] == q[0] is not None and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2]]
    assert sorted(got) == sorted(want) and len(want) > 200
    placed = overlaps._placed(overlaps._sized(a, "a", F.col("s"), F.col("e")), "a", [])
    assert placed.groupBy("`a.id`").count().agg(F.max("count")).first()[0] <= 2**overlaps.FINE + 1
    assert overlaps.meeting(a.limit(0), b, ["k"], (F.col("s"), F.col("e")), (F.col("s"), F.col("e"))).count() == 0


def test_best_overlap_with_ten_years(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    kind = "mission string, channel string, start_time timestamp, end_time timestamp"
    windows = [(i, "Mission1", "c1", day(i * 7), day(i * 7 + 1.5)) for i in range(200)] + [(900, "Mission1", "c1", day(-50), day(4000))]
    refs = [(1, "Mission1", "c1", day(10), day(3660)), (2, "Mission1", "c1", day(70), day(70.5)), (3, "Mission1", "c1", day(0), day(5)), (4, "Mission1", "c2", day(0), day(5000))]
    got = {r["index"]: (r["ref_id"], r["overlap_s"]) for r in gr.best_overlap(spark.createDataFrame(windows, f"index int, {kind}"), spark.createDataFrame(refs, f"id int, {kind}")).collect()}
    want = {}
    for i, _, ch, a, b in windows:
        best = min(((-(min(b, e) - max(a, s_)).total_seconds(), s_, r) for r, _, c2, s_, e in refs if c2 == ch and a < e and s_ < b), default=None)
        want[i] = (best[2], -best[0]) if best else (None, None)
    assert got == want
    big = spark.createDataFrame([("Mission1", "c1", 0, 3_000_000), ("Mission1", "c1", 5_000_000, 5_000_031)], "mission string, channel string, start long, end long")
    small = spark.createDataFrame([("Mission1", "c1", 40_000 * i, 40_000 * i + 31) for i in range(150)], "mission string, channel string, start long, end long")
    assert m.interval_matches(big, small, 32).count() == 76 + 1 and m.interval_matches(small, big, 32).count() == 77


# ---------------------------------------------------------------- A25 to A27, A30


def test_image_operators_inside_the_row(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(5, 2, 6, 9))  # two channels, 6 x 9, patches of 4: one down, two across
    attribution = rng.normal(size=(5, 2))
    rows = [(i, x[i].ravel().tolist(), attribution[i].tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, v array<double>, a array<double>")
    want = np.stack([[[x[i, ch, :4, 4 * k : 4 * k + 4].mean() for k in range(2)] for ch in range(2)] for i in range(5)])
    pooled = im.avg_pool(df, ["id"], "v", 9, 4, 6, 2)
    got = {(r["id"], r["patch_id"]): r["mean"] for r in pooled.collect()}
    assert len(got) == 20 and all(np.isclose(got[i, 2 * ch + k], want[i, ch, k]) for i in range(5) for ch in range(2) for k in range(2))
    with_light = df.withColumn("light", im.patch_means(F.col("v"), 9, 4, 6, 2))
    corr = im.brightness_corr(with_light, ["id"], "a", "light", 2)
    for r in corr.collect():
        each = [np.corrcoef(np.abs(attribution[r["id"]]), want[r["id"], ch])[0, 1] for ch in range(2)]
        assert np.allclose(r["by_channel"], each) and np.isclose(r["r"], np.mean(each))
    square = spark.createDataFrame([(1, [1.0, 2.0, 3.0, None]), (2, None), (3, [])], "id int, w array<double>")
    assert {(r["id"], r["col"]): r["mean"] for r in im.column_means(square, ["id"], "w", 2).collect()} == {(1, 0): 2.0, (1, 1): 2.0}
    assert im.brightness_corr(spark.createDataFrame([(1, [1.0, 1.0], [2.0, 3.0]), (2, [], []), (3, [1.0], [1.0, 2.0])], "id int, attribution array<double>, brightness array<double>"), ["id"]).select("r").distinct().collect() == [(0.0,)]
    for out in (pooled, corr, im.column_means(square, ["id"], "w", 2)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    sized = spark.createDataFrame([(1, list(map(float, range(16)))), (2, None), (3, [1.0] * 16)], "id int, v array<double>").select("id", im.resize_bilinear(F.col("v"), 1, 4, 4, 2, 2).alias("o"))
    assert {r["id"]: r["o"] for r in sized.collect()} == {1: [2.5, 4.5, 10.5, 12.5], 2: None, 3: [1.0] * 4}


# ---------------------------------------------------------------- gates, catalogue


def test_gates_that_fail(spark):
    passed = lambda df: {r["check"]: r["passed"] for r in df.collect()}
    records = spark.createDataFrame([("Mission1", True), ("Mission1", False), ("Mission2", False)], "mission string, is_anomaly boolean")
    assert passed(c.check_splits(records, 3, 1, 2, 2)) == {"total": True, "anomalies": True, "missions": True}
    assert passed(c.check_splits(records, 4, 2, 3, 3)) == {"total": False, "anomalies": False, "missions": False}
    rows = spark.createDataFrame([("a", 0.5, 0.5, 0.5, 1.5, None, 10.0), ("b", None, 0.5, 0.5, 0.5, "no metrics", 90.0)], "approach string, precision double, recall double, f1 double, cef double, error string, advice_avg_chars double")
    assert passed(c.check_comparison(rows, "a")) == {"rows": True, "errors": False, "bounds": False, "advice_length": False}
    images = spark.createDataFrame([([0.5, 2.0], 1.0), ([float("nan")], None)], "v array<double>, y double")
    assert passed(c.check_images(im.profile(images, "v", "y"), 1, 1, 2, -1.0, 1.0, 3)) == {"rows": False, "shape": False, "values": False, "finite": False, "labels": False}
    # what is missing or not a number passes no gate
    advice = spark.createDataFrame([("a", "x", None), ("b", "y", "low")], "anomaly_id string, advice string, severity string")
    assert not passed(c.check_advice(advice, ["advice"]))["severity"] and passed(c.check_advice(advice.where("severity = 'low'"), ["advice"]))["severity"]
    assert not passed(c.check_chat(spark.createDataFrame([("<s> a",), (None,)], "text string"), "<s>"))["marker"]
    fits = spark.createDataFrame([(0.5, None, 0.5, 2.0, 1.0), (0.5, 0.5, 0.5, 2.0, 1.0)], "precision double, recall double, f1 double, first_loss double, last_loss double")
    assert not passed(c.check_detector(fits))["finite"] and passed(c.check_detector(fits.dropna()))["finite"]
    nan = float("nan")
    shape = "mae double, baseline_mae double, pearson double, cost double"
    got = passed(c.check_regression(spark.createDataFrame([(0.1, nan, nan, nan)], shape)))
    assert got == {"beats_mean": False, "baseline": False, "mae": True, "pearson": False, "cost": False}
    marks = spark.createDataFrame([(None, nan, nan, nan)], "faithful boolean, gini double, top_decile double, r double")
    assert passed(c.check_attribution(marks)) == {"faithful": False, "gini": False, "top_decile": False, "brightness": False}


def test_catalogue_of_several_parts_keeps_its_order(spark, tmp_path):
    folder = tmp_path / "Mission1" / "channels.csv"
    folder.mkdir(parents=True)
    head = "Channel,Subsystem,Physical Unit,Group,Target\n"
    for part, n in (("part-0.csv", 2), ("part-1.csv", 400), ("part-2.csv", 1)):  # the largest isn't the first
        (folder / part).write_text(head + "".join(f"{part[5]}_{i},s,u,1,YES\n" for i in range(n)))
    got = [r["channel"] for r in io.read_channels(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == ["0_0", "0_1", *[f"1_{i}" for i in range(400)], "2_0"]


# ---------------------------------------------------------------- T1 to T4

EVENTS = "mission string, channel string, ts timestamp, value double"


def delivered(spark, job, batches, restart):
    """What a job gives from batches that arrive one after another, in one run or with a restart after each; and the late groups."""
    inbox, out, late = new_path(spark), new_path(spark), 0
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(inbox)
        if restart:
            stream = job(spark.readStream.schema(EVENTS).parquet(inbox))
            late += st.run_available(stream, out, out + "-state")
    if not restart:
        stream = job(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(inbox))
        late = st.run_available(stream, out, out + "-state")
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(out).collect()), key=str), late


@pytest.mark.parametrize("name", ["resample", "windows", "screen", "episodes"])
def test_streams_drop_late_rows_and_survive_restarts(spark, name):
    at = lambda h, mn=0: T0 + dt.timedelta(hours=h, minutes=mn)
    row = lambda h, v, mn=0, ch="c1": ("Mission1", ch, at(h, mn), float(v))
    # Spark judges a batch by the watermark before the last batch: the third, of no later time, lets both ways know the second's
    batches = [[row(0, 1), row(0, 3, 30), row(1, 5), row(2, 9, 0, "c2")], [row(40, 2), row(41, 4), row(39, 8, 59)], [row(40, 1, 0, "c2")], [row(1, 100), row(40, 6, 30), row(0, 50, 10, "c2")], [row(200, 1), row(201, 1)]]
    limits = spark.createDataFrame([("Mission1", "c1", 2.0, 1.0), ("Mission1", "c2", 0.0, 1.0)], "mission string, channel string, mean double, std double")
    job = {"resample": st.stream_resample, "windows": st.stream_windows, "screen": lambda x: st.stream_screen(x, limits), "episodes": lambda x: st.stream_episodes(x.select("mission", "channel", "ts"))}[name]
    one, late = delivered(spark, job, batches, False)
    again, late_again = delivered(spark, job, batches, True)
    assert one == again and late > 0 and late_again > 0
    punctual = [*batches[:3], [batches[3][1]], batches[4]]
    assert one == delivered(spark, job, punctual, True)[0] and len(one) >= 3  # what was late left no trace


def test_records_without_advice_stay_where_they_are(spark):
    """Records that are not anomalous have no id to meet advice by; they must not all be dealt to one task. Those that are keep every meeting."""
    kind = "id long, is_anomaly boolean, anomaly_id string, response string"
    few = [(1, True, "a", "bad"), (2, True, "b", "bad"), (3, True, None, "bad"), (4, None, "a", "odd"), (5, False, "a", "good"), (6, True, "a", "bad")]
    many = spark.range(100, 20_100, 1, 8).select("id", F.lit(False).alias("is_anomaly"), F.concat(F.lit("x"), F.col("id")).alias("anomaly_id"), F.lit("good").alias("response"))
    given = spark.createDataFrame([("a", "high", "spike", "look", "act"), ("c", "low", "drift", "wait", "rest"), (None, "low", "drift", "wait", "rest")], "anomaly_id string, severity string, pattern string, advice string, recommended_action string")
    out = ad.attach_advice(spark.createDataFrame(few, kind).union(many), given)
    assert out.columns == ["id", "is_anomaly", "anomaly_id", "response", "severity", "pattern"]
    told = "bad\n\nDIAGNOSIS: SPIKE (severity: high)\nADVICE: look\nACTION: act"
    rows = {r["id"]: (r["response"], r["severity"], r["pattern"]) for r in out.where("id < 100").collect()}
    assert rows == {1: (told, "high", "spike"), 2: ("bad", None, None), 3: ("bad", None, None), 4: ("odd", None, None), 5: ("good", None, None), 6: (told, "high", "spike")}
    parts = [r["count"] for r in out.where("id >= 100 and response = 'good' and severity is null").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 20_000 and max(parts) <= 10_000, parts
