"""Windows without a row for each grid point: the same as by way of the points."""

import datetime as dt
import random

from pyspark.sql import functions as F

from skyloom.operators import grid as g
from skyloom.operators import windows as w

DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((r.mission, r.channel or "", r.start_idx, r.end_idx, r.start_time, r.end_time, r.is_anomaly, r.anomaly_ratio, tuple(round(v, 9) for v in r["values"])) for r in df.collect())


def test_windows_of_stretches_are_those_of_points(spark, monkeypatch):
    monkeypatch.setattr(w, "CHUNK", 3)
    rng = random.Random(5)
    at = lambda h: DAY + dt.timedelta(hours=h)
    rows = [("M", c, at(rng.uniform(5, 400)), rng.choice([None, float("nan"), *[rng.uniform(0, 9) for _ in range(6)]])) for c in ("a", "b", None) for _ in range(60)]
    rows += [("M", "short", at(1), 1.0), ("M", "one", at(1), 2.0), ("M", "one", at(33.5), 3.0), ("M", "void", at(1), None), ("M", "void", at(99), None)]
    rows += [("M", "edge", at(1), None), ("M", "edge", at(50), 4.0), ("M", "edge", at(90), None)]
    telemetry = spark.createDataFrame(rows, "mission string, channel string, ts timestamp, value double")
    spans = [("M", c, at(x := rng.uniform(-50, 420)), at(x + rng.choice([0, 0.3, 5, 40, 300]))) for c in ("a", "one", None, "none") for _ in range(4)]
    spans += [("M", "b", at(100), at(120)), ("M", "b", at(110), at(130)), ("M", "b", at(100), at(120)), ("M", "edge", at(20.0), at(20.0))]
    intervals = spark.createDataFrame(spans, "mission string, channel string, start_time timestamp, end_time timestamp")
    points = g.in_intervals(g.resample(telemetry), intervals)
    seen = g.stretches(telemetry).localCheckpoint()
    got = w.windows_of_stretches(seen, intervals).localCheckpoint()
    assert rows_of(got) == rows_of(w.make_windows(points)) and {r.channel for r in got.select("channel").distinct().collect()} >= {"a", "b", None, "one", "edge"}
    assert rows_of(w.normalised_windows(got, seen)) == rows_of(w.make_windows(g.revin(points), value="value_norm"))
    assert got.where(F.col("channel") == "b").where("is_anomaly").count() > 0


def test_stretches_hold_no_row_for_a_point(spark):
    telemetry = spark.createDataFrame([("M", "a", DAY, 1.0), ("M", "a", DAY + dt.timedelta(days=900), 2.0)], "mission string, channel string, ts timestamp, value double")
    assert g.stretches(telemetry).count() == 2 and g.resample(telemetry).count() == 900 * 24 + 1


def test_short_channels_finish_in_a_task_as_long_ones_do_over_many(spark, monkeypatch):
    import numpy as np

    from skyloom.operators import detectors as d

    rng = np.random.default_rng(3)
    rows = [("M", c, i * 16, [float(v) for v in rng.normal(size=8)], bool(i % 9 == 0)) for c, n in (("a", 70), ("b", 41), ("c", 1)) for i in range(n)]
    windows = spark.createDataFrame(rows, "mission string, channel string, start_idx int, values array<double>, is_anomaly boolean").localCheckpoint()
    seen = lambda df: {(r.channel, r.start_idx): r for r in df.collect()}
    forest, errors = seen(d.isolation_forest(windows)), seen(d.reconstruction_errors(windows, least_normal=20))
    shuffled = []
    spread = d._spread_forest
    monkeypatch.setattr(d, "_spread_forest", lambda rows, *a: shuffled.append(1) or spread(rows, *a))
    assert not shuffled
    monkeypatch.setattr(d, "by_size", lambda rows, most: (rows.where("false"), rows))
    slow, far = seen(d.isolation_forest(windows)), seen(d.reconstruction_errors(windows, least_normal=20))
    assert shuffled and len(forest) == 112 and {k: (round(r.score, 12), r.flag) for k, r in forest.items()} == {k: (round(r.score, 12), r.flag) for k, r in slow.items()}
    assert len(errors) == 111 and {k: (r.i, round(r.error, 9), r.is_anomaly) for k, r in errors.items()} == {k: (r.i, round(r.error, 9), r.is_anomaly) for k, r in far.items()}


def test_telemetry_with_channels_beside_readings(spark, tmp_path):
    from skyloom.sources import io

    rows = [("M1", f"channel_{i % 40}", DAY, float(i), None) for i in range(200)] + [("M2", "channel_1", DAY, 7.0, "on")]
    df = spark.createDataFrame(rows, "mission string, channel string, ts timestamp, value double, raw string")
    df.coalesce(2).write.partitionBy("mission").parquet(str(tmp_path / "t"))
    back = io.read_telemetry(spark, str(tmp_path / "t"), df.select("mission", "channel").where("channel <> 'channel_3'"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.where("channel <> 'channel_3'").collect()}


def test_long_channels_in_fragments_and_windows_laid_out_in_parts(spark, monkeypatch):
    """Fragments of 50 buckets, chunks of 3 strides and 100 points at a time give what whole channels give; shapes and moments are those of the values."""
    rng = random.Random(8)
    at = lambda h: DAY + dt.timedelta(hours=h)
    rows = [("M", c, at(h), rng.choice([None, 1e3 + rng.uniform(0, 9)])) for c, n, top in (("a", 90, 900), ("b", 70, 3000), (None, 80, 400), ("few", 5, 3000)) for h in (rng.uniform(3, top) for _ in range(n))]
    telemetry = spark.createDataFrame(rows, "mission string, channel string, ts timestamp, value double").localCheckpoint()
    spans = [("M", c, at(x := rng.uniform(0, 2500)), at(x + rng.choice([0, 9, 2000]))) for c in ("a", "b", "few") for _ in range(6)]
    intervals = spark.createDataFrame(spans, "mission string, channel string, start_time timestamp, end_time timestamp")
    whole = sorted(map(str, g.stretches(telemetry).drop("_ref").collect()))
    points = g.in_intervals(g.resample(telemetry), intervals).localCheckpoint()
    plain = rows_of(w.make_windows(points))
    monkeypatch.setattr(g, "LONG", 50)
    seen = g.stretches(telemetry).localCheckpoint()
    assert sorted(map(str, seen.drop("_ref").collect())) == whole and seen.select("channel", "_ref").distinct().count() > 6
    monkeypatch.setattr(w, "CHUNK", 3)
    monkeypatch.setattr(w, "POINTS", 100)
    got = w.windows_of_stretches(seen, intervals, shape=True, moments=True).localCheckpoint()
    assert rows_of(got) == plain
    stats = {r.channel: (r.m, r.s) for r in points.groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    shaped = {(r.channel, r.start_idx): r for r in w.with_stats(w.make_windows(points)).collect()}
    normal = {(r.channel, r.start_idx): r for r in w.with_stats(w.make_windows(g.revin(points), value="value_norm")).collect()}
    for r in got.collect():
        assert abs(r._mean - stats[r.channel][0]) < 1e-8 and abs(r._std - stats[r.channel][1]) < 1e-8
        assert all(abs(r[c] - shaped[r.channel, r.start_idx][c]) < 1e-7 for c in w.SHAPE)
    for r in w.normalised_shape(got).collect():
        assert all(abs(r[c] - normal[r.channel, r.start_idx][c]) < 1e-7 for c in w.SHAPE)
    bare = w.windows_of_stretches(seen, intervals, values=False)
    assert "values" not in bare.columns and bare.count() == len(plain)


def test_windows_shuffle_no_values(spark):
    """The exchange holds stretches and intervals, neither points nor windows: no array passes it."""
    telemetry = spark.createDataFrame([("M", "a", DAY, 1.0), ("M", "a", DAY + dt.timedelta(days=900), 2.0)], "mission string, channel string, ts timestamp, value double")
    intervals = spark.createDataFrame([("M", "a", DAY, DAY)], "mission string, channel string, start_time timestamp, end_time timestamp")
    windows = w.windows_of_stretches(g.stretches(telemetry), intervals)
    assert windows.count() == 1349
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_only_keys_of_many_rows_are_spread(spark, monkeypatch):
    from skyloom import shared

    monkeypatch.setattr(shared, "SHARE", 10)
    rows = [("M", c, float(i)) for c, n in (("hot", 40), ("c", 3), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "mission string, channel string, x double")
    per = df.groupBy("mission", "channel").agg(F.sum("x").alias("total"), F.count("*").alias("_rows"))
    got = shared.join_spread(df, per, ["mission", "channel"])
    assert sorted(map(str, got.collect())) == sorted(map(str, [df.sparkSession.createDataFrame([(*r, {"hot": 780.0, "c": 3.0, None: 66.0}[r[1]])], "mission string, channel string, x double, total double").first() for r in rows]))


def test_screened_state_is_not_broadcast(spark, tmp_path):
    """The batch without rows of its own, whose state may be large, meets the thresholds by an exchange."""
    from skyloom.streaming import jobs as st

    rows = [("M", f"c{i % 3}", DAY + dt.timedelta(hours=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "mission string, channel string, ts timestamp, value double")
    df.write.parquet(f"{tmp_path}/in")
    thresholds = df.groupBy("mission", "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    job = st.stream_screen(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), thresholds).writeStream.format("memory").queryName("screened").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    plan = job._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert spark.table("screened").count() == 57


def test_windows_sort_by_a_number_first_and_once(spark):
    """Rows of a channel stand together by a number of its name, and all windows over known hours share that sort."""
    telemetry = spark.createDataFrame([("M", "a", DAY, 1.0), ("M", "a", DAY + dt.timedelta(days=900), 2.0)], "mission string, channel string, ts timestamp, value double")
    intervals = spark.createDataFrame([("M", "a", DAY, DAY)], "mission string, channel string, start_time timestamp, end_time timestamp")
    sorts = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Sort [" in x]
    seen = g.stretches(telemetry)
    assert all("Sort [_key" in x for x in sorts(seen)) and sum("_at" in x for x in sorts(seen)) == 1
    assert any("Sort [_key" in x and "_lo" in x for x in sorts(w.windows_of_stretches(seen.localCheckpoint(), intervals)))
