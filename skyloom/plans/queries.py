"""Registered queries: every operator of the library on the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.constants import SYSTEM_PROMPT, TURN
from ..operators import advice as a
from ..operators import checks as v
from ..operators import detectors as d
from ..operators import fusion as f
from ..operators import grading as gr
from ..operators import grid as g
from ..operators import imagery as im
from ..operators import metrics as m
from ..operators import sampling as k
from ..operators import sequences as s
from ..operators import windows as w
from ..schemas import MC
from ..shared import binary_round, new_path, stored
from ..sources import io
from ..streaming import jobs as st
from . import bindings as b

QUERIES: dict = {}
KEYS = [*MC, "start_idx"]
SEED = 42


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


#: Readings have two decimals, so interpolated ones often end in an exact 5; this decides it the same way in every engine.
TIE = 1e-7


def digest_of(values: str, name: str = "values") -> Column:
    """A text of the array's values at 4 decimals."""
    return F.array_join(F.transform(values, lambda x: F.round(x + TIE, 4).cast("decimal(20,4)").cast("string")), ",").alias(name)


# ---------------------------------------------------------------- sources


@query
def s1_missions(spark, sf):
    return io.filter_missions(b.telemetry(spark, sf), "1,3").groupBy("mission").agg(F.count("*").alias("n"))


def catalogue(spark, sf):
    """The catalogue written as files and read again."""
    path = new_path(spark)
    rows = b.channels(spark, sf).orderBy("ordinal")
    io.write_catalogue(rows.select("mission", F.col("channel").alias("Channel"), F.col("subsystem").alias("Subsystem"), F.col("physical_unit").alias("Physical Unit"), F.col("grp").alias("Group"), F.col("target").alias("Target")), path, "channels.csv")
    return io.read_channels(spark, path)


@query
def s2_channels(spark, sf):
    return catalogue(spark, sf)


@query
def s3_cap_channels(spark, sf):
    return io.cap_channels(b.channels(spark, sf), 3)


@query
def s4_telemetry(spark, sf):
    """Readings written as a folder for each mission, the channel beside each reading, and read again: files follow the size of the data, not the
    number of channels."""
    path = new_path(spark)
    b.telemetry(spark, sf).select(*MC, "ts", "value", "raw").write.partitionBy("mission").parquet(path)
    return io.read_telemetry(spark, path, catalogue(spark, sf)).groupBy(*MC).agg(F.count("*").alias("n"), F.count("raw").alias("n_raw"), F.max(stamp("ts")).alias("last"), F.round(F.sum("value"), 4).alias("total"))


@query
def s5_intervals(spark, sf):
    """Intervals written as files with ISO-8601 texts and read again."""
    path = new_path(spark)
    iso = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(n) for c, n in (("start_time", "StartTime"), ("end_time", "EndTime"))]
    io.write_catalogue(b.intervals(spark, sf).select("mission", F.col("id").alias("ID"), F.col("channel").alias("Channel"), *iso), path, "labels.csv")
    return io.read_intervals(spark, path).select("mission", "id", "channel", stamp("start_time"), stamp("end_time"))


@query
def s6_records(spark, sf):
    """Records written as JSON lines by mission and read again."""
    records = t.to_record(b.windows(spark, sf)).withColumn("split", F.when(F.col("metadata.start_idx") % 32 == 0, "train").otherwise("test"))
    path = new_path(spark)
    io.write_records(records, path)
    back = io.read_records(spark, path, io.RECORD + ", split string")
    return back.select("split", "metadata.mission", "metadata.channel", "metadata.start_idx", "metadata.start_time", "metadata.is_anomaly", F.size("metadata.values").alias("n_values"), F.length("response").alias("n_response"))


@query
def s7_results(spark, sf):
    rows = b.answers(spark, sf).withColumn("predicted", t.parse_verdict(F.col("actual_response")))
    path = new_path(spark)
    io.write_results(rows, m.verdict_summary(rows), path)
    return spark.read.parquet(f"{path}/rows").groupBy("predicted").agg(F.count("*").alias("n"))


@query
def s8_pending(spark, sf):
    units = b.channels(spark, sf).select(*MC)
    return io.pending(units, b.intervals(spark, sf), MC)


@query
def s9_split_dense(spark, sf):
    dense = b.errors(spark, sf).groupBy(*MC).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "error"))), lambda x: x["error"]).alias("window_errors"))
    return io.split_dense(dense)[1].select(*MC, "i", *r6("error"))


# ---------------------------------------------------------------- columns


@query
def p1_ordinal(spark, sf):
    return b.telemetry(spark, sf).select("event_id", g.ordinal_encode(F.col("raw")).alias("encoded"))


@query
def p2_revin(spark, sf):
    return g.revin(b.grid(spark, sf)).select(*MC, "idx", *r6("value_norm", "mean", "std"))


@query
def p2_revin_inverse(spark, sf):
    return g.revin_inverse(g.revin(b.grid(spark, sf)).drop("value")).select(*MC, "idx", F.round(F.col("value") + TIE, 5).alias("value"))


@query
def p3_standardize(spark, sf):
    return g.standardize(b.grid(spark, sf)).select(*MC, "idx", *r6("value_std"))


@query
def p4_positions(spark, sf):
    return g.standardize_positions(b.windows(spark, sf)).groupBy(*MC, "pos").agg(F.round(F.max("value"), 5).alias("hi"), F.round(F.min("value"), 5).alias("lo"), F.count("*").alias("n"))


@query
def p5_revin_window(spark, sf):
    return g.revin_window(b.windows(spark, sf)).select(*KEYS, F.round(F.array_max("values_norm"), 6).alias("hi"), F.round(F.array_min("values_norm"), 6).alias("lo"), F.round(F.element_at("values_norm", 1), 6).alias("first"))


@query
def p6_instruction(spark, sf):
    return b.windows(spark, sf).select(*KEYS, t.instruction_text(F.col("mission"), F.col("channel"), F.transform("values", lambda x: F.round(x + TIE, 2))).alias("instruction"))


@query
def p7_response(spark, sf):
    return b.windows(spark, sf, values=False).select(*KEYS, t.response_text(F.col("is_anomaly")).alias("response"))


@query
def p8_record(spark, sf):
    r = t.to_record(b.windows(spark, sf))
    return r.select("metadata.mission", "metadata.channel", "metadata.start_idx", "metadata.end_idx", "metadata.start_time", "metadata.end_time", "metadata.is_anomaly", "metadata.anomaly_ratio", digest_of("metadata.values"))


@query
def p9_window_stats(spark, sf):
    return b.shaped(spark, sf).select(*KEYS, *r6("mean", "std", "p2p", "trend"))


@query
def p10_pattern(spark, sf):
    shape = [F.col(c) for c in ("anomaly_ratio", "mean", "std", "p2p", "trend")]
    return b.shaped(spark, sf).select(*KEYS, a.classify_pattern(*shape).alias("pattern"))


@query
def p11_pattern_desc(spark, sf):
    shape = [F.col(c) for c in ("anomaly_ratio", "mean", "std", "p2p", "trend")]
    return b.shaped(spark, sf).select(*KEYS, a.pattern_desc(*shape, lambda x: binary_round(binary_round(x, 4), 2)).alias("description"))


@query
def p12_severity(spark, sf):
    return b.windows(spark, sf, values=False).where("is_anomaly").select(*KEYS, a.severity(F.col("anomaly_ratio")).alias("severity"))


@query
def p13_names(spark, sf):
    return a.lookup_names(b.channels(spark, sf)).select(*MC, "subsystem", "physical_unit")


@query
def p14_anomaly_id(spark, sf):
    return b.windows(spark, sf, values=False).select(*KEYS, a.anomaly_id(F.col("mission"), F.col("channel"), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")).alias("anomaly_id"))


@query
def p15_enriched(spark, sf):
    rows = b.advice(spark, sf)
    return rows.select("anomaly_id", a.enrich_response(t.response_text(F.lit(True)), F.col("pattern"), F.col("severity"), F.col("pattern"), F.col("recommended_action")).alias("response"))


@query
def p16_chatml(spark, sf):
    return b.chats(spark, sf).select("conv_id", "turn", t.to_chatml(F.col("instruction"), F.col("response")).alias("text"))


@query
def p17_prompt(spark, sf):
    c = b.chats(spark, sf)
    prefix = t.fewshot_prefix(c.withColumn("index", F.col("conv_id") * 1000 + F.col("turn")), 1)
    return c.crossJoin(F.broadcast(prefix)).select("conv_id", "turn", t.to_prompt(F.col("instruction"), F.col("prefix"), True).alias("prompt"))  # one prefix row


@query
def p18_fewshot(spark, sf):
    return t.fewshot_prefix(b.chats(spark, sf).withColumn("index", F.col("conv_id") * 1000 + F.col("turn")), 2)


@query
def p19_verdict(spark, sf):
    return b.answers(spark, sf).select("index", t.parse_verdict(F.col("actual_response")).alias("predicted"))


@query
def p20_verdict_score(spark, sf):
    x, y = F.col("l_anom"), F.col("l_nom")
    return b.logits(spark, sf).select("index", t.verdict_score(x, y).alias("score"), t.argmax(x, y).alias("argmax"))


@query
def p21_conversation(spark, sf):
    rows = b.windows(spark, sf).select(*KEYS, "is_anomaly", "values")
    c = t.to_conversation(k.plot_manifest(k.split(rows, KEYS, seed=SEED), 1 << 40))
    return c.select("index", F.col("messages")[0]["content"][1]["image"].alias("image"), F.col("messages")[0]["content"][0]["text"].alias("prompt"), F.col("messages")[1]["content"][0]["text"].alias("label"))


@query
def p22_log_flux(spark, sf):
    y = t.log_flux(F.col("value") * 1e-6)
    return b.telemetry(spark, sf).select("event_id", F.round(y, 6).alias("label"), F.round(t.log_flux_inverse(y) * 1e6, 4).alias("back"))


@query
def p23_scalar(spark, sf):
    return b.telemetry(spark, sf).select("event_id", t.scalar_of(F.array("value")).alias("value"))


@query
def p24_advice_flags(spark, sf):
    return b.answers(spark, sf).select("index", *[c.alias(n) for n, c in t.advice_flags(F.col("actual_response")).items()])


@query
def p25_normalise(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", t.normalise_verdict(F.when(F.col("turn") % 3 == 0, "anomaly").when(F.col("turn") % 3 == 1, "Nominal").otherwise(F.col("role"))).alias("predicted"))


@query
def p26_parse_time(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("no time")
    return b.telemetry(spark, sf).select("event_id", t.parse_time(text).alias("at")).select("event_id", stamp("at"))


# ---------------------------------------------------------------- grid and sequences


@query
def w1_resample(spark, sf):
    return g.resample(b.telemetry(spark, sf)).select(*MC, "idx", stamp("ts"), F.round(F.col("value") + TIE, 5).alias("value"))


@query
def w1_no_rule(spark, sf):
    return g.resample(b.telemetry(spark, sf), None).groupBy(*MC).agg(F.max("idx").alias("last"), F.round(F.sum("value"), 4).alias("total"))


@query
def w2_mask(spark, sf):
    return b.grid(spark, sf).select(*MC, "idx", "is_anomaly")


@query
def w3_windows(spark, sf):
    return b.windows(spark, sf).select(*KEYS, "end_idx", stamp("start_time"), stamp("end_time"), "is_anomaly", "anomaly_ratio", digest_of("values"))


@query
def w3_channel_windows(spark, sf):
    """The headline: per channel, windows and the share of anomalous ones."""
    return b.windows(spark, sf, values=False).groupBy(*MC).agg(F.count("*").alias("n_windows"), F.round(F.avg(F.col("is_anomaly").cast("int")), 6).alias("anomaly_share"))


@query
def w4_short(spark, sf):
    return g.short_channels(b.grid(spark, sf), 700)


@query
def w5_ewma(spark, sf):
    return s.ewma(b.errors(spark, sf), 5).select(*MC, "i", F.round("ewma", 4).alias("ewma"))


@query
def w6_runs(spark, sf):
    return s.contiguous_runs(b.grid(spark, sf).withColumnRenamed("idx", "i"), "is_anomaly").select(*MC, "start", "end", "n")


def span(windows):
    return windows.select(*MC, F.col("start_idx").alias("start"), (F.col("start_idx") + 32).alias("end"))


def pred_gt(spark, sf):
    e = stored(d.flat_threshold(stored(b.errors(spark, sf)), 1.0).where("flag or is_anomaly"))  # read four times
    return span(e.where("flag")), span(e.where("is_anomaly"))


@query
def w7_merge(spark, sf):
    return s.merge_intervals(span(stored(b.windows(spark, sf, values=False).where("is_anomaly").select(*MC, "start_idx"))), 16)  # a range exchange reads twice


@query
def w8_spans(spark, sf):
    starts = b.errors(spark, sf).where("is_anomaly").groupBy(*MC).agg(F.array_sort(F.collect_list((F.col("i") * 16).cast("int"))).alias("starts"))
    return s.spans(starts, "starts", 32)


# ---------------------------------------------------------------- joins


@query
def j1_point_in_interval(spark, sf):
    """Every reading against the intervals."""
    p = b.telemetry(spark, sf).select(*MC, "event_id", "ts")
    return g.in_intervals(p, b.intervals(spark, sf)).select("event_id", "is_anomaly")


@query
def j2_channel_meta(spark, sf):
    return a.with_channel_meta(b.windows(spark, sf, values=False).select(*KEYS), io.targets(b.channels(spark, sf))).select(*KEYS, "subsystem", "physical_unit", "grp")


@query
def j3_attach_advice(spark, sf):
    windows = stored(b.measured(spark, sf))  # read twice
    rows = windows.select(*KEYS, "is_anomaly", a.anomaly_id(F.col("mission"), F.col("channel"), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss")).alias("anomaly_id"), t.response_text(F.col("is_anomaly")).alias("response"))
    return a.attach_advice(rows, b.advice(spark, sf, windows)).select(*KEYS, "severity", "pattern", F.length("response").alias("n_response"))


def side(spark, sf, name):
    return b.scores(spark, sf).select("index", *MC, "is_anomaly", F.col(name).alias("score"))


@query
def j4_align(spark, sf):
    return f.align(side(spark, sf, "text"), side(spark, sf, "vision")).select("index", "text", "score", "same")


def meta(spark, sf):
    """A window place for each scored row."""
    return b.scores(spark, sf).select("index", *MC, F.floor((F.col("index") % 40) * 16).cast("int").alias("start_idx"), F.floor((F.col("index") % 40) * 16 + 32).cast("int").alias("end_idx"))


@query
def j5_map_to_grid(spark, sf):
    return f.map_to_grid(meta(spark, sf), b.errors(spark, sf)).select("index", "i", *r6("error"))


@query
def j6_verdict_windows(spark, sf):
    v_ = b.answers(spark, sf).select("index", t.parse_verdict(F.col("actual_response")).alias("predicted"))
    return f.verdict_windows(v_, meta(spark, sf)).select("index", "predicted", "start_idx", "end_idx")


def indexed_windows(spark, sf):
    return b.windows(spark, sf, values=False).select((F.regexp_extract("channel", r"(\d+)$", 1).cast("long") * 1000 + F.col("start_idx")).alias("index"), *MC, "start_time", "end_time", "is_anomaly")


@query
def j7_best_overlap(spark, sf):
    """Windows are stored, as levels, pairs and the result read them."""
    return gr.best_overlap(stored(indexed_windows(spark, sf)), b.intervals(spark, sf)).select("index", "ref_id", F.round("overlap_s", 3).alias("overlap_s"))


@query
def j8_interval_match(spark, sf):
    p, y = (stored(s.merge_intervals(x, 16)) for x in pred_gt(spark, sf))  # read for their levels and for the pairs
    return m.interval_matches(p, y).select(*MC, "ps", "pe", "gs", "ge")


@query
def j9_missing(spark, sf):
    return gr.missing(b.scores(spark, sf).select("index"), b.judgments(spark, sf).where("correctness > 0"))


@query
def j10_assemble(spark, sf):
    j = b.judgments(spark, sf).drop("is_anomaly")
    return gr.assemble(side(spark, sf, "text"), j).select("index", "mission", "is_anomaly", "score", "correctness", "actionability", "grounding")


@query
def j11_prior(spark, sf):
    """Prior values onto channels, NaN where there is none."""
    prior = b.intervals(spark, sf).groupBy(*MC).agg(F.count("*").cast("double").alias("loss"))
    return gr.carry_prior(b.channels(spark, sf).select(*MC), prior, "loss").withColumn("has_prior", ~F.isnan("loss")).withColumn("loss", F.nanvl("loss", F.lit(-1.0)))


# ---------------------------------------------------------------- samples


def flags(spark, sf):
    return b.windows(spark, sf, values=False).select(*KEYS, "is_anomaly")


@query
def k1_balance(spark, sf):
    return k.balance(flags(spark, sf), KEYS, seed=SEED)


@query
def k2_cap(spark, sf):
    return k.cap(flags(spark, sf), 500, KEYS, seed=SEED)


@query
def k3_shuffle(spark, sf):
    """The shuffled order as a place for each row."""
    from ..shared import draw, exact_rank

    return exact_rank(flags(spark, sf).withColumn("_d", draw(KEYS, SEED)), ["_d", *KEYS], "place").drop("_d")


@query
def k4_split(spark, sf):
    return k.split(flags(spark, sf), KEYS, seed=SEED)


@query
def k5_index(spark, sf):
    return k.split(flags(spark, sf), KEYS, seed=SEED).groupBy("split").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.count("*").alias("n"), F.countDistinct("index").alias("distinct_n"))


@query
def k6_stratified(spark, sf):
    return k.stratified_sample(flags(spark, sf), 150, "is_anomaly", KEYS, seed=SEED)


@query
def k7_sample_flags(spark, sf):
    flagged = d.flat_threshold(b.errors(spark, sf), 1.0).where("flag").select(*KEYS, "is_anomaly")
    return k.stratified_sample(flagged, 40, "is_anomaly", KEYS, seed=SEED)


@query
def k8_cap_per_key(spark, sf):
    return k.cap_per_key(flags(spark, sf).where("not is_anomaly"), 20, MC, KEYS, seed=SEED)


@query
def k9_manifest(spark, sf):
    rows = b.windows(spark, sf).select(*KEYS, "is_anomaly", "values")
    return k.plot_manifest(k.split(rows, KEYS, seed=SEED), 300)


@query
def k10_dedupe(spark, sf):
    twice = b.advice(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(0))))
    return a.dedupe_advice(twice, ["copy"]).select("anomaly_id", "pattern", "severity", "copy")


@query
def k11_holdout(spark, sf):
    return k.holdout(b.images(spark, sf).select("index", "label"), 0.2, ["index"], seed=SEED)


@query
def k12_bounded(spark, sf):
    return k.take_bounded(b.images(spark, sf).select("index", "label"), 100, ["index"])


@query
def k13_best(spark, sf):
    return m.best_by(a12_sweep(spark, sf), "cef")


@query
def k14_union(spark, sf):
    rows = approach_rows(spark, sf)
    return rows.select("approach", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "cef")])


# ---------------------------------------------------------------- metrics


def flat(spark, sf, z=1.0, errors=None):
    errors = stored(b.errors(spark, sf)) if errors is None else errors  # read twice
    return d.flat_threshold(errors, z).withColumnRenamed("flag", "pred")


@query
def a1_confusion(spark, sf):
    return m.confusion(flat(spark, sf), "pred", "is_anomaly", MC).select(*MC, "tp", "fp", "fn", "tn", *r6("precision", "recall", "f1"))


def verdicts(spark, sf):
    return b.answers(spark, sf).withColumn("predicted", t.parse_verdict(F.col("actual_response")))


@query
def a2_verdict_summary(spark, sf):
    return m.verdict_summary(verdicts(spark, sf))


@query
def a3_score_summary(spark, sf):
    rows = b.logits(spark, sf).withColumn("argmax", t.argmax(F.col("l_anom"), F.col("l_nom"))).withColumn("elapsed_s", F.col("index") % 7 / 10.0)
    return m.verdict_summary(rows, "argmax")


@query
def a4_cef(spark, sf):
    return a1_confusion(spark, sf).select(*MC, F.round(m.cef(F.col("precision"), F.col("recall")), 4).alias("cef"))


def records(spark, sf, errors=None):
    return m.confusion(flat(spark, sf, errors=errors), "pred", "is_anomaly", MC)


@query
def a5_macro(spark, sf):
    return m.macro(records(spark, sf)).select(*r6("precision", "recall", "f1", "cef"), "n_channels")


@query
def a6_macro_report(spark, sf):
    return m.macro(records(spark, sf), True).select(*r6("precision", "recall", "f1", "cef"), "n_channels")


@query
def a7_affinity(spark, sf):
    return m.affinity_f1(*pred_gt(spark, sf)).select("n_pred", "n_gt", "pred_hit", "gt_hit", *r6("affinity_precision", "affinity_recall", "affinity_f1"))


@query
def a8_trivial(spark, sf):
    return m.trivial_baseline(flags(spark, sf)).select(*r6("precision", "recall", "f1", "cef"), "n_units")


@query
def a9_detection(spark, sf):
    return m.summarize_detection(verdicts(spark, sf))


@query
def a10_severity_counts(spark, sf):
    return a.advice_counts(b.advice(spark, sf), "severity")


@query
def a10_pattern_counts(spark, sf):
    return a.advice_counts(b.advice(spark, sf), "pattern")


@query
def a11_split_counts(spark, sf):
    return m.split_counts(k.split(flags(spark, sf), KEYS, seed=SEED))


@query
def a12_sweep(spark, sf):
    return m.sweep(b.scores(spark, sf), "text", m.unit_grid())


@query
def a13_range_sweep(spark, sf):
    return m.sweep(b.scores(spark, sf), "vision", m.range_grid(b.scores(spark, sf), "vision"))


@query
def a14_average_precision(spark, sf):
    return m.average_precision(b.scores(spark, sf), "text").select(*r6("average_precision"))


@query
def a15_pr_curve(spark, sf):
    return m.pr_curve(b.scores(spark, sf), "vision").select("threshold", *r6("precision", "recall"))


@query
def a16_operating_points(spark, sf):
    rows = b.scores(spark, sf)
    hard = F.when(F.col("text") >= 0.4, "ANOMALY").when(F.col("text") < 0.1, "UNKNOWN").otherwise("NOMINAL")
    return m.operating_points(rows, "text", m.unit_grid(), verdicts=rows.select("is_anomaly", hard.alias("predicted")))


@query
def a17_grades(spark, sf):
    return gr.grade_stats(b.judgments(spark, sf))


@query
def a18_rubric(spark, sf):
    """Judgments beyond the scale, after a shift that puts some there."""
    return gr.check_rubric(b.judgments(spark, sf).withColumn("correctness", F.col("correctness") + (F.col("index") % 10 == 0).cast("int"))).select("index", "correctness", "actionability", "grounding")


def approach_rows(spark, sf):
    errors = stored(b.errors(spark, sf))  # a row for each window, read by three approaches
    det = m.macro(records(spark, sf, errors)).withColumn("approach", F.lit("flat threshold")).drop("n_channels")
    loose = m.macro(m.confusion(flat(spark, sf, 2.0, errors), "pred", "is_anomaly", MC)).withColumn("approach", F.lit("flat threshold z 2")).drop("n_channels")
    text = m.summarize_detection(verdicts(spark, sf)).withColumn("approach", F.lit("text")).select("approach", "precision", "recall", "f1", "cef", "format_compliance", "advice_structured_frac", "advice_avg_chars")
    trivial = m.trivial_baseline(errors).withColumn("approach", F.lit("always")).drop("n_units")
    return stored(gr.union_metrics(det, loose, text, None, trivial))  # few rows, which comparisons read again and again


@query
def a19_compare(spark, sf):
    rows = approach_rows(spark, sf).select("approach", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "cef")], "format_compliance", "advice_structured_frac")
    return gr.compare(rows, "text", "always")


@query
def a20_hybrid(spark, sf):
    det = m.macro(records(spark, sf)).select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "cef")])
    return gr.hybrid_row(det, m.summarize_detection(verdicts(spark, sf)))


@query
def a21_regression(spark, sf):
    return im.regression_metrics(b.regression(spark, sf)).select(*r6("mae", "rmse", "bias", "pearson"), "n")


@query
def a22_mean_baseline(spark, sf):
    rows = b.regression(spark, sf)
    return im.mean_baseline(rows.where("l_orderkey % 5 <> 0"), rows.where("l_orderkey % 5 = 0")).select(*r6("baseline_mae"))


@query
def a23_gini(spark, sf):
    return b.images(spark, sf).select("index", F.round(im.gini(F.col("attribution")), 5).alias("gini"))


@query
def a24_top_decile(spark, sf):
    return b.images(spark, sf).select("index", F.round(im.top_decile_mass(F.col("attribution")), 5).alias("top_decile"))


@query
def a25_brightness(spark, sf):
    """The brightness array and its reverse are two channels of an image."""
    rows = b.images(spark, sf).withColumn("brightness", F.concat("brightness", F.reverse("brightness")))
    return im.brightness_corr(rows, ["index"], channels=2).select("index", (F.round("r", 5) + 0.0).alias("r"))


@query
def a26_avg_pool(spark, sf):
    return im.avg_pool(b.images(spark, sf), ["index"], "attribution", 8, 2).select("index", "patch_id", (F.round("mean", 5) + 0.0).alias("mean"))


@query
def a27_resize(spark, sf):
    return b.images(spark, sf).select("index", digest_of(im.resize_bilinear(F.col("attribution"), 1, 8, 8, 4, 4), "pixels"))


@query
def a28_faithful(spark, sf):
    total = F.aggregate("attribution", F.lit(0.0), lambda x, y: x + y)
    return b.images(spark, sf).select("index", im.faithfulness(F.col("attribution"), total + (F.col("index") % 3 == 0).cast("double") * 0.01).alias("faithful"))


@query
def a29_profile(spark, sf):
    return im.profile(b.images(spark, sf), "attribution", "label").select("rows", "min_size", "max_size", *[F.round(c, 5).alias(c) for c in ("value_min", "value_max")], "label_min", "label_max", "not_finite")


@query
def a30_column_means(spark, sf):
    return im.column_means(b.images(spark, sf), ["index"], "attribution", 8).select("index", "col", (F.round("mean", 5) + 0.0).alias("mean"))


# ---------------------------------------------------------------- detectors and fusion


@query
def d1_flat_threshold(spark, sf):
    return flat(spark, sf, 2.0).select(*MC, "i", F.round("threshold", 4).alias("threshold"), "pred")


@query
def d2_z_sweep(spark, sf):
    return d.z_sweep(stored(b.errors(spark, sf)), (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)).select("z", *r6("precision", "recall", "f1", "cef"), "n_channels")


@query
def d2_best_z(spark, sf):
    return d.best_z(d2_z_sweep(spark, sf))


@query
def d3_epsilon(spark, sf):
    return d.epsilons(d.smoothed(b.errors(spark, sf), 5)).select(*MC, F.round(F.exp("eps"), 6).alias("epsilon"))


@query
def d4_pruned(spark, sf):
    """Flags before and after pruning."""
    return d.flag_counts(d.dynamic_runs(b.errors(spark, sf)), {"n_all": 0.0, "n_pruned": 0.13})


@query
def d5_dynamic(spark, sf):
    return d.detect_dynamic(b.errors(spark, sf)).select(*MC, "i", "flag", *r6("epsilon"))


@query
def d6_isolation_forest(spark, sf):
    return d.isolation_forest(b.windows(spark, sf)).select(*KEYS, *r6("score"), "flag")


@query
def d7_reconstruction(spark, sf):
    return d.reconstruction_errors(b.windows(spark, sf), least_normal=20).select(*MC, "i", "start_idx", *r6("error"), "is_anomaly")


@query
def d8_score_windows(spark, sf):
    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        spread = batch["values"].map(lambda x: max(x) - min(x)).astype(float) + TIE
        return pd.DataFrame({"l_anom": spread / 50, "l_nom": 2 - spread / 50})

    return d.score_windows(b.windows(spark, sf).select(*KEYS, "values"), predict, KEYS)


@query
def d9_matrix(spark, sf):
    return f.score_matrix(side(spark, sf, "text"), side(spark, sf, "vision"), b.errors(spark, sf), meta(spark, sf)).select("index", "is_anomaly", "text", "vision", *r6("error"))


@query
def d10_weighted(spark, sf):
    return f.weighted_sum(b.scores(spark, sf), ["text", "vision"]).select("index", *r6("weighted"))


@query
def d11_vote(spark, sf):
    return f.vote(b.scores(spark, sf).where("error is not null"), ["text", "vision", "error"])


@query
def d12_oof_stack(spark, sf):
    return f.oof_stack(b.scores(spark, sf).select("index", "is_anomaly", "text", "vision"), ["text", "vision"], seed=SEED).select("index", "fold", F.round("stacked", 4).alias("stacked"))


@query
def d13_stack_weights(spark, sf):
    return f.stack_weights(b.scores(spark, sf).select("index", "is_anomaly", "text", "vision"), ["text", "vision"])


@query
def d14_singles(spark, sf):
    return f.single_baselines(b.scores(spark, sf), ["text", "vision"])


@query
def d15_fuse(spark, sf):
    return f.fuse(b.scores(spark, sf).select("index", "is_anomaly", "text", "vision", "error"), SEED)


@query
def d16_alerts(spark, sf):
    windows = stored(b.measured(spark, sf))  # read four times
    rows = flat(spark, sf, errors=b.errors(spark, sf, windows)).withColumnRenamed("pred", "flag").where("flag").join(windows.select(*KEYS, "start_time"), KEYS)
    ids = rows.withColumn("anomaly_id", a.anomaly_id(F.col("mission"), F.col("channel"), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"))).select("anomaly_id", "flag")
    return f.hybrid_alerts(ids, b.advice(spark, sf, windows)).select("anomaly_id", "severity", "pattern", "rank")


# ---------------------------------------------------------------- checks


@query
def v1_splits(spark, sf):
    """As many windows as the times of each channel's first and last reading allow."""
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    each = b.telemetry(spark, sf).groupBy(*MC).agg((hour(F.max("ts")) - hour(F.min("ts")) + 1).alias("n"))
    total = each.agg(F.sum(F.greatest(F.lit(0), F.floor((F.col("n") - 32) / 16) + 1))).first()[0]
    return v.check_splits(flags(spark, sf), total, 1, total, 3)


@query
def v2_advice(spark, sf):
    return v.check_advice(b.advice(spark, sf), ["advice", "recommended_action", "pattern"])


@query
def v3_chat(spark, sf):
    return v.check_chat(p16_chatml(spark, sf).select("text"), f"{TURN}system\n{SYSTEM_PROMPT}")


@query
def v4_detector(spark, sf):
    """The errors of a channel's first and last window stand for the losses of its fit."""
    loss = b.errors(spark, sf).groupBy(*MC).agg(F.min_by("error", "i").alias("first_loss"), F.max_by("error", "i").alias("last_loss"))
    return v.check_detector(records(spark, sf).where("tp + fn > 0").join(loss, MC))


@query
def v5_verdicts(spark, sf):
    return v.check_verdicts(verdicts(spark, sf))


@query
def v6_comparison(spark, sf):
    """An approach without metrics counts as failed."""
    rows = approach_rows(spark, sf)
    return v.check_comparison(rows.withColumn("error", F.when(F.col("f1").isNull() | F.isnan("f1"), F.concat(F.lit("no metrics of "), "approach"))), "text")


@query
def v7_regression(spark, sf):
    rows = b.regression(spark, sf)
    base = im.mean_baseline(rows.where("l_orderkey % 5 <> 0"), rows.where("l_orderkey % 5 = 0"))
    return v.check_regression(im.regression_metrics(rows).crossJoin(base).withColumn("cost", F.col("n") * 1e-4))  # two single rows


@query
def v8_images(spark, sf):
    """Every index from the least to the greatest was asked for."""
    rows = b.images(spark, sf)
    low, high = rows.agg(F.min("index"), F.max("index")).first()
    return v.check_images(im.profile(rows, "attribution", "label"), 1, 8, 8, -1.0, 1.0, high - low + 1)


@query
def v9_attribution(spark, sf):
    x = b.images(spark, sf)
    total = F.aggregate("attribution", F.lit(0.0), lambda p, q: p + q)
    rows = x.select("index", im.faithfulness(F.col("attribution"), total).alias("faithful"), im.gini(F.col("attribution")).alias("gini"), im.top_decile_mass(F.col("attribution")).alias("top_decile"))
    return v.check_attribution(rows.join(im.brightness_corr(x, ["index"]), "index"))


# ---------------------------------------------------------------- streams


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream; the pattern in the name lets the source take one file as well as a folder."""
    events = b.table(spark, sf, "events")
    return b.as_telemetry(spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]"))


def thresholds(spark, sf):
    return b.telemetry(spark, sf).groupBy(*MC).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@query
def t1_stream_resample(spark, sf):
    return st.drain(st.stream_resample(stream(spark, sf))).select(*MC, stamp("ts"), *r6("value"), "n")


@query
def t1_stream_late(spark, sf):
    """The hourly means again, from three deliveries with a restart from the state folder after each: the first half of the time, the second, and
    last every tenth event, of all times, most of which are then too late."""
    events = b.table(spark, sf, "events")
    late, half = F.col("event_id") % 10 == 0, events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t")).first()["t"]
    inbox, out = new_path(spark), new_path(spark)
    for part in (events.where(~late & (F.col("ts") <= F.lit(half))), events.where(~late & (F.col("ts") > F.lit(half))), events.where(late)):
        part.write.mode("append").parquet(inbox)
        feed = st.stream_resample(b.as_telemetry(spark.readStream.schema(events.schema).parquet(inbox)))
        st.run_available(feed, out, out + "-state")
    return spark.read.schema(feed.schema).parquet(out).select(*MC, stamp("ts"), *r6("value"), "n")


@query
def t2_stream_windows(spark, sf):
    return st.drain(st.stream_windows(stream(spark, sf))).select(*MC, stamp("start_time"), stamp("end_time"), "n", F.round(F.col("mean") + TIE, 4).alias("mean"), *[F.round(c, 4).alias(c) for c in ("std", "lo", "hi")])


@query
def t3_stream_screen(spark, sf):
    return st.drain(st.stream_screen(stream(spark, sf), thresholds(spark, sf), 1.0)).select(*MC, stamp("ts"), *r6("value"), "flag")


@query
def t4_stream_episodes(spark, sf):
    high = stream(spark, sf).join(thresholds(spark, sf), MC).where("value > mean + std").select(*MC, "ts")
    return st.drain(st.stream_episodes(high)).select(*MC, stamp("start_time"), stamp("end_time"), "n")
