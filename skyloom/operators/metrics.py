"""Metrics, threshold sweeps and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MC
from ..shared import running_sums, stored
from .overlaps import meeting
from .sequences import merge_intervals


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    """A4 with beta 0.5"""
    return ratio((1 + beta**2) * p * r, beta**2 * p + r)


def cef(p: Column, r: Column, beta: float = 0.5) -> Column:
    return f_beta(p, r, beta)


def prf(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", f_beta(F.col("precision"), F.col("recall")))


def confusion(df: DataFrame, pred: str = "pred", act: str = "act", keys: list[str] | None = None) -> DataFrame:
    """A1"""
    p, a = F.col(pred), F.col(act)
    return prf(df.groupBy(*(keys or [])).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")))


def verdict_summary(verdicts: DataFrame, predicted: str = "predicted") -> DataFrame:
    """A2, A3: one row; an unknown answer is a miss on an anomaly and never a true negative."""
    a, y = F.col(predicted), F.col("is_anomaly")
    counts = verdicts.agg(
        F.count("*").alias("n_samples"), F.count_if(y & (a == "ANOMALY")).alias("tp"), F.count_if(~y & (a == "ANOMALY")).alias("fp"), F.count_if(y & (a != "ANOMALY")).alias("fn"),
        F.count_if(~y & (a == "NOMINAL")).alias("tn"), F.count_if(a == "UNKNOWN").alias("unknown_responses"), F.coalesce(F.avg("elapsed_s"), F.lit(0.0)).alias("avg_time_s"),
    )
    out = prf(counts).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("n_samples")))
    return out.withColumns({**{c: F.round(c, 4) for c in ("precision", "recall", "f1", "accuracy")}, "avg_time_s": F.round("avg_time_s", 3)})


def macro(records: DataFrame, all_channels: bool = False, keys: list[str] | None = None) -> DataFrame:
    """A5 over channels with anomalies, A6 over all: mean precision, recall and F1, and CEF from the mean precision and recall."""
    rows = records if all_channels else records.where((F.col("tp") + F.col("fn")) > 0)
    out = rows.groupBy(*(keys or [])).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("n_channels"))
    return out.withColumn("cef", cef(F.col("precision"), F.col("recall")))


#: Positions in one unit of the join of spans.
BAND = 1024


def interval_matches(pred: DataFrame, gt: DataFrame, delta: int = 32, keys: list[str] = MC) -> DataFrame:
    """Pairs of predicted and true spans with pred start <= gt end + delta and pred end >= gt start - delta."""
    band = lambda c: F.floor(c / BAND)
    p, g = pred.select(*keys, F.col("start").alias("ps"), F.col("end").alias("pe")), gt.select(*keys, F.col("start").alias("gs"), F.col("end").alias("ge"))
    met = meeting(p, g, keys, (band(F.col("ps") - delta), band(F.col("pe") + delta)), (band(F.col("gs")), band(F.col("ge"))))
    pairs = met.select(*[F.col(f"`a.{c}`").alias(c) for c in (*keys, "ps", "pe")], *[F.col(f"`b.{c}`").alias(c) for c in ("gs", "ge")])
    return pairs.where((F.col("ps") <= F.col("ge") + delta) & (F.col("pe") >= F.col("gs") - delta))


def affinity_f1(pred: DataFrame, gt: DataFrame, delta: int = 32, gap: int = 16, keys: list[str] = MC) -> DataFrame:
    """Spans merged within gap per channel, matched within delta, counts pooled over channels."""
    mp, mg = stored(merge_intervals(pred, gap, keys)), stored(merge_intervals(gt, gap, keys))
    pairs = interval_matches(mp, mg, delta, keys)
    hits = pairs.agg(F.countDistinct(*keys, "ps").alias("pred_hit"), F.countDistinct(*keys, "gs").alias("gt_hit"))
    counts = mp.agg(F.count("*").alias("n_pred")).crossJoin(mg.agg(F.count("*").alias("n_gt"))).crossJoin(hits)  # three single rows
    out = counts.withColumns({"affinity_precision": ratio(F.col("pred_hit"), F.col("n_pred")), "affinity_recall": ratio(F.col("gt_hit"), F.col("n_gt"))})
    return out.withColumn("affinity_f1", f_beta(F.col("affinity_precision"), F.col("affinity_recall")))


def trivial_baseline(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """What calling everything an anomaly would score."""
    p = df.agg(F.avg(F.col(label).cast("int")).alias("precision"), F.count("*").alias("n_units"))
    return p.withColumn("recall", F.lit(1.0)).withColumns({"f1": f_beta(F.col("precision"), F.col("recall")), "cef": cef(F.col("precision"), F.col("recall"))})


def summarize_detection(verdicts: DataFrame) -> DataFrame:
    """The summary with CEF, format compliance and how the flagged rows' answers look."""
    flagged = F.col("predicted") == "ANOMALY"
    up = F.upper("actual_response")
    shape = verdicts.agg(
        F.count_if(flagged).alias("n_anomaly_predictions"), F.coalesce(F.round(F.avg(F.when(flagged, F.length("actual_response"))), 1), F.lit(0.0)).alias("advice_avg_chars"),
        F.coalesce(F.round(F.avg(F.when(flagged, (up.contains("DIAGNOSIS") & up.contains("ADVICE")).cast("int"))), 4), F.lit(0.0)).alias("advice_structured_frac"),
    )
    s = verdict_summary(verdicts)
    out = s.withColumns({"cef": F.round(cef(F.col("precision"), F.col("recall")), 4), "format_compliance": F.round(ratio(F.col("n_samples") - F.col("unknown_responses"), F.col("n_samples")), 4)})
    return out.crossJoin(shape)  # two single rows


def split_counts(records: DataFrame) -> DataFrame:
    """A11"""
    return records.groupBy("split").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("n_anomaly"))


def unit_grid() -> list[float]:
    """201 thresholds on [0, 1]."""
    return [i / 200 for i in range(201)]


def range_grid(df: DataFrame, score: str) -> list[float]:
    """201 thresholds from least to greatest score, and 0.5."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    if hi <= lo:
        hi = lo + 1e-9
    return sorted({*(lo + (hi - lo) * i / 200 for i in range(201)), 0.5})


def sweep(df: DataFrame, score: str, grid: list[float], label: str = "is_anomaly") -> DataFrame:
    """Confusion metrics at every threshold (score >= threshold), 4 decimals; threshold at 6.

    One pass sorts rows into the slots between thresholds; the running sum goes over at most 203 counts.
    """
    edges = F.expr("array(" + ", ".join(f"{float(t)!r}D" for t in grid) + ")")
    # a null score reaches no threshold; naming the score twice also keeps its own expression out of the loop over edges
    slot = F.when(F.col(score).isNull(), 0).otherwise(F.size(F.filter(edges, lambda t: t <= F.col(score))))
    counts = df.groupBy(slot.alias("slot")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    points = df.sparkSession.range(1).select(F.posexplode(edges).alias("slot", "threshold")).withColumn("slot", F.col("slot") + 1)
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    curve = points.join(counts, "slot", "left").select("slot", "threshold", F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(above).alias("fp"))
    out = prf(curve.crossJoin(total).withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")}))
    out = out.withColumn("cef", cef(F.col("precision"), F.col("recall")))
    return out.select(F.round("threshold", 6).alias("threshold"), *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "cef")], "tp", "fp", "fn", "tn")


def best_by(curve: DataFrame, metric: str) -> DataFrame:
    """The row with the greatest metric, the least threshold on ties."""
    return curve.orderBy(F.desc(metric), F.asc("threshold")).limit(1)


def pr_points(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """(score, tp, fp, pos) at each distinct score, counts over all scores not below it."""
    steps = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    total = steps.agg(F.sum("p").alias("pos"))
    return running_sums(steps, "score", ["p", "n"]).select("score", "p", F.col("cum_p").alias("tp"), F.col("cum_n").alias("fp")).crossJoin(total)  # one total row


def average_precision(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """The sum of recall gained times precision over distinct scores from high to low."""
    gain = F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return pr_points(df, score, label).agg(F.coalesce(F.sum(F.when(F.col("pos") > 0, gain)), F.lit(0.0)).alias("average_precision"))


def pr_curve(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """(threshold, precision, recall) at each distinct score, and the end point (null, 1, 0)."""
    points = pr_points(df, score, label).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), ratio(F.col("tp"), F.col("pos")).alias("recall"))
    return points.unionByName(df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def hard_point(verdicts: DataFrame) -> DataFrame:
    """The confusion of hard verdicts as a point without a threshold; an unknown answer is a miss on an anomaly and never a true negative."""
    s = verdict_summary(verdicts.withColumn("elapsed_s", F.lit(0.0)))
    return s.select(F.lit(None).cast("double").alias("threshold"), "precision", "recall", "f1", F.round(cef(F.col("precision"), F.col("recall")), 4).alias("cef"), "tp", "fp", "fn", "tn")


def operating_points(df: DataFrame, score: str, grid: list[float], label: str = "is_anomaly", verdicts: DataFrame | None = None) -> DataFrame:
    """The points at 0.5, of best CEF, of best F1, and of greatest recall at precision 0.6 or more (recall above 0); with verdicts
    (predicted, is_anomaly) also the point of the hard answers."""
    curve = sweep(df, score, grid, label)
    half = sweep(df, score, [0.5], label)
    named = [("argmax", half), ("cef_best", best_by(curve, "cef")), ("f1_best", best_by(curve, "f1")), ("recall_at_p60", best_by(curve.where("precision >= 0.6 and recall > 0"), "recall"))]
    if verdicts is not None:
        named.append(("hard_verdict", hard_point(verdicts)))
    out = None
    for name, point in named:
        point = point.withColumn("point", F.lit(name))
        out = point if out is None else out.unionByName(point)
    return out
