"""Data-quality checks: rows of (check, passed, observed, expected) (V1-V9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import binary_round
from .metrics import ratio

Check = tuple[str, Column, Column, str]


def fails(ok: Column) -> Column:
    """How many rows aren't ok; a missing value isn't."""
    return F.count_if(~F.coalesce(ok, F.lit(False)))


def above(x: Column, least: float) -> Column:
    """Spark ranks NaN above every number; here it isn't above any."""
    return (x > least) & ~F.isnan(x)


def plain(x: Column) -> Column:
    """A number as a text without an exponent: 0.0001, not 1.0E-4."""
    text = x.cast("string")
    digits = F.regexp_replace(x.try_cast("decimal(38,10)").cast("string"), r"(\.\d*?[1-9]|\.0)0*$", "$1")
    return F.when(text.contains("E"), F.coalesce(digits, text)).otherwise(text)


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Each check is (name, observed aggregate, whether it passes, expectation); all in one pass, a row each."""
    one = df.agg(*[x for i, (_, seen, ok, _) in enumerate(checks) for x in (seen.alias(f"o{i}"), F.coalesce(ok, F.lit(False)).alias(f"p{i}"))])
    seen = lambda i: plain(F.col(f"o{i}")) if dict(one.dtypes)[f"o{i}"] in ("double", "float") else F.col(f"o{i}").cast("string")
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"p{i}").alias("passed"), seen(i).alias("observed"), F.lit(want).alias("expected")) for i, (name, _, _, want) in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def check_splits(records: DataFrame, total: int, low: int, high: int, missions: int) -> DataFrame:
    """V1"""
    n, a, m = F.count("*"), F.count_if("is_anomaly"), F.countDistinct("mission")
    return run_checks(records, [("total", n, n == total, str(total)), ("anomalies", a, a.between(low, high), f"{low}..{high}"), ("missions", m, m == missions, str(missions))])


def check_advice(advice: DataFrame, required: list[str]) -> DataFrame:
    """V2"""
    copies = F.count("*") - F.countDistinct("anomaly_id")
    empty = F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) == "") for c in required]))
    bad = fails(F.col("severity").isin("low", "medium", "high"))
    levels = [(f"n_{s}", F.count_if(F.col("severity") == s), F.count_if(F.col("severity") == s) >= 0, ">= 0") for s in ("low", "medium", "high")]
    return run_checks(advice, [("unique_ids", copies, copies == 0, "0"), ("fields", empty, empty == 0, "0"), ("severity", bad, bad == 0, "0"), *levels])


def check_chat(chat: DataFrame, marker: str) -> DataFrame:
    """V3: columns, and rows that don't start with the system marker."""
    names, bad = ",".join(chat.columns), fails(F.col("text").startswith(marker))
    return run_checks(chat, [("columns", F.lit(names), F.lit(names == "text"), "text"), ("marker", bad, bad == 0, "0")])


def check_detector(records: DataFrame) -> DataFrame:
    """V4: records with precision, recall, f1, and the first and last loss of the fit; a missing loss hasn't fallen."""
    n, f1 = F.count("*"), binary_round(F.avg("f1"), 4)
    bad, fell = fails(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("precision", "recall", "f1")])), F.count_if(F.col("last_loss") < F.col("first_loss"))
    return run_checks(records, [("scored", n, n > 0, "> 0"), ("finite", bad, bad == 0, "0"), ("loss_fell", fell, fell > 0, "> 0"), ("mean_f1", f1, (f1 > 0.05) & (f1 < 0.98), "0.05..0.98")])


def check_verdicts(v: DataFrame) -> DataFrame:
    """V5"""
    n, unknown = F.count("*"), binary_round(F.count_if(F.col("predicted") == "UNKNOWN") / F.count("*"), 4)
    time, n_long = binary_round(F.avg("elapsed_s"), 3), F.count_if(F.length("actual_response") > 10)
    word = binary_round(F.count_if(F.upper("actual_response").rlike("ANOMALY|NOMINAL")) / F.count("*"), 4)
    bad = F.count_if(F.col("elapsed_s").isNull() | F.isnan("elapsed_s") | (F.abs("elapsed_s") == float("inf")))
    hit, y = F.col("predicted") == "ANOMALY", F.col("is_anomaly")
    f1 = binary_round(ratio(2.0 * F.count_if(hit & y), 2 * F.count_if(hit & y) + F.count_if(hit & ~y) + F.count_if(~hit & y)), 4)
    return run_checks(v, [
        ("rows", n, n > 0, "> 0"), ("finite", bad, bad == 0, "0"), ("f1", f1, f1.between(0, 1), "0..1"), ("unknown", unknown, unknown < 0.2, "< 0.2"), ("time", time, F.avg("elapsed_s") < 30, "< 30"),
        ("length", binary_round(n_long / n, 4), n_long == n, "1"), ("keyword", word, word > 0.8, "> 0.8"),
    ])


def check_comparison(m: DataFrame, text: str) -> DataFrame:
    """V6: rows of approaches with their four metrics, an error text or null, and advice_avg_chars of the approach `text`."""
    out = F.count_if(reduce(lambda a, b: a | b, [~F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in ("precision", "recall", "f1", "cef")]))
    errors, long = F.count("error"), F.max(F.when(F.col("approach") == text, F.col("advice_avg_chars")))
    return run_checks(m, [("rows", F.count("*"), F.count("*") > 0, "> 0"), ("errors", errors, errors == 0, "0"), ("bounds", out, out == 0, "0"), ("advice_length", long, long > 50, "> 50")])


def check_regression(m: DataFrame) -> DataFrame:
    """V7: one row with mae, baseline_mae, pearson and cost. All but Pearson's r meet their limits as they are, not rounded."""
    mae, base, r, cost = (binary_round(F.max(c), 4) for c in ("mae", "baseline_mae", "pearson", "cost"))
    return run_checks(m, [
        ("beats_mean", mae, (F.max("mae") <= 0.95 * F.max("baseline_mae")) & ~F.isnan(F.max("baseline_mae")), "<= 0.95 baseline"), ("baseline", base, above(F.max("baseline_mae"), 0), "> 0"), ("mae", mae, (F.max("mae") > 0.01) & (F.max("mae") < 0.4), "0.01..0.4"),
        ("pearson", r, r.between(-1, 1), "-1..1"), ("cost", cost, F.max("cost") < 25, "< 25"),
    ])


def check_images(p: DataFrame, channels: int, height: int, width: int, low: float, high: float, rows: int) -> DataFrame:
    """V8: one profile row of the images that were pulled, `rows` of which were asked for."""
    size = channels * height * width
    return run_checks(p, [
        ("rows", F.max("rows"), F.max("rows") == rows, str(rows)), ("shape", F.max("max_size"), (F.max("max_size") == size) & (F.min("min_size") == size), f"{channels}x{height}x{width}"),
        ("values", binary_round(F.max("value_max"), 4), (F.min("value_min") >= low - 1e-3) & (F.max("value_max") <= high + 1e-3), f"{low:g}..{high:g}"), ("finite", F.max("not_finite"), F.max("not_finite") == 0, "0"),
        ("labels", F.max("label_not_finite"), F.max("label_not_finite") == 0, "0"),
    ])


def check_attribution(a: DataFrame) -> DataFrame:
    """V9: rows with faithful, gini, top_decile and r."""
    bad, g, t, r = fails(F.col("faithful")), binary_round(F.avg("gini"), 4), binary_round(F.avg("top_decile"), 4), binary_round(F.avg("r"), 4)
    return run_checks(a, [("faithful", bad, bad == 0, "0"), ("gini", g, above(g, 0.05), "> 0.05"), ("top_decile", t, above(t, 0.12), "> 0.12"), ("brightness", r, above(r, 0.1), "> 0.1")])
