"""Advice grading and comparison of approaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MC
from .overlaps import meeting

AXES = ("correctness", "actionability", "grounding")


def best_overlap(windows: DataFrame, refs: DataFrame, keys: list[str] = MC) -> DataFrame:
    """Each window with the id of the channel's reference of greatest overlap (seconds above 0), the first on ties, else null.

    windows: (index, keys, start_time, end_time); refs: (id, keys, start_time, end_time).
    """
    w = windows.select("index", *keys, F.col("start_time").alias("ws"), F.col("end_time").alias("we"))
    r = refs.select("id", *keys, F.col("start_time").alias("rs"), F.col("end_time").alias("re"))
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    near = meeting(w, r, keys, (day("ws"), day("we")), (day("rs"), day("re")))
    met = near.select(*[F.col(f"`a.{c}`").alias(c) for c in ("index", "ws", "we")], *[F.col(f"`b.{c}`").alias(c) for c in ("id", "rs", "re")]).where((F.col("ws") < F.col("re")) & (F.col("rs") < F.col("we")))
    overlap = (F.unix_micros(F.least("we", "re")) - F.unix_micros(F.greatest("ws", "rs"))) / 1e6
    best = met.withColumn("o", -overlap).groupBy("index").agg(F.min(F.struct("o", "rs", "id")).alias("b"))
    return windows.join(best.select("index", F.col("b.id").alias("ref_id"), (-F.col("b.o")).alias("overlap_s")), "index", "left")


def missing(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """Sampled rows without an answer; must be empty."""
    return sample.join(answers.select("index").distinct(), "index", "left_anti")


def assemble(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """J10"""
    return sample.join(answers, "index")


def check_rubric(judgments: DataFrame) -> DataFrame:
    """Judgments with an axis outside 0..2; must be empty."""
    return judgments.where(reduce(lambda a, b: a | b, [~F.col(a).between(0, 2) for a in AXES]))


def grade_stats(judged: DataFrame, truth: str = "is_anomaly") -> DataFrame:
    """Means per axis and total (3 decimals), share of 1 or more per axis and of high quality (4), overall and by truth."""
    total = sum(F.col(a) for a in AXES)
    good = (total >= 4) & reduce(lambda a, b: a & b, [F.col(a) >= 1 for a in AXES])
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    rows = judged.withColumn("_y", F.when(F.col(truth), "true_positive").otherwise("false_positive"))
    out = rows.rollup("_y").agg(
        F.count("*").alias("n"), *[F.round(F.avg(a), 3).alias(f"mean_{a}") for a in AXES], F.round(F.avg(total), 3).alias("mean_total"),
        *[share(F.col(a) >= 1).alias(f"share_{a}") for a in AXES], share(good).alias("share_high_quality"),
    )
    return out.withColumn("subset", F.coalesce("_y", F.lit("overall"))).drop("_y")


def union_metrics(*rows: DataFrame | None) -> DataFrame:
    """The metric rows that exist, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r in rows if r is not None])


#: What A19 compares with the control besides F1, where the rows have it.
DELTAS = ("f1", "precision", "format_compliance", "advice_structured_frac")


def compare(metrics: DataFrame, control: str, trivial: str) -> DataFrame:
    """Ranks by F1 and CEF, the best of each, the differences to the control in F1, precision, compliance and structured share (null
    where a side has none), and whether F1 beats the trivial baseline; a row for each of a few approaches."""
    deltas = [c for c in DELTAS if c in metrics.columns]
    base = metrics.where(F.col("approach") == control).select(*[F.col(c).alias(f"_{c}") for c in deltas])
    floor = metrics.where(F.col("approach") == trivial).select(F.col("f1").alias("_t"))
    out = metrics.crossJoin(base).crossJoin(floor)  # single rows
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    ranked = out.select(*metrics.columns, rank("f1").alias("rank_f1"), rank("cef").alias("rank_cef"), *[F.round(F.col(c) - F.col(f"_{c}"), 4).alias(f"delta_{c}") for c in deltas], (F.col("f1") > F.col("_t")).alias("above_trivial"))
    return ranked.withColumns({"best_f1": F.col("rank_f1") == 1, "best_cef": F.col("rank_cef") == 1}).orderBy("rank_f1", "approach")


def hybrid_row(detector: DataFrame, text: DataFrame) -> DataFrame:
    """Detection columns of the detector's row, advice columns of the text model's."""
    return detector.select("precision", "recall", "f1", "cef").crossJoin(text.select("advice_structured_frac", "advice_avg_chars")).withColumn("approach", F.lit("hybrid"))


def carry_prior(units: DataFrame, prior: DataFrame, column: str, keys: list[str] = MC) -> DataFrame:
    """Units with the earlier value of `column`, NaN where there is none."""
    return units.join(prior.select(*keys, column), keys, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))))
