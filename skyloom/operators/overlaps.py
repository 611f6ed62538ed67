"""Joins of spans that meet, by stretches whose size follows the spans' lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span touches at most 2 ** FINE + 1 stretches of its own size.
FINE = 4


def _sized(df: DataFrame, side: str, start: Column, end: Column) -> DataFrame:
    """df's columns named after the side, with its first and last unit and its level: stretches of 2 ** level units are its own size."""
    named = df.select(*[F.col(c).alias(f"{side}.{c}") for c in df.columns], start.alias(f"{side}_s"), end.alias(f"{side}_e")).where(F.col(f"{side}_s") <= F.col(f"{side}_e"))
    return named.withColumn(f"{side}_l", F.greatest(F.lit(0), F.ceil(F.log2(F.col(f"{side}_e") - F.col(f"{side}_s") + 1)).cast("int") - FINE))


def _placed(df: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """df once for each stretch that it touches at its own level and at those of the other side's longer spans."""
    above = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col(f"{side}_l"))
    rows = df.withColumn("level", F.explode(F.concat(F.array(f"{side}_l"), above)))
    at = lambda c: F.expr(f"shiftright({c}, level)")
    return rows.withColumn("first", at(f"{side}_s")).withColumn("stretch", F.explode(F.sequence(F.col("first"), at(f"{side}_e")))).withColumnRenamed("first", f"{side}_first")


def meeting(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[Column, Column], b_span: tuple[Column, Column]) -> DataFrame:
    """Pairs of rows of equal keys whose spans of whole units, both ends included, meet; columns are named `a.x` and `b.x`.

    A span stands in stretches of its own size, 2 ** FINE + 1 at most, however long it is, and in one or a few at each level at which the other side
    has longer spans; a level doubles the size, so that these are as many as the logarithm of the greatest length at most. A pair meets at the
    level of its longer span, in the first stretch that both touch. Null keys meet nothing, and neither does a span that ends before it starts.
    """
    x, y = _sized(a, "a", *a_span), _sized(b, "b", *b_span)
    seen = lambda df, side: sorted(r[0] for r in df.select(f"{side}_l").distinct().collect() if r[0])  # 64 at most
    p, q = _placed(x, "a", seen(y, "b")), _placed(y, "b", seen(x, "a"))
    on = [F.col(f"`a.{k}`") == F.col(f"`b.{k}`") for k in keys] + [p["level"] == q["level"], p["stretch"] == q["stretch"]]
    once = (F.greatest("a_l", "b_l") == p["level"]) & (F.greatest("a_first", "b_first") == p["stretch"]) & (F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e"))
    return p.join(q, on).where(once).select(*[F.col(f"`{c}`") for c in (*x.columns, *y.columns) if "." in c])
