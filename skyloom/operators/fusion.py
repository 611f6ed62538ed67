"""Score alignment and fusion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MC
from ..shared import draw, exact_rank, stored
from .metrics import average_precision, best_by, cef, f_beta, range_grid, ratio, sweep


def align(text: DataFrame, vision: DataFrame) -> DataFrame:
    """Vision rows with the text score of their index; same is false where mission or channel disagree."""
    t, v = text.alias("t"), vision.alias("v")
    same = (F.col("t.mission") == F.col("v.mission")) & (F.col("t.channel") == F.col("v.channel"))
    return v.join(t, F.col("t.index") == F.col("v.index")).select("v.*", F.col("t.score").alias("text"), same.alias("same"))


def map_to_grid(windows: DataFrame, errors: DataFrame, stride: int = 16) -> DataFrame:
    """Windows with the detector's error at i = start_idx div stride, null where there is none."""
    at = windows.withColumn("i", F.floor(F.col("start_idx") / stride).cast("int"))
    return at.join(errors.select(*MC, "i", "error"), [*MC, "i"], "left")


def verdict_windows(verdicts: DataFrame, meta: DataFrame) -> DataFrame:
    """Verdicts with their window's place; an index beyond the windows is dropped."""
    return verdicts.join(meta.select("index", "start_idx", "end_idx"), "index")


def score_matrix(text: DataFrame, vision: DataFrame, errors: DataFrame, meta: DataFrame, stride: int = 16) -> DataFrame:
    """(index, mission, channel, is_anomaly, text, vision, error), a row for each vision row with a text score."""
    rows = align(text, vision).where("same").withColumnRenamed("score", "vision").drop("same")
    return map_to_grid(rows.join(meta.select("index", "start_idx"), "index"), errors, stride).select("index", *MC, "is_anomaly", "text", "vision", "error")


def zscores(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """Each signal as its global z-score; centred only where it doesn't vary."""
    stats = matrix.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = matrix.crossJoin(F.broadcast(stats))  # one row
    return out.select(*matrix.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(f"z_{c}") for c in cols])


def weighted_sum(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """Weighted, the mean of the z-scores."""
    out = zscores(matrix, cols)
    return out.withColumn("weighted", sum(F.col(f"z_{c}") for c in cols) / len(cols)).drop(*[f"z_{c}" for c in cols])


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of the values that aren't null, from ranks, so that no task gathers them."""
    ranked = exact_rank(df.select(column).where(F.col(column).isNotNull()), [column], "_r")
    n = ranked.count()
    return ranked.where(F.col("_r").isin((n - 1) // 2, n // 2)).agg(F.avg(column)).first()[0]


def cut_points(matrix: DataFrame, cols: list[str], unbounded: tuple[str, ...] = ("error",)) -> dict[str, float]:
    """0.5 for probabilities, the median for an unbounded signal."""
    return {c: median(matrix, c) if c in unbounded else 0.5 for c in cols}


def with_votes(matrix: DataFrame, cols: list[str]) -> DataFrame:
    cuts = cut_points(matrix, cols)
    return matrix.withColumn("votes", sum((F.col(c) >= F.lit(cuts[c])).cast("int") for c in cols))


def _hard(votes: DataFrame, name: str, pred: Column) -> DataFrame:
    y = F.col("is_anomaly")
    c = votes.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"), F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(F.lit(name).alias("rule"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f_beta(p, r), 4).alias("f1"), F.round(cef(p, r), 4).alias("cef"), "tp", "fp", "fn", "tn")


def vote(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """Confusion of the majority vote, of any and of all signals, and how many rows they disagree on."""
    n, v = len(cols), F.col("votes")
    rows = with_votes(matrix, cols)
    split = rows.agg(F.count_if((v > 0) & (v < n)).alias("disagreement"))
    parts = [_hard(rows, name, pred) for name, pred in (("vote", v >= n // 2 + 1), ("any", v >= 1), ("all", v >= n))]
    return reduce(DataFrame.unionByName, parts).crossJoin(split)  # one row


#: What Newton's method stops at: steps, and the change of a weight.
STEPS, SETTLED = 60, 1e-10


@dataclass
class Stackers:
    """Logistic models of some signals, one for each left-out fold (or one of all rows): the means and spreads that signals are standardised by,
    and weights, the intercept last; a row a model."""

    cols: list[str]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, model: Column) -> Column:
        """The probability under the model of that number."""
        of = lambda x: F.element_at(F.lit(x.tolist()), model + 1)
        z = sum(of(self.weights[:, j]) * (F.col(c) - of(self.mean[:, j])) / of(self.spread[:, j]) for j, c in enumerate(self.cols))
        return 1 / (1 + F.exp(-(z + of(self.weights[:, -1]))))


def _fold_moments(rows: DataFrame, cols: list[str], folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, positives, mean, sum of squared differences) of each fold, from one grouped pass."""
    aggs = [f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("v", F.var_pop))]
    n, pos, mean, m2 = np.zeros(folds), np.zeros(folds), np.zeros((folds, len(cols))), np.zeros((folds, len(cols)))
    for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("pos"), *aggs).collect():  # a row for each fold
        f = r["fold"]
        n[f], pos[f] = r["n"], r["pos"]
        mean[f] = [r[f"m{i}"] for i in range(len(cols))]
        m2[f] = [r[f"v{i}"] * r["n"] for i in range(len(cols))]
    return n, pos, mean, m2


def fit_stackers(rows: DataFrame, cols: list[str], folds: int, leave_out: bool = True) -> Stackers:
    """Logistic regressions with balanced classes and the penalty of half the squared weights, without the intercept's, against the sum of losses:
    one for each fold left out, or one of all rows. rows: (fold, is_anomaly, the signals without nulls).

    All models take Newton's steps together: a step is one pass in which each task sums gradients and small Hessians of every model, and the
    sums, a few numbers a model, are added up by a grouped sum. A step that raises a model's loss is halved.
    """
    n, pos, mean, m2 = _fold_moments(rows, cols, folds)
    uses = ~np.eye(folds, dtype=bool) if leave_out else np.ones((1, folds), bool)  # model x fold
    k, size = len(uses), len(cols) + 1
    total, positive = np.maximum(uses @ n, 1), uses @ pos
    centre = (uses * n) @ mean / total[:, None]
    spread = np.sqrt(np.maximum(np.array([((m2 + n[:, None] * (mean - c) ** 2) * u[:, None]).sum(axis=0) for u, c in zip(uses, centre)]) / total[:, None], 0))
    spread[spread == 0] = 1.0
    balance = np.stack([total / (2 * np.maximum(total - positive, 1)), total / (2 * np.maximum(positive, 1))], axis=1)
    ridge = np.diag([1.0] * len(cols) + [0.0])
    slim = rows.select("fold", "is_anomaly", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def sums(weights: np.ndarray) -> np.ndarray:
        """Loss, gradient and Hessian of each model at its weights."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, 1 + size + size * size))
            for batch in batches:
                fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(int)
                x = np.column_stack([*(batch.column(2 + i).to_numpy() for i in range(len(cols))), np.ones(len(y))])
                for m in range(k):
                    mine = uses[m][fold]
                    own, label = x[mine].copy(), y[mine]
                    own[:, :-1] = (own[:, :-1] - centre[m]) / spread[m]
                    z, w = own @ weights[m], balance[m][label]
                    q = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    out[m, 0] += (w * (np.logaddexp(0, z) - label * z)).sum()
                    out[m, 1 : 1 + size] += own.T @ (w * (q - label))
                    out[m, 1 + size :] += (own.T @ (own * (w * q * (1 - q))[:, None])).ravel()
            model, at = np.indices(out.shape)
            yield pa.RecordBatch.from_arrays([pa.array(model.ravel(), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array(out.ravel())], names=["model", "at", "value"])

        out = np.zeros((k, 1 + size + size * size))
        for r in slim.mapInArrow(add, "model int, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).collect():
            out[r["model"], r["at"]] = r["value"]
        return out

    weights, step, before = np.zeros((k, size)), np.zeros((k, size)), np.full(k, np.inf)
    for _ in range(STEPS):
        got = sums(weights)
        loss = got[:, 0] + 0.5 * np.einsum("mi,ij,mj->m", weights, ridge, weights)
        for m in range(k):
            if loss[m] > before[m] + 1e-9 * abs(before[m]):
                step[m] /= 2
                weights[m] -= step[m]
                continue
            before[m] = loss[m]
            hessian = got[m, 1 + size :].reshape(size, size) + ridge
            step[m] = -np.linalg.lstsq(hessian, got[m, 1 : 1 + size] + ridge @ weights[m], rcond=None)[0]
            weights[m] += step[m]
        if np.abs(step).max() < SETTLED:
            break
    return Stackers(cols, centre, spread, weights)


def with_folds(matrix: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """fold 0..k-1, dealt in drawn order inside each class."""
    ranked = exact_rank(matrix.withColumn("_d", draw(["index"], seed)), ["is_anomaly", "_d", "index"], "_r").drop("_d")
    calm = ranked.where(~F.col("is_anomaly")).count()  # false sorts before true
    return ranked.withColumn("fold", ((F.col("_r") - F.when(F.col("is_anomaly"), calm).otherwise(0)) % k).cast("int")).drop("_r")


def oof_stack(matrix: DataFrame, cols: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Stacked, each row's probability under a model fitted on the other folds. A signal that is null gives a null."""
    rows = with_folds(matrix, k, seed)  # stands on a stored table
    whole = rows.dropna(subset=cols)
    return rows.select(*matrix.columns, "fold", fit_stackers(whole, cols, k).score(F.col("fold")).alias("stacked"))


def stack_weights(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """(name, weight) of a fit on all rows, 4 decimals, the intercept last."""
    rows = stored(matrix.select("is_anomaly", *cols, F.lit(0).alias("fold")).dropna(subset=cols))
    weights = fit_stackers(rows, cols, 1, leave_out=False).weights[0]
    return matrix.sparkSession.createDataFrame([(name, round(float(w), 4)) for name, w in zip([*cols, "intercept"], weights)], "name string, weight double")


def single_baselines(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """For each signal the argmax point, average precision, and the points of best CEF and best F1."""
    matrix = stored(matrix)
    cuts = cut_points(matrix, cols)
    parts = []
    for c in cols:
        curve = sweep(matrix, c, range_grid(matrix, c))
        ap = average_precision(matrix, c).select(F.round("average_precision", 4).alias("average_precision"))
        for name, point in (("argmax", sweep(matrix, c, [cuts[c]])), ("cef_best", best_by(curve, "cef")), ("f1_best", best_by(curve, "f1"))):
            parts.append(point.withColumns({"signal": F.lit(c), "point": F.lit(name)}).crossJoin(ap))  # one row each
    return reduce(DataFrame.unionByName, parts)


def fuse(matrix: DataFrame, seed: int = 0) -> DataFrame:
    """A report row for each fused score of the two-signal variant, and of the three-signal one where over 50 rows have an error."""
    matrix = stored(matrix)
    third = matrix.where("error is not null")
    n, n_third = matrix.agg(F.count("*"), F.count("error")).first()
    variants = [("text_vision", matrix, ["text", "vision"], n)] + ([("text_vision_error", third, ["text", "vision", "error"], n_third)] if n_third > 50 else [])
    parts = []
    for name, rows, cols, units in variants:
        scored = stored(weighted_sum(oof_stack(rows, cols, seed=seed), cols).select("is_anomaly", "stacked", "weighted"))
        for kind in ("stacked", "weighted"):
            best = best_by(sweep(scored, kind, range_grid(scored, kind)), "cef")
            parts.append(best.select(F.lit(name).alias("variant"), F.lit(kind).alias("fusion"), "threshold", "precision", "recall", "f1", "cef", F.lit(units).alias("n_units")))
    return reduce(DataFrame.unionByName, parts)


def hybrid_alerts(flags: DataFrame, advice: DataFrame) -> DataFrame:
    """Flagged windows with their advice, the severest first."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return flags.where("flag").join(advice, "anomaly_id").withColumn("rank", rank).orderBy("rank", "anomaly_id")
