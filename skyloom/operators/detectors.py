"""Detectors and thresholds per channel."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import Z_GRID
from ..schemas import ERRORS, MC
from ..shared import exact_rank, join_channels, join_spread, key_hash, numbered_groups, stored
from .metrics import best_by, macro, prf
from .sequences import SEGMENT, ewma


def normal_stats(errors: DataFrame, keys: list[str] = MC) -> DataFrame:
    """Mean and population std of the errors of truly normal windows, and how many windows there are, in `_rows`."""
    calm = F.when(~F.col("is_anomaly"), F.col("error"))
    return errors.groupBy(*keys).agg(F.avg(calm).alias("mean"), F.stddev_pop(calm).alias("std"), F.count("*").alias("_rows"))


def flat_threshold(errors: DataFrame, z: float = 4.0, keys: list[str] = MC) -> DataFrame:
    """threshold = mean + z std of the normal errors, flag = error > threshold; a channel without normal windows flags nothing."""
    stats = normal_stats(errors, keys).select(*keys, (F.col("mean") + z * F.col("std")).alias("threshold"), "_rows")
    out = join_spread(errors, stats, keys)
    return out.withColumn("flag", F.coalesce(F.col("error") > F.col("threshold"), F.lit(False)))


def z_sweep(errors: DataFrame, grid: tuple[float, ...] = Z_GRID, keys: list[str] = MC) -> DataFrame:
    """Macro precision, recall, F1 and CEF at each z. Every row takes its slot between the thresholds once; the rest sums slots of a channel."""
    zs = sorted(grid)
    rows = join_spread(errors, normal_stats(errors, keys).withColumnsRenamed({"mean": "_m", "std": "_s"}), keys)
    slot = sum(F.coalesce((F.col("error") > F.col("_m") + z * F.col("_s")).cast("int"), F.lit(0)) for z in zs)  # how many z it passes
    counts = rows.groupBy(*keys, slot.alias("_n")).agg(F.count_if("is_anomaly").alias("_p"), F.count_if(~F.col("is_anomaly")).alias("_q"))
    passed = lambda c, i: F.sum(F.when(F.col("_n") > i, F.col(c)).otherwise(0))
    points = F.array(*[F.struct(F.lit(z).alias("z"), passed("_p", i).alias("tp"), passed("_q", i).alias("fp")) for i, z in enumerate(zs)])
    each = counts.groupBy(*keys).agg(points.alias("_x"), F.sum("_p").alias("_pos"), F.sum("_q").alias("_neg")).select(*keys, F.explode("_x").alias("_x"), "_pos", "_neg")
    flat = each.select("_x.z", *keys, "_x.tp", "_x.fp", (F.col("_pos") - F.col("_x.tp")).alias("fn"), (F.col("_neg") - F.col("_x.fp")).alias("tn"))
    return macro(prf(flat), keys=["z"])


def best_z(curve: DataFrame) -> DataFrame:
    return best_by(curve.withColumn("threshold", F.col("z")), "cef").drop("threshold")


# Limits of the epsilon search: fixed values.
EPS_FROM, EPS_TO, EPS_STEP, EPS_FALLBACK = 2.5, 12.0, 0.5, 3.0


def slots_of(smooth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, prev, n, mean, m2): how many positions stand in a slot between the thresholds of the grid of z after one in slot `prev` (-1: none),
    and the moments of their values. smooth has _segment, m and s of the channel, and _last, the value that ends the segment before."""
    zs = [EPS_FROM + EPS_STEP * k for k in range(int((EPS_TO - EPS_FROM) / EPS_STEP) + 1)]
    slot = lambda x: sum((x >= F.col("m") + z * F.col("s")).cast("int") for z in zs)
    inside = Window.partitionBy("_key", *keys, "_segment").orderBy("i")
    rows = smooth.where("s > 0").withColumn("_key", key_hash(keys)).withColumn("slot", slot(F.col("ewma"))).withColumn("prev", F.coalesce(F.lag("slot").over(inside), slot(F.col("_last")), F.lit(-1)))
    return rows.groupBy(*keys, "slot", "prev", "m", "s").agg(F.count("*").alias("n"), F.avg("ewma").alias("mean"), (F.var_pop("ewma") * F.count("*")).alias("m2"))


def epsilons(smooth: DataFrame, keys: list[str] = MC) -> DataFrame:
    """D3: (keys, eps): mean + z std of the smoothed errors, with the z whose removal lowers mean and std most for the runs and points it takes away.

    Only a z that flags something, but less than half, counts; the least z wins ties. Without any, z = 3. Moments of the slots between
    thresholds are merged for each z, and runs are counted as steps up from a lower slot.
    """
    steps = int((EPS_TO - EPS_FROM) / EPS_STEP) + 1
    each = slots_of(smooth, keys).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    high, low = F.col("slot") > F.col("j"), F.col("slot") <= F.col("j")
    off = F.col("mean") - F.col("m")  # moments about the channel's mean keep their digits
    total = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    sums = each.groupBy(*keys, "j", "m", "s").agg(
        F.sum("n").alias("n"), total(high, F.col("n")).alias("nh"), total(high & (F.col("prev") <= F.col("j")), F.col("n")).alias("runs"),
        total(low, F.col("n") * off).alias("a"), total(low, F.col("m2") + F.col("n") * off * off).alias("b"),
    )
    left, m, s = F.col("n") - F.col("nh"), F.col("m"), F.col("s")
    shift = F.col("a") / left
    lower = F.sqrt(F.greatest(F.col("b") / left - shift * shift, F.lit(0.0)))
    gain = F.when(m == 0, 0.0).otherwise(-shift / F.when(m == 0, 1.0).otherwise(m)) + (s - lower) / s
    # z that take the same points away are one choice, the least of them
    fits = sums.where((F.col("nh") > 0) & (F.col("nh") < F.col("n") / 2)).withColumn("score", gain / (F.col("runs") * F.col("runs") + F.col("nh")))
    fits = fits.groupBy(*keys, "nh").agg(F.min_by(F.struct("score", "m", "s", "j"), "j").alias("x"))
    best = fits.groupBy(*keys).agg(F.max(F.struct("x.score", (-F.col("x.j")).alias("k"))).alias("x")).select(*keys, (EPS_FROM - EPS_STEP * F.col("x.k")).alias("_z"))
    stats = smooth.groupBy(*keys).agg(F.max("m").alias("m"), F.max("s").alias("s"))
    named = best.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_z")
    both = stats.join(named, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
    return both.select(*keys, (m + F.coalesce("_z", F.lit(EPS_FALLBACK)) * s).alias("eps"))


def marked(runs: DataFrame, ps: dict[str, float], keys: list[str] = MC) -> DataFrame:
    """Runs (keys, g, peak, start, outside) with a flag for each named p: whether a run stands above the last drop of p or more between falling
    peaks; `outside`, the highest unflagged error of the channel or null, is the last peak. Windows see a row for each run."""
    order = Window.partitionBy(*keys).orderBy(F.desc("peak"), F.desc("start"))
    following = F.coalesce(F.lead("peak").over(order), F.col("outside"), F.lit(0.0))
    ranked = runs.withColumn("_drop", F.when(F.col("peak") > 0, (F.col("peak") - following) / F.col("peak")).otherwise(0.0)).withColumn("_rank", F.row_number().over(order))
    last = lambda p: F.max(F.when(F.col("_drop") >= p, F.col("_rank"))).over(Window.partitionBy(*keys))
    return ranked.withColumns({name: F.coalesce(F.col("_rank") <= last(p), F.lit(False)) for name, p in ps.items()}).drop("_drop", "_rank")


def pruned(runs: DataFrame, p: float = 0.13, keys: list[str] = MC) -> DataFrame:
    """(keys, g) of the runs that pruning keeps."""
    return marked(runs, {"_kept": p}, keys).where("_kept").select(*keys, "g")


def smoothed(errors: DataFrame, span: int, keys: list[str] = MC) -> DataFrame:
    """Stored: i, error, ewma (the smoothed log error), _segment, the channel's mean m and std s of it, _last, with which the segment before ends, and _cut, whether the
    channel has several segments."""
    logs = errors.select(*keys, "i", "error", F.log(F.col("error") + 1e-12).alias("_log"))
    rows = stored(ewma(logs, span, keys, "i", "_log", ("error",)).withColumn("_segment", F.floor(F.col("i") / SEGMENT)))
    stats = rows.groupBy(*keys).agg(F.avg("ewma").alias("m"), F.stddev_pop("ewma").alias("s"))
    ends = rows.groupBy(*keys, "_segment").agg(F.max_by("ewma", "i").alias("_end"))
    last = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_segment"))  # a row for each segment
    cut = F.count("*").over(Window.partitionBy(*keys)) > 1
    per = join_channels(ends.withColumns({"_last": last, "_cut": cut}).drop("_end"), stats, keys)
    return join_channels(rows, per, [*keys, "_segment"])


def dynamic_runs(errors: DataFrame, span: int = 5) -> DataFrame:
    """Stored: i, error, eps, high and g, the run of high positions, each with its segment."""
    smooth = stored(smoothed(errors, span))
    own = ["_cut", "_key", *MC]  # _cut follows from the channel; as a part of the key it lets the others' rows go before they are joined
    rows = join_spread(smooth, epsilons(smooth), MC).withColumns({"high": F.col("ewma") >= F.col("eps"), "_key": key_hash(MC)})
    before = F.coalesce(F.lag("high").over(Window.partitionBy(*own, "_segment").orderBy("i")), F.col("_last") >= F.col("eps"), F.lit(False))
    rows = rows.withColumn("_opens", F.col("high") & ~before)
    return stored(numbered_groups(rows, own, F.col("_opens"), "g", "_segment", "i", cut=F.col("_cut")).select(*MC, "i", "error", "eps", "high", "_segment", F.when(F.col("high"), F.col("g")).alias("g")))


def run_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the runs of a segment hold, with g null for all positions outside of runs, and the runs of whole channels, from the rows of dynamic_runs."""
    pieces = rows.groupBy(*MC, "_segment", "g").agg(F.max("error").alias("peak"), F.min("i").alias("start"), F.count("*").alias("n"))
    outside = pieces.groupBy(*MC).agg(F.max(F.when(F.col("g").isNull(), F.col("peak"))).alias("outside"))
    runs = pieces.where("g is not null").groupBy(*MC, "g").agg(F.max("peak").alias("peak"), F.min("start").alias("start"), F.sum("n").alias("n"))
    return pieces, join_channels(runs, outside, MC)


def flag_counts(rows: DataFrame, ps: dict[str, float]) -> DataFrame:
    """How many positions of a channel flag_runs flags at each named p, from runs: no row of a position is joined or shuffled again."""
    pieces, runs = run_pieces(rows)
    counts = marked(runs, ps).groupBy(*MC).agg(*[F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name) for name in ps])
    return join_channels(pieces.select(*MC).distinct(), counts, MC, "left").fillna(0, list(ps))


def flag_runs(rows: DataFrame, p: float = 0.13) -> DataFrame:
    """(i, flag, epsilon): flag tells the positions of the runs that pruning keeps."""
    pieces, runs = run_pieces(rows)
    kept = pruned(runs, p)
    # a run stands once for each segment that it touches, and meets the rows there
    held = join_channels(pieces.where("g is not null").select(*MC, "g", "_segment"), kept, [*MC, "g"]).select(*[F.col(c).alias(f"_of_{c}") for c in (*MC, "_segment", "g")])
    flags = rows.join(held, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in MC] + [F.col("_segment") == F.col("_of__segment"), F.col("g") == F.col("_of_g")], "left")
    return flags.select(*MC, F.col("i").cast("int").alias("i"), F.col("_of_g").isNotNull().alias("flag"), F.exp("eps").alias("epsilon"))


def detect_dynamic(errors: DataFrame, span: int = 5, p: float = 0.13) -> DataFrame:
    """Smoothed log errors, adaptive epsilon, runs, pruning. A channel of any length is worked on in segments of positions: moments are merged,
    runs are carried over borders, and only runs, not positions, are ranked together. Errors that are missing or NaN aren't provided for."""
    return flag_runs(dynamic_runs(errors, span), p)


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


#: Positions whose windows are scored in one call; windows of a channel that trees are drawn from.
BLOCK, POOL = 131_072, 25_600


def in_blocks(windows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with `_block`, stored: a channel and a block name at most BLOCK starts."""
    return stored(windows.select(*MC, "start_idx", *columns, F.floor(F.col("start_idx") / BLOCK).alias("_block")))


def heads(rows: DataFrame) -> DataFrame:
    """A channel's blocks with the number of rows before each."""
    own = rows.groupBy(*[F.col(c).alias(c) for c in (*MC, "_block")]).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*MC).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*MC, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def by_size(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of channels of `most` windows at most in one block, which a task can hold and finish alone, and the others if there are any."""
    sizes = rows.groupBy(*MC).agg(F.count("*").alias("_n"), F.max("_block").alias("_top")).where((F.col("_n") > most) | (F.col("_top") > 0))
    long = stored(sizes.select(*MC, F.lit(True).alias("_long")))
    if long.isEmpty():
        return rows, None
    marked = join_channels(rows, long, MC, "left")
    return marked.where("_long is null").drop("_long"), marked.where("_long").drop("_long")


def grow_forest(x: np.ndarray, seed: int, trees: int = 100, sample: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isolation trees of `sample` rows each: (axis or -1, cut, depth of a leaf) of every node, a row for each tree; node i has children
    2i + 1 and 2i + 2. All trees grow together, a level at a time."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    slots = 2 ** (limit + 1) - 1
    axis, cut, depth = np.full(trees * slots, -1, np.int16), np.zeros(trees * slots), np.zeros(trees * slots)
    own = np.concatenate([rng.choice(len(x), size, replace=False, shuffle=False) for _ in range(trees)])
    node = np.repeat(np.arange(trees) * slots, size)
    for level in range(limit + 1):
        order = np.argsort(node, kind="stable")
        own, node = own[order], node[order]
        names, start, count = np.unique(node, return_index=True, return_counts=True)
        lo, hi = np.minimum.reduceat(x[own], start, axis=0), np.maximum.reduceat(x[own], start, axis=0)
        depth[names] = level + _harmonic(count)
        grows = (hi > lo).any(axis=1) & (level < limit)
        if not grows.any():
            break
        chosen, rows = np.argmax(rng.random(lo.shape) * (hi > lo), axis=1), np.arange(len(names))
        low, high = lo[rows, chosen], hi[rows, chosen]
        at = low + (high - low) * (1 - rng.random(len(names)))
        at = np.where(at <= low, high, at)
        axis[names[grows]], cut[names[grows]] = chosen[grows], at[grows]
        mine = np.searchsorted(names, node)
        own, mine = own[grows[mine]], mine[grows[mine]]
        place = names[mine] % slots
        node = names[mine] - place + 2 * place + 1 + (x[own, chosen[mine]] >= at[mine])
    return axis.reshape(trees, slots), cut.reshape(trees, slots), depth.reshape(trees, slots)


def isolation_scores(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, depth: np.ndarray, size: int) -> np.ndarray:
    """Points that random axis cuts of `size` rows isolate early score near 1."""
    tree, row, node = np.arange(len(axis)), np.arange(len(x))[:, None], np.zeros((len(x), len(axis)), np.int32)
    for _ in range(int(np.log2(axis.shape[1] + 1)) - 1):
        on = axis[tree, node]
        node = np.where(on >= 0, 2 * node + 1 + (x[row, np.maximum(on, 0)] >= cut[tree, node]), node)
    return 2.0 ** (-depth[tree, node].mean(axis=1) / max(float(_harmonic(np.array(size))), 1e-12))


def isolation_forest(windows: DataFrame, contamination: float = 0.1, seed: int = 0, trees: int = 100, sample: int = 256) -> DataFrame:
    """Score and flag of each window, a forest per channel; flagged beyond the contamination percentile of all scores of the channel.

    A channel's trees draw their rows from its POOL windows of least hash, all of them where it has no more. The windows then meet the trees in
    blocks, so that a channel of any length is scored in many tasks. Random cuts don't depend on an axis' scale, so positions aren't scaled.
    Draws depend on names and positions only, not on partitioning. Channels that one task can hold are grown, scored and cut there, so that no trees
    leave it: trees are larger than such a channel's windows.
    """
    few, many = by_size(in_blocks(windows, ["values"]), POOL)
    drawn = F.xxhash64(*MC, "start_idx", F.lit(seed))

    def seeded(group: pd.DataFrame) -> int:
        return int(hashlib.md5("|".join([*group.iloc[0][MC].astype(str), str(seed)]).encode()).hexdigest()[:12], 16)

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_drawn", "start_idx"])
        x = np.stack(group["values"].to_numpy())
        scores = isolation_scores(x, *grow_forest(x, seeded(group), trees, sample), min(sample, len(x)))
        at, ranked = (len(x) - 1) * (1 - contamination), np.sort(scores)
        low = int(np.floor(at))
        cut = ranked[low] + (ranked[min(low + 1, len(x) - 1)] - ranked[low]) * (at - low)
        return group[[*MC, "start_idx"]].assign(score=scores, flag=scores > cut)

    out = few.select(*MC, "start_idx", "values", drawn.alias("_drawn")).groupBy(*MC).applyInPandas(alone, "mission string, channel string, start_idx int, score double, flag boolean")
    return out if many is None else out.unionByName(_spread_forest(many, contamination, seed, trees, sample))


def _spread_forest(rows: DataFrame, contamination: float, seed: int, trees: int, sample: int) -> DataFrame:
    """isolation_forest of channels that are too long for a task."""
    drawn = F.xxhash64(*MC, "start_idx", F.lit(seed))
    share = F.shiftrightunsigned(drawn, 33) / float(1 << 31)
    few = join_channels(rows, rows.groupBy(*MC).agg(F.count("*").alias("_n")), MC).where(share <= 2.0 * POOL / F.col("_n"))
    nth = F.row_number().over(Window.partitionBy(*MC).orderBy(drawn, "start_idx"))
    pool = few.select(*MC, "start_idx", "values", nth.alias("_nth")).where(F.col("_nth") <= POOL)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_nth")
        key = "|".join([*group.iloc[0][MC].astype(str), str(seed)])
        grown = grow_forest(np.stack(group["values"].to_numpy()), int(hashlib.md5(key.encode()).hexdigest()[:12], 16), trees, sample)
        return group[MC].head(1).assign(size=min(sample, len(group)), **{n: [v.tobytes()] for n, v in zip(("axis", "cut", "depth"), grown)})

    def score(key: tuple, group: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        f = forest.iloc[0]
        parts = [np.frombuffer(f[n], kind).reshape(trees, -1) for n, kind in (("axis", np.int16), ("cut", np.float64), ("depth", np.float64))]
        return group[[*MC, "start_idx"]].assign(score=isolation_scores(np.stack(group["values"].to_numpy()), *parts, f["size"]))

    forests = pool.groupBy(*MC).applyInPandas(fit, "mission string, channel string, size int, axis binary, cut binary, depth binary")
    near = join_channels(heads(rows), forests, MC)
    scored = rows.groupBy(*MC, "_block").cogroup(near.groupBy(*MC, "_block")).applyInPandas(score, "mission string, channel string, start_idx int, score double")
    ranked = exact_rank(stored(scored), [*MC, "score"], "_rank")
    ends = ranked.groupBy(*MC).agg(F.min("_rank").alias("_first"), ((F.count("*") - 1) * (1 - contamination)).alias("_at"))
    placed = join_channels(ranked, ends, MC)
    step = F.col("_rank") - F.col("_first") - F.floor("_at")
    low, high = F.max(F.when(step == 0, F.col("score"))), F.max(F.when(step == 1, F.col("score")))
    cuts = placed.groupBy(*MC).agg((low + F.coalesce(high - low, F.lit(0.0)) * F.max(F.col("_at") - F.floor("_at"))).alias("_cut"))
    return join_channels(ranked, cuts, MC).select(*MC, "start_idx", "score", (F.col("score") > F.col("_cut")).alias("flag"))


def pca_fit(k: int = 4) -> Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """A linear autoencoder: k principal components of the normal windows."""

    def fit(normal: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        mean = normal.mean(axis=0)
        _, vectors = np.linalg.eigh(np.cov(normal - mean, rowvar=False, bias=True))
        top = vectors[:, -k:]
        return lambda x: mean + (x - mean) @ top @ top.T

    return fit


#: (n, mean, sum of outer products about the mean) of some windows, and how many channels a task sums at a time.
Moments = tuple[int, np.ndarray, np.ndarray]
CHANNELS_AT_ONCE = 1000
MOMENTS = "mission string, channel string, salt int, n bigint, mean array<double>, outer array<double>"


def _added(a: Moments | None, b: Moments) -> Moments:
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def principal_components(windows: DataFrame, k: int, least_normal: int) -> DataFrame:
    """(mission, channel, mean, top): the k principal components of a channel's normal windows, from moments summed in every task, then by salt, then
    by channel. Channels with fewer than `least_normal` normal windows are left out."""

    def rows(sums: dict, salt: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, salt, n, mean, outer.ravel()) for key, (n, mean, outer) in sums.items()], columns=[*MC, "salt", "n", "mean", "outer"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, salt = {}, TaskContext.get().partitionId() % 64
        for frame in frames:
            for key, values in frame.groupby(MC, dropna=False)["values"]:
                key, x = tuple(None if pd.isna(v) else v for v in key), np.stack(values.to_numpy())
                mean = x.mean(axis=0)
                sums[key] = _added(sums.get(key), (len(x), mean, (x - mean).T @ (x - mean)))
            if len(sums) > CHANNELS_AT_ONCE:
                yield rows(sums, salt)
                sums = {}
        yield rows(sums, salt)

    def total(group: pd.DataFrame) -> Moments:
        out = None
        for n, mean, outer in zip(group["n"], group["mean"], group["outer"]):
            out = _added(out, (int(n), np.asarray(mean), np.asarray(outer).reshape(len(mean), -1)))
        return out

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        n, mean, outer = total(group.sort_values("n"))
        return group[[*MC, "salt"]].head(1).assign(n=n, mean=[mean], outer=[outer.ravel()])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        n, mean, outer = total(group.sort_values("salt"))
        if n < least_normal:
            return group[MC].head(0).assign(mean=None, top=None)
        top = np.linalg.eigh(outer / n)[1][:, -k:]
        return group[MC].head(1).assign(mean=[mean], top=[top.ravel()])

    partials = windows.where(~F.col("is_anomaly")).select(*MC, "values").mapInPandas(partial, MOMENTS)
    return partials.groupBy(*MC, "salt").applyInPandas(merge, MOMENTS).groupBy(*MC).applyInPandas(solve, "mission string, channel string, mean array<double>, top array<double>")


def reconstruction_errors(windows: DataFrame, fit: Callable | None = None, least_normal: int = 100, k: int = 4) -> DataFrame:
    """Mean squared reconstruction error of every window from k principal components of its channel's normal windows. A channel with fewer than
    `least_normal` normal windows gives no rows. Moments are partial sums and windows are rebuilt in blocks, so a channel may have any length;
    channels of one block are fitted and rebuilt in one call, so that neither moments nor components leave the task.

    A caller's `fit` sees all normal windows of a channel and returns a function that rebuilds windows: a channel stands in one task then.
    """
    if fit is None:
        few, rows = by_size(in_blocks(windows, ["values", "is_anomaly"]), POOL)

        def alone(group: pd.DataFrame) -> pd.DataFrame:
            normal = (~group["is_anomaly"]).to_numpy(dtype=bool)
            if normal.sum() < max(least_normal, 1):
                return group[MC].head(0).assign(i=0, start_idx=0, error=0.0, is_anomaly=False)
            group = group.sort_values("start_idx")
            x, normal = np.stack(group["values"].to_numpy()), (~group["is_anomaly"]).to_numpy(dtype=bool)
            mean = x[normal].mean(axis=0)
            x = x - mean
            top = np.linalg.eigh(x[normal].T @ x[normal] / normal.sum())[1][:, -k:]
            return group[MC].assign(i=np.arange(len(group)), start_idx=group["start_idx"], error=((x - x @ top @ top.T) ** 2).mean(axis=1), is_anomaly=group["is_anomaly"])

        own = few.drop("_block").groupBy(*MC).applyInPandas(alone, ERRORS)
        if rows is None:
            return own

        def rebuild(key: tuple, group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if model.empty or group.empty:
                return group[MC].head(0).assign(i=0, start_idx=0, error=0.0, is_anomaly=False)
            group = group.sort_values("start_idx")
            mean = np.asarray(model["mean"].iloc[0])
            top, x = np.asarray(model["top"].iloc[0]).reshape(len(mean), -1), np.stack(group["values"].to_numpy()) - mean
            i = model["_before"].iloc[0] + np.arange(len(group))
            return group[MC].assign(i=i, start_idx=group["start_idx"], error=((x - x @ top @ top.T) ** 2).mean(axis=1), is_anomaly=group["is_anomaly"])

        near = join_channels(heads(rows), principal_components(rows, k, least_normal), MC)
        return own.unionByName(rows.groupBy(*MC, "_block").cogroup(near.groupBy(*MC, "_block")).applyInPandas(rebuild, ERRORS))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start_idx").reset_index(drop=True)
        x = np.stack(group["values"].to_numpy())
        normal = x[~group["is_anomaly"].to_numpy()]
        if len(normal) < least_normal:
            return group.head(0)[[*MC]].assign(i=0, start_idx=0, error=0.0, is_anomaly=False)
        error = ((x - fit(normal)(x)) ** 2).mean(axis=1)
        return group[MC].assign(i=np.arange(len(group)), start_idx=group["start_idx"], error=error, is_anomaly=group["is_anomaly"])

    return windows.select(*MC, "start_idx", "values", "is_anomaly").groupBy(*MC).applyInPandas(run, ERRORS)


def score_windows(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> DataFrame:
    """A caller's batch model: predict gets a batch and returns l_anom and l_nom. A batch that fails is tried row by row; a row that fails
    gets score 0 and argmax ERROR."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                got = predict(frame)[["l_anom", "l_nom"]].reset_index(drop=True)
            except Exception:  # the caller's model may fail on any row
                parts = []
                for i in range(len(frame)):
                    try:
                        parts.append(predict(frame.iloc[i : i + 1])[["l_anom", "l_nom"]])
                    except Exception:
                        parts.append(pd.DataFrame({"l_anom": [np.nan], "l_nom": [np.nan]}))
                got = pd.concat(parts, ignore_index=True)
            out = frame[keys].reset_index(drop=True)
            bad = got["l_anom"].isna()
            out["score"] = np.where(bad, 0.0, np.round(1 / (1 + np.exp(got["l_nom"] - got["l_anom"])), 6))
            out["logit_anomaly"], out["logit_nominal"] = np.round(got["l_anom"].fillna(0.0), 4), np.round(got["l_nom"].fillna(0.0), 4)
            out["argmax"] = np.where(bad, "ERROR", np.where(got["l_anom"] >= got["l_nom"], "ANOMALY", "NOMINAL"))
            yield out

    schema = df.select(*keys).schema.add("score", "double").add("logit_anomaly", "double").add("logit_nominal", "double").add("argmax", "string")
    return df.mapInPandas(score, schema)
