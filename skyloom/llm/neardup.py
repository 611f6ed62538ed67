"""Near duplicates by an LSH forest: sorted signature orders, common-prefix neighbours, depth that adapts to each region.

Every distinct shingle set has one representative. In each of TREES orders of its MinHash signature, representatives
that share a prefix of MIN_DEPTH values form a region. A region too large for one task is read at greater depth until its
parts are small enough, and its members are tied to its first member, which keeps large groups linear.
Candidates pass a size test (exact) and two sketch tests (4.5 standard deviations below the threshold) and are
confirmed on full sets. First every row meets its nearest neighbours only; when those links have been joined into
components, all remaining candidates between different components follow, so no region's pairs are expanded inside a
component. Greater depths lose pairs, so members of large regions that are still in different components then meet by
an equi-join on each set's rarest shingles, of which two sets at the threshold always share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, freeing, partitions, small_batches, summed_array
from .spans import SpanHash, mix, runs

TREES, PER_TREE, MIN_DEPTH = 16, 4, 3
VALUES = TREES * PER_TREE
#: Cells of a second sketch that only serves the test of pairs: the least hash in each cell, as a byte.
CELLS = 256
WIDTH = 4 * VALUES + CELLS
#: Prefix lengths at which too large regions are read again.
DEPTHS = (MIN_DEPTH, 5, 8, 12, 20, 32, VALUES)
#: Members of a region that one task compares with each other.
REGION = 512
#: Shingles of the sets under one rare shingle that one task compares; more are compared block by block, over many tasks.
BLOCK = 1 << 18
#: Bits of a shingle's cell in the histogram that orders shingles from rare to common.
ORDER_BITS = 20
CHUNK_BYTES = 1 << 20
#: Pairs of one leader of a large region that one task confirms.
STAR = 64
#: Up to this many candidate ids (some MB) are sent to the texts; more meet them by a shuffle.
SENT_IDS = 200_000

_spaces = np.zeros(256, dtype=bool)
_spaces[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and sorted distinct shingle hashes, in chunks of bounded bytes; a text without words has no entry."""
    held: list[int] = []
    room = 0
    for i, t in enumerate(texts):
        if t:
            if held and room + len(t) > CHUNK_BYTES:
                yield _sets(texts, held, size)
                held, room = [], 0
            held.append(i)
            room += len(t)
    if held:
        yield _sets(texts, held, size)


def _sets(texts: list[bytes | None], held: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts[i] for i in held), dtype=np.uint8)
    ends = np.cumsum([len(texts[i]) + 1 for i in held])
    start, end = runs(~_spaces[data])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = SpanHash(_lower[data])(start, end)
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=len(held))
    n = len(word)
    # whole windows of one text, and the whole sequence of texts with fewer words
    full = np.zeros(n, dtype=np.uint64)
    inside = np.arange(n - size + 1) if n >= size else np.zeros(0, np.int64)
    inside = inside[owner[inside] == owner[inside + size - 1]]
    for k in range(size):
        full[inside] += word[inside + k] * _PLACE[k]
    owners, hashes = [owner[inside]], [mix(full[inside])]
    first = np.cumsum(counts) - counts
    for m in range(1, size):
        short = np.flatnonzero(counts == m)
        h = np.full(len(short), m, dtype=np.uint64)
        for k in range(m):
            h += word[first[short] + k] * _PLACE[k + size]
        owners.append(short)
        hashes.append(mix(h ^ np.uint64(0x5151 + m)))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first_of = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
    return np.array(held)[owner[first_of]], h[first_of]


def _signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, f1, f2, sig): f1 and f2 are two independent sums over the set, equal for equal sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = np.zeros(len(texts), dtype=np.int64)
            sums = np.zeros((2, len(texts)), dtype=np.uint64)
            sig: list[bytes | None] = [None] * len(texts)
            for owner, h in shingle_sets(texts, size):
                if not len(owner):
                    continue
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                rows = owner[begin]
                n[rows] = np.diff(np.append(begin, len(owner)))
                sums[0, rows] = np.add.reduceat(mix(h ^ np.uint64(1)), begin)
                sums[1, rows] = np.add.reduceat(mix(h ^ np.uint64(2)), begin)
                least = np.empty((len(rows), VALUES), dtype=np.uint32)
                for v in range(VALUES):
                    least[:, v] = np.minimum.reduceat(((h * _MULTIPLY[v] + _ADD[v]) >> np.uint64(32)).astype(np.uint32), begin)
                # hashes are sorted inside a text, so the first of each cell is its least; 0 marks an empty cell
                cell = (h >> np.uint64(56)).astype(np.int64)
                first = np.append(True, (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1]))
                cells = np.zeros((len(rows), CELLS), dtype=np.uint8)
                cells[np.searchsorted(rows, owner[first]), cell[first]] = (h[first] >> np.uint64(24)).astype(np.uint8) | np.uint8(1)
                for row, s, c in zip(rows, least, cells):
                    sig[row] = s.tobytes() + c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "sig"])

    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(freeing(sign), "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, sig binary")


def _unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values and cells, a row each."""
    both = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, WIDTH)
    return np.ascontiguousarray(both[:, : 4 * VALUES]).view(np.uint32), both[:, 4 * VALUES :]


def _prefixes(reps: DataFrame, depth: int, trees: DataFrame | None = None) -> DataFrame:
    """(region, tree, rep, n, sig) for every tree, or for the (tree, rep) rows given: region is a hash of the order's first `depth` values."""

    def order(sig: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """Hash of the first `depth` values of each row in its tree's order, which starts at the tree's own values and wraps."""
        h = tree.astype(np.uint64) + np.uint64(depth << 8)
        for i in range(depth):
            at = (tree * PER_TREE + i) % VALUES
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[np.arange(len(sig)), at])
        return h.view(np.int64)

    def all_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _unpack(batch.column(2).to_pylist())[0]
            for t in range(TREES):
                tree = np.full(len(sig), t)
                yield pa.RecordBatch.from_arrays([pa.array(order(sig, tree)), pa.array(tree.astype(np.int32)), batch.column(0)], names=["region", "tree", "rep"])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _unpack(batch.column(3).to_pylist())[0]
            tree = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(order(sig, tree)), *batch.columns], names=["region", "tree", "rep", "n", "sig"])

    if trees is None:
        return reps.select("rep", "n", "sig").mapInArrow(freeing(all_trees), "region long, tree int, rep long")
    return trees.select("tree", "rep", "n", "sig").mapInArrow(freeing(given), "region long, tree int, rep long, n long, sig binary")


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of regions small enough for one task, (region, rep, n, sig), star pairs (a, b, fan) of the larger ones, and all members (rep)
    of regions that were too large at MIN_DEPTH. fan is the number of tasks among which the pairs of one leader are dealt."""
    rows = cut(_prefixes(reps, MIN_DEPTH))
    sizes = rows.groupBy("region").count().where("count > 1")
    members = cut(rows.join(sizes, "region").join(reps, "rep").select("region", "tree", "rep", "n", "sig", "count"))
    crowd = cut(members.where(F.col("count") > REGION).select("rep").distinct())
    small, stars, fan = [], [], F.ceil(F.col("count") / STAR).alias("fan")
    for depth in DEPTHS[1:]:
        small.append(members.where(F.col("count") <= REGION).select("region", "rep", "n", "sig"))
        large = members.where(F.col("count") > REGION)
        if large.isEmpty():
            break
        lead = large.groupBy("region").agg(F.min("rep").alias("a"))
        stars.append(large.join(lead, "region").where("a < rep").select("a", F.col("rep").alias("b"), fan))
        deeper = _prefixes(reps, depth, large)
        again = deeper.groupBy("region").count().where("count > 1")
        members = cut(deeper.join(again, "region").select("region", "tree", "rep", "n", "sig", "count"))
    else:  # rows with one signature in more than one task's share: chunks of them, tied together by their stars
        small.append(members.select(F.xxhash64("region", F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / REGION))).alias("region"), "rep", "n", "sig"))
        lead = members.where(F.col("count") > REGION).groupBy("region").agg(F.min("rep").alias("a"))
        stars.append(members.join(lead, "region").where("a < rep").select("a", F.col("rep").alias("b"), fan))
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    pairs = stars[0] if stars else members.select(F.col("rep").alias("a"), F.col("rep").alias("b"), fan).limit(0)
    for s in stars[1:]:
        pairs = pairs.unionByName(s)
    return out, pairs, crowd


def _whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by region, so that no region is in two tables."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        region = rows.column("region").to_numpy()
        last = int(np.searchsorted(region, region[-1])) if len(region) else 0
        rest = rows.slice(last)
        if last:
            yield rows.slice(0, last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _alike(region: np.ndarray, n: np.ndarray, sig: np.ndarray, cells: np.ndarray, percent: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one region that pass the size and sketch tests and are wanted, and how many sketch values are equal.

    The comparison runs over all regions at once, one distance in the order after another.
    """
    j = percent / 100
    least = int(np.ceil(VALUES * (j - 4.5 * np.sqrt(j * (1 - j) / VALUES))))
    found_a, found_b, found_s = [], [], []
    i = np.arange(len(region))
    step = 1
    while len(i):
        i = i[i + step < len(region)]
        i = i[region[i] == region[i + step]]
        k = i + step
        go = 100 * np.minimum(n[i], n[k]) >= percent * np.maximum(n[i], n[k])
        if wanted:
            go &= wanted(i, k)
        a, b = i[go], k[go]
        same, keep = np.empty(len(a), dtype=np.int64), np.empty(len(a), dtype=bool)
        for at in range(0, len(a), 65536):
            x, y = a[at : at + 65536], b[at : at + 65536]
            equal = (sig[x] == sig[y]).sum(axis=1)
            u, v = cells[x], cells[y]
            used, met = ((u | v) > 0).sum(axis=1), ((u == v) & (u > 0)).sum(axis=1)
            same[at : at + 65536] = equal + met
            keep[at : at + 65536] = (equal >= least) & (met >= j * used - 4.5 * np.sqrt(j * (1 - j) * used))
        found_a.append(a[keep]), found_b.append(b[keep]), found_s.append(same[keep])
        step += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b, found_s))


def region_pairs(members: DataFrame, percent: int, apart: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of one region that pass the size and signature tests.

    apart False: each member's best partner only. apart True: every pair whose `comp` differs.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_regions(batches):
            region, rep, n = (rows.column(c).to_numpy() for c in ("region", "rep", "n"))
            comp = rows.column("comp").to_numpy() if apart else None
            sig, cells = _unpack(rows.column("sig").to_pylist())
            a, b, same = _alike(region, n, sig, cells, percent, (lambda i, k: comp[i] != comp[k]) if apart else None)
            if not apart and len(a):  # both ends look for their best partner; equal ones go to the smaller id
                one, other, s = np.append(a, b), np.append(b, a), np.append(same, same)
                order = np.lexsort((rep[other], -s, one))
                first = order[np.append(True, one[order][1:] != one[order][:-1])]
                a, b = one[first], other[first]
            lo, hi = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
            both = np.unique(np.stack([lo, hi], axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    columns = ["region", "rep", "n", "sig", *(["comp"] if apart else [])]
    ordered = members.select(*columns).repartition(partitions(members.sparkSession), "region").sortWithinPartitions("region", "rep")
    return ordered.mapInArrow(freeing(pairs), "a long, b long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, text, and what else wanted holds) of the texts that stand for the wanted reps.

    They are found by id and text hash, as an id may stand on several texts. The reps are counted: a few are sent to the
    texts, more meet them by a hash join without a sort.
    """
    named = wanted.join(reps.select("rep", "id", "hash"), "rep").hint("broadcast" if wanted.count() <= SENT_IDS else "shuffle_hash")
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("_i"), F.xxhash64(f"`{text}`").alias("_h"), F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null")
    return slim.join(named, slim["_i"].eqNullSafe(named["id"]) & (slim["_h"] == named["hash"])).select("rep", "text", *[c for c in wanted.columns if c != "rep"])


def rare_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(shingle, rep, comp, n, left) of the rarest shingles of each text in one order of all shingles, as many as are needed for
    two sets at the threshold to share one: all but percent of the set, and one more.

    Any order that is the same everywhere is exact; a histogram of fixed size puts rare shingles first. n is the size of the
    set and left the number of its shingles from this one on.
    """
    shift, cells = np.uint64(64 - ORDER_BITS), 1 << ORDER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for _, h in shingle_sets(batch.column(0).to_pylist(), size):
                seen += np.bincount((h >> shift).astype(np.int64), minlength=cells)
        return seen

    shared = texts.sparkSession.sparkContext.broadcast(summed_array(texts.select("text"), count, cells))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for owner, h in shingle_sets(batch.column(2).to_pylist(), size):
                order = np.lexsort((h, shared.value[(h >> shift).astype(np.int64)], owner))
                owner, h = owner[order], h[order]
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(owner)))
                place = np.arange(len(owner)) - np.repeat(begin, n)
                go = place <= np.repeat(n - -(-percent * n // 100), n)
                of = np.repeat(n, n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[go].view(np.int64), ids[owner[go]], comps[owner[go]], of[go], (of - place)[go])], names=["shingle", "rep", "comp", "n", "left"])

    return texts.select("rep", "comp", "text").mapInArrow(freeing(rarest), "shingle long, rep long, comp long, n long, left long")


def crowded_links(docs: DataFrame, reps: DataFrame, crowd: DataFrame, roots: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components with a pair at the threshold among `crowd`, the members of too large regions; none is left out
    but by the sketch tests.

    Sets that share a rare shingle are compared where they are of more than one component. Above BLOCK shingles, each block of
    those outside the commonest component meets each block of all, so one component of any size is read once for each
    block of others. A task confirms pairs on full sets and gives one link for each two components that it joins.
    """
    wanted = cut(crowd.join(roots, crowd["rep"] == roots["node"], "left").select("rep", F.coalesce("root", "rep").alias("comp")))
    rare = cut(rare_shingles(_texts(docs, wanted, reps, key, text), size, percent))
    each = rare.groupBy("shingle", "comp").agg(F.sum("n").alias("c"))
    stats = each.groupBy("shingle").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    met = rare.join(stats.select("shingle", "all", (F.col("all") - F.col("main.c")).alias("others"), F.col("main.comp").alias("main")), "shingle")
    half = BLOCK // 2
    blocks = lambda n: F.when(F.col("all") <= BLOCK, 1).otherwise(F.ceil(F.col(n) / half)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    every = met.select("*", mine("all").alias("y"), F.explode(F.sequence(F.lit(0), blocks("others") - 1)).alias("x"))
    other = met.where((F.col("comp") != F.col("main")) & (F.col("all") > BLOCK)).select("*", mine("others").alias("x"), F.explode(F.sequence(F.lit(0), blocks("all") - 1)).alias("y"))
    members = cut(every.unionByName(other).select(F.xxhash64("shingle", "x", "y").alias("region"), "rep", "comp", "left"))
    full = _full_sets(docs, cut(members.select("rep").distinct()), reps, key, text, size)
    columns = ["region", "rep", "comp", "left", "n", "sig", "members"]
    ordered = members.join(reps.select("rep", "n", "sig"), "rep").join(full, "rep").select(*columns).repartition(partitions(docs.sparkSession), "region").sortWithinPartitions("region", "rep")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_regions(batches):
            region, rep, comp, left, n = (rows.column(c).to_numpy() for c in columns[:5])
            sig, cells = _unpack(rows.column("sig").to_pylist())
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
            # where a pair first shares a shingle, all that it shares is among what is left of both
            first = lambda i, k: (comp[i] != comp[k]) & ((100 + percent) * np.minimum(left[i], left[k]) >= percent * (n[i] + n[k]))
            a, b, same = _alike(region, n, sig, cells, percent, first)
            _, name = np.unique(np.stack([region, comp], axis=1), axis=0, return_inverse=True)
            up = list(range(len(rep)))
            name, found = name.ravel().tolist(), []

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for i, k in zip(*(x[np.argsort(-same, kind="stable")].tolist() for x in (a, b))):
                x, y = top(name[i]), top(name[k])
                if x != y:
                    u, v = sets[i], sets[k]
                    both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        up[x] = y
                        found.append(sorted((rep[i], rep[k])))
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return ordered.mapInArrow(freeing(links), "a long, b long").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(rep, members) of the wanted reps: their sorted shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for owner, h in shingle_sets(texts, size):
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
                stop = np.append(begin[1:], len(owner))
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[begin]]), pa.array([h[x:y].tobytes() for x, y in zip(begin, stop)], pa.binary())], names=["rep", "members"])

    # repeated rows have one set, so each pair is judged once
    return _texts(docs, wanted, reps, key, text).mapInArrow(freeing(sets), "rep long, members binary").groupBy("rep").agg(F.max("members").alias("members"))


def confirm(docs: DataFrame, pairs: DataFrame, reps: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """pairs (a, b, fan) with `linked`: whether the full shingle sets reach the threshold. The pairs of one `a` are dealt among fan tasks, and its
    set is sent to each of them that has a pair."""
    wanted = cut(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct())
    full = _full_sets(docs, wanted, reps, key, text, size)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("fan")))
    left = full.withColumnsRenamed({"rep": "a", "members": "x"}).join(dealt.select("a", "part").distinct(), "a")
    right = full.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    return dealt.join(left, ["a", "part"]).join(right, "b").select("a", "b", "x", "y").mapInArrow(freeing(judge), "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that isn't the least of its component, by alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(floor.select("u", F.col("m").alias("v"))).distinct())


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots after more links (a, b)."""
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def _classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (rep, id, hash, n, copies, sig, f1, f2), and those reps (rep) that aren't the id of a row.

    id and hash name a row with the set: the least id, if any has one. rep is the id; sets without an id, and further sets of an id
    that stands on several texts, take numbers above all ids (which must be less than 2^62).
    """
    some = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    lead = F.coalesce(some, F.min(F.struct(F.lit(None).cast("long").alias("doc_id"), "text_hash")))
    sets = base.where("n_shingles > 0").groupBy("f1", "f2").agg(lead.alias("x"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    sets = cut(sets.select(F.col("x.doc_id").alias("id"), F.col("x.text_hash").alias("hash"), "n", "copies", "sig", "f1", "f2"))
    again = cut(sets.where("id is not null").groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    columns = ["rep", "id", "hash", "n", "copies", "sig", "f1", "f2"]
    most, unnamed = sets.agg(F.max("id"), F.count_if(F.col("id").isNull())).first()
    if not unnamed and again.isEmpty():
        reps = sets.withColumn("rep", F.col("id")).select(*columns)
        return reps, reps.select("rep").limit(0)
    both = sets.join(again, "id", "left")
    own = F.col("id").isNotNull() & (F.col("first").isNull() | (F.struct("f1", "f2") == F.col("first")))
    others = cut(both.where(~own).withColumn("rep", F.monotonically_increasing_id() + F.lit((most if most is not None else 0) + 1)).select(*columns))
    return both.where(own).withColumn("rep", F.col("id")).select(*columns).unionByName(others), others.select("rep")


def _least_ids(reps: DataFrame, others: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, least) for the components that hold one of the others: their least id, which their root isn't then."""
    linked = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    all_ = linked.union(others.join(linked, others["rep"] == linked["node"], "left_anti").select(F.col("rep").alias("node"), F.col("rep").alias("root")))
    touched = all_.join(others, all_["node"] == others["rep"], "left_semi").select("root").distinct()
    return all_.join(touched, "root").join(reps.select(F.col("rep").alias("node"), "id"), "node").groupBy("root").agg(F.min("id").alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id), and text_hash, which tells
    rows of one id apart.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; the set holds distinct `size`-word shingles,
    or the whole sequence if there are fewer words. Sets link at 100 * intersection >= percent * union. A null text or
    one without words has an empty set and links with nothing. Texts of any length count whole. Rows with equal sets link
    whatever their order, and texts that share an id are told apart: each has its own links. A null id is never the least of
    its component; a component without any id has a null component_id and keeps its rows. An empty table gives an
    empty result. Other columns of docs are left out. Ids are integers below 2^62, as a component is named by its least;
    ids of another kind need a number first, for instance their rank.
    """
    small_batches(docs.sparkSession)
    base = cut(_signatures(docs, key, text, size))
    reps, others = _classes(base)
    reps = cut(reps)
    members, stars, crowd = forest(reps)
    near = region_pairs(members, percent, False).withColumn("fan", F.lit(1).cast("long")).union(stars).groupBy("a", "b").agg(F.max("fan").alias("fan"))
    seen = cut(confirm(docs, cut(near), reps, key, text, size, percent))
    roots = components(seen.where("linked"))
    label = members.join(roots, members["rep"] == roots["node"], "left").select("region", "rep", "n", "sig", F.coalesce("root", "rep").alias("comp"))
    mixed = label.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region")
    rest = cut(region_pairs(label.join(mixed, "region", "left_semi"), percent, True).join(seen.select("a", "b"), ["a", "b"], "left_anti").withColumn("fan", F.lit(1).cast("long")))
    if not rest.isEmpty():
        roots = _joined(roots, cut(confirm(docs, rest, reps, key, text, size, percent).where("linked").select("a", "b")))
    if not crowd.isEmpty():
        roots = _joined(roots, cut(crowded_links(docs, reps, crowd, roots, key, text, size, percent)))
    named = reps.join(roots, reps["rep"] == roots["node"], "left").select("f1", "f2", F.coalesce("root", "rep").alias("component_id"), "copies", "root")
    if others.isEmpty():
        named = named.where("copies > 1 or root is not null")
    else:
        least = cut(_least_ids(reps, others, roots)).withColumnRenamed("root", "top")
        least = least.hint("broadcast" if least.count() <= SENT_IDS else "merge")
        named = named.join(least, named["component_id"] == least["top"], "left").withColumn("component_id", F.when(F.col("top").isNull(), F.col("component_id")).otherwise(F.col("least")))
    out = base.select("doc_id", "text_hash", "n_shingles", "f1", "f2").join(named.select("f1", "f2", "component_id"), ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    named = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash")
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())).select("doc_id", "n_shingles", "component_id", "kept", "text_hash")
