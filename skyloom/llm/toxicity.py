"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, weighted votes.

Every term of every example is indexed: words and their beginnings. A term's weight is its idf over all texts times its
relevance, which lies between RELEVANCE and 1 and grows with the share of toxic texts among those that hold the term, so a
text is near those that share what marks them, and a copy of any example still has cosine 1 with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import letters, pieces
from .scratch import cut, free_unused, freeing, fresh, kept, small_batches, summed_array
from .spans import SpanHash, mix, runs

#: Labelled texts of each class that are indexed, and their bytes in all; document frequencies use all texts.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2000, 64 << 20
#: Letters of a word's beginning, a term besides the whole word.
BEGINNING = 4
#: Relevance of a term without evidence, and the texts at the base rate that its evidence is weighed against.
RELEVANCE, DOUBT = 0.02, 10.0
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 15, 64, 0.5
#: Terms in more than this part of the examples keep a dense posting list, scored for all examples at once.
DENSE_PART = 1 / 40
#: Blocks opened in each round of a search; the last number goes on.
ROUNDS = (2, 6, 24)
THRESHOLD = 0.3
BATCH = 256


def term_hashes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, term hash) of every word and of every longer word's beginning, in chunks of bounded size."""
    for at, held in pieces(texts):
        lowered = [t.lower() for t in held]
        codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        border = np.cumsum([len(t) + 1 for t in lowered])
        start, end = runs(letters()[codes])
        if not len(start):
            continue
        owner = np.array(at)[np.searchsorted(border, start, side="right")]
        spans = SpanHash(codes)
        yield owner, spans(start, end)
        long = end - start > BEGINNING
        yield owner[long], mix(spans(start[long], start[long] + BEGINNING) ^ np.uint64(2 * BEGINNING))


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, times), by text and term."""
    seen = list(term_hashes(texts))
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, h = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
    return owner[first], h[first], np.diff(np.append(first, len(owner)))


def places(h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in the sorted vocabulary, and whether it does."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return at, vocabulary[at] == h


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range of `count` numbers, one range after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class Terms:
    """The examples' terms with their weights; a term that stands in no example weighs as one of a single text without evidence."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, outside: float):
        self.hashes, self.weight, self.outside = hashes, weight, outside

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term number, weight) of the terms that stand in examples; unit rows over all terms, with logarithmic term frequency."""
        row, h, times = term_counts(texts)
        at, real = places(h, self.hashes)
        w = (1 + np.log(times)) * (np.where(real, self.weight[at], self.outside) if len(self.hashes) else self.outside)
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(texts)))
        w = w / np.maximum(norm[row], 1e-12)
        return row[real], at[real], w[real].astype(np.float32)


class BlockMaxIndex:
    """Posting lists of examples in blocks, with the greatest weight of each term in each block.

    Frequent terms keep dense lists, whose part of every cosine is computed at once. That part's maximum in a block and
    the greatest weights of the other terms there bound every cosine of the block, so a search opens blocks from the best
    bound down and stops once no bound reaches the k-th best cosine: exact, with ties going to the earlier example.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n, self.blocks = n, -(-n // BLOCK)
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) > max(BLOCK, n * DENSE_PART))
        self.dense_at = np.full(n_terms, -1)
        self.dense_at[often] = np.arange(len(often))
        frequent = self.dense_at[term] >= 0 if len(term) else np.zeros(0, bool)
        self.dense = np.zeros((len(often), self.blocks * BLOCK), dtype=np.float32)
        self.dense[self.dense_at[term[frequent]], example[frequent]] = weight[frequent]
        example, term, weight = example[~frequent], term[~frequent], weight[~frequent]
        order = np.lexsort((example, term))
        term, block = term[order], example[order] // BLOCK
        self.inside, self.weight = example[order] % BLOCK, weight[order].astype(np.float32)
        # a run is one term's postings in one block
        self.run_at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.run_len = np.diff(np.append(self.run_at, len(term)))
        self.run_block = block[self.run_at]
        self.run_max = np.maximum.reduceat(self.weight, self.run_at) if len(term) else np.zeros(0, np.float32)
        self.first_run = np.searchsorted(term[self.run_at], np.arange(n_terms + 1))

    def search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and example numbers of the k nearest of each of n queries, best first; -1 where fewer have a positive cosine."""
        best, names = np.zeros((n, k), dtype=np.float32), np.full((n, k), -1, dtype=np.int64)
        if not self.n or not n:
            return best, names
        frequent = self.dense_at[term] >= 0
        queries = np.zeros((n, len(self.dense)), dtype=np.float32)
        queries[row[frequent], self.dense_at[term[frequent]]] = weight[frequent]
        base = (queries @ self.dense).reshape(n * self.blocks, BLOCK)
        row, term, weight = row[~frequent], term[~frequent], weight[~frequent]
        count = self.first_run[term + 1] - self.first_run[term]
        run, weight = ranges(self.first_run[term], count), np.repeat(weight, count)
        cell = np.repeat(row, count) * self.blocks + self.run_block[run]  # one for each query and block
        bound = base.max(axis=1) + np.bincount(cell, weight * self.run_max[run], minlength=len(base))
        bound = np.where(bound > 0, bound + 1e-5, 0).reshape(n, self.blocks)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        scores = np.zeros(base.shape, dtype=np.float32)
        live, at, step = np.arange(n), 0, 0
        while at < self.blocks and len(live):
            to = min(self.blocks, at + ROUNDS[min(step, len(ROUNDS) - 1)])
            near = bound[live, at:to]
            i, j = np.nonzero((near > 0) & (near >= best[live, -1:]))
            open_ = live[i] * self.blocks + order[live[i], at + j]
            slot = np.full(len(base), -1)
            slot[open_] = np.arange(len(open_))
            hit = np.flatnonzero(slot[cell] >= 0)
            size = self.run_len[run[hit]]
            post = ranges(self.run_at[run[hit]], size)
            add = np.bincount(np.repeat(slot[cell[hit]], size) * BLOCK + self.inside[post], np.repeat(weight[hit], size) * self.weight[post], minlength=len(open_) * BLOCK)
            got = np.round(base[open_] + add.reshape(-1, BLOCK), 6).astype(np.float32)
            scores[open_] = got
            new = np.zeros((len(live), to - at, BLOCK), dtype=np.float32)
            new[i, j] = got
            both = np.concatenate([best[live], new.reshape(len(live), -1)], axis=1)
            best[live] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
            at, step = to, step + 1
            if at < self.blocks:
                live = live[(bound[live, at] > 0) & (bound[live, at] >= best[live, -1])]
        i, j = np.nonzero(scores.reshape(n, -1) >= np.maximum(best[:, -1:], 1e-7))
        i, j = (x[np.lexsort((j, -scores.reshape(n, -1)[i, j], i))] for x in (i, j))
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        names[i[rank < k], rank[rank < k]] = j[rank < k]
        return best, names


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a never falling share of label over raw (pool adjacent violators)."""
    if not len(raw):
        return np.array([0.0, 1.0]), np.zeros(2)
    values, inverse = np.unique(raw, return_inverse=True)
    w = np.bincount(inverse, weight)
    s = np.bincount(inverse, weight * label)
    pools: list[list[float]] = []
    for v, a, b in zip(values, s, w):
        pools.append([a, b, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a2, b2, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, pools[-1][2], hi]
    x = np.array([p[i] for p in pools for i in (2, 3)])
    y = np.array([p[0] / p[1] for p in pools for _ in (2, 3)])
    return x, y


class Examples:
    """The learned examples; their number and their terms are bounded by the sample's rows and bytes."""

    def __init__(self, terms: Terms, ids: np.ndarray, label: np.ndarray, stands_for: np.ndarray, base: float, postings: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.terms, self.ids, self.label, self.stands_for, self.base, self.postings = terms, ids, label, stands_for, base, postings
        self.steps = isotonic(np.zeros(0), np.zeros(0), np.zeros(0))
        self._index: BlockMaxIndex | None = None

    @property
    def index(self) -> BlockMaxIndex:
        """Built once in each Python worker, so that the dense lists aren't sent; it takes the postings' place."""
        if self._index is None:
            self._index = BlockMaxIndex(*self.postings, len(self.ids), len(self.terms.hashes))
            self.postings = None
            free_unused()
        return self._index

    def votes(self, cosine: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Share of toxic votes, weighted by squared cosine and by what each example stands for, with the base rate as a weak vote."""
        if not len(self.label):
            return np.full(len(cosine), self.base)
        w = np.where(near >= 0, cosine.astype(np.float64) ** 2 * self.stands_for[near], 0)
        return (np.sum(w * self.label[near], axis=1) + PRIOR_WEIGHT * self.base) / (w.sum(axis=1) + PRIOR_WEIGHT)

    def without_self(self, texts: list[str | None], own: np.ndarray) -> np.ndarray:
        """Votes about examples, each left out of its own."""
        cosine, near = self.index.search(*self.terms.vectors(texts), len(texts), NEIGHBOURS + 1)
        return self.votes(np.where(near == own[:, None], 0, cosine), near)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and the nearest examples' ids (-1: none) and cosines."""
        cosine, near = self.index.search(*self.terms.vectors(texts), len(texts), NEIGHBOURS)
        raw = self.votes(cosine, near)
        score = 0.98 * np.interp(raw, *self.steps) + 0.02 * raw  # the second part keeps the order inside a step
        ids = np.where(near >= 0, self.ids[near], -1) if len(self.ids) else near
        return np.clip(score, 0, 1), ids, cosine


def relevance(positive: np.ndarray, negative: np.ndarray, base: float) -> np.ndarray:
    """RELEVANCE where a term's texts are toxic no oftener than others, and more with the share of toxic ones; few texts prove little."""
    share = (positive + DOUBT * base) / (positive + negative + DOUBT)
    return RELEVANCE + np.maximum(0, (share - base) / max(1 - base, 1e-9)) ** 2


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Examples:
    """Examples from docs (key, text) and labels (key, label 0 or 1); null texts, keys and labels teach nothing.

    Examples are a hash sample of about `sample` labelled keys per class, a table of bounded size that is sent to the
    texts, so no text is shuffled; where their texts exceed `sample_bytes`, a smaller share is taken. Class sizes come from
    all labels and document frequencies from all of docs. Equal texts under one label are one example; a key
    under both labels teaches both. Without labels every score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    marks = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sizes = dict(marks.groupBy("label").count().collect())
    total, positive = sum(sizes.values()), sizes.get(1, 0)
    none = np.zeros(0, np.int64)
    if not total:
        return Examples(Terms(none.view(np.uint64), np.zeros(0), 0.0), none, none, np.zeros(0), 0.0, (none, none, np.zeros(0)))
    share = F.when(F.col("label") == 1, min(1.0, sample / max(positive, 1))).otherwise(min(1.0, sample / max(total - positive, 1)))
    drawn = lambda salt: F.shiftrightunsigned(F.xxhash64("id", F.lit(salt)), 33) / float(1 << 31)
    few = marks.where(drawn(10) < share)
    part = cut(rows.join(F.broadcast(few), "id").groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("id").alias("id"), F.min("text").alias("text")).select("id", "label", "text"))
    held = part.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > sample_bytes:
        part = part.where(drawn(11) < sample_bytes / held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                row, h, times = term_counts(some.column(2).to_pylist())
                ends = np.searchsorted(row, np.arange(some.num_rows + 1))
                each = [(h[a:b].tobytes(), times[a:b].astype(np.int32).tobytes()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(list(x), pa.binary()) for x in zip(*each)]], names=["id", "label", "terms", "times"])

    found = sorted(part.mapInArrow(freeing(gather), "id long, label int, terms binary, times binary").collect(), key=lambda r: (r["id"], r["label"]))
    ids, y = np.array([r["id"] for r in found], dtype=np.int64), np.array([r["label"] for r in found], dtype=np.int64)
    h = np.frombuffer(b"".join(r["terms"] for r in found), np.uint64)
    times = np.frombuffer(b"".join(r["times"] for r in found), np.int32)
    row = np.repeat(np.arange(len(found)), [len(r["terms"]) // 8 for r in found])
    del found
    row = row.astype(np.int32)
    hashes, term = np.unique(h, return_inverse=True)
    del h

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        seen = np.zeros(len(hashes) + 1, dtype=np.int64)  # the last place counts the texts
        for batch in batches:
            texts = batch.column(0).to_pylist()
            seen[-1] += len(texts)
            for i in range(0, len(texts), BATCH):
                at, real = places(term_counts(texts[i : i + BATCH])[1], hashes)
                seen[:-1] += np.bincount(at[real], minlength=len(hashes))
        return seen

    df = summed_array(rows.select("text"), frequencies, len(hashes) + 1)
    # the sample may hold the classes in other shares than the labels: an example stands for so many labelled texts
    up, down = positive / max(int(y.sum()), 1), (total - positive) / max(int((1 - y).sum()), 1)
    base = positive / total
    evidence = relevance(np.bincount(term, y[row] * up, minlength=len(hashes)), np.bincount(term, (1 - y[row]) * down, minlength=len(hashes)), base)
    weight = np.log((1 + df[-1]) / (1 + df[:-1])) * evidence
    terms = Terms(hashes, weight, float(np.log((1 + df[-1]) / 2) * RELEVANCE))

    w = (1 + np.log(times)) * weight[term]
    w = w / np.maximum(np.sqrt(np.bincount(row, w * w, minlength=len(ids))), 1e-12)[row]
    # blocks of examples that share their heaviest term
    heavy = np.lexsort((-w, row))
    first = heavy[np.append(True, row[heavy][1:] != row[heavy][:-1])] if len(row) else heavy
    lead = np.full(len(ids), -1)
    lead[row[first]] = term[first]
    order = np.lexsort((y, ids, lead))
    spot = np.empty(len(order), dtype=np.int64)
    spot[order] = np.arange(len(order))
    model = Examples(terms, ids[order], y[order], np.where(y[order] == 1, up, down) / max(up, 1e-12), base, (spot[row].astype(np.int32), term.astype(np.int32), w.astype(np.float32)))

    shared, places_of = spark.sparkContext.broadcast(model), {(i, l): p for p, (i, l) in enumerate(zip(model.ids.tolist(), model.label.tolist()))}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                own = np.array([places_of[x] for x in zip(some.column(0).to_pylist(), some.column(1).to_pylist())], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(shared.value.without_self(some.column(2).to_pylist(), own))], names=["place", "raw"])

    asked = sorted(tuple(r) for r in part.mapInArrow(freeing(ask), "place long, raw double").collect())
    shared.unpersist()
    at, raw = np.array([a[0] for a in asked], dtype=np.int64), np.array([a[1] for a in asked])
    model.steps = isotonic(raw, model.label[at].astype(np.float64), model.stands_for[at])
    return model


def score_toxicity(docs: DataFrame, model: Examples, text: str = "text", threshold: float = THRESHOLD, evidence: int = 3) -> DataFrame:
    """docs without its text, with score, predicted and evidence: ids and cosines of the nearest examples.

    Whole texts count, however long. A null or empty text, or one without a letter, has no neighbour and gets the calibrated
    base rate. Equal texts get equal scores, repeated rows give repeated rows, and an empty table gives an empty one.
    Columns named like the outputs, in any case of letters, are replaced.
    """
    small_batches(docs.sparkSession)
    new = {"score": "double", "predicted": "int", "evidence": "array<struct<doc_id:bigint,cosine:float>>"}
    keep = [c for c in kept(docs, new) if c.lower() != text.lower()]
    (held,) = fresh(docs, "_text")
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(held))
    schema = slim.drop(held).select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                score, ids, cosine = shared.value.score(part.column(part.num_columns - 1).to_pylist())
                seen = [[{"doc_id": int(d), "cosine": float(c)} for d, c in zip(a[:evidence], b) if d != -1] for a, b in zip(ids, cosine)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(seen, shape)], names=[*keep, *new])

    return slim.mapInArrow(freeing(predict), schema)
