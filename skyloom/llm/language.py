"""Language identification: nearest of several clustered TF-IDF n-gram centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, kept, small_batches

DIM = 8192
#: Labelled texts per language from which centroids are clustered; document frequencies use every labelled text.
SAMPLE_PER_LANGUAGE = 2000
CENTROIDS_PER_LANGUAGE = 4
#: Share of a cluster's own texts that lie within its radius; farther texts are marked as rejected.
RADIUS_SHARE = 0.995
CHUNK_CHARS, CHUNK_DOCS = 1 << 19, 256


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Text numbers and texts in chunks of bounded size; a long text is cut at white space, else at the limit."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        begin = 0
        while begin < len(text):
            end = min(len(text), begin + CHUNK_CHARS)
            if end < len(text):
                end = max(text.rfind(" ", begin, end), text.rfind("\n", begin, end)) + 1 or end
            if held and (size + end - begin > CHUNK_CHARS or len(set(at)) >= CHUNK_DOCS):
                yield at, held
                at, held, size = [], [], 0
            at.append(i)
            held.append(text[begin:end])
            size += end - begin
            begin = end
    if held:
        yield at, held


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Hashed counts of letters, letter pairs and triples with word borders, a row of DIM for each text."""
    counts = np.zeros((len(texts), DIM), dtype=np.float32)
    for at, held in pieces(texts):
        lowered = [t.lower() for t in held]
        codes = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(held)), [len(t) + 1 for t in lowered])
        is_letter = letters()[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # one border after each run of letters
        codes = np.concatenate(([0], np.where(is_letter, codes, 0)[keep])).astype(np.uint64)
        owner = np.concatenate(([0], owner[keep]))
        real = codes != 0
        mid = np.flatnonzero(real[1:-1]) + 1
        pair = np.flatnonzero(real[:-1] & real[1:])
        one = np.flatnonzero(real)
        k = np.uint64(0x9E3779B97F4A7C15)
        keys = [
            ((codes[mid - 1] * k + codes[mid]) * k + codes[mid + 1]) * k,
            ((codes[pair] + np.uint64(1 << 40)) * k + codes[pair + 1]) * k,
            (codes[one] + np.uint64(1 << 42)) * k,
        ]
        rows = [owner[mid], owner[pair], owner[one]]
        slot = np.concatenate([(x ^ x >> np.uint64(29)) * k >> np.uint64(51) for x in keys]).astype(np.int64)
        flat = np.bincount(np.concatenate(rows) * DIM + slot, minlength=len(held) * DIM).reshape(len(held), DIM)
        for row, mine in zip(at, flat):  # parts of a long text add up
            counts[row] += mine
    return counts


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors with logarithmic term frequency."""
    return unit(np.log1p(counts) * idf)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and the radius of each."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    for _ in range(1, min(k, len(x))):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centers = unit(x[seeds])
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        centers = unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))]))
    similar = x @ centers.T
    near = similar.argmax(axis=1)
    radius = np.array([np.quantile(1 - similar[near == j, j], RADIUS_SHARE) if (near == j).any() else 0.0 for j in range(len(centers))])
    return centers.astype(np.float32), radius


class Centroids:
    """What a prediction needs; its size is languages x centroids x DIM, however many texts it was learned from."""

    def __init__(self, langs: list[str], centers: np.ndarray, radius: np.ndarray, idf: np.ndarray):
        self.langs, self.centers, self.radius, self.idf = langs, centers, radius, idf
        self.names = sorted(set(langs))
        self.column = np.array([self.names.index(x) for x in langs])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), np.ones(len(texts), bool)
        counts = gram_counts(texts)
        none = counts.sum(axis=1) == 0
        similar = vectors(counts, self.idf) @ self.centers.T
        best = similar.argmax(axis=1) if len(texts) else np.zeros(0, int)
        by_lang = np.stack([similar[:, self.column == j].max(axis=1) for j in range(len(self.names))], axis=1)
        order = np.sort(by_lang, axis=1)
        first = np.clip(order[:, -1], 0, 1)
        second = np.clip(order[:, -2], 0, 1) if len(self.names) > 1 else np.zeros(len(texts))
        score = np.where(none, 0.0, 0.5 + 0.5 * (first - second) / np.maximum(first, 1e-9))
        distance = np.where(none, 1.0, 1 - first)
        names = ["und" if n else self.langs[b] for n, b in zip(none, best)]
        return names, np.clip(score, 0, 1), distance, none | (distance > self.radius[best])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS_PER_LANGUAGE) -> Centroids:
    """Centroids from labelled texts; rows with a null text or language, or without a letter, teach nothing. Without any
    other row there are no centroids, and every text is `und`.

    Document frequencies come from all rows (a few thousand sums reach the driver); clusters from a hash sample of
    about `sample` distinct texts per language, so one language may hold any share of the rows.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), CHUNK_DOCS):
                counts = gram_counts(texts[i : i + CHUNK_DOCS])
                df += (counts > 0).sum(axis=0)
                n += int((counts.sum(axis=1) > 0).sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], n))], names=["slot", "n"])

    df = dict(rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect())
    n = df.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIM)]))).astype(np.float32) + np.float32(0.1)

    sizes = dict(rows.groupBy("lang").count().collect())  # one row for each language
    if not sizes:
        return Centroids([], np.zeros((0, DIM), np.float32), np.zeros(0), idf)
    share = F.create_map(*[x for name, c in sizes.items() for x in (F.lit(name), F.lit(min(1.0, sample / c)))])[F.col("lang")]
    part = rows.withColumn("h", F.xxhash64("text")).where((F.shiftrightunsigned("h", 33) / float(1 << 31)) < share).dropDuplicates(["lang", "h"]).select("lang", "text")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), CHUNK_DOCS):
                x = vectors(gram_counts(texts[i : i + CHUNK_DOCS]), idf)
                held = [j for j in range(len(x)) if x[j].any()]
                used = [np.flatnonzero(x[j]) for j in held]
                yield pa.RecordBatch.from_arrays([pa.array([names[i + j] for j in held], pa.string()), pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()), pa.array([x[j][u].tobytes() for j, u in zip(held, used)], pa.binary())], names=["lang", "slots", "weights"])

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slots", "weights"])  # the same order however the rows arrive
        x = np.zeros((len(group), DIM), dtype=np.float32)
        for row, (s, w) in enumerate(zip(group["slots"], group["weights"])):
            x[row, np.frombuffer(s, np.uint16)] = np.frombuffer(w, np.float32)
        centers, radius = cluster(x, k)
        return pd.DataFrame({"lang": key[0], "center": [c.tobytes() for c in centers], "radius": radius})

    found = part.mapInArrow(weights, "lang string, slots binary, weights binary").groupBy("lang").applyInPandas(centroids, "lang string, center binary, radius double").collect()
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["center"])))
    if not found:
        return Centroids([], np.zeros((0, DIM), np.float32), np.zeros(0), idf)
    return Centroids([r["lang"] for r in found], np.stack([np.frombuffer(r["center"], np.float32) for r in found]), np.array([r["radius"] for r in found]), idf)


def identify(docs: DataFrame, model: Centroids, text: str = "text", reject: bool = True) -> DataFrame:
    """docs without its text, with lang_pred, score (0 to 1), distance and rejected.

    A null text or one without a letter is `und` with score 0. With `reject`, a text outside its nearest centroid's
    radius is `und` too; otherwise it keeps the nearest language and is only marked. Whole texts count, however long; ties go to
    the first language by name. Equal texts get equal rows, repeated rows stay, an empty table gives an empty one. Columns of
    those names, in any case of letters, are replaced.
    """
    small_batches(docs.sparkSession)
    new = {"lang_pred": "string", "score": "double", "distance": "double", "rejected": "boolean"}
    keep = [c for c in kept(docs, new) if c.lower() != text.lower()]
    (held,) = fresh(docs, "_text")
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(held))
    schema = slim.drop(held).select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(i, CHUNK_DOCS)
                names, score, distance, far = model.predict(part.column(part.num_columns - 1).to_pylist())
                if reject:
                    names = ["und" if f else x for x, f in zip(names, far)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score.astype(np.float64)), pa.array(distance.astype(np.float64)), pa.array(far)], names=[*keep, *new])

    return slim.mapInArrow(predict, schema)
