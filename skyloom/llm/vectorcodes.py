"""Product codes of vectors: integer k-means per part, with memoised grid cells in place of whole distance tables.

A vector's components become integers, floor(scale * x), and the vector is cut into equal consecutive parts. Each part lies in a coarse grid
cell. An entry of the codebook that is farther from the whole cell than another entry is anywhere in it is dominated there, so it is never the
nearest of a part in that cell. The entries that are not dominated are cached under the cell's hash, and only those are evaluated, exactly.

Defined cases: a row whose vector is null or holds null, NaN or an infinity goes; so does a vector whose length isn't that of the kept vector
of least id (a positive multiple of the number of parts), as it can't be cut alike. Equal ids are ordered by their components; a null id comes
last. Repeated rows count each time. Fewer vectors than entries make a codebook of as many entries; no vector gives no rows. Integers are
clipped to bounds, far beyond any embedding, within which every distance fits into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .scratch import small_batches
from .spans import mix

#: Bytes of cached cells for one part position of a task; a full cache starts anew.
CACHE_BYTES = 4 << 20
#: Shares of a label's rows that meet its sum apart.
SALTS = 64


@dataclass
class Codebooks:
    """entries: parts x entries x components, whole numbers; scale: what components were multiplied by."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for, each component in the middle of its step."""
        picked = [self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]
        return ((np.concatenate(picked) + 0.5) / self.scale).tolist() if picked else []


def usable(vector: Column) -> Column:
    """Whether a vector holds finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(flat: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, clipped so that a part of `width` components has distances below 2^62."""
    most = isqrt((1 << 62) // width) // 2
    return np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64)


class Cells:
    """The entries of one part's codebook that may be nearest, by grid cell."""

    def __init__(self, entries: np.ndarray):
        self.entries, (_, self.width) = entries, entries.shape
        self.side = max(1, int(np.ptp(entries, axis=0).max()) // 4)
        self.most = max(1024, CACHE_BYTES // (8 * self.width + len(entries)))
        self.salt = mix(np.arange(1, self.width + 1, dtype=np.uint64))
        self.evaluated = 0
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.cells, self.may = np.zeros((0, self.width), np.int64), np.zeros((0, len(self.entries)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: entries whose least distance to the cell's box doesn't exceed the least of all greatest distances."""
        low = (cells * self.side)[:, None, :]
        high, e = low + self.side - 1, self.entries[None]
        near = np.maximum(np.maximum(low - e, e - high), 0)
        far = np.maximum(np.abs(e - low), np.abs(e - high))
        return (near**2).sum(axis=2) <= (far**2).sum(axis=2).min(axis=1, keepdims=True)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Parts x entries: what has to be evaluated for each part."""
        cells = x // self.side
        hashed = mix((mix(cells.astype(np.uint64)) * self.salt).sum(axis=1, dtype=np.uint64))
        names, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        names = names.tolist()
        new = [i for i, h in enumerate(names) if h not in self.at]
        if len(self.at) + len(new) > self.most:
            self._clear()
            new = list(range(len(names)))
        if new:
            added = cells[first[new]]
            self.at.update((names[i], len(self.cells) + k) for k, i in enumerate(new))
            self.cells, self.may = np.concatenate((self.cells, added)), np.concatenate((self.may, self.undominated(added)))
        where = np.array([self.at[h] for h in names], np.int64)[back]
        may = self.may[where]
        may[(self.cells[where] != cells).any(axis=1)] = True  # another cell of the same hash
        return may

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, the lower on ties; squared distance) of each part."""
        rows, tried = np.nonzero(self.candidates(x))
        self.evaluated += len(rows)
        away = ((x[rows] - self.entries[tried]) ** 2).sum(axis=1)
        start = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(away, start)
        hit = np.flatnonzero(away == least[rows])
        return tried[hit[np.diff(rows[hit], prepend=-1) > 0]], least


def _matrix(column: pa.Array, parts: int, scale: int) -> np.ndarray:
    """rows x parts x components of a list column without nulls and of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // (len(column) * parts)
    return integers(flat, scale, width).reshape(len(column), parts, width)


def _kept(df: DataFrame, vector: str, parts: int, key: str) -> tuple[DataFrame, int]:
    """The rows whose vectors can be coded, and the length of these vectors (0: none)."""
    v = F.col(f"`{vector}`")
    rows = df.where(usable(v) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    first = rows.select(F.col(f"`{key}`").alias("key"), v.alias("v")).orderBy(F.asc_nulls_last("key"), "v").limit(1).collect()
    size = len(first[0]["v"]) if first else 0
    return rows.where(F.size(v) == size), size


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of `parts` x `entries` (256 at most): they start as the parts of the vectors of least id; each round assigns all parts and takes
    floor(sum / count) of each component. Reads df once a round: rows stay where they are, and only sums of entries are shuffled."""
    rows, size = _kept(df, vector, parts, key)
    if not size:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    small_batches(df.sparkSession)
    v = F.col(f"`{vector}`").cast("array<double>")
    first = rows.select(F.col(f"`{key}`").alias("key"), v.alias("v")).orderBy(F.asc_nulls_last("key"), "v").limit(entries).collect()
    books = np.stack([integers(np.array(r["v"]), scale, size // parts).reshape(parts, -1) for r in first]).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(rows.select(v.alias("v")), books, scale)
    return Codebooks(books, scale)


def _moved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    parts, entries, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), parts, scale)
                for p in range(parts):
                    index, _ = cells[p].nearest(x[:, p])
                    counts[p] += np.bincount(index, minlength=entries)
                    np.add.at(sums[p], index, x[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    each = vectors.mapInArrow(assign, "part int, entry int, n long, total array<long>").select("part", "entry", "n", F.posexplode("total").alias("pos", "total"))
    out = books.copy()
    for r in each.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each component of the codebooks
        out[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return out


def encode(df: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, the carried columns, code, error) of each vector that can be coded: two hex digits for the entry of each part, and the squared
    distances in steps of 1 / scale, summed over the parts. Names of carried columns must differ from code and error."""
    parts, entries, width = books.entries.shape
    all_entries, scale = books.entries, books.scale
    rows = df.where(usable(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") == parts * width) & F.lit(entries > 0))
    rows = rows.select(*[F.col(f"`{c}`") for c in (key, *carry)], F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    small_batches(df.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, digits = [Cells(b) for b in all_entries], np.frombuffer(b"0123456789abcdef", np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1), parts, scale)
            out, error = np.zeros((len(x), parts, 2), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                index, away = cells[p].nearest(x[:, p])
                out[:, p, 0], out[:, p, 1] = digits[index >> 4], digits[index & 15]
                error += away
            text = out.tobytes().decode()
            codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes, pa.array(error)], names=[*batch.schema.names[:-1], "code", "error"])

    return rows.mapInArrow(code, rows.drop("_v").schema.add("code", "string").add("error", "long"))


def sums_of_groups(df: DataFrame, group: str, value: str, key: str, out: str) -> DataFrame:
    """df, which must be stored, with the sum of `value` over equal groups (nulls together; null where it exceeds a long).

    A group of any size is summed before it is shuffled, and its rows meet the sum in SALTS shares.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    shares = salted.groupBy(F.col(group).alias("_g"), F.col("_salt").alias("_s")).agg(F.try_sum(value).alias("_part"))
    whole = shares.groupBy(F.col("_g").alias("_h")).agg(F.try_sum("_part").alias(out))
    each = shares.join(whole, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_s", out)
    return salted.join(each, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_s"))).select(*df.columns, out)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", **how: int) -> DataFrame:
    """(key, group, code, error, group_error, codebooks_sha256): codes of all vectors by codebooks learned from all of them."""
    books = train(df, key, vector, **how)
    coded = stored(encode(df, books, key, vector, (group,)))
    return sums_of_groups(coded, group, "error", key, "group_error").withColumn("codebooks_sha256", F.lit(books.sha256()))
