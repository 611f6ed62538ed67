"""Shards of near-equal bytes by histogram sort: exact bytes below candidate borders, refined until each border fits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, partitions

#: Candidate borders inside each open interval and round, at least.
PROBES = 1024
#: A shard's border is settled when the bytes below it differ from its share by no more than this part of a shard, a border inside a shard by this part of a cell.
TOLERANCE, LOOSE = 0.0005, 0.1


@dataclass
class Border:
    """The target bytes below a border and the key interval that still holds it; `settled` is a key prefix once found."""

    want: int
    slack: int
    below: int = 0
    fixed: tuple[int, ...] = ()
    lo: int = -(1 << 63)
    hi: int = (1 << 63) - 1
    settled: tuple[int, ...] | None = None


def lexical(keys: np.ndarray) -> np.ndarray:
    """Rows of signed 64-bit numbers as byte strings that sort like the rows."""
    raw = np.ascontiguousarray((keys.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8"))
    return raw.view(f"S{8 * keys.shape[1]}").ravel()


def _columns(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy() for i in range(n)]).astype(np.int64, copy=False)


@dataclass
class Spans:
    """Open intervals of keys in order, none within another, each cut into `each` cells of `step` values of the column that it lies on."""

    starts: np.ndarray
    depth: np.ndarray
    fixed: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    step: np.ndarray
    each: int

    @classmethod
    def of(cls, spans: list[tuple[tuple[int, ...], int, int]], parts: int, each: int) -> Spans:
        low = -(1 << 63)
        full = np.array([(*f, lo, *[low] * (parts - len(f) - 1)) for f, lo, _ in spans], np.int64)
        fixed = np.array([(*f, *[low] * (parts - len(f))) for f, _, _ in spans], np.int64)
        step = np.array([max(1, -(-(hi - lo + 1) // each)) for _, lo, hi in spans], np.uint64)
        return cls(lexical(full), np.array([len(f) for f, _, _ in spans]), fixed, *(np.array([s[i] for s in spans], np.int64) for i in (1, 2)), step, each)

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, value of the column that the span lies on) of each row that an open interval holds."""
        at = np.searchsorted(self.starts, lexical(keys), side="right") - 1
        row = np.flatnonzero(at >= 0)
        at = at[row]
        depth = self.depth[at]
        value = keys[row, depth]
        held = (self.lo[at] <= value) & (value <= self.hi[at])
        for d in range(keys.shape[1]):
            held &= (d >= depth) | (keys[row, d] == self.fixed[at, d])
        row, at, value = row[held], at[held], value[held]
        return row, at * self.each + ((value.view(np.uint64) - self.lo[at].view(np.uint64)) // self.step[at]).astype(np.int64), value


def _counted(rows: DataFrame, parts: list[str], size: str, spans: Spans) -> dict[int, list[np.ndarray]]:
    """Of each span that holds rows: bytes, least and greatest value of its cells that do, in order. A task sums its rows before any are shuffled;
    the driver gets a row for each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(spans.starts) * spans.each
        held, least, most = np.zeros(n, np.int64), np.full(n, (1 << 63) - 1), np.full(n, -(1 << 63))
        for batch in batches:
            row, cell, value = spans.cells(_columns(batch, len(parts)))
            np.add.at(held, cell, batch.column(len(parts)).to_numpy()[row])
            np.minimum.at(least, cell, value)
            np.maximum.at(most, cell, value)
        seen = np.flatnonzero(least <= most)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, held[seen], least[seen], most[seen])], names=["cell", "held", "least", "most"])

    tasks = rows.select(*parts, size).mapInArrow(count, "cell long, held long, least long, most long")
    got = tasks.groupBy("cell").agg(F.sum("held").alias("held"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    table = np.column_stack([got.column(i).to_numpy() for i in range(4)]).reshape(-1, 4)
    table = table[np.argsort(table[:, 0])]
    span = table[:, 0] // spans.each
    edge = np.flatnonzero(np.diff(span, prepend=-1))
    return {int(span[a]): [table[a:b, k] for k in (1, 2, 3)] for a, b in zip(edge, [*edge[1:], len(table)])}


def find_borders(rows: DataFrame, parts: list[str], size: str, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES, cells: int = 1) -> list[list[tuple[int, ...]]]:
    """Keys that part the rows, ordered by the long columns `parts`, into `shards` of near-equal sums of `size`, and each shard
    into `cells` of about equal ones: a list for each shard of where its cells begin, of which the first is the shard's own border.

    Each round counts exact bytes in the cells between candidate borders of every open interval, over all partitions at
    once; only those cells reach the driver, a few for each border. A row finds its interval by binary search, so thousands of borders cost little
    more than one. A cell narrows to the least and greatest key that it really holds. Where
    equal keys outweigh the tolerance, the search goes on inside them by the next column; rows equal in every
    column can't be parted and stay together.
    """
    total, probes = rows.agg(F.sum(size)).first()[0] or 0, max(probes, 16 * shards * cells)
    slack = {True: max(1, int(tolerance * total / shards)), False: max(1, int(LOOSE * total / (shards * cells)))}
    borders = [Border(want=total * i // (shards * cells), slack=slack[i % cells == 0]) for i in range(1, shards * cells)]
    while open_ := [b for b in borders if b.settled is None]:
        named = sorted({(*b.fixed, b.lo): (b.fixed, b.lo, b.hi) for b in open_}.values(), key=lambda s: (*s[0], s[1], *[-(1 << 63)] * (len(parts) - len(s[0]) - 1)))
        place = {s: i for i, s in enumerate(named)}
        seen = _counted(rows, parts, size, Spans.of(named, len(parts), max(4, probes // len(named))))
        sums = {i: np.cumsum(x[0]) for i, x in seen.items()}
        for b in open_:
            i, depth = place[b.fixed, b.lo, b.hi], len(b.fixed)
            k = int(np.searchsorted(sums[i], b.want - b.below)) if i in seen else 0
            if i not in seen or k == len(sums[i]):
                b.settled = (*b.fixed, b.hi)
                continue
            held, least, most = (int(x[k]) for x in seen[i])
            below = b.below + int(sums[i][k]) - held
            if b.want - below <= b.slack:
                b.settled = (*b.fixed, least)
            elif below + held - b.want <= b.slack and most < (1 << 63) - 1:
                b.settled = (*b.fixed, most + 1)
            elif least < most:
                b.below, b.lo, b.hi = below, least, most
            elif depth + 1 < len(parts):
                b.below, b.fixed, b.lo, b.hi = below, (*b.fixed, least), -(1 << 63), (1 << 63) - 1
            else:  # equal in every column: the nearer side
                near = b.want - below <= below + held - b.want or most == (1 << 63) - 1
                b.settled = (*b.fixed, least) if near else (*b.fixed, most + 1)
    # the columns that a border doesn't name begin with their least value
    whole = sorted((*b.settled, *[-(1 << 63)] * (len(parts) - len(b.settled))) for b in borders)
    whole = [(-(1 << 63),) * len(parts), *whole]
    return [whole[i : i + cells] for i in range(0, len(whole), cells)]


def with_place(rows: DataFrame, parts: list[str], borders: list[tuple[int, ...]], out: str) -> DataFrame:
    """rows with `out`: how many of the sorted borders aren't above the row's key."""
    sorted_ = lexical(np.array(borders, np.int64).reshape(len(borders), len(parts)))
    others = [c for c in rows.columns if c not in parts]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.searchsorted(sorted_, lexical(_columns(batch, len(parts))), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], names=[*batch.schema.names, out])

    slim = rows.select(*parts, *others)
    return slim.mapInArrow(place, ", ".join(f"`{c}` {t}" for c, t in [*slim.dtypes, (out, "int")]))


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard, under the law that the shards' bytes are near equal, and its slot inside the shard.

    Rows are ordered by the text's hash, then by key and a hash of the row, so equal texts stand together and a group of copies
    heavier than a shard is parted by its keys. Splitters of the shards, and looser ones inside them, say which task
    gets a row, so rows are exchanged once and a slot is the row's place in its task after the rows of the tasks before.
    size is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of an empty one. A null key sorts
    first. Rows equal in every column stay together and get slots in any order. A text longer than a shard makes its shard
    longer. Empty tables give empty results. Other columns of docs only break ties. grown_shard is null: this law makes
    no promise about one more shard. The key is an integer, or a text of one; any other text is an error under ANSI rules.
    """
    doc, words = F.col(f"`{key}`"), F.col(f"`{text}`")
    order = ["_text", "_id", "_row"]
    slim = cut(docs.select(
        doc.alias("doc_id"),
        (F.coalesce(F.octet_length(words), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(words, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(words).alias("_text"),
        F.coalesce(doc.cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not docs.schema[c].dataType.typeName() in ("map", "variant")]).alias("_row"),
    ))
    cells = -(-partitions(docs.sparkSession) // shards)
    borders = find_borders(slim, order, "size", shards, cells=cells)
    placed = with_place(slim, order, [k for b in borders for k in b], "_task").withColumn("_task", F.col("_task") - 1)
    placed = placed.withColumn("shard", F.floor(F.col("_task") / cells).cast("int"))
    counts = placed.groupBy("shard", F.col("_task").alias("_t")).agg(F.count("*").alias("_n"))  # a row for each task
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = placed.repartitionById(shards * cells, "_task").withColumn("_at", F.row_number().over(Window.partitionBy("_task").orderBy(*order)) - 1)
    out = dealt.join(F.broadcast(counts.select("_t", before.alias("_before"))), F.col("_task") == F.col("_t"), "left")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
