"""Repair of damaged conversations: the cheapest edits that make roles read (system)? (user assistant)+, found by a Viterbi pass in chunks.

A row is kept (0), given the role that fits (2) or deleted (3; blank and repeated rows must be); an empty row may be inserted anywhere (2); a
truncated row that isn't deleted adds 1. The state is the last role written. Costs run backward: the vector of costs to the end, a state each,
before a row follows from the one after it. Conversations are cut into fragments of CHUNK rows at most. Every fragment starts from the vector
at the end of a conversation, as a guess; then fix-up passes compare what a fragment has taken with what the next one gives, and rerun it where
the two differ by more than a constant, back to the row where old and new vectors again do no more than that. Differences alone decide edits,
so each fragment traces its least edits (D < I < K < R) from every state that it may be entered in, and one pass in order strings them together.

Rows are ordered by conversation, turn (nulls first), role and text, so repeated rows are neighbours. A null text or role is one space, which
makes a row blank, or of a role that must change. Null conversation ids form one conversation. The digest of a repaired conversation and its list
of edits are single values, so a conversation's rows pass one task in order at the end, as a stream: texts of one batch are in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .scratch import partitions, small_batches

#: Rows of a fragment: a power of two.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing written, system, user, assistant. What comes next after each: user, but assistant after user.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Costs at the end: nothing written and assistant are accepted.
END = (0, 2 * INSERT, INSERT, 0)
#: A row's code: its role's class (0 other, 1 s, 2 u, 3 a), bits for blank, truncated and repeated.
BLANK, CUT, REPEATED = 4, 8, 16
SPACE = r"[\x20\x09-\x0D]"


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first."""
    a, b = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return min(v[0], a + INSERT), min(v[1], a + INSERT), a, b


def _step(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row, from the one after it."""
    deleted = [DELETE + c for c in after]
    if code & (BLANK | REPEATED):
        return _closed(deleted)
    extra, role = TRUNCATED if code & CUT else 0, code & 3
    best = []
    for s in range(4):
        cost = min(deleted[s], REROLE + extra + after[NEXT[s]])
        if role == NEXT[s]:
            cost = min(cost, extra + after[role])
        elif role == 1 and s == 0:
            cost = min(cost, extra + after[1])
        best.append(cost)
    return _closed(best)


def _shift(a: tuple[int, ...], b: tuple[int, ...]) -> int | None:
    """What b is above a, if that is the same in all states."""
    d = b[0] - a[0]
    return d if all(y - x == d for x, y in zip(a, b)) else None


def backward(codes: bytes, end: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a fragment from the one after it."""
    for code in reversed(codes):
        end = _step(code, end)
    return end


def rerun(codes: bytes, guess: tuple[int, ...], end: tuple[int, ...], start: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a fragment that gave `start` from `guess`, now from `end`; stops where both runs differ by a constant."""
    for i in range(len(codes) - 1, -1, -1):
        d = _shift(guess, end)
        if d is not None:
            return tuple(c + d for c in start)
        guess, end = _step(codes[i], guess), _step(codes[i], end)
    return end


def traces(codes: bytes, end: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """The least cheapest edits of a fragment and the state it is left in, for each state that it is entered in. Paths that meet are walked once."""
    vectors = [end]
    for code in reversed(codes):
        vectors.append(_step(code, vectors[-1]))
    vectors.reverse()
    met: list[dict[int, tuple[int, int]]] = [{} for _ in codes]  # at a row and state: which earlier path, and how many edits it had made
    edits, left = [], []
    for s in range(4):
        mine, i = [], 0
        while i < len(codes):
            if s in met[i]:
                path, made = met[i][s]
                mine.append(edits[path][made:])
                s = left[path]
                break
            met[i][s] = (len(edits), len(mine))
            now, after, code = vectors[i][s], vectors[i + 1], codes[i]
            if DELETE + after[s] == now:
                mine.append("D")
                i += 1
                continue
            if INSERT + vectors[i][NEXT[s]] == now:
                mine.append("I")
                s = NEXT[s]
                continue
            role, extra = code & 3, TRUNCATED if code & CUT else 0
            to = 1 if role == 1 and s == 0 else role if role == NEXT[s] else 0
            if to and extra + after[to] == now:
                mine.append("K")
                s = to
            else:
                mine.append("R")
                s = NEXT[s]
            i += 1
        edits.append("".join(mine))
        left.append(s)
    return edits, left


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy): what the contract makes of each row by crc32 of conv:turn, nulls being one space."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    own = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), (F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    own = own.where(k != 0).withColumns({"text": F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(k == 4, "user").otherwise(F.col("role"))})
    return own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(k == 3, 1).otherwise(0)))).drop("_k")


def codes_of(role: Column, text: Column) -> Column:
    """The code of a row by itself."""
    first, bare = F.substring(role, 1, 1), F.regexp_replace(text, SPACE, "")
    kind = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    return kind + fault


def _fragments(placed: DataFrame) -> DataFrame:
    """(conv, chunk, at, codes) of each fragment, codes a byte a row, repeated rows marked. The first row of each role and text is a mark that
    meets the rows of its fragment, so a text that stands in a third of the rows is reduced before it is shuffled."""
    firsts = placed.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("first"), F.lit(0).alias("code"))
    both = placed.select("conv", "at", F.lit(False).alias("first"), "code").unionByName(firsts)
    each = both.groupBy("conv", F.shiftright("at", CHUNK.bit_length() - 1).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "first", "code"))).alias("x"))  # 2 CHUNK at most
    firsts = F.transform(F.filter("x", lambda r: r["first"]), lambda r: r["at"])
    return each.select("conv", "chunk", F.filter("x", lambda r: ~r["first"]).alias("x"), firsts.alias("firsts")).select(
        "conv", "chunk", F.col("x")[0]["at"].alias("at"), F.transform("x", lambda r: r["code"].cast("int")).alias("own"), F.transform("x", lambda r: r["at"]).alias("ats"), "firsts")


FRAGMENT = "conv {0}, chunk long, at long, codes binary, taken array<long>, start array<long>"


def _guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, starts = [], []
        for own, ats, firsts in zip(*(batch.column(n).to_pylist() for n in ("own", "ats", "firsts"))):
            firsts = set(firsts)
            codes.append(bytes(c if a in firsts or c & BLANK else (c & 3) | REPEATED for c, a in zip(own, ats)))
            starts.append(list(backward(codes[-1], END)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("conv", "chunk", "at")), pa.array(codes, pa.binary()), pa.array([list(END)] * len(codes), pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))],
            names=["conv", "chunk", "at", "codes", "taken", "start"])


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments whose next one gives something else (`given`) are rerun."""
    for batch in batches:
        rows, taken, starts = batch.to_pydict(), [], []
        for codes, old, start, given in zip(rows["codes"], rows["taken"], rows["start"], rows["given"]):
            if given is not None and _shift(tuple(old), tuple(given)) is None:
                start, old = list(rerun(codes, tuple(old), tuple(given), tuple(start))), given
            taken.append(old)
            starts.append(start)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv", "chunk", "at", "codes")), pa.array(taken, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names=["conv", "chunk", "at", "codes", "taken", "start"])


def stitched(fragments: DataFrame) -> DataFrame:
    """Fragments with the vectors that they take and start with; right up to a constant in each fragment. A pass settles at least the last fragment
    that is wrong, and nearly always all: vectors forget what came after within a few rows."""
    after = Window.partitionBy("conv").orderBy("chunk")
    schema = fragments.schema
    while True:
        both = fragments.withColumn("given", F.lead("start").over(after))  # a row for each fragment
        gap = lambda i: F.col("given")[i] - F.col("taken")[i]
        if not both.where((gap(0) != gap(1)) | (gap(0) != gap(2)) | (gap(0) != gap(3))).limit(1).count():
            return fragments
        fragments = stored(both.mapInArrow(_fix, schema))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        found = [traces(c, tuple(t)) for c, t in zip(rows["codes"], rows["taken"])]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), batch.column("codes"), batch.column("taken"), batch.column("start"), pa.array([e for e, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["conv", "at", "codes", "taken", "start", "edits", "left"])


class _Repaired:
    """One conversation, fed in order."""

    def __init__(self, conv: object):
        self.conv, self.hash, self.lines, self.audit, self.state = conv, hashlib.sha256(), 0, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = self.initial = None
        self.start, self.taken, self.shift = None, END, 0

    def fragment(self, codes: bytes, taken: list[int], start: list[int], edits: list[str], left: list[int]) -> None:
        if self.start is None:
            self.start = start
        else:
            self.shift += start[0] - self.taken[0]  # what this fragment really costs above what the one before has taken
        self.taken, self.codes, self.i = taken, codes, 0
        self.audit.append(edits[self.state])
        self.edits, self.after = iter(edits[self.state]), left[self.state]

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def inserted(self) -> None:
        self.state = NEXT[self.state]
        self.line(NAMES[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        code = self.codes[self.i]
        self.i += 1
        self.blank += bool(code & BLANK)
        self.duplicate += bool(code & REPEATED)
        self.truncated += bool(code & CUT)
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for edit in self.edits:
            if edit == "I":
                self.inserted()
                continue
            if edit == "K":
                self.state = 1 if self.state == 0 and code & 3 == 1 else NEXT[self.state]
                self.line(role, text)
            elif edit == "R":
                self.state = NEXT[self.state]
                self.line(NAMES[self.state], text)
            break

    def done(self) -> tuple:
        if self.start is not None:
            while END[self.state]:
                self.inserted()
                self.audit.append("I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost = 0 if self.start is None else self.start[0] + self.shift
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


NAMES_OUT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Repaired | None = None

    def table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), *(pa.array(c, pa.string()) for c in cols[7:])], names=list(NAMES_OUT))

    kind = None
    for batch in batches:
        done, kind = [], batch.schema.field("conv").type
        cols = [batch.column(n).to_pylist() for n in ("conv", "kind", "turn", "role", "text", "codes", "taken", "start", "edits", "left")]
        for conv, what, turn, role, text, codes, taken, start, edits, left in zip(*cols):
            if what == 0:  # a conversation begins
                if now:
                    done.append(now.done())
                now = _Repaired(conv)
            elif what == 1:
                now.fragment(codes, taken, start, edits, left)
            else:
                now.row(turn, role, text)
        if done:
            yield table(done, kind)
    if now:
        yield table([now.done()], kind)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: bool = False) -> DataFrame:
    """A row for each conversation in `rows`: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows are taken as they are
    unless `damaged`, where damage() comes first. An empty table gives no rows, a conversation without rows after damage zeros, an empty audit and
    the digest of an empty string. Other columns are ignored. Turns must be whole numbers."""
    spark = rows.sparkSession
    small_batches(spark)
    n, kind = partitions(spark), dict(rows.dtypes)[conv]
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    own = damage(rows, conv, turn, role, text) if damaged else rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(0).alias("copy"))
    own = own.withColumn("turn", F.col("turn").cast("long")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "tie"]
    # one exchange in order; the table that is written fixes each row's place
    placed = stored(own.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "conv", "turn", "role", "text", codes_of(F.col("role"), F.col("text")).alias("code"), F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)).alias("digest"), F.monotonically_increasing_id().alias("at")))
    guessed = stored(_fragments(placed).mapInArrow(_guess, FRAGMENT.format(kind)))
    heads = stitched(guessed).mapInArrow(_traced, f"conv {kind}, at long, codes binary, taken array<long>, start array<long>, edits array<string>, left array<int>")
    each = rows.select(F.col(f"`{conv}`").alias("conv")).distinct().select("conv", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"))
    stream = (
        each.unionByName(heads.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(placed.select("conv", "at", F.lit(2).alias("kind"), "turn", "role", "text"), allowMissingColumns=True)
    )
    strung = stream.repartition(n, "conv").sortWithinPartitions("conv", "at", "kind")
    return strung.mapInArrow(_strung, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
