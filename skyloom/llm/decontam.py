"""Benchmark decontamination: template windows with typed placeholders, hash join, slot consistency.

Texts become canonical tokens: numbers, names and units after numbers turn into placeholders, other words are
lower-cased. A capitalised word that opens a sentence may be a name or not, so a window that holds one is read both ways.
Windows of WINDOW tokens are hashed; one that is mostly placeholders keeps its values, so bare placeholders never match,
and is also read as a placeholder window of WIDE tokens if enough of them are plain. A document is a candidate for an item when
it holds one of the item's rarest windows, of which at least one must match if the wanted share of all windows does. A
candidate counts when within any stretch of the document the share of the item's windows that match, with every slot
value standing for one value, is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .language import letters, pieces
from .scratch import cut, freeing, partitions, small_batches
from .spans import SpanHash, mix, runs

WINDOW, SHARE = 5, 0.8
#: A window of mostly placeholders is also read at this length if it has so many plain tokens then.
WIDE, PLAIN = 9, 4
#: Bits of the filter that drops document windows foreign to the benchmark before the join, per benchmark window, and at most.
FILTER_BITS_EACH, FILTER_BITS_MOST, FILTER_PART = 64, 1 << 28, 1 << 13

# Words that are numbers, and units that turn into a placeholder after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers kilometre kilometres mph kmh kph hz khz mhz ghz w kw kwh j kj cal kcal v a k c f degree degrees byte bytes kb mb gb tb".split()

_PLACE = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3))


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """By code point, its lower case if that is one code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i).lower()
        if len(c) == 1:
            low[i] = ord(c)
    return low


@lru_cache(maxsize=1)
def uppers() -> np.ndarray:
    return np.fromiter((i < 0x20000 and chr(i).isupper() for i in range(0x110000)), dtype=bool, count=0x110000)


def word_hashes(words: list[str]) -> np.ndarray:
    codes = np.frombuffer("\n".join(words).encode("utf-32-le"), dtype=np.uint32)
    start, end = runs(codes != 10)
    return np.sort(SpanHash(codes)(start, end))


@lru_cache(maxsize=1)
def lexicon() -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(NUMBER_WORDS), word_hashes(UNITS)


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Tokens:
    """Tokens of some texts in order: text number, value hash, and the canonical hash with sentence-opening capitalised words as plain words
    (`plain`) and as names (`named`). Canonical and value hashes differ for slots only."""

    def __init__(self, texts: list[str | None]):
        parts = list(canonical(texts))
        self.owner, self.plain, self.named, self.value = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.uint64, np.uint64, np.uint64)))


def canonical(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, plain, named, value) of every token, in chunks of bounded size."""
    for at, held in pieces(texts):
        codes = np.frombuffer(("\n".join(held) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        border = np.cumsum([len(t) + 1 for t in held])
        digit = (codes >= 48) & (codes <= 57)
        point = np.zeros(len(codes), dtype=bool)
        point[1:-1] = digit[:-2] & digit[2:] & ((codes[1:-1] == 44) | (codes[1:-1] == 46))
        digit |= point
        letter = letters()[codes]
        d0, d1 = runs(digit)
        w0, w1 = runs(letter)
        start, end = np.concatenate([d0, w0]), np.concatenate([d1, w1])
        if not len(start):
            continue
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        value = SpanHash(lowered()[codes])(start, end)
        is_number = digit[start]
        numbers, units = lexicon()
        is_number |= within(value, numbers)
        owner = np.searchsorted(border, start, side="right")
        same = np.append(False, owner[1:] == owner[:-1])
        unit = np.append(False, is_number[:-1]) & same & within(value, units)
        upper = np.concatenate(([0], np.cumsum(uppers()[codes])))
        # a capital, and a letter after it that isn't one
        capital = uppers()[codes[start]] & (upper[end] - upper[start] < end - start) & ~is_number & ~unit
        # the stretch before a token tells whether a sentence begins there
        stop = np.zeros(256, dtype=bool)
        stop[[ord(c) for c in ".!?:;\n\"("]] = True
        stops = np.concatenate(([0], np.cumsum(stop[np.minimum(codes, 255)])))
        before = np.append(0, end[:-1])
        inner = same & (stops[start] == stops[before])
        canon = np.where(is_number, NUMBER, np.where(unit, UNIT, value))
        yield np.array(at)[owner], np.where(capital & inner, NAME, canon), np.where(capital, NAME, canon), value


def window_hashes(at: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of `size` tokens that begin at `at`."""
    h = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        h += tokens[at + k] * _PLACE[k]
    return mix(h)


def windows(t: Tokens, size: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(first token, hash) of every window of `size` tokens of one text, and how many tokens the hash covers.

    The first part has each window once. Others have more readings of some: openers of sentences as plain words, and
    windows of mostly placeholders at length WIDE.
    """
    n = len(t.owner) - size + 1
    if n <= 0:
        return []
    at = np.flatnonzero(t.owner[:n] == t.owner[size - 1 :])
    held = lambda x, m: (y := np.concatenate(([0], np.cumsum(x))))[at + m] - y[at]

    def read(canon: np.ndarray, mine: np.ndarray, slots: np.ndarray) -> np.ndarray:
        # slots in more than half of the window, or any in a window shorter than usual: values count
        dense = slots * 2 > (size if size >= WINDOW else 0)
        return np.where(dense, window_hashes(mine, t.value, size), window_hashes(mine, canon, size))

    slots = held(t.named != t.value, size)
    out = [(at, read(t.named, at, slots), size)]
    if (opens := held(t.named != t.plain, size) > 0).any():
        out.append((at[opens], read(t.plain, at[opens], held(t.plain != t.value, size)[opens]), size))
    if size == WINDOW and (dense := np.flatnonzero(slots * 2 > size)).size:
        dense = dense[at[dense] + WIDE <= len(t.owner)]
        wide = at[dense]
        fits = (t.owner[wide] == t.owner[wide + WIDE - 1]) & (sum((t.named[wide + k] == t.value[wide + k]).astype(int) for k in range(WIDE)) >= PLAIN)
        out.append((wide[fits], window_hashes(wide[fits], t.named, WIDE), WIDE))
    return out


def digest(values: list[int]) -> int:
    """One signed number for the values of a template's classes."""
    h, m = len(values), (1 << 64) - 1
    for v in values:
        h = (h ^ v) * 0x9E3779B97F4A7C15 & m
        h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, own, canon, value, kinds, more, spot, length, size): items with a digest of their slot values, their tokens, the first reading of each
    window, and the hash, place and length of the others; an item without a token is left out."""
    slim = items.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    names = ["canon", "value", "kinds", "more", "spot", "length"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = Tokens([text])
                if len(t.owner):
                    size = min(WINDOW, len(t.owner))
                    first, *rest = windows(t, size)
                    more = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([h.view(np.int64) for _, h, _ in rest], [at for at, _, _ in rest], [np.full(len(at), n) for at, _, n in rest])]
                    arrays = (t.named.view(np.int64), t.value.view(np.int64), first[1].view(np.int64), *more)
                    own = digest(list(dict.fromkeys(t.value.view(np.int64)[t.named != t.value].tolist())))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([own]), *[pa.array([x], pa.list_(pa.int64())) for x in arrays], pa.array([size], pa.int32())], names=["item", "own", *names, "size"])

    return slim.mapInArrow(freeing(cut_up), "item long, own long, " + ", ".join(f"{n} array<long>" for n in names) + ", size int")


def doc_windows(docs: DataFrame, key: str, text: str, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """Documents that hold windows passing the filter: their hashes and places, and the tokens under them."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text")).where("text is not null")
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i in range(0, len(texts), 256):
                t = Tokens(texts[i : i + 256])
                found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for size in sizes:
                    for at, h, _ in windows(t, size):
                        spot = h >> shift
                        hit = (table[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        found.append((at[hit], h[hit]))
                at, h = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((at, t.owner[at]))
                at, h = at[order], h[order]
                begin = np.flatnonzero(np.append(True, t.owner[at][1:] != t.owner[at][:-1])) if len(at) else []
                for a, b in zip(begin, [*begin[1:], len(at)]):
                    doc, place = int(t.owner[at[a]]), at[a:b]
                    lo = int(np.searchsorted(t.owner, doc))  # a text's tokens stand together
                    under = np.unique(place[:, None] + np.arange(WIDE))
                    under = under[(under < len(t.owner))]
                    under = under[t.owner[under] == doc]
                    arrays = (h[a:b].view(np.int64), place - lo, under - lo, t.value[under].view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + doc, 1), batch.column(1).slice(i + doc, 1), *[pa.array([x], pa.list_(pa.int64())) for x in arrays]], names=["doc_id", "text_hash", "hashes", "places", "under", "values"])

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(freeing(find), f"doc_id {kind}, text_hash long, hashes array<long>, places array<long>, under array<long>, values array<long>")


def window_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter of bounded size from n window hashes (hash), built in parts by the executors."""
    n_bits = 1 << max(16, min(FILTER_BITS_MOST.bit_length() - 1, int(n * FILTER_BITS_EACH - 1).bit_length()))
    part = 8 * FILTER_PART

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            spot = batch.column(0).to_numpy()
            for i in np.unique(spot // part):
                mine = spot[spot // part == i] % part
                np.bitwise_or.at(held.setdefault(int(i), np.zeros(FILTER_PART, np.uint8)), mine >> 3, np.left_shift(1, mine & 7).astype(np.uint8))
        for i, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    spots = hashes.select(F.shiftrightunsigned("hash", 64 - n_bits.bit_length() + 1).alias("spot"))
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in spots.repartition(partitions(hashes.sparkSession), F.floor(F.col("spot") / part)).mapInArrow(fill, "part long, bits binary").collect():
        out[r["part"] * FILTER_PART : (r["part"] + 1) * FILTER_PART] = np.frombuffer(r["bits"], np.uint8)[: len(out)]
    return out


class Template:
    """An item's tokens and windows, and what each of their hashes stands for: its kind, its first token and its length."""

    def __init__(self, canon: list[int], value: list[int], kinds: list[int], more: list[int], spot: list[int], length: list[int], size: int):
        self.slot = [c != v for c, v in zip(canon, value)]
        self.value, self.span_own, self.span, self.stands = value, len(kinds) - 1, int(1.5 * len(kinds)) + 8, {}
        for i, h in enumerate(kinds):
            self.stands.setdefault(h, (h, i, size))
        for h, i, n in zip(more, spot, length):
            self.stands.setdefault(h, (kinds[i], i, n))
        self.n = len(set(kinds))
        # slots of one value are one class, in order of their first place
        self.classes = list(dict.fromkeys(v for v, s in zip(value, self.slot) if s))


class _Stretch:
    """The found windows from a first one on, within `span` tokens: how often each of the template's windows is among them."""

    def __init__(self, t: Template, found: list[tuple[int, int]], span: int):
        self.t, self.found, self.span, self.right, self.seen = t, found, span, 0, {}

    def begin(self, left: int) -> None:
        most = self.found[left][0] + self.span
        while self.right < len(self.found) and self.found[self.right][0] <= most:
            kind = self.t.stands[self.found[self.right][1]][0]
            self.seen[kind] = self.seen.get(kind, 0) + 1
            self.right += 1

    def leave(self, left: int) -> None:
        kind = self.t.stands[self.found[left][1]][0]
        self.seen[kind] -= 1
        if not self.seen[kind]:
            del self.seen[kind]


Slots = tuple[int, list[tuple[int, int]]]


def consistent(t: Template, pairs: list[Slots]) -> tuple[float, dict[int, int]]:
    """The share of the template's distinct windows whose slots keep one value for one value, both ways, and those values: the most frequent
    first, then those found first."""
    votes: dict[tuple[int, int], int] = {}
    for _, slots in pairs:
        for s in slots:
            votes[s] = votes.get(s, 0) + 1
    there: dict[int, int] = {}
    back: set[int] = set()
    for (a, b), _ in sorted(votes.items(), key=lambda x: -x[1]):
        if a not in there and b not in back:
            there[a] = b
            back.add(b)
    good = {kind for kind, slots in pairs if all(there.get(a) == b for a, b in slots)}
    return len(good) / t.n, there


def judge_stretches(t: Template, hashes: list[int], places: list[int], values: dict[int, int], share: float) -> tuple[float, list[int]]:
    """The greatest consistent coverage of a stretch that reaches `share` (0: none does), and the digests of the slot values of all that do.

    From each found window on, two stretches are judged: as many windows as the template has, which a copy of the same length fills alone, and
    1.5 times as many and 8, which leaves room for words put in. What begins inside a copy that is found whole is not judged again.
    """
    found = sorted(((p, h) for h, p in zip(hashes, places) if h in t.stands), key=lambda x: (x[0], t.stands[x[1]][1:]))
    pairs: list[Slots] = []
    for p, h in found:
        kind, i, n = t.stands[h]
        pairs.append((kind, [(t.value[i + k], values[p + k]) for k in range(n) if t.slot[i + k]]))
    tight, wide = _Stretch(t, found, t.span_own), _Stretch(t, found, t.span)
    best, owns, done = 0.0, {}, -1
    for left, (place, _) in enumerate(found):
        last = -1
        for s in (tight, wide):
            s.begin(left)
            if place > done and s.right != last and len(s.seen) / t.n >= share:
                covered, there = consistent(t, pairs[left : s.right])
                if covered >= share:
                    best = max(best, covered)
                    # without all slots only the template's own item can be told
                    same = all(a == b for a, b in there.items())
                    owns[digest([there[c] for c in t.classes]) if len(there) == len(t.classes) else digest(t.classes) if same else None] = None
                if covered == 1 and s is tight:
                    done = found[s.right - 1][0]
            last = s.right
            s.leave(left)
    return best, [x for x in owns if x is not None]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_items, coverage, reparameterised, items, text_hash) for each document and each benchmark template it holds.

    Items with one canonical form are one template of n_items. items lists those whose very slot values a stretch of the document has, and
    reparameterised tells that there are none; item_id is the least of them, else the least of the template. A stretch that holds only a
    part of the slots has the values of the template's least item, if of any. coverage is the share of the template's distinct windows
    found consistently in the best stretch. Null or wordless texts on either side hold and match nothing; texts of any length count
    whole. Repeated rows give repeated rows; text_hash tells rows of one id, or without one, apart. An empty table gives an
    empty result; other columns are left out. A template of fewer than WINDOW tokens is one window and must match with its very values.
    """
    small_batches(docs.sparkSession)
    kept = item_windows(items, item_key, item_text)
    # one template for each canonical form; the form's slots are compared by which of them are equal, so any item stands for it
    pattern = F.expr("transform(value, v -> array_position(value, v))")
    slots = F.zip_with(F.zip_with("canon", "value", lambda c, v: c != v), pattern, lambda s, p: F.when(s, p).otherwise(0))
    columns = ["canon", "value", "kinds", "more", "spot", "length", "size"]
    formed = cut(kept.withColumn("form", F.xxhash64("canon", slots, "kinds")))
    templates = cut(formed.groupBy("form").agg(F.min(F.struct("item", *columns)).alias("x"), F.count("*").alias("n_items")).select("form", F.col("x.*"), "n_items"))
    members = formed.groupBy("form", "own").agg(F.array_sort(F.collect_list("item")).alias("items"))
    first = templates.select("form", F.posexplode("kinds").alias("i", "kind")).select("form", "kind", F.col("kind").alias("hash"))
    others = templates.select("form", "kinds", F.explode(F.arrays_zip("more", "spot")).alias("z")).select("form", F.get("kinds", F.col("z.spot").cast("int")).alias("kind"), F.col("z.more").alias("hash"))
    exploded = cut(first.union(others).distinct())
    counts, sizes = exploded.count(), sorted(r[0] for r in templates.select("size").distinct().collect())
    result = "doc_id {}, item_id long, n_items long, coverage double, reparameterised boolean, items array<long>, text_hash long".format(docs.select(F.col(f"`{key}`").alias("k")).dtypes[0][1])
    if not counts:
        return docs.sparkSession.createDataFrame([], result)

    found = cut(doc_windows(docs, key, text, sizes, window_filter(exploded, counts)).withColumn("row", F.monotonically_increasing_id()))
    # anchors: the rarest windows of each template; if `share` of its windows match, one of these does
    often = exploded.groupBy("hash").agg(F.count("*").alias("times"))
    rarity = exploded.join(often, "hash").groupBy("form", "kind").agg(F.max("times").alias("times"))
    ranked = rarity.withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy("times", "kind"))).withColumn("n", F.count("*").over(Window.partitionBy("form")))
    anchors = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * share) + 1).select("form", "kind").join(exploded, ["form", "kind"]).select("hash", "form")
    candidates = found.select("row", F.explode(F.array_distinct("hashes")).alias("hash")).join(anchors, "hash").select("row", "form").distinct()
    sides = candidates.join(found, "row").join(templates, "form")
    given = ["form", "item", "n_items", *columns, "hashes", "places", "under", "values"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, r in enumerate(batch.select(given).to_pylist()):
                covered, owns = judge_stretches(Template(*[r[c] for c in columns]), r["hashes"], r["places"], dict(zip(r["under"], r["values"])), share)
                if covered:
                    rows.append((i, r["form"], r["item"], r["n_items"], covered, owns))
            pick = [list(x) for x in zip(*rows)] if rows else [[] for _ in range(6)]
            which = pa.array(pick[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(which) for k in range(3)), *[pa.array(x, t) for x, t in zip(pick[1:], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())))]], names=["row", "doc_id", "text_hash", "form", "item", "n_items", "coverage", "owns"])

    kind = dict(found.dtypes)["doc_id"]
    judged = cut(sides.select("row", "doc_id", "text_hash", *given).mapInArrow(freeing(judge), f"row long, doc_id {kind}, text_hash long, form long, item long, n_items long, coverage double, owns array<long>"))
    # what stretches with different values name comes together again for each row and template
    named = judged.select("row", "form", F.explode("owns").alias("own")).join(members, ["form", "own"])
    named = named.groupBy("row", "form").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return judged.join(named, ["row", "form"], "left").select(
        "doc_id", F.coalesce(F.get("items", F.lit(0)), "item").alias("item_id"), "n_items", "coverage", F.col("items").isNull().alias("reparameterised"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"), "text_hash",
    )
