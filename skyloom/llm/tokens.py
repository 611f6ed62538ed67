"""Token counts: batch encoding that returns lengths only.

Texts are gathered into batches of about equal bytes and cut at ASCII white space, where the tokenizer itself always
breaks, by Arrow. Pieces that are frequent in a batch are encoded once and remembered; a text's other pieces are encoded
together, in runs of bounded length. A vocabulary whose pieces may span white space gets whole texts instead, still in
batches of equal bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import freeing, fresh, kept, small_batches

#: Pieces whose lengths a worker remembers; beyond it starts anew. Bounds memory, not results.
CACHE_PIECES = 500_000
#: A piece that stands so often in a batch is remembered; rarer ones cost less inside a run of this many pieces of their text.
OFTEN, RUN = 2, 1024
BATCH_BYTES = 8 << 20
#: Letters that lower-casing and composition map one to one, and punctuation after them; no apostrophe, which begins contractions.
PLAIN = r"^([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)([.,!?;:%$&*#)]*)$"

_counters: dict[str, PieceCounter] = {}


def breaks_at_space(spec: dict) -> bool:
    """Whether a tokenizers file drops white space before its model, so that no piece spans it."""
    def flat(node: dict | None, inner: str) -> list[dict]:
        return [] if not node else node[inner] if node["type"] == "Sequence" else [node]

    if spec["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
        return False
    norm = flat(spec["normalizer"], "normalizers")
    if any(n["type"] not in ("NFC", "Lowercase", "Replace") or n["type"] == "Replace" and n["pattern"] != {"Regex": r"\s+"} for n in norm):
        return False
    pre = flat(spec["pre_tokenizer"], "pretokenizers")
    head = pre[0] if pre else {}
    kept = head.get("pattern", {}).get("Regex", r"\s") if head.get("type") == "Split" and head.get("behavior") == "Removed" and head.get("invert") else r"\s"
    if r"\s" in kept.replace(r"[^\s\p{L}\p{N}]", "") or not all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:]):
        return False
    return spec["post_processor"] is None


def parts_words(spec: dict) -> bool:
    """Whether a vocabulary that breaks at white space also lower-cases and parts letters from punctuation, and has no special string like a plain word."""
    pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    first = pre.get("pretokenizers", [pre])[0].get("pattern", {}).get("Regex", "")
    shapes = first.split("|")
    lowers = any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm]) if n)
    special = any(not any(c in "<>[]|" for c in t["content"]) for t in spec["added_tokens"])
    return lowers and not special and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(shapes) and all(x.startswith("'") for x in shapes if not x.startswith("["))


class PieceCounter:
    """Counts tokens of UTF-8 texts under one vocabulary file; one per Python worker and file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.known, self.lengths = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.by_piece, self._encode_plain = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            def whole(model: Tokenizer) -> Callable[[list[str]], list[int]]:
                model.no_truncation()
                model.no_padding()
                return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.by_piece = breaks_at_space(spec)
            self._encode = whole(Tokenizer.from_file(path))
            if self.by_piece and parts_words(spec):  # words in lower case, parted from punctuation, need no more than the model
                model = Tokenizer.from_file(path)
                model.normalizer = None
                model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
                self._encode_plain = whole(model)

    def encode(self, texts: pa.Array, plain: bool = False) -> np.ndarray:
        encode = self._encode_plain if plain else self._encode
        return np.array(encode([t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]), dtype=np.int64)

    def _kinds(self, pieces: pa.Array) -> Iterator[tuple[bool, np.ndarray, pa.Array]]:
        """Whether pieces are plain, their numbers, and how each kind of encoder wants them."""
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False) if self._encode_plain else np.zeros(len(pieces), bool)
        for kind in (True, False):
            if len(mine := np.flatnonzero(plain == kind)):
                shown = pieces.take(pa.array(mine))
                yield kind, mine, pc.utf8_lower(pc.replace_substring_regex(shown, PLAIN, r"\1 \2")) if kind else shown

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a string array without nulls."""
        if not self.by_piece or not len(texts):
            return self.encode(texts)
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        pieces, at = coded.dictionary, coded.indices.to_numpy()
        if len(self.known) > CACHE_PIECES:
            self.known, self.lengths = self.known.slice(0, 0), self.lengths[:0]
        place = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy()
        each = np.where(place >= 0, np.append(self.lengths, 0)[place], 0)
        strange = (place < 0) & (pc.binary_length(pieces).to_numpy() > 0)  # Arrow gives an empty piece before and after outer white space
        often = strange & (np.bincount(at, minlength=len(pieces)) >= OFTEN)
        if often.any():
            new = np.flatnonzero(often)
            learnt = pieces.take(pa.array(new))
            for plain, mine, shown in self._kinds(learnt):
                each[new[mine]] = self.encode(shown, plain)
            self.known, self.lengths = pa.concat_arrays([self.known, learnt]), np.append(self.lengths, each[new])
        sums = np.concatenate(([0], np.cumsum(each[at])))
        out = sums[ends[1:]] - sums[ends[:-1]]
        once = np.flatnonzero(strange & ~often)
        for plain, mine, shown in self._kinds(pieces.take(pa.array(once))):
            spot = np.full(len(pieces), -1)
            spot[once[mine]] = np.arange(len(mine))
            spot = spot[at]
            stops = np.concatenate(([0], np.cumsum(spot >= 0)))[ends]
            cuts = np.union1d(stops, np.arange(0, stops[-1], RUN))
            together = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), shown.take(pa.array(spot[spot >= 0])))
            np.add.at(out, np.searchsorted(stops, cuts[:-1], side="right") - 1, self.encode(pc.binary_join(together, " "), plain))
        return out


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def by_bytes(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """First and one past the last of consecutive texts in groups of at most `most` bytes; a longer text stands alone."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive batches together, as many as it takes to hold `most` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """Every row of docs without its text, with UTF-8 bytes, tokens and whether tokens exceed `limit`.

    vocabulary: path of a tokenizers .json or sentencepiece .model file that exists on every executor. No begin,
    end or added special tokens, no truncation; special strings inside texts as the library handles them by default.
    A null or empty text has 0 bytes and 0 tokens and isn't over. Texts of any length count whole. Columns named like the
    outputs, in any case of letters, are replaced. Rows may repeat; each is counted. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in kept(docs, out) if c.lower() != text.lower()]
    (held,) = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "_text")
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(held))
    schema = slim.drop(held).withColumns({out[0]: F.lit(0).cast("long"), out[1]: F.lit(0).cast("long"), out[2]: F.lit(False)}).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in gathered(batches):
            raw = pc.fill_null(batch.column(batch.num_columns - 1), b"")
            texts = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), offset=raw.offset)  # not checked again: Spark's texts
            sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
            tokens = np.concatenate([np.zeros(0, np.int64), *[count(texts.slice(a, b - a)) for a, b in by_bytes(sizes)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=[*keep, *out])

    return slim.mapInArrow(freeing(encode), schema)
