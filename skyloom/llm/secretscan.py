"""Secret scans: fixed patterns, and formats of credentials learned as probabilistic automata.

Labelled credentials are what the fixed patterns find. For each kind, the prefix tree of all of them is folded into a probabilistic automaton:
states whose endings and next characters agree within a Hoeffding bound, and below them too, are merged. A further automaton is inferred from
all ordinary runs of the same characters. The tree is folded in rounds: every word walks the states that stand, to the first edge whose end isn't known
yet. What follows there, of all words and all parts of the tree that were folded together, is the tree of the next round. A round takes the prefixes
that one in BRANCHES of these words has, or more, LONGEST characters deep, with the counts of all their next characters; rarer and deeper ones come in
the next rounds, together with what is like them by then, until every word has passed the automaton to its end. All its characters and its ending
are counted there.
Every run of LEAST or more such characters in every text that no pattern has found is a candidate; its score is its log likelihood under the
kind's automaton less that under the ordinary one, a character. It is a secret if the score is above 0 and that of nearly all labelled credentials
of the kind (1 - MISSED), by exact rank among all. A kind whose format more than a few of all ordinary runs share (SHARED) adds nothing, as its
automaton can't tell them apart.

Null texts are empty. Texts are read whole, whatever their length; rows are independent, so repeated rows give equal results. An empty table gives
no rows; without a labelled credential only the patterns speak.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import exact_rank, stored
from .scratch import fresh, kept, small_batches
from .spans import runs

#: A round of folding takes the prefixes that one in so many of its words has, and so many characters of them. What is rarer or deeper is left to the
#: next rounds; no word or character is left out.
BRANCHES, LONGEST = 2000, 80
#: In a step: an edge whose end isn't known yet. As a symbol: the end of a word.
OPEN, END = -1, 256
#: Characters of a candidate at least.
LEAST = 12
#: Words that are left when stepping together no longer pays.
FEW = 8
#: Confidence of the test that lets states differ, weight of unseen characters; labelled credentials below a threshold, and ordinary runs above it at most.
ALPHA, UNSEEN, MISSED, SHARED = 0.05, 0.02, 0.02, 0.05
KINDS = ("assign", "access", "hex")
PLAIN = "plain"
# The fixed patterns, by kind. The last two are written with their least lengths: a run that is long enough is found whole, and none other.
PATTERNS = {
    "assign": re.compile(r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"(AKIA[A-Z0-9]{14,})"),
    "hex": re.compile(r"([0-9a-f]{16,})"),
}
#: What a text must hold for any of them; read in one pass over a batch.
HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"
ALPHABET = np.zeros(256, bool)
ALPHABET[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
SYMBOLS = int(ALPHABET.sum())


def matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of what the patterns find, leftmost and not overlapping in each kind, in order."""
    found = []
    for k, kind in enumerate(KINDS):
        for m in PATTERNS[kind].finditer(text):
            if kind != "assign" or m.end(1) - m.start(1) >= 12:
                found.append((m.start(), k, m.end(), m[1]))
    return [(KINDS[k], a, b, value) for a, k, b, value in sorted(found)]


# ---------------------------------------------------------------- automata


class Tree:
    """Counts of states that stand (`step`, `count`: state x 257) and of the prefix trees on their open edges, which are folded into them; nodes are
    numbers, 0 the first state. A prefix is (prefix, words that begin with it, words that are it) and, in a round, also (counts of all its next
    characters, the edge it hangs on as state * 256 + byte); with a prefix, all shorter ones are there. An edge is [node, n]; the node is OPEN
    where the round has no prefix."""

    def __init__(self, prefixes: Iterable[tuple], step: np.ndarray | None = None, count: np.ndarray | None = None):
        step, count = (np.zeros((0, 256), np.int64), np.zeros((0, 257), np.int64)) if step is None else (step, count)
        self.red = list(range(max(len(step), 1)))
        self.ends, self.seen = count[:, END].tolist() or [0], count.sum(axis=1).tolist() or [0]
        self.next: list[dict[int, list[int]]] = [{} for _ in self.red]
        for q, c in zip(*(x.tolist() for x in np.nonzero(count[:, :END]))):
            self.next[q][c] = [int(step[q, c]), int(count[q, c])]
        number = {}
        for prefix, n, ends, *more in sorted(prefixes, key=lambda x: (len(x[0]), x[0])):
            after, edge = more or ({}, None)
            if prefix or edge is not None:
                at = number[edge, prefix] = len(self.ends)
                above, c = (number.get((edge, prefix[:-1]), 0), prefix[-1]) if prefix else divmod(edge, 256)
                self.next[above].setdefault(c, [OPEN, n])[0] = at
                self.ends.append(0), self.seen.append(0), self.next.append({})
            else:
                at = 0
            self.seen[at], self.ends[at] = n, ends
            self.next[at] |= {c: [OPEN, k] for c, k in after.items()}

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states, and those below, agree within the bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            bound = np.sqrt(0.5 * np.log(2 / ALPHA)) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
            x, y = self.next[a], self.next[b]
            if bound < 1:  # no shares differ by more
                if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                    return False
                for c in x.keys() | y.keys():
                    if abs((x[c][1] if c in x else 0) / n - (y[c][1] if c in y else 0) / m) > bound:
                        return False
            todo += [(x[c][0], y[c][0]) for c in x.keys() & y.keys() if x[c][0] != OPEN and y[c][0] != OPEN]
        return True

    def fold(self, into: int, node: int) -> list[tuple[int, int]]:
        """Add a subtree's counts to a state and the states below it; the (state, character) where parts of it hang now."""
        todo, hung = [(into, node)], []
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, (to, n) in self.next[b].items():
                edge = self.next[a].setdefault(c, [OPEN, 0])
                edge[1] += n
                if edge[0] == OPEN:
                    edge[0] = to
                    hung.append((a, c))
                elif to != OPEN:
                    todo.append((edge[0], to))
        return hung

    def merged(self) -> list[int]:
        """The states that stay: each state next to them, most visited first, is folded into the first that is compatible, or stays too."""
        red, stay = list(self.red), {*self.red, OPEN}
        near = {(q, c) for q in red for c in self.next[q]}
        while near := {(q, c) for q, c in near if self.next[q][c][0] not in stay}:
            q, c = min(near, key=lambda x: (-self.next[x[0]][x[1]][1], x))
            node = self.next[q][c][0]
            for r in red:
                if self.compatible(r, node):
                    self.next[q][c][0] = r
                    near |= {(a, k) for a, k in self.fold(r, node) if a in stay}
                    break
            else:
                red.append(node)
                stay.add(node)
                near |= {(node, k) for k in self.next[node]}
        return red


@dataclass
class Automaton:
    """step: state x byte -> state; log: state x byte -> log probability; end: log probability of ending. The last state is where unseen characters lead."""

    step: np.ndarray
    log: np.ndarray
    end: np.ndarray

    def likelihood(self, words: list[bytes]) -> np.ndarray:
        """Log likelihood a character, the end counting as one. All words step together, the longest first, so ended ones drop off; the last FEW go
        on one at a time."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, total, size, start = np.zeros(len(words), np.int64), np.zeros(len(words)), size[order], start[order]
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, side="left"))  # words longer than i
            if n <= FEW:
                step, log = self.step.item, self.log.item
                for w in range(n):
                    q, sum_ = int(state[w]), float(total[w])
                    for c in flat[start[w] + i : start[w] + size[w]].tolist():
                        sum_, q = sum_ + log(q, c), step(q, c)
                    state[w], total[w] = q, sum_
                break
            c = flat[start[:n] + i]
            total[:n] += self.log[state[:n], c]
            state[:n] = self.step[state[:n], c]
        out = np.empty(len(words))
        out[order] = (total + self.end[state]) / (size + 1)
        return out


def states_of(tree: Tree, default: int = 0) -> np.ndarray:
    """step of the automaton that a tree is folded into: state x byte -> state, `default` where the tree has no branch and OPEN where an edge stays open."""
    states = tree.merged()
    number = {q: i for i, q in enumerate(states)} | {OPEN: OPEN}
    step = np.full((len(states), 256), default, np.int64)
    for i, q in enumerate(states):
        for c, (to, _) in tree.next[q].items():
            step[i, c] = number[to]
    return step


def visits(step: np.ndarray, words: list[bytes], most: int | None = LONGEST, state: np.ndarray | None = None, left: dict[int, tuple[int, int]] | None = None) -> np.ndarray:
    """How often words take each character in each state, and, in the last column, end there: state x 257. `most`: characters of a word that are
    walked, None: all; `state`: where each begins, else in the first. A word that takes an open edge stops after it: `left` gets word -> (edge, as
    state * 256 + byte, and characters walked)."""
    size = np.array([len(w) for w in words], np.int64)
    limit = size if most is None else np.minimum(size, most)
    flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    state = np.zeros(len(words), np.int64) if state is None else state.copy()
    go, taken, i = np.argsort(-limit, kind="stable"), [np.zeros(0, np.int64)], 0  # words that go on, the longest first
    while len(go):
        n = int(np.searchsorted(-limit[go], -i, side="left"))  # words longer than i
        over, go = go[n:], go[:n]
        taken.append(state[over[size[over] == i]] * 257 + END)
        if n <= FEW:
            for w in go.tolist():
                q, passed = int(state[w]), []
                for c in flat[start[w] + i : start[w] + limit[w]].tolist():
                    passed.append(q * 257 + c)
                    if (to := step.item(q, c)) == OPEN:
                        left[w] = (q * 256 + c, i + len(passed))
                        break
                    q = to
                else:
                    passed += [q * 257 + END] if limit[w] == size[w] else []
                taken.append(np.array(passed, np.int64))
            break
        c = flat[start[go] + i].astype(np.int64)
        taken.append(state[go] * 257 + c)
        to = step[state[go], c]
        for k in np.flatnonzero(to == OPEN).tolist():
            left[int(go[k])] = (int(state[go[k]] * 256 + c[k]), i + 1)
        state[go] = to
        go, i = go[to != OPEN], i + 1
    return np.bincount(np.concatenate(taken), minlength=len(step) * 257).reshape(-1, 257)


def advance(step: np.ndarray, edges: list[int], rests: list[bytes]) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Words, each an edge that it has taken (OPEN: none yet) and what follows there, go on as far as step leads: what they visit newly, and the edges and
    rests of those that stand at an open edge then."""
    at = np.array(edges, np.int64)
    state = np.where(at == OPEN, 0, step.reshape(-1)[np.maximum(at, 0)])
    go = np.flatnonzero(state != OPEN)
    words, left = [rests[i] for i in go.tolist()], {}
    count = visits(step, words, None, state[go], left)
    stay = np.flatnonzero(state == OPEN).tolist()
    return count, [edges[i] for i in stay] + [e for e, _ in left.values()], [rests[i] for i in stay] + [words[w][i:] for w, (_, i) in left.items()]


class Folding:
    """An automaton while its words are folded in rounds: step, and what the words have visited so far. It begins with one state and open edges only."""

    def __init__(self) -> None:
        self.step, self.count = np.full((1, 256), OPEN, np.int64), np.zeros((1, 257), np.int64)

    def least(self) -> int:
        """Words that a prefix of the next round has at least: one in BRANCHES of those at open edges, but no more than some edge has; 0 if all have ended."""
        on = self.count[:, :END][self.step == OPEN]
        return int(min(-(-on.sum() // BRANCHES), on.max())) if on.any() else 0

    def grow(self, step: np.ndarray) -> None:
        """Take the step of a round: the states so far, then new ones."""
        self.step, self.count = step, np.vstack((self.count, np.zeros((len(step) - len(self.count), 257), np.int64)))

    def automaton(self) -> Automaton:
        return automaton_of(np.maximum(self.step, 0), self.count)


def automaton_of(step: np.ndarray, count: np.ndarray) -> Automaton:
    """Unseen characters and endings keep a small share everywhere."""
    sink = len(step)
    count = np.vstack((count, np.zeros((1, 257), np.int64)))
    seen = np.where(count[:-1, :256] > 0, step, sink)
    whole = count.sum(axis=1)[:, None] + UNSEEN * (SYMBOLS + 1)
    log = np.log((count + UNSEEN) / whole)
    return Automaton(np.vstack((seen, np.full((1, 256), sink))), log[:, :256], log[:, 256])


def infer(words: list[bytes]) -> Automaton:
    """The automaton of some words that are at hand."""
    x, edges, rests = Folding(), [OPEN] * len(words), words
    while rests:
        count, edges, rests = advance(x.step, edges, rests)
        x.count += count
        if least := x.least():
            after: dict[tuple[int, bytes], Counter] = {}
            for edge, rest in zip(edges, rests):
                for i in range(min(len(rest), LONGEST) + 1):
                    after.setdefault((edge, rest[:i]), Counter())[rest[i] if i < len(rest) else END] += 1
            x.grow(states_of(Tree([(p, n, a.pop(END, 0), a, e) for (e, p), a in after.items() if (n := a.total()) >= least], x.step, x.count), OPEN))
    return x.automaton()


@dataclass
class Model:
    """An automaton and a threshold for each kind that was learned, and the automaton of ordinary runs."""

    kinds: dict[str, tuple[Automaton, float]] = field(default_factory=dict)
    plain: Automaton | None = None

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the best kind or -1, its score above the threshold) of each word."""
        best, top = np.full(len(words), -1), np.full(len(words), -np.inf)
        if words and self.kinds:
            ordinary = self.plain.likelihood(words)
            for kind, (automaton, threshold) in self.kinds.items():
                over = automaton.likelihood(words) - ordinary - threshold
                best = np.where(over > np.maximum(top, 0), KINDS.index(kind), best)
                top = np.maximum(top, over)
        return best, top


# ---------------------------------------------------------------- scan


def _batch_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, and the row, start and end of each run of LEAST or more characters) of a column without nulls."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    codes = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ALPHABET[codes]
    borders = at[1:-1]
    first, last = runs(inside)
    cuts = np.unique(borders[(borders > 0) & (borders < len(codes))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts  # runs that pass from one text into the next
    first, last = np.sort(np.concatenate((first, cuts))), np.sort(np.concatenate((last, cuts)))
    long = last - first >= LEAST
    first, last = first[long], last[long]
    return codes, at, np.searchsorted(at, first, side="right") - 1, first, last


def _scanned(column: pa.Array) -> Iterator[tuple[list[list], list[tuple[int, int, int, bytes]]]]:
    """The pattern matches of each row, and (row, start, end, run) in code points of each candidate that no match touches."""
    hinted = pc.match_substring_regex(column, HINT).to_numpy(zero_copy_only=False)
    found = [matches(column[i].as_py()) if h else [] for i, h in enumerate(hinted.tolist())]
    codes, at, row, first, last = _batch_runs(column)
    raw, loose = codes.tobytes(), []
    before: dict[int, np.ndarray] = {}
    for i, a, b in zip(row.tolist(), first.tolist(), last.tolist()):
        if i not in before:  # code points before each byte of the row
            before.clear()
            before[i] = np.cumsum((codes[at[i] : at[i + 1]] & 0xC0) != 0x80) - 1
        start = int(before[i][a - at[i]])
        end = start + b - a
        if not any(s < end and start < e for _, s, e, _ in found[i]):
            loose.append((i, start, end, raw[a:b]))
    return found, loose


def _texts(batch: pa.RecordBatch, at: int) -> pa.Array:
    return pc.fill_null(batch.column(at), "")


def _words(docs: DataFrame, text: str) -> DataFrame:
    """Stored: the distinct (kind, word) of all credentials and ordinary runs."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, loose = _scanned(_texts(batch, 0))
            pairs = {(k, v) for row in found for k, _, _, v in row} | {(PLAIN, w.decode()) for *_, w in loose}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.string())], names=["kind", "word"])

    return stored(docs.select(F.col(f"`{text}`")).mapInArrow(listed, "kind string, word string").distinct())


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch by kind."""
    by_kind: dict[str, list[bytes]] = {}
    for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by_kind.setdefault(kind, []).append(word.encode())
    yield from by_kind.items()


def _round(rest: DataFrame, now: dict[str, Folding], least: dict[str, int]) -> dict[str, np.ndarray]:
    """The step of each kind in `least` after a round. Spark counts all prefixes of the rests; a task for each kind gets those of the round, BRANCHES of each
    length at most."""
    size, at = F.length("rest"), F.col("_i")
    heads = rest.where(F.col("kind").isin(list(least))).select("kind", "edge", F.substring("rest", 1, LONGEST + 1).alias("rest"))
    prefixes = heads.select("kind", "edge", "rest", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(LONGEST)))).alias("_i"))
    prefixes = prefixes.select("kind", "edge", F.substring("rest", F.lit(1), at).alias("prefix"), F.when(at < size, F.ascii(F.substring("rest", at + 1, F.lit(1)))).otherwise(END).alias("symbol"))
    most = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("kind")]
    each = prefixes.groupBy("kind", "edge", "prefix", "symbol").agg(F.count("*").alias("n"))
    shared = each.groupBy("kind", "edge", "prefix").agg(F.sum("n").alias("n"), F.collect_list(F.struct("symbol", "n")).alias("after")).where(F.col("n") >= most)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kind, nodes = group["kind"].iloc[0], []
        for edge, prefix, n, symbols, ns in zip(group["edge"], group["prefix"], group["n"], group["symbols"], group["ns"]):
            after = dict(zip(symbols.tolist(), ns.tolist()))
            nodes.append((prefix.encode(), n, after.pop(END, 0), after, edge))
        step = states_of(Tree(nodes, now[kind].step, now[kind].count), OPEN)
        return pd.DataFrame({"kind": [kind], "step": [step.astype(np.int32).tobytes()]})

    rows = shared.select("kind", "edge", "prefix", "n", F.col("after.symbol").alias("symbols"), F.col("after.n").alias("ns")).groupBy("kind").applyInPandas(fold, "kind string, step binary")
    return {r["kind"]: np.frombuffer(r["step"], np.int32).reshape(-1, 256).astype(np.int64) for r in rows.collect()}


def _automata(words: DataFrame, kinds: Iterable[str]) -> dict[str, Automaton]:
    """The automaton of each kind, of all its words. A round walks the words that stand at an edge which the one before has led on; words that have
    ended, and the states they passed, stay as they are."""
    now, rest = {kind: Folding() for kind in kinds}, words.select("kind", F.lit(OPEN).cast("long").alias("edge"), F.col("word").alias("rest"))
    names = ["kind", "edge", "rest", "state", "symbol", "n"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of rests (kind, edge, rest), and of visits (kind, state, symbol, n)."""
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_kind: dict[str, tuple[list[int], list[bytes]]] = {}
            for kind, edge, word in zip(*(column.to_pylist() for column in batch.columns)):
                edges, rests = by_kind.setdefault(kind, ([], []))
                edges.append(edge), rests.append(word.encode())
            for kind, some in by_kind.items():
                count, edges, rests = advance(now[kind].step, *some)
                counts[kind] = counts.get(kind, 0) + count
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(edges), pa.string()), pa.array(edges, pa.int64()), pa.array([r.decode() for r in rests], pa.string()), *(pa.nulls(len(edges), pa.int64()) for _ in range(3))], names=names)
        for kind, count in counts.items():
            state, symbol = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(state), pa.string()), pa.nulls(len(state), pa.int64()), pa.nulls(len(state), pa.string()), pa.array(state), pa.array(symbol), pa.array(count[state, symbol])], names=names)

    while True:
        walked = stored(rest.mapInArrow(walk, "kind string, edge long, rest string, state long, symbol long, n long"))
        for r in walked.where("rest is null").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n")).collect():
            now[r["kind"]].count[r["state"], r["symbol"]] += r["n"]
        least = {kind: n for kind, x in now.items() if (n := x.least())}
        if not least:
            return {kind: x.automaton() for kind, x in now.items()}
        rest = walked.where("rest is not null").select("kind", "edge", "rest")
        for kind, step in _round(rest, now, least).items():
            now[kind].grow(step)


def _thresholds(words: DataFrame, sizes: dict[str, int], fitted: dict[str, Automaton], plain: Automaton) -> dict[str, float]:
    """For each kind the MISSED quantile of its words' scores, by the exact ranks of all, 0 at least."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, some in _grouped(batch):
                gap = fitted[kind].likelihood(some) - plain.likelihood(some)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.string()), pa.array(gap)], names=["kind", "gap"])

    wanted, before = {}, 0  # rank -> kind; ranks go over kinds in order
    for kind in sorted(k for k in sizes if k != PLAIN):
        low = int(MISSED * (sizes[kind] - 1))
        wanted[kind] = (before + low, before + min(low + 1, sizes[kind] - 1), MISSED * (sizes[kind] - 1) - low)
        before += sizes[kind]
    if not wanted:
        return {}
    ranked = exact_rank(stored(words.where(F.col("kind") != PLAIN).mapInArrow(score, "kind string, gap double")), ["kind", "gap"], "rank")  # a range exchange reads twice
    at = {r["rank"]: r["gap"] for r in ranked.where(F.col("rank").isin(sorted({x for low, high, _ in wanted.values() for x in (low, high)}))).select("rank", "gap").collect()}
    return {kind: max(at[low] + (at[high] - at[low]) * part, 0.0) for kind, (low, high, part) in wanted.items()}


def _above(words: DataFrame, thresholds: dict[str, float], fitted: dict[str, Automaton], plain: Automaton) -> dict[str, int]:
    """How many of all ordinary runs are above each kind's threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in _grouped(batch):
                ordinary = plain.likelihood(some)
                over = [int((fitted[kind].likelihood(some) - ordinary > t).sum()) for kind, t in thresholds.items()]
                yield pa.RecordBatch.from_arrays([pa.array(list(thresholds), pa.string()), pa.array(over, pa.int64())], names=["kind", "n"])

    rows = words.where(F.col("kind") == PLAIN).mapInArrow(count, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    return {r["kind"]: r["n"] for r in rows.collect()}


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Automata and thresholds of all the table's credentials, each distinct one once."""
    small_batches(docs.sparkSession)
    words = _words(docs, text)
    sizes = {r["kind"]: r["n"] for r in words.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not set(sizes) & set(KINDS):
        return Model()
    fitted = _automata(words, sizes)
    plain = fitted.get(PLAIN) or infer([])
    model = Model(plain=plain)
    thresholds = _thresholds(words, sizes, fitted, plain)
    above = _above(words, thresholds, fitted, plain) if PLAIN in sizes else {}
    for kind in KINDS:
        if kind in thresholds and above.get(kind, 0) <= SHARED * sizes.get(PLAIN, 0):
            model.kinds[kind] = (fitted[kind], thresholds[kind])
    return model


SPANS = "array<struct<kind: string, start: int, end: int, learned: boolean, score: double>>"


def find_secrets(docs: DataFrame, model: Model, text: str = "text", out: str = "found") -> DataFrame:
    """docs with `out`: the spans of secrets in order, ends exclusive, in code points. What an automaton adds is named after its kind with `like_`
    before it, and carries its score above the threshold; a column of the name `out` is replaced."""
    keep = kept(docs, [out])
    (whole,) = fresh(docs, "_whole")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(whole))
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, loose = _scanned(_texts(batch, batch.num_columns - 1))
            spans = [[(a, KINDS.index(k), b, k, False, None) for k, a, b, _ in row] for row in found]
            best, over = model.scores([w for *_, w in loose])
            for (i, a, b, _), k, s in zip(loose, best.tolist(), over.tolist()):
                if k >= 0:
                    spans[i].append((a, len(KINDS) + k, b, f"like_{KINDS[k]}", True, s))
            listed = [[{"kind": k, "start": a, "end": b, "learned": new, "score": s} for a, _, b, k, new, s in sorted(row, key=lambda x: x[:2])] for row in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(listed, kind)], names=[*batch.schema.names[:-1], out])

    schema = rows.drop(whole).schema
    return rows.mapInArrow(scan, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"`{out}` {SPANS}"]))


def redact(text: str, spans: list) -> str:
    """A text without the secrets that were found in it: each is replaced by its kind in brackets, overlapping ones by the first's."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
