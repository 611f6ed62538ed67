"""Conversation repair against a search over all edits, chunk borders and edge cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from skyloom.llm import turns

ROWS = "conv_id long, turn long, role string, text string"
BARE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text), "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (k != 0) * (2 if k == 3 else 1)
    return out


def plain(convs, rows):
    """For each conversation the least (cost, audit) over all edits, searched with memory of (row, last role)."""
    out = []
    for conv in convs:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            marks = BARE.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        follows = lambda last, role: role == "u" if last in ("s", "a") else role == "a" if last == "u" else role in ("s", "u")

        @lru_cache(None)
        def best(i, last, inserts):
            ways = [(0, "", ())] if i == len(own) and last in ("", "a") else []
            if inserts < 3:
                for role in ("user", "assistant"):
                    if follows(last, role[0]):
                        c, a, t = best(i, role[0], inserts + 1)
                        ways.append((c + 2, "I" + a, (role + ":", *t)))
            if i < len(own):
                _, role, text = own[i]
                c, a, t = best(i + 1, last, 0)
                ways.append((c + 3, "D" + a, t))
                if faults[i] not in ("blank", "duplicate"):
                    extra = faults[i] == "truncated"
                    for cost, edit, to in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                        if to and follows(last, to[0]):
                            c, a, t = best(i + 1, to[0], 0)
                            ways.append((c + cost + extra, edit + a, (f"{to}:{text}", *t)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, lines = best(0, "", 0)
        ts = {r[0] for r in own} - {None}
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(ts) - min(ts) + 1 - len(ts) if ts else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng, conv, n):
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "", " ", None], ["Hello.", "Why?", "no end", "ok!  ", " \t\n", "", None, "a: b.", "ü漢."]
    return [(conv, rng.choice([i, i, i, i + 1, i + 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(10**6)}.") for i in range(n)]


def repaired(df, **how):
    return sorted((tuple(r) for r in turns.repair(df, **how).collect()), key=str)


def test_against_all_edits(spark):
    rng = random.Random(5)
    rows = [r for conv in [*range(150), None] for r in talk(rng, conv, rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    convs = {r[0] for r in rows}
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert repaired(df) == plain(convs, spaced)
    wide = df.withColumns({"conv": F.lit(1), "at": F.lit(2), "kind": F.lit(3), "AUDIT": F.lit("x")})
    assert repaired(wide, damaged=True) == plain(convs, damaged(rows))


def test_borders_of_fragments_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = talk(rng, 1, 90) + [(2, i, "system", f"s{i}.") for i in range(60)] + [(3, 0, "user", "same.")] * 50 + talk(rng, 4, 3)
    whole = plain({1, 2, 3, 4}, damaged(rows))
    for size in (1, 4):
        monkeypatch.setattr(turns, "CHUNK", size)
        assert repaired(spark.createDataFrame(rows, ROWS), damaged=True) == whole


def test_fragments_settle_by_reruns():
    rng = random.Random(7)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 9, 10, 11, 4, 18]) for _ in range(rng.randrange(1, 30)))
        guess, end = turns.END, turns.backward(bytes(rng.choice([0, 1, 2, 3, 4]) for _ in range(9)), turns.END)
        assert turns.rerun(codes, guess, end, turns.backward(codes, guess)) == turns.backward(codes, end)


def test_no_rows_and_none_left(spark):
    assert repaired(spark.createDataFrame([], ROWS)) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "x")], ROWS), damaged=True) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "short.")]
    assert repaired(spark.createDataFrame(long, ROWS))[0][6:8] == (0, "KK")
