"""Secret scans against the plain patterns, learned formats, and edge cases."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import queries, secretscan

HEX, UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
BASE = [  # the contract's words
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII, lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", re.ASCII, lambda m: len(m[0]) >= 16),
]


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, flags, fits) in enumerate(BASE) for m in re.finditer(rx, text or "", flags) if fits(m)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def texts(rng, n):
    bits = ["password=", "TOKEN : '", 'api_key="', "apikey:", "secret =", "paſſword=", "toKen=", "AKIA", "ünï 漢字 ", "deadbeef", " ", "\n", "=", "'", "passwdpassword=", "token=password=x", ". "]
    out = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(bits), drawn(rng, HEX, rng.choice([3, 11, 12, 15, 16, 17, 40])), drawn(rng, UPPER, rng.choice([13, 14, 16])), "Wortzusammensetzungen", drawn(rng, "aeiou.+/_=-", 12)]) for _ in range(rng.randrange(1, 12))]
        out.append("".join(parts))
    return out


def test_patterns_are_the_contracts():
    rng = random.Random(1)
    for text in texts(rng, 4000):
        assert [m[:3] for m in secretscan.matches(text)] == base(text)


def corpus(rng):
    """Credentials between prose, and in the last rows formats that no pattern takes."""
    long = ["keitlichenlichkeit", "understanding", "erchlichheitpfverlich", *("".join(rng.choice(["keit", "lich", "en", "tion", "ung", "pf", "ver", "qu"]) for _ in range(6)) for _ in range(600))]
    prose = lambda: " ".join(rng.choice(["a", "the", rng.choice(long)]) for _ in range(rng.randrange(3, 30)))
    rows = [f"{prose()} {rng.choice(['password=' + drawn(rng, HEX, 18), 'token: ' + drawn(rng, HEX, 40), 'AKIA' + drawn(rng, UPPER, 16), drawn(rng, HEX, 32)])} {prose()}" for _ in range(400)]
    rows += [prose() for _ in range(600)]
    return rows + [f"ü漢 {prose()} AKIA{drawn(rng, UPPER, 12)} {prose()}" for _ in range(20)]


def test_query_against_the_contract(spark, tmp_path):
    rng = random.Random(2)
    rows = [*texts(rng, 300), *corpus(rng), None, "", " \t", "ab" * 500_000 + " token=" + "x" * 700_000, "漢" * 100_000 + "f" * 20]
    rows = list(enumerate(rows)) + [(5, "same"), (5, "same"), (None, "AKIA" + "A" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "spans": F.lit("x"), "_whole": F.lit(2)})
    df.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_secret_scans(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len([s for s in b if s[0] == "assign"]), len([s for s in b if s[0] == "access"]), len([s for s in b if s[0] == "hex"]), hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in b).encode()).hexdigest()) for i, t in rows for b in [base(t)])
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    by_id, listed = dict(rows), []
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
            assert [s for s in spans if not s[0].startswith("like_")] == base(by_id[r["doc_id"]]) and spans == sorted(spans, key=lambda s: s[1])
            added = [s for s in spans if s[0].startswith("like_")]
            assert all(re.fullmatch(r"[A-Za-z0-9+/_=-]{12,}", by_id[r["doc_id"]][a:b]) for _, a, b in added)
            listed += [by_id[r["doc_id"]][a:b] for _, a, b in added]
    assert sum(bool(re.fullmatch(f"AKIA[{UPPER}]{{12}}", x)) for x in listed) >= 19  # a format like the labelled one, too short for its pattern
    assert not {"keitlichenlichkeit", "understanding", "erchlichheitpfverlich"} & set(listed)


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None)], [(1, "just words understanding")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = secretscan.find_secrets(df, secretscan.learn(df)).collect()
        assert [r["found"] for r in got] == [[] for _ in rows]
    only = spark.createDataFrame([(1, "AKIA" + "B" * 16)], "doc_id long, text string")
    assert [s["kind"] for s in secretscan.find_secrets(only, secretscan.learn(only)).first()["found"]] == ["access"]


def test_automaton_keeps_fixed_prefixes_and_folds_random_tails():
    rng = random.Random(3)
    words = sorted({"AKIA" + drawn(rng, UPPER, 16) for _ in range(1500)})
    a = secretscan.infer([w.encode() for w in words])
    assert len(a.end) < 60  # of some 20,000 nodes of the tree
    good, bad = a.likelihood([b"AKIA" + drawn(rng, UPPER, 16).encode() for _ in range(50)]), a.likelihood([drawn(rng, UPPER, 20).encode() for _ in range(50)])
    assert good.min() > bad.max()
    one = [b"AKIA0", b"xy", b"AKIA" * 30]
    total = []
    for word in one:  # a plain walk
        state, log = 0, 0.0
        for c in word:
            log, state = log + a.log[state, c], a.step[state, c]
        total.append((log + a.end[state]) / (len(word) + 1))
    assert np.allclose(a.likelihood(one), total)
    sums = np.exp(a.log[:, secretscan.ALPHABET]).sum(axis=1) + np.exp(a.end)
    assert np.allclose(sums, 1)


def test_redaction():
    text = "a token=0123456789abcdef01 b " + "AKIA" + "B" * 16
    spans = [{"kind": k, "start": a, "end": b} for k, a, b, _ in secretscan.matches(text)]
    assert secretscan.redact(text, spans) == "a [assign] b [access]"


def test_every_word_counts(spark, monkeypatch):
    """Counts, thresholds and shares come from all words, though the tree has few branches: a plain loop over all of them gives the same."""
    monkeypatch.setattr(secretscan, "BRANCHES", 40)
    rng = random.Random(6)
    rows = [t for _ in range(700) for t in ("token=" + drawn(rng, HEX, 18), "AKIA" + drawn(rng, UPPER, 16), "wort" * 2 + drawn(rng, "aeiou", 8))] + ["api_key: " + drawn(rng, HEX, 400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = secretscan.learn(df)
    known: dict = {}
    for row in rows:
        for kind, _, _, word in secretscan.matches(row) or [("plain", 0, 0, row)]:
            known.setdefault(kind, set()).add(word.encode())
    known = {k: sorted(v) for k, v in known.items()}
    want = {k: secretscan.infer(v) for k, v in known.items()}
    assert len(known["assign"]) > 690 and set(got.kinds) == set(known) - {"plain"}
    assert np.allclose(got.plain.log, want["plain"].log)
    for kind, (automaton, threshold) in got.kinds.items():
        assert np.array_equal(automaton.step, want[kind].step) and np.allclose(automaton.log, want[kind].log)
        gap = want[kind].likelihood(known[kind]) - want["plain"].likelihood(known[kind])
        assert np.isclose(threshold, max(np.quantile(gap, secretscan.MISSED), 0))
        # every word enters the root once
        root = secretscan.visits(secretscan.states_of(secretscan.Tree([(b"", len(known[kind]), 0)])), known[kind])
        assert root[0, 256] == sum(len(w) <= secretscan.LONGEST for w in known[kind]) and root.sum() == sum(min(len(w), 80) for w in known[kind]) + root[0, 256]


def test_rare_prefixes_and_long_words_have_their_states(spark, monkeypatch):
    """A format that few words have, and what follows in long words, come in later rounds: rounds of 8 branches and 5 characters leave out no character,
    and tell the rare format as a single round does."""
    rng = random.Random(7)
    known = lambda: "ZQ7-KXW9=JV-" + drawn(rng, "0123456789", 3)
    rare = {known() for _ in range(60)}
    words = sorted({*(drawn(rng, "abcdefgh", rng.randrange(12, 20)) for _ in range(2000)), *rare, *("m" + "n" * k + drawn(rng, "op", 150) for k in range(3))})
    counts = []
    kept = secretscan.automaton_of
    monkeypatch.setattr(secretscan, "automaton_of", lambda step, count: (counts.append(count), kept(step, count))[1])
    whole = secretscan.infer([w.encode() for w in words])
    monkeypatch.setattr(secretscan, "BRANCHES", 8), monkeypatch.setattr(secretscan, "LONGEST", 5)
    rounds = secretscan.infer([w.encode() for w in words])
    df = spark.createDataFrame([("plain", w) for w in words], "kind string, word string").repartition(3)
    got = secretscan._automata(df, {"plain": len(words)})["plain"]
    assert np.array_equal(got.step, rounds.step) and np.allclose(got.log, rounds.log) and np.allclose(got.end, rounds.end)
    assert [c.sum() for c in counts] == [sum(len(w) + 1 for w in words)] * 3 and [c[:, 256].sum() for c in counts] == [len(words)] * 3
    fresh, other = [known().encode() for _ in range(40)], [drawn(rng, "ZQ7-KXW9=JV", 15).encode() for _ in range(40)]
    for automaton in (whole, rounds):
        assert automaton.likelihood(fresh).min() > automaton.likelihood(other).max() + 1
