"""The training-data operators against brute force, round trips and edge cases."""

import datetime as dt
import itertools
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from skyloom.llm import decontam, language, mpeg, neardup, packing, pseudonyms, shards, tokens, toxicity, urlrules
from skyloom.llm import queries as llm_queries
from skyloom.llm.scratch import gapless_rank

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "long words here " * 30_000), (5, "same text twice, twice"), (5, "same text twice, twice"), (6, "same text twice, twice"), (None, "no id"), (7, None), (8, "ünïcode ß 漢字 \u0301")]


def docs(spark, rows, **extra):
    df = spark.createDataFrame([(i, x, None, "s", len(x or "")) for i, x in rows], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---------------------------------------------------------------- 1 language

EN, FR = ["the cat and the dog walked with them there", "that is what they thought then", "this other thing"], ["le chien et la souris dans les rues", "elle est avec une amie que nous aimons", "les oiseaux chantent"]


@pytest.fixture(scope="module")
def langs(spark):
    rows = [(i, x + f" {i}", "en") for i, x in enumerate(EN * 5)] + [(100 + i, x + f" {i}", "fr") for i, x in enumerate(FR * 5)] + [(200, None, "de"), (201, "ohne", None), (202, "123", "xx")]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), k=2)


def test_language_of_edge_cases(spark, langs):
    rows = [*EDGE, (20, "the dog and the cat"), (21, "LES CHIENS ET LES SOURIS"), (22, "12 34 !")]
    got = {r["doc_id"]: r for r in language.identify(docs(spark, rows, score=9.0, lang_pred="x"), langs, reject=False).collect()}
    assert got[20]["lang_pred"] == "en" and got[21]["lang_pred"] == "fr" and langs.names == ["en", "fr"]
    assert {i: got[i]["lang_pred"] for i in (0, 1, 2, 22)} == dict.fromkeys((0, 1, 2, 22), "und")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and language.identify(docs(spark, []), langs).count() == 0
    assert language.identify(docs(spark, [(1, "漢字漢字 漢字")]), langs).first()["lang_pred"] == "und"  # far from every centroid


def test_language_learnt_from_nothing(spark):
    for rows in ([], [(1, None, "en"), (2, "words", None)], [(1, "12 !", "en")]):
        model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        got = language.identify(docs(spark, EDGE, _text=1, LANG_PRED="x"), model).collect()
        assert len(got) == len(EDGE) and {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)}


def test_language_query_against_brute_force(spark, tmp_path):
    """The whole query on a few hundred texts: counts of letters, pairs and triples by hand, the model's centroids by plain cosines."""
    import zlib

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(x.split()) for _ in range(12)) + rng.choice(["", " 12!", " É"]), lang) for i, (x, lang) in enumerate([(EN[0] + " " + EN[1], "en"), (FR[0] + " " + FR[1], "fr")] * 100)]
    rows += [(500, None, "en"), (501, "", None), (502, "?? 3", "fr"), (503, rows[3][1], None), (503, rows[3][1], None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = llm_queries.op1_language_id(spark, str(tmp_path)).collect()
    model = language.learn(table.where(~llm_queries.held_out()))

    def slot(kind, chars):
        k, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
        x = (((chars[0] * k + chars[1]) * k + chars[2]) * k if kind == 3 else (chars[0] + (1 << 40)) * k + chars[1] if kind == 2 else chars[0] + (1 << 42)) & m
        x = x * k & m if kind < 3 else x & m
        return ((x ^ x >> 29) * k & m) >> 51

    def vector(text):
        n = {}
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            c = [0, *map(ord, word), 0]
            for i in range(1, len(c) - 1):
                for kind, part in ((1, c[i : i + 1]), (2, c[i : i + 2] if i + 1 < len(c) - 1 else None), (3, c[i - 1 : i + 2])):
                    if part:
                        n[slot(kind, part)] = n.get(slot(kind, part), 0) + 1
        x = np.zeros(language.DIM)
        for at, times in n.items():
            x[at] = np.log1p(times) * model.idf[at]
        return x / max(np.linalg.norm(x), 1e-12)

    want = []
    for i, text, _ in rows:
        x = vector(text)
        near = model.centers @ x
        lang = "und" if not x.any() else model.langs[int(np.argmax(near))]
        want.append((i, zlib.crc32(str(i).encode()) % 4 == 2, lang, round(float(1 - near.max()) if x.any() else 1.0, 3)))
    assert sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["distance"], 3)) for r in got) == sorted(want)
    assert set(model.langs) == {"en", "fr"} and all(0 <= r["score"] <= 1 for r in got)
    assert llm_queries.op1_language_id(spark, str(tmp_path)).where("doc_id < 500 and lang_pred <> if(doc_id % 2 = 0, 'en', 'fr')").count() == 0


def test_gram_counts_of_parts_add_up(monkeypatch):
    text = "some words that are cut apart at spaces " * 50
    whole = language.gram_counts([text, "other"])
    monkeypatch.setattr(language, "CHUNK_CHARS", 64)
    assert (language.gram_counts([text, "other"]) == whole).all()


# ---------------------------------------------------------------- 2 personal data


def test_pseudonyms_keep_format_and_links():
    p, other = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"other")
    text = "Mail und.34@mail7.example.com, card 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112, call +1 (499) 555-6503, ip 10.20.30.40 not 300.1.1.1, on 2021-03-04 and 04.03.2021 not 2021-13-04, DE89 3704 0044 0532 0130 00, token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""
    out, n = p.replace(text)
    assert n == {"email": 1, "card": 2, "phone": 1, "ip": 1, "date": 2, "iban": 1, "secret": 1}
    for gone in ("und.34", "4111 1111", "555-6503", "10.20.30.40", "2021-03-04", "04.03.2021", "DE89", "1eb9c654"):
        assert gone not in out
    for stays in ("4111111111111112", "300.1.1.1", "2021-13-04"):
        assert stays in out
    a, b = re.search(r"card ([\d ]{19}) or ([\d-]{19})", out).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and pseudonyms.luhn_digit(re.sub(r"\D", "", a)[:-1]) == int(a[-1])
    iso, dotted = re.search(r"on (\S+) and (\S+) not", out).groups()
    assert dt.date.fromisoformat(iso) == dt.datetime.strptime(dotted, "%d.%m.%Y").date()
    iban = re.search(r"DE\d\d[\d ]+", out)[0].replace(" ", "").strip()
    assert int("".join(str(int(c, 36)) for c in iban[4:22] + iban[:4])) % 97 == 1
    assert p.replace(text) == (out, n) and other.replace(text)[0] != out


def test_phone_numbers_of_other_layouts():
    p = pseudonyms.Pseudonyms(b"k")
    for phone in ("+14155550123", "+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 1234567", "+49 (0)30 1234567", "020 7946 0958", "01 23 45 67 89", "(030) 1234567", "+9 (999) 999-9999"):
        out, n = p.replace(f"call {phone}, or write")
        assert n == {"phone": 1} and phone not in out and re.sub(r"\d", "9", out) == re.sub(r"\d", "9", f"call {phone}, or write"), phone
    assert re.sub(r"\D", "", p.replace("+14155550123")[0]) == re.sub(r"\D", "", p.replace("+1 (415) 555-0123")[0])
    for text in ("+289 1234567", "+123456", "0.123 456 789", "1234567", "x+14155550123", "0123 4567 8901 2345 6"):
        assert p.replace(text)[1] == {}, text


@settings(max_examples=50, deadline=None)
@given(hs.integers(1, 500), hs.text("abcXYZ019-", max_size=12))
def test_feistel_is_a_permutation(size, text):
    f = pseudonyms.Feistel(b"k")
    assert sorted(f.number(i, size, b"t") for i in range(size)) == list(range(size))
    there = f.text(text, b"t")
    assert f.text(there, b"t", back=True) == text and [pseudonyms._class(c, False) for c in there] == [pseudonyms._class(c, False) for c in text]


def test_windows_find_what_the_whole_text_has():
    rng = random.Random(5)
    bits = ["x@y.org", "4111111111111111", "+1 (499) 555-6503", "1.2.3.4", "2021-03-04", "word " * 200, "a" * 900, " ", "9", "@"]
    for _ in range(100):
        text = " ".join(rng.choice(bits) for _ in range(12))
        inside = [m.span() for a, b in pseudonyms.windows(text) for m in pseudonyms.FOUND.finditer(text, a, b)]
        assert inside == [m.span() for m in pseudonyms.FOUND.finditer(text)]


def test_addresses_of_any_script_and_length():
    p = pseudonyms.Pseudonyms(b"k")
    for local, domain in (("ユーザー", "example.com"), ("müller", "büro.example.de"), ("a" * 200, "x.org"), ("иван.петров", "пример.рф"), ("e\u0301lan", "x.fr")):
        out, n = p.replace(f"an {local}@{domain}, oder")
        new = re.search(r"an (\S+)@(\S+), oder", out)
        assert n == {"email": 1} and new and len(new[1]) == len(local) and len(new[2]) == len(domain) and new[2].rsplit(".")[-1] == domain.rsplit(".")[-1]
        assert not set(local) - set("aeo.") & set(new[1]) or sum(a == b for a, b in zip(local, new[1])) < len(local) / 2 + 1
        assert out != f"an {local}@{domain}, oder" and p.replace(out)[0] != out


def test_pii_query_on_planted_values(spark, tmp_path):
    """The whole query on texts built from known values: every value gets another of its form, one for one over all documents, and nothing else changes."""
    rng = random.Random(2)
    luhn = lambda d: d + str(pseudonyms.luhn_digit(d))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    iban = lambda rest: f"DE{pseudonyms.iban_check('DE', rest):02d}{rest}"
    pool = [("email", f"user{i}.x@mail{i}.example.org") for i in range(6)] + [("card", luhn("4" + digits(14))) for _ in range(4)] + [("ip", f"10.{i}.7.{200 - i}") for i in range(4)]
    pool += [("date", f"20{10 + i}-0{1 + i}-1{i}") for i in range(4)] + [("iban", iban(digits(18))) for _ in range(3)] + [("phone", f"+44 20 7946 0{digits(3)}") for _ in range(3)] + [("ssn", f"5{digits(2)}-{digits(2)}-{digits(4)}") for _ in range(3)]
    rows, plan = [], {}
    for i in range(120):
        values = [rng.choice(pool) for _ in range(rng.randrange(5))]
        gaps = [f" word{rng.randrange(5)} here " for _ in range(len(values) + 1)]
        rows.append((1000 + i, gaps[0] + "".join(v + g for (_, v), g in zip(values, gaps[1:]))))
        plan[1000 + i] = (values, gaps)
    docs(spark, rows + EDGE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pseudonyms.KEY_SETTING, "one secret")
    try:
        got = llm_queries.op2_pii(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)
    assert len(got) == len(rows) + len(EDGE)
    shape = {"email": r"[\w.]+@[\w.]+\.org", "card": r"\d{15,16}", "ip": r"(?:\d{1,3}\.){3}\d{1,3}", "date": r"\d{4}-\d\d-\d\d", "iban": r"DE\d{20}", "phone": r"\+\d\d \d\d \d{4} \d{4}", "ssn": r"\d{3}-\d\d-\d{4}"}
    names = {}
    for r in got:
        if (r["doc_id"], r["text"]) in EDGE:
            continue
        values, gaps = plan[r["doc_id"]]
        m = re.fullmatch(re.escape(gaps[0]) + "".join(f"({shape[k]}){re.escape(g)}" for (k, _), g in zip(values, gaps[1:])), r["text"])
        assert m, r
        count = {}
        for (k, old), new in zip(values, m.groups()):
            count[k] = count.get(k, 0) + 1
            assert names.setdefault((k, old), new) == new != old
            assert k != "card" or luhn(new[:-1]) == new
            assert k != "iban" or iban(new[4:]) == new
            assert k != "date" or dt.date.fromisoformat(new)
            assert k != "ip" or max(map(int, new.split("."))) < 256
        assert r["pii"] == count
    assert len(set(names.values())) == len(names) and {(r["doc_id"], r["text"]) for r in got} >= set(EDGE)
    assert pseudonyms.secret_key(spark) == pseudonyms.secret_key(spark) != b"one secret"


def test_pseudonyms_on_a_cluster_without_a_secret(spark, monkeypatch, caplog):
    """A key is drawn for the application, with a warning; all its jobs share it."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(pseudonyms, "_drawn", {})
    df = docs(spark, [(1, "mail ann.lee@example.com"), (2, "to ann.lee@example.com")])
    first, again = ({r["doc_id"]: r["text"].split()[-1] for r in pseudonyms.pseudonymise(df).collect()} for _ in range(2))
    assert first == again and first[1] == first[2] != "ann.lee@example.com"
    assert len([r for r in caplog.records if pseudonyms.KEY_SETTING in r.getMessage()]) == 1


def naive_kind(value):
    """What a value is by plain parsing, or None."""
    import ipaddress

    digits = [int(c) for c in value if c.isdigit()]
    if re.fullmatch(r"[a-z0-9.]+@[a-z]+\.[a-z]+", value):
        return "email"
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value):
        try:
            return ipaddress.IPv4Address(value) and "ip"
        except ValueError:
            return None
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9 ]+", value):
        packed = value.replace(" ", "")
        return "iban" if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else None
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
        try:
            return "date" if 1900 <= dt.date.fromisoformat(value).year <= 2099 else None
        except ValueError:
            return None
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value):
        area, group, serial = value.split("-")
        return "ssn" if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None
    if re.fullmatch(r"[0-9]{4}( [0-9]{4}){3}", value):
        doubled = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        return "card" if doubled % 10 == 0 and len(set(digits)) > 1 else None
    return "phone" if re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", value) else None


def test_pseudonyms_against_a_plain_reader(spark):
    """Values and near misses between words: exactly the valid ones change, each to a valid one of its kind and layout, one for one."""
    rng = random.Random(9)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{rng.choice('abc')}{number(2)}.x@host{rng.choice('xyz')}.org".replace("host", "mail"), lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 33):02d}",
        lambda: f"{rng.choice(['000', '666', number(3)])}-{rng.choice(['00', number(2)])}-{rng.choice(['0000', number(4)])}", lambda: " ".join(number(4) for _ in range(4)), lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: (lambda rest: f"DE{rng.choice([pseudonyms.iban_check('DE', rest), 11]):02d} " + " ".join(rest[i : i + 4] for i in range(0, 18, 4)))(number(18)), lambda: rng.choice(["word", "v1.2", "3", "1990", "@home", "a@b", "12-34", "x9", "7.5 kg,"]),
    ]
    texts = [[rng.choice(makers)() if k % 2 else rng.choice(["und", "the (", "ü漢;", "and\n"]) for k in range(rng.randrange(1, 40))] for _ in range(300)]
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs(spark, [(i, " | ".join(t)) for i, t in enumerate(texts)]), key=b"k").collect()}
    there, changed = {}, 0
    for i, parts in enumerate(texts):
        out = got[i].split(" | ")
        assert len(out) == len(parts)
        for old, new in zip(parts, out):
            kind = naive_kind(old)
            changed += old != new
            assert naive_kind(new) == kind if kind else new == old, (old, new)
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", old)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", new)) or kind == "ip"
            assert there.setdefault((kind, old), new) == new
    valid = {k: v for k, v in there.items() if k[0]}
    assert changed > 500 and len({(k[0], v) for k, v in valid.items()}) == len(valid) and {k[0] for k in valid} == {"email", "ip", "date", "ssn", "card", "phone", "iban"}


def test_pseudonymise_edges(spark):
    got = pseudonymise_rows = pseudonyms.pseudonymise(docs(spark, EDGE, pii="clash"))
    by = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert by == set(EDGE) and pseudonymise_rows.count() == len(EDGE) and dict(got.dtypes)["pii"] == "map<string,int>"
    assert pseudonyms.pseudonymise(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 3 tokens

TEXTS = [x or "" for _, x in EDGE] + ["Don't stop. It's 12.5% <|endoftext|>. x<|startoftext|>y", "<|ENDOFTEXT|>foo, A<|endoftext|>B. <|EndOfText|>x!", "a\x1cb \u0085 c\u00a0d", "x'. 'S 've. ... ?!", "É é İ ΑΣ, Σ.", "tab\tnew\nline\r\x0b\x0c."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_match_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(x)) for x in TEXTS]
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        want = [len(model.encode(x, add_special_tokens=False)) for x in TEXTS]
    assert tokens.counter(path).by_piece == (name == "word_bpe_49k.json")
    got = tokens.count_tokens(docs(spark, list(enumerate(TEXTS)), n_tokens="clash"), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == want
    assert [r["n_bytes"] for r in got] == [len(x.encode()) for x in TEXTS]
    assert [r["over_limit"] for r in got] == [n > 2048 for n in want]


def test_token_counts_of_nothing(spark):
    got = tokens.count_tokens(docs(spark, EDGE), VOCAB).where("doc_id in (0, 1, 7)").collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(0, 0, False)] * 3
    assert tokens.count_tokens(docs(spark, []), VOCAB).count() == 0
    assert list(tokens.by_bytes(np.array([2, 2, 9, 1]), 4)) == [(0, 2), (2, 3), (3, 4)] and list(tokens.by_bytes(np.zeros(0, int))) == []


def test_token_counts_of_rare_and_frequent_pieces(spark, monkeypatch):
    """Pieces of every kind, repeated and not, over several batches, with runs that end inside a text."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    stems = ["Wort", "élan", "Straße", "don't", "x", "İstanbul", "e\u0301", "a1b2", "漢字", "<|endoftext|>", "<|EndOfText|>a", "Æ", "ŉ", "ÀB", "…", "a&b", "$5"]
    texts = ["\t ".join(rng.choice(stems) + rng.choice(["", "", ".", ",", "!?", "'s", ")", "'"]) + (str(rng.randrange(99)) if rng.random() < 0.1 else "") for _ in range(rng.randrange(60))) + rng.choice(["", " ", "\n"]) for _ in range(120)]
    monkeypatch.setattr(tokens, "RUN", 7)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    model = Tokenizer.from_file(VOCAB)
    count = tokens.PieceCounter(VOCAB)
    assert count._encode_plain
    got = [n for a in range(0, 120, 30) for n in count(tokens.pa.array(texts[a : a + 30]))]
    assert got == [len(model.encode(x, add_special_tokens=False)) for x in texts]


# ---------------------------------------------------------------- 4 urls


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if None not in (h, p, v) and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_against_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b", "", "block"), ("a.b", "", "allow"), (None, "/", "block"), ("org", "/", "allow")]
    urls = [None, "", "nothing", "http://", "http://ORG/", "https://x.Example.ORG/es/1?q#f", "http://example.org/en/172", "http://notexample.org/es/", "ftp://a.b.com/de/x", "http://b.com/fr", "http://b.com/fr/", "x://a.b", "x://c.a.b?x=/", "http://..org/a", "http://É.org/é", "http://x.com/de/" + "y" * 5000] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit("clash")})
    got = urlrules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judged(u, rules) for i, u in enumerate(urls)}
    none = urlrules.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.count() == len(urls) and none.where("rule is not null").count() == 0
    assert urlrules.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_more_rules_than_are_broadcast(spark):
    few = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("com", "/fr/", "allow"), ("com", "/fr/", "block")]
    many = spark.range(urlrules.BROADCAST_RULES).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/p").alias("path"), F.lit("block").alias("verdict"))
    rules = many.union(spark.createDataFrame(few, "host string, path string, verdict string"))
    # one host suffix in most urls
    urls = [f"http://h{i * 7}.org/{'pq'[i % 2]}{i}" for i in range(3000)] + [f"http://x.h{i}.org/p" for i in range(99_990, 100_010)]
    urls += [None, "nothing", "http://EXAMPLE.org/es/1", "http://b.com/fr/2", "http://b.com/de/?q", "http://net/"] * 2
    got = urlrules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    named = {(f"h{i}.org", "/p"): "block" for i in range(urlrules.BROADCAST_RULES)}

    def plain(url):
        host, path, rule, verdict = judged(url, few)
        mine = ".".join(host.split(".")[-2:])
        return (host, path, mine + "/p", "block") if (mine, "/p") in named and path.startswith("/p") else (host, path, rule, verdict)

    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: plain(u) for i, u in enumerate(urls)}


def test_urls_of_many_labels(spark):
    """Long hosts and paths cost time in proportion to their length."""
    rules = [("org", "/", "allow"), ("b.a.org", "/x", "block"), (".org", "", "block")]
    urls = ["http://" + "a." * 200_000 + "org/x", "http://b.a.org/" + "x" * 500_000, "http://" + "b.a." * 50_000 + "b.a.org/xy"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"HOST": F.lit(1), "Rule": F.lit(2)})
    got = urlrules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judged(u, rules) for i, u in enumerate(urls)}


# ---------------------------------------------------------------- 5 leaks

ITEMS = [
    (0, "A train leaves Boston at 30 km per hour and reaches Dover after 12 hours. How far is it from Boston to Dover along this line?"),
    (1, "if a shop sells seven red apples and three green pears each morning what does it sell in a week"),
    (2, None), (3, ""), (4, "tiny item"), (5, "1 + 2 = 3 4 5 6 7 8"),
    (6, "if a shop sells four red apples and nine green pears each morning what does it sell in a week"),
]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = words(random.Random(1), 60)
    rows = [
        *EDGE, (20, filler), (21, f"{filler} {ITEMS[0][1]} {filler}"), (22, f"{filler}. {ITEMS[1][1].upper()} {filler}"),
        (23, ITEMS[0][1].replace("Boston", "Paris").replace("Dover", "Rome").replace("30", "75").replace("12", "8")),  # other parameters, consistent
        (24, "A train leaves Paris at 75 km per hour and reaches Rome after 8 hours. How far is it from Oslo to Bern along this line?"),  # other names in the same slots
        (25, "so 1 + 2 = 3 4 5 6 7 8 it is"), (26, "so 2 + 3 = 4 5 6 7 8 9 it is"), (27, "a tiny item here"), (28, " ".join(ITEMS[1][1].split()[:9])), (29, f"{ITEMS[1][1]} {filler} {ITEMS[1][1]}"),
    ]
    got = decontam.contaminated(docs(spark, rows, item_id=5, coverage=1.0), items).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert {d for d, _ in found} == {21, 22, 23, 25, 27, 29}
    assert found[22, 1]["n_items"] == 2 and found[23, 0]["reparameterised"] and not found[21, 0]["reparameterised"] and found[22, 1]["items"] == [1] and found[23, 0]["items"] == []
    assert found[25, 5]["coverage"] == 1 and (27, 4) in found and len(got) == len(found)
    assert decontam.contaminated(docs(spark, []), items).count() == 0
    assert decontam.contaminated(docs(spark, rows), items.limit(0)).count() == 0


def read_windows(text):
    """Tokens (canonical, value) and windows: for each place the readings (tuple, length), the first of them first."""
    tokens, end, number = [], 0, False
    for m in re.finditer(r"[0-9](?:[.,]?[0-9])*|[^\W\d_]+", text or ""):
        w, low = m[0], m[0].lower()
        opens = not tokens or re.search(r'[.!?:;\n"(]', text[end : m.start()])
        is_number = low[0].isdigit() or low in decontam.NUMBER_WORDS
        unit = number and low in decontam.UNITS
        capital = w[0].isupper() and not w.isupper() and not is_number and not unit
        canon = "#NUM" if is_number else "#UNIT" if unit else low
        tokens.append(("#NAME" if capital and not opens else canon, "#NAME" if capital else canon, low))
        end, number = m.end(), is_number
    size = min(5, len(tokens))
    out = []
    for i in range(len(tokens) - size + 1 if tokens else 0):
        win = tokens[i : i + size]

        def read(which):
            slots = sum(t[which] != t[2] for t in win)
            return tuple(t[2] for t in win) if slots * 2 > (size if size == 5 else 0) else tuple(t[which] for t in win)

        readings = [(read(1), size)] + ([(read(0), size)] if any(t[0] != t[1] for t in win) else [])
        wide = tokens[i : i + 9]
        if size == 5 and sum(t[1] != t[2] for t in win) > 2 and len(wide) == 9 and sum(t[1] == t[2] for t in wide) >= 4:
            readings.append((tuple(t[1] for t in wide), 9))
        out.append(readings)
    return [(t[1], t[2]) for t in tokens], out


def true_leaks(docs_, items, share=0.8):
    forms = {}
    for i, text in sorted(items):
        tokens, wins = read_windows(text)
        if tokens:
            values = [v for _, v in tokens]
            pattern = tuple(values.index(v) if c != v else None for c, v in tokens)
            forms.setdefault((tuple(c for c, _ in tokens), pattern, tuple(w[0] for w in wins)), []).append((i, tokens, wins))
    rows = []
    for d, text in docs_:
        doc_tokens, doc_wins = read_windows(text)
        for members in forms.values():
            item, tokens, wins = members[0]
            stands = {}
            for i, w in enumerate(wins):
                stands.setdefault(w[0], (w[0][0], i, w[0][1]))
            for i, w in enumerate(wins):
                for x in w[1:]:
                    stands.setdefault(x, (w[0][0], i, x[1]))
            n = len({w[0][0] for w in wins})
            hits = [(p, x) for p, w in enumerate(doc_wins) for x in dict.fromkeys(w) if x in stands]
            best, named = 0, set()
            classes = list(dict.fromkeys(v for c, v in tokens if c != v))
            own = lambda t: list(dict.fromkeys(v for c, v in t if c != v))
            hits.sort(key=lambda h: (h[0], stands[h[1]][1:]))
            for first in range(len(hits)):
                for span in (len(wins) - 1, int(1.5 * len(wins)) + 8):
                    use = [h for h in hits[first:] if h[0] - hits[first][0] <= span]
                    if len({stands[x][0] for _, x in use}) / n < share:
                        continue
                    pairs, votes = [], {}
                    for p, x in use:
                        kind, i, size = stands[x]
                        slots = [(tokens[i + k][1], doc_tokens[p + k][1]) for k in range(size) if tokens[i + k][0] != tokens[i + k][1]]
                        pairs.append((kind, slots))
                        for s in slots:
                            votes[s] = votes.get(s, 0) + 1
                    there = {}
                    for a, b in sorted(votes, key=lambda s: -votes[s]):
                        if a not in there and b not in there.values():
                            there[a] = b
                    good = len({kind for kind, slots in pairs if all(there.get(a) == b for a, b in slots)}) / n
                    if good >= share:
                        best = max(best, good)
                        wanted = [there[c] for c in classes] if len(there) == len(classes) else classes if all(a == b for a, b in there.items()) else None
                        named |= {i for i, t, _ in members if own(t) == wanted}
            if best:
                rows.append((d, min(named, default=item), len(members), round(best, 9), not named, tuple(sorted(named))))
    return rows


def test_leaks_against_brute_force(spark):
    """Random items of every shape in random documents: verbatim, with other values, partly changed, in other cases; every row is right and none is missing."""
    rng = random.Random(3)
    names, units = ["Tom", "Anna", "McCoy", "Paris", "Oslo", "Eve"], ["km", "hours", "kg", "dollars"]

    def sentence(form):
        out = []
        for kind in form:
            out.append(rng.choice(names) if kind == "N" else f"{rng.randrange(2, 99)} {rng.choice(units)}" if kind == "U" else str(rng.randrange(2, 9999)) if kind == "#" else kind)
        return " ".join(out)

    shapes = [[rng.choice(["N", "#", "U", *[f"w{rng.choice('abcdefghijk')}"] * 5]) for _ in range(rng.randrange(3, 26))] for _ in range(25)]
    shapes += [["N", "has", "#", "apples", ". N", "buys", "U", "more", ". How", "many"], ["U", "by", "U", "by", "U", "wa", "is", "U", "wb", "wc", "wd"], ["#", "#", "#", "#", "#"]]
    shapes = [[x.replace(". N", f". {rng.choice(names)}") for x in s] for s in shapes]
    items = [(i, sentence(rng.choice(shapes))) for i in range(60)]
    items += [(100 + k, items[k][1]) for k in range(5)] + [(200, "Tom has 3 apples. Tom buys 4 km more. How many apples does Tom have"), (201, "Anna has 5 apples. Anna buys 9 km more. How many apples does Anna have")]
    rows = []
    for i in range(150):
        passage = rng.choice(items)[1] if i % 3 else sentence(rng.choice(shapes))
        passage = passage.split()
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            passage[rng.randrange(len(passage))] = "changed"
        passage = " ".join(passage)
        passage = passage.lower() if i % 7 == 1 else passage
        rows.append((i, f"{words(rng, 12, 60)}{rng.choice(['. ', ' ', ', '])}{passage} {words(rng, 9, 60)}"))
    rows += [(300, "Eve has 8 apples. Eve buys 2 km more. How many apples does Eve have"), (301, "Eve has 8 apples. Tom buys 2 km more. How many apples does Oslo have"), (302, items[60 + 6][1])]
    # several stretches of one item in a text: other values, mixed values, the very words, in both orders
    turns_ = [x for _, x in items[200:] or items[-2:]] + ["Eve has 8 apples. Anna buys 9 km more. How many apples does Paris have", "Oslo has 77 apples. Oslo buys 8 km more. How many apples does Oslo have"]
    for k in range(60):
        parts = [rng.choice([*turns_, items[k % 60][1], sentence(rng.choice(shapes)), words(rng, rng.randrange(1, 30), 60)]) for _ in range(rng.randrange(2, 6))]
        rows.append((400 + k, rng.choice([" ", ". ", f" {words(rng, 20, 60)} "]).join(parts)))
    got = [(r["doc_id"], r["item_id"], r["n_items"], round(r["coverage"], 9), r["reparameterised"], tuple(r["items"])) for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(true_leaks(rows, items))
    assert len(got) > 60 and any(x[4] for x in got) and any(len(x[5]) > 1 for x in got)
    assert {x[0] for x in got} >= {300, 302} and 301 not in {x[0] for x in got}


def test_copies_after_inconsistent_variants(spark):
    """A variant with mixed values doesn't hide the item itself, wherever it stands; all values of a template are listed."""
    item = "Tom has 3 apples and gives 3 apples to Anna before he buys 9 pears and sells 9 pears at the market near the river"
    mixed = "Tom has 5 apples and gives 8 apples to Anna before he buys 9 pears and sells 4 pears at the market near the river"
    other = item.replace("3", "6").replace("9", "2")
    filler = words(random.Random(4), 300)
    items = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows = [(1, f"{mixed} {filler} {item}"), (2, f"{item} {filler} {mixed}"), (3, f"{mixed} {filler} {mixed}"), (4, f"{mixed} {item} {mixed}"), (5, f"{other} {item}"), (6, f"{item} " * 300 + other)]
    got = {r["doc_id"]: r["items"] for r in decontam.contaminated(docs(spark, rows), items).collect()}
    assert got == {1: [1], 2: [1], 4: [1], 5: [1, 2], 6: [1, 2]}


# ---------------------------------------------------------------- 6 shards


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    rows = [*EDGE, *[(100 + i, words(rng, rng.randrange(1, 60))) for i in range(900)], *[(2000 + i, "copied text of a hot group") for i in range(1500)]]
    got = shards.shard_by_bytes(docs(spark, rows, shard=3, size=9, slot=1), 8).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    small = got[got["size"] < 1e5]
    sums = got.groupby("shard")["size"].sum()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    heavy = got.loc[got["size"].idxmax(), "shard"]  # one text outweighs a shard
    assert sums.drop(heavy).max() <= got["size"].sum() / 8 + small["size"].max() and sorted(got.loc[got["doc_id"] == 0, "size"]) == [1]
    even = shards.shard_by_bytes(docs(spark, [r for r in rows if r[0] != 4]), 8).toPandas().groupby("shard")["size"].sum()
    assert len(even) == 8 and even.max() - even.min() <= 2 * small["size"].max()


def test_shard_query_against_brute_force(spark, tmp_path):
    """The whole query with a hot text: sizes, checksums and law by hand; shards as even as single rows allow; one order through all shards and slots; one exchange of the rows."""
    import zlib

    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 40))) for i in range(600)] + [(1000 + i, "one hot text") for i in range(400)] + [x for x in EDGE if x[0] != 4]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    result = llm_queries.op6_sharding(spark, str(tmp_path))
    got = result.collect()
    size = lambda x: len((x or "").encode()) + 1
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"])) for r in got) == sorted(str((i, size(x), zlib.crc32((x or "").encode()), "bytes", None)) for i, x in rows)
    share = sum(size(x) for _, x in rows) / 8
    held = [[r for r in got if r["shard"] == k] for k in range(8)]
    assert all(abs(sum(r["size"] for r in h) - share) <= 2 * max(size(x) for _, x in rows) and sorted(r["slot"] for r in h) == list(range(len(h))) for h in held)
    line = [r["text_crc32"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a != b for a, b in zip(line, line[1:])) <= len({x for _, x in rows}) - 1  # equal texts are neighbours; a null and an empty one have one checksum
    assert result._jdf.queryExecution().executedPlan().toString().count("rangepartitioning") == 0


@pytest.mark.parametrize("cells", [1, 5, 250])
def test_borders_fit_their_tolerance(spark, cells):
    rng = random.Random(cells)
    rows = [(rng.choice([5, 5, 5, -(1 << 63), (1 << 63) - 1, rng.getrandbits(63)]), rng.getrandbits(62), rng.randrange(1, 30)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, w long")
    found = shards.find_borders(df, ["a", "b"], "w", 4, tolerance=0.01, probes=8, cells=cells)
    total = sum(w for *_, w in rows)
    flat = [k for shard in found for k in shard]
    assert [len(s) for s in found] == [cells] * 4 and flat == sorted(flat)
    for i, k in enumerate(flat):
        below = sum(w for a, b, w in rows if (a, b) < k)
        assert abs(below - total * i / (4 * cells)) <= (0.01 * total / 4 if i % cells == 0 else 0.1 * total / (4 * cells)) + 30
    counted = shards.with_place(df, ["a", "b"], flat, "p").collect()
    assert all(r["p"] == sum(k <= (r["a"], r["b"]) for k in flat) for r in counted)


def test_shards_of_equal_and_no_rows(spark):
    same = shards.shard_by_bytes(docs(spark, [(1, "x")] * 50), 4).toPandas()
    assert sorted(same["slot"]) == list(range(50)) and same["shard"].nunique() == 1
    assert shards.shard_by_bytes(docs(spark, []), 4).count() == 0
    assert set(shards.shard_by_bytes(docs(spark, [(1, "x")]), 4).toPandas()["slot"]) == {0}


def test_gapless_rank_with_null_groups(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(7)], "g long, k long")
    got = gapless_rank(df, "g", ["k"], "r").collect()
    assert all(r["r"] == r["k"] for r in got) and len(got) == 12


# ---------------------------------------------------------------- 7 near duplicates


def true_components(rows, size, percent):
    sets, by_row = {}, []
    for n, (i, x) in enumerate(rows):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        sets[n] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i if i is not None else -1, len(sets[n]), (least.get(find(n), -1) if sets[n] else i)) for n, (i, _) in enumerate(rows))


def near_rows(rng, n=60, copies=6):
    rows = []
    for _ in range(n):
        base = words(rng, rng.randrange(3, 60), 5000).split()
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("region", [512, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "SENT_IDS", 200_000 if region > 4 else 3)
    rng = random.Random(region)
    hot = words(rng, 80, 5000).split()
    rows = near_rows(rng) + [(1000 + i, " ".join([*hot[:k], f"v{i}", *hot[k + 1 :]])) for i, k in enumerate(rng.randrange(80) for _ in range(30))]
    rows += [(2000, "A b C d e"), (2001, "a B c D E"), (2002, "a b c"), (2003, "A B C"), (2004, "a b"), (2005, " a  b "), (2006, "É é"), (2007, "é é")]
    got = neardup.near_duplicates(docs(spark, rows, component_id=1, kept=True)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == true_components(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark):
    got = neardup.near_duplicates(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"]) for r in got) == [x[:2] for x in true_components(EDGE, 4, 80)]
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(0, 0), (1, 1), (2, 2), (5, 5), (6, 5), (7, 7)} <= by
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    """Two texts under one id, and texts without an id: each has its own links."""
    rng = random.Random(12)
    a, b, c, d = ([f"{x}{rng.randrange(9999)}" for _ in range(60)] for x in "abcd")
    near = lambda w: " ".join([*w[:30], "changed", *w[31:]])
    rows = [(1, a), (1, b), (2, near(a).split()), (3, near(b).split()), (9, c), (None, near(c).split()), (0, d), (0, a[:20]), (7, near(d).split()), (7, d[:20]), (None, b[:25]), (None, b[:25]), (8, a[:20])]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()]
    want = [(1, 57, 1, True), (1, 57, 1, True), (2, 57, 1, False), (3, 57, 1, False), (9, 57, 9, True), (None, 57, 9, False), (0, 57, 0, True), (0, 17, 0, True), (7, 57, 0, False), (7, 17, 7, True), (None, 22, None, True), (None, 22, None, True), (8, 17, 0, False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(str(r[2]) for r in got) == sorted(str(x[2]) for x in want)


@pytest.mark.parametrize("star", [64, 2])
def test_recall_inside_large_regions(spark, monkeypatch, star):
    """Documents that share most words: all pairs above the threshold are joined though every region is read deeper, however stars are dealt."""
    monkeypatch.setattr(neardup, "REGION", 8)
    monkeypatch.setattr(neardup, "STAR", star)
    rng = random.Random(star)
    common = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = [f"x{i}_{k}" for k in range(110)]
        near = own[:]
        for k in rng.sample(range(110), 8):
            near[k] = f"y{i}_{k}"
        rows += [(i, " ".join(common + own)), (1000 + i, " ".join(common + near))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert sorted((i, c) for i, c in got.items()) == sorted((i, c) for i, _, c in true_components(rows, 4, 80))


def test_near_duplicates_in_a_region_above_its_bound(spark, monkeypatch):
    """Sets of one template and words of their own: pairs of them at the threshold, none alike the leader, under every split of the work."""
    rng = random.Random(5)
    template, own = [f"t{i}" for i in range(85)], iter(f"o{i}" for i in itertools.count())
    rows, pairs = [], []
    for k in range(40):
        both = [next(own) for _ in range(4)]  # 89 of 111 words shared: 0.802; others share 85 of 115: 0.739
        pairs.append((1000 + k, 2000 + k))
        rows += [(i, " ".join(rng.sample(template + both + [next(own) for _ in range(11)], 100))) for i in pairs[-1]]
    rows += [(i, " ".join(template + [next(own) for _ in range(15)])) for i in range(220)]
    monkeypatch.setattr(neardup, "REGION", 32)
    for block in (neardup.BLOCK, 1600):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), size=1).collect()}
        missed = sum(got[b] != a for a, b in pairs)
        assert missed == 0 and all(got[i] == i for i, _ in rows if i < 2000)


def test_crowded_links_of_common_shingles_by_blocks(spark, monkeypatch):
    """Every shingle is common: a component of 30 sets and sets outside it are compared block by block."""
    rng, names = random.Random(6), [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(names, 33))) for i in range(120)]
    sets = {i: set(x.split()) for i, x in rows}
    monkeypatch.setattr(neardup, "BLOCK", 600)
    reps, others = neardup._classes(neardup._signatures(docs(spark, rows), "doc_id", "text", 1))
    assert others.isEmpty()
    roots = spark.createDataFrame([(i, 0) for i in range(1, 30)], "node long, root long")
    got = [(r["a"], r["b"]) for r in neardup.crowded_links(docs(spark, rows), reps, reps.select("rep"), roots, "doc_id", "text", 1, 80).collect()]
    true = [(a, b) for a, b in itertools.combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]

    def parts(links):
        of = {i: 0 if i < 30 else i for i in sets}
        for a, b in links:
            x, y = sorted((of[a], of[b]))
            of = {i: x if c == y else c for i, c in of.items()}
        return of

    assert set(got) <= set(true) and 1 < len(set(parts(true).values())) < 91 and parts(got) == parts(true)


# ---------------------------------------------------------------- 8 audio


@settings(max_examples=40, deadline=None)
@given(hs.binary(max_size=5000))
def test_payload_round_trip(payload):
    media = mpeg.write_payload(payload)
    found = mpeg.parse(media)
    assert mpeg.read_payload(media, found) == payload
    assert found["crc_bad"] == 0 and found["skipped"] == 0 and found["table_ok"] and found["samples"] == 1152 * found["frames"] and found["table"]["bytes"] == found["audio_bytes"]
    assert all(mpeg.header(media[o : o + 4]) for o in found["offsets"])


def test_damaged_streams():
    media = mpeg.write_payload(bytes(range(256)) * 40)
    clean = mpeg.parse(media)
    assert clean["frames"] == 8
    cut = clean["offsets"][3]
    broken = media[:cut] + b"\xff\xfbgarbage\xff" + media[cut:-128] + b"TAG" + b"Some title".ljust(30, b"\0") + bytes(95)
    found = mpeg.parse(broken)
    assert found["frames"] == clean["frames"] and found["resyncs"] == 1 and found["skipped"] == 10 and found["tags"]["title"] == "Some title"
    assert mpeg.read_payload(broken, found) == bytes(range(256)) * 40
    at = clean["offsets"][2] + 7
    assert mpeg.parse(media[:at] + b"\x55" + media[at + 1 :])["crc_bad"] == 1
    lost = mpeg.parse(media[: clean["offsets"][5]] + media[clean["offsets"][6] :])
    assert lost["frames"] == 7 and not lost["table_ok"]
    for junk in (b"", b"\xff", b"\xff" * 3000, bytes(500), b"ID3\x03\0\0\x7f\x7f\x7f\x7f"):
        assert mpeg.parse(junk)["frames"] == 0


@pytest.mark.parametrize("size", [64, 256, 512, 1024, 3008])
def test_tags_inside_a_payload_stay_payload(size):
    """TAG and ID3 at every place: each byte comes back, also where a stream ends with its last frame instead of a tag."""
    for word in (b"TAG", b"ID3", b"TAG\xff\xfb\xe8\xc4", b"\xff\xfa\xe8\xc4"):
        for at in range(size - len(word) + 1):
            payload = bytes(at) + word + b"x" * (size - len(word) - at)
            for media in (mpeg.write_payload(payload), mpeg.write_payload(payload)[:-128]):
                found = mpeg.parse(media)
                assert mpeg.read_payload(media, found) == payload and found["skipped"] == 0 and found["crc_bad"] == 0 and found["table_ok"], (word, at)


def crc_of(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ b
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@pytest.mark.parametrize("head,widths,doubled", [
    (b"\xff\xfe\x90\x00", [4] * 64, 0),  # layer I stereo
    (b"\xff\xfe\x90\xc0", [4] * 32, 0),  # layer I mono
    (b"\xff\xfc\xa4\x00", [4] * 22 + [3] * 24 + [2] * 8, 1),  # layer II, 192 kbit/s stereo at 48 kHz
    (b"\xff\xfc\xa0\x00", [4] * 22 + [3] * 24 + [2] * 14, 1),  # layer II, 192 kbit/s stereo at 44.1 kHz
    (b"\xff\xfc\x28\xc0", [4] * 2 + [3] * 10, 1),  # layer II, 48 kbit/s mono at 32 kHz
])
def test_checksums_of_layers_one_and_two(head, widths, doubled):
    rng = random.Random(8)
    fields = [rng.randrange(1 << w) if rng.random() < 0.7 else 0 for w in widths]
    bits = [f >> (w - 1 - k) & 1 for f, w in zip(fields, widths) for k in range(w)] + [rng.randrange(2) for _ in range(2 * doubled * sum(f > 0 for f in fields))]
    cover = [b >> (7 - k) & 1 for b in head[2:] for k in range(8)] + bits
    bits += [1, 0, 1, 1] + [0] * (-len(bits) - 4 & 7)
    body = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    size = mpeg.header(head)[5]
    frame = (head + crc_of(cover).to_bytes(2, "big") + body).ljust(size, b"\0")
    found = mpeg.parse(frame * 3)
    assert (found["frames"], found["crc_ok"], found["crc_bad"]) == (3, 3, 0)
    bad = bytearray(frame)
    bad[7] ^= 0x40
    assert mpeg.parse(bytes(bad) * 3)["crc_bad"] == 3


def test_header_sizes():
    assert mpeg.header(b"\xff\xfb\x90\x00")[3:7] == (128, 44100, 417, 1152)
    assert mpeg.header(b"\xff\xfb\x92\x00")[5] == 418
    assert mpeg.header(b"\xff\xf3\x80\x00")[3:7] == (64, 22050, 208, 576)
    assert mpeg.header(b"\xff\xff\x90\x00")[2:7] == (False, 288, 44100, 312, 384)
    assert mpeg.header(b"\xff\xfb\xf0\x00") is None and mpeg.header(b"\xff\xeb\x90\x00") is None


def test_media_columns_and_text_media(spark):
    rows = [(0, bytearray(mpeg.write_payload(b"x" * 3000))), (1, None), (2, bytearray(b"no audio"))]
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumn("n_frames", F.lit("clash"))
    got = {r["doc_id"]: r for r in mpeg.media_columns(df).collect()}
    assert got[0]["n_frames"] == 3 and got[0]["duration_s"] == 0.108 and got[0]["tags"] == {"payload_bytes": "3000"} and len(got[0]["seek_offsets"]) == 3
    assert got[1]["n_frames"] == got[2]["n_frames"] == 0 and got[2]["skipped_bytes"] == 8
    import hashlib

    out = mpeg.text_media(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    import zlib

    def row(i, x):
        raw = (x or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        return i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])

    assert sorted(map(str, (tuple(r)[:5] for r in out))) == sorted(str(row(i, x)) for i, x in EDGE) and mpeg.text_media(docs(spark, [])).count() == 0
    assert all(r["media_bytes"] > r["payload_bytes"] and r["feature"].startswith("mpeg1 layer3 ") and " 0bad " not in r["feature"] and "+0bad" in r["feature"] for r in out)


def plain_frames(media):
    """Offsets of the frames after the leading tag, header by header, where they end, and their sample rate."""
    at, rate, seen = 10 + sum(b << s for b, s in zip(media[6:10], (21, 14, 7, 0))), 0, []
    while media[at] == 0xFF and media[at + 1] >> 1 == 0x7D:
        kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[media[at + 2] >> 4]
        rate = (44100, 48000, 32000)[media[at + 2] >> 2 & 3]
        seen.append(at)
        at += 144_000 * kbps // rate + (media[at + 2] >> 1 & 1)
    return seen, at, rate


def test_media_query_against_a_plain_reader(spark, tmp_path):
    """Every column of the query: stored bytes by the writer, frames and seek offsets by walking over headers."""
    import hashlib
    import zlib

    rng = random.Random(12)
    rows = [*EDGE, *[(100 + n, "x" * n) for n in (63, 64, 65, 1365, 1366, 1367)], *[(200 + i, words(rng, 40 * i)) for i in range(1, 8)], (300, "ID3 TAG Xing \u00ff" * 400)]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    def row(i, text):
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = mpeg.write_payload(padded)
        (_, *frames), end, rate = plain_frames(media)  # the first one holds the table
        assert media[end : end + 3] == b"TAG" and len(media) == end + 128
        seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in frames))
        shape = (str(len(frames)), str(1152 * len(frames)), str(rate), f"{seek:08x}")
        return (i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest(), shape)

    got = llm_queries.op8_mpeg_audio(spark, str(tmp_path)).collect()
    read = [(*tuple(r)[:7], re.search(r"frames=(\d+) samples=(\d+)/(\d+) .*table=ok .*seek=(\w+)$", r["feature"]).groups()) for r in got]
    assert sorted(map(str, read)) == sorted(str(row(*r)) for r in rows)


def test_media_keys_named_like_an_output(spark):
    with pytest.raises(ValueError, match="name of an output"):
        mpeg.text_media(docs(spark, EDGE).withColumn("Payload_Bytes", F.lit(1)), key="Payload_Bytes")


# ---------------------------------------------------------------- 9 packing


@settings(max_examples=60, deadline=None)
@given(hs.dictionaries(hs.integers(0, 80), hs.integers(1, 9), min_size=1, max_size=9), hs.integers(1, 4))
def test_borders_are_optimal(cells, k):
    lengths, counts = np.array(sorted(cells)), np.array([cells[x] for x in sorted(cells)])
    pad = lambda b: sum(c * (min(x for x in b if x >= v) - v) for v, c in cells.items())
    best = min(pad((*s, int(lengths[-1]))) for r in range(min(k, len(lengths))) for s in itertools.combinations(lengths[:-1].tolist(), r))
    got = packing.best_borders(lengths, counts, k)
    assert len(got) <= k and pad(got) == best


def test_packing_is_optimal_beyond_any_length(spark):
    """Least padding over every choice of borders, and as few batches as the budget allows, with lengths far above 32,768."""
    cells = {10: 3, 32_700: 2, 33_001: 5, 33_002: 1, 40_017: 2, 70_001: 1, 70_123: 4, 900_001: 1}
    rows = [(i, n) for i, n in enumerate(n for n, c in cells.items() for _ in range(c))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("_Length", F.lit(1)).withColumn("_at", F.lit(2)), buckets=3, budget=100_000).toPandas()
    pad = lambda b: sum(c * (min(x for x in b if x >= v) - v) for v, c in cells.items())
    assert got["padding"].sum() == min(pad((*s, 900_001)) for s in itertools.combinations(list(cells)[:-1], 2)) and "_Length" in got.columns
    for bucket, g in got.groupby("bucket"):
        assert g["batch"].nunique() == -(-len(g) // max(1, 100_000 // bucket))


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 3, 10, 10, 50, 700])) for i in range(300)] + [(1000, None), (1001, 90_000), (None, 3), (5, 3), (5, 3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("batch", F.lit("clash")), buckets=4, budget=1000).toPandas()
    assert len(got) == len(rows) and (got["padding"] >= 0).all()
    for (bucket, _), g in got.groupby(["bucket", "batch"]):
        assert sorted(g["place"]) == list(range(len(g))) and (len(g) * max(bucket, 1) <= 1000 or len(g) == 1)
    for _, g in got.groupby("bucket"):
        assert sorted(g["batch"].unique()) == list(range(g["batch"].nunique()))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_packing_query_against_brute_force(spark, tmp_path):
    """Token counts by the tokenizer itself, least padding over all choices of 16 borders, and batches within the budget."""
    from tokenizers import Tokenizer

    rng = random.Random(13)
    rows = [*EDGE, *[(100 + i, words(rng, rng.randint(1, 300))) for i in range(60)]]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = llm_queries.op9_packing(spark, str(tmp_path)).toPandas()
    count = Tokenizer.from_file(llm_queries.vocabulary())
    want = [len(count.encode(text or "", add_special_tokens=False).ids) for _, text in rows]
    key = lambda pairs: sorted((-1 if np.isnan(float(i)) else int(i), int(n)) for i, n in pairs)
    assert key(zip(got["doc_id"], got["n_tokens"])) == key((np.nan if i is None else i, n) for (i, _), n in zip(rows, want))
    lengths = sorted(set(want))
    pad = lambda a, b: sum(lengths[b] - n for n in want if lengths[a] <= n <= lengths[b])
    least = [0] + [float("inf")] * len(lengths)
    for _ in range(16):
        least = [0] + [min(least[j + 1], *(least[a] + pad(a, j) for a in range(j + 1))) for j in range(len(lengths))]
    assert len(lengths) > 16 and got["bucket"].nunique() <= 16 and got["padding"].sum() == least[-1]
    assert (got["padding"] == got["bucket"] - got["n_tokens"]).all()
    for bucket, g in got.groupby("bucket"):
        room = max(1, 65_536 // max(bucket, 1))
        assert sorted(zip(g["batch"], g["place"])) == [(i // room, i % room) for i in range(len(g))]


# ---------------------------------------------------------------- 10 toxicity


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    for part, rounds in ((1 / 8, (1, 2)), (2.0, (3,)), (0.0, (100,))):  # some, no and many dense lists
        monkeypatch.setattr(toxicity, "DENSE_PART", part)
        monkeypatch.setattr(toxicity, "ROUNDS", rounds)
        rows = rng.random((300, 40)) * (rng.random((300, 40)) < np.linspace(0.02, 0.3, 40))
        rows = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        rows[::7] = rows[0]  # ties
        queries = np.concatenate([rows[:50], np.zeros((2, 40), np.float32), np.eye(40, dtype=np.float32)[:1]])
        index = toxicity.BlockMaxIndex(*np.nonzero(rows), rows[np.nonzero(rows)], 300, 40)
        cosine, ids = index.search(*np.nonzero(queries), queries[np.nonzero(queries)], len(queries), 15)
        full = np.round(queries @ rows.T, 6)
        for q, c, i in zip(full, cosine, ids):
            order = np.lexsort((np.arange(len(q)), -q))[:15]
            order = order[q[order] > 0]
            assert np.allclose(c[: len(order)], q[order], atol=2e-6) and np.allclose(q[i[: len(order)]], q[order], atol=2e-6) and (i[len(order) :] == -1).all()
            assert len(set(i[i >= 0])) == len(order)
    assert (toxicity.BlockMaxIndex(*np.zeros((2, 0), int), np.zeros(0), 0, 0).search(*np.zeros((2, 0), int), np.zeros(0), 2, 3)[1] == -1).all()


def test_toxicity_query_against_brute_force(spark):
    """The whole query on the smallest tables: every term of every labelled text, plain cosines, votes and calibration."""
    import zlib

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the test tables aren't here")
    got = {r["doc_id"]: r for r in llm_queries.op10_toxicity(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not held(r["doc_id"])}

    def counts(text):
        n = {}
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
            for term in ([("word", w)] if w else []) + ([("begin", w[:4])] if len(w) > 4 else []):
                n[term] = n.get(term, 0) + 1
        return n

    terms = {i: counts(x) for i, x in texts.items() if x is not None}
    examples = {}
    for i in sorted(marks):
        if i in terms:
            examples.setdefault((texts[i], marks[i]), i)
    known = {t for i in examples.values() for t in terms[i]}
    df = {}
    for n in terms.values():
        for t in n:
            df[t] = df.get(t, 0) + 1
    total, base = len(marks), sum(marks.values()) / len(marks)
    y = {i: marks[i] for i in examples.values()}
    up = sum(marks.values()) / sum(y.values())
    down = (total - sum(marks.values())) / (len(y) - sum(y.values()))
    share = lambda t: [sum(1 for i in y if y[i] == k and t in terms[i]) for k in (1, 0)]
    weight = {}
    for t in known:
        pos, neg = share(t)
        p = (pos * up + 10 * base) / (pos * up + neg * down + 10)
        weight[t] = np.log((1 + len(terms)) / (1 + df[t])) * (0.02 + max(0, (p - base) / (1 - base)) ** 2)
    outside = np.log((1 + len(terms)) / 2) * 0.02

    def vector(n):
        x = {t: (1 + np.log(c)) * weight.get(t, outside) for t, c in n.items()}
        size = np.sqrt(sum(v * v for v in x.values())) or 1
        return {t: v / size for t, v in x.items()}

    vectors = {i: vector(n) for i, n in terms.items()}

    def raw(i):
        near = sorted(((round(sum(v * vectors[j].get(t, 0) for t, v in vectors.get(i, {}).items()), 6), j) for j in y), reverse=True)
        return [(c, j) for c, j in near if c > 0]

    def votes(near):
        w = [(c * c * (1 if y[j] else down / up), y[j]) for c, j in near[:15]]
        return (sum(a * b for a, b in w) + 0.5 * base) / (sum(a for a, _ in w) + 0.5)

    own = [(votes([(c, j) for c, j in raw(i) if j != i]), y[i], 1 if y[i] else down / up) for i in y]
    own.sort()
    value, label, w = (np.array(x, dtype=float) for x in zip(*own))
    steps = [max(min((label[a:b] * w[a:b]).sum() / w[a:b].sum() for b in range(k + 1, len(own) + 1)) for a in range(k + 1)) for k in range(len(own))]
    close = 0
    for i, r in got.items():
        near = raw(i)
        assert np.allclose([e["cosine"] for e in r["evidence"]], [c for c, _ in near[:3]], atol=2e-5), i
        v = votes(near)
        close += abs(r["score"] - np.clip(0.98 * np.interp(v, value, steps) + 0.02 * v, 0, 1)) < 2e-3
        assert r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.3)
    assert set(got) == set(texts) and close >= 0.98 * len(got)  # a few lie where near ties among examples move a step


def test_isotonic_never_falls():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0, 1, 1, 0, 1]), np.ones(5))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and y[0] == 0


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(8)
    bad = lambda i: words(rng, 30) + rng.choice([" dreadful", " horrible"]) + " " + words(rng, 10)
    rows = [(i, bad(i) if i % 5 == 0 else words(rng, 40)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (9999, None), (300, 2)], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, rows), labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, [*rows[300:], *[(i if i is None else i + 5000, x) for i, x in EDGE]], score="clash"), model).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(300, 400))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5000]["predicted"] == 0 and got[300]["evidence"][0]["doc_id"] % 5 == 0
    assert got[5005]["score"] == got[5006]["score"]
    nothing = toxicity.learn(docs(spark, rows), labels.limit(0))
    assert toxicity.score_toxicity(docs(spark, EDGE), nothing).where("score = 0").count() == len(EDGE)
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0
