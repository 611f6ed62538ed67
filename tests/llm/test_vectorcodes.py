"""Vector codes against plain loops, and edge cases."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import vectorcodes

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python integers."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    ordered = sorted(kept, key=lambda r: (r[0], r[1]))
    books = [[cut(v, p) for _, v, _ in ordered[:entries]] for p in range(parts)]
    near = lambda v, p: min((away(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            moved.append([[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = moved
    found = [(i, g, [near(v, p) for p in range(parts)]) for i, v, g in kept]
    errors = {}
    for _, g, at in found:
        errors[g] = errors.get(g, 0) + sum(d for d, _ in at)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), errors[g], digest) for i, g, at in found)


def coded(df):
    return sorted(tuple(r) for r in vectorcodes.compress(df).select("vec_id", "code", "error", "group_error", "codebooks_sha256").collect())


def test_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.4, (5, 16))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.1, 16)).astype("f4").tolist(), i % 3 if i % 7 else None) for i in range(300)]
    rows += [(300 + i, rows[4][1], 1) for i in range(200)] + [(7, rows[7][1], 1), (600, [0.0] * 16, 2), (601, [-1.0, 1.0] * 8, 2)]  # copies, a repeated id
    rows += [(-1, None, 1), (-2, [float("nan")] + [0.0] * 15, 1), (-3, [None] + [0.0] * 15, 1), (-4, [float("inf")] + [0.0] * 15, 9)]
    df = spark.createDataFrame(rows, ROWS)
    assert coded(df) == plain(rows)
    wide = df.repartition(7).withColumns({"code": F.lit("x"), "error": F.lit(1), "_v": F.lit(2), "_salt": F.lit(3), "group_error": F.lit(4)})
    assert coded(wide) == plain(rows)


def test_ties_take_the_lower_entry(spark):
    rows = [(0, [0.0] * 8, 0), (1, [0.0] * 8, 0), (2, [1.0] * 8, 0), (3, [0.5] * 8, 0)]
    assert coded(spark.createDataFrame(rows, ROWS)) == plain(rows)


def test_few_none_odd_and_huge_vectors(spark):
    assert coded(spark.createDataFrame([], ROWS)) == []
    assert coded(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 8, 1), (3, [], 1), (4, [1.0] * 7, 1)], ROWS)) == []
    mixed = [(1, [0.1] * 8, None), (2, [0.2] * 16, 1), (3, [0.3] * 8, None), (None, [0.4] * 8, 1), (5, [3e38] * 8, 2)]
    got = vectorcodes.compress(spark.createDataFrame(mixed, ROWS)).collect()
    assert {r["vec_id"] for r in got} == {1, 3, None, 5} and {r["error"] for r in got} == {0}  # each is an entry of its own


def test_cells_find_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(1)
    entries = rng.integers(-3000, 3000, (16, 3))
    x = np.concatenate([rng.integers(-4000, 4000, (5000, 3)), entries, entries + 1])
    cells = vectorcodes.Cells(entries)
    cells.most = 100  # the cache starts anew again and again
    index, away = zip(*(cells.nearest(part) for part in np.array_split(x, 9)))
    full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (np.concatenate(index) == full.argmin(axis=1)).all() and (np.concatenate(away) == full.min(axis=1)).all()
    assert cells.evaluated < full.size / 2
    same = vectorcodes.Cells(entries)
    same.salt = np.zeros_like(same.salt)  # every cell has one hash
    assert (same.nearest(x)[0] == full.argmin(axis=1)).all()


def test_decoding_is_within_the_error(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 8).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = vectorcodes.train(df)
    for r in vectorcodes.encode(df, books).collect():
        gap = (np.array(books.decode(r["code"])) - np.array(rows[r["vec_id"]][1])) * 4096
        assert abs((gap**2).sum() ** 0.5 - r["error"] ** 0.5) <= 8**0.5
