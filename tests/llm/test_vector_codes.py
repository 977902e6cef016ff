import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, extra int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Every part to every entry, in Python's integers."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, total[lab], sha) for (i, _, lab), f, e in zip(kept, found, errors, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def test_nearest_equals_all_distances():
    r = np.random.default_rng(1)
    for d, k, spread in ((16, 256, 300), (3, 7, 3), (1, 5, 2), (4, 256, 2), (32, 40, 10**6)):
        x, book = r.integers(-spread, spread, (700, d)), r.integers(-spread, spread, (k, d))
        book[k // 2] = book[0]  # equal entries
        dist = ((x[:, None] - book[None]) ** 2).sum(2)
        index, least = V.nearest(x, book)
        assert np.array_equal(index, dist.argmin(1)) and np.array_equal(least, dist.min(1))


def test_nearest_takes_dimensions_by_variance():
    book = np.array([[0, 5, 1], [0, -5, 2], [0, 50, 3]])
    assert V.by_variance(book).tolist() == [1, 2, 0]


@pytest.mark.parametrize(("n", "entries"), [(30, 8), (12, 256), (90, 16)])
def test_codes_equal_brute_force(spark, n, entries):
    r = np.random.default_rng(n)
    rows = [(i, np.float32(r.normal(0, 0.1, 8)).tolist(), [None, 0, 1][i % 3]) for i in range(n)]
    rows += [(i, rows[i % 5][1], 1) for i in range(n, n + 20)]  # ties and repeated vectors
    bad = [(-1, None, 1), (-2, [0.5] * 7 + [None], 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, None)]
    got = V.product_codes(frame(spark, rows + bad), "vec_id", "embedding", "label", entries=entries)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, entries=entries)


def test_repeated_rows_lengths_and_large_numbers(spark):
    four = [(1, [0.1, 0.2, 0.3, 0.4], 5)] * 3 + [(2, [0.0, -0.1, 0.25, 1.0], 5)]
    eight = [(i, [i / 7.0] * 8, None) for i in range(5)]
    odd = [(50, [1.0] * 5, 5), (51, [1e30] * 4, None), (52, [], 9)]
    got = sorted(tuple(x) for x in V.product_codes(frame(spark, four + eight + odd), "vec_id", "embedding", "label").collect() if x.code is not None or x.vec_id in (50, 51))
    by = {x[0]: x for x in got}
    assert by[50][1:3] == (None, None) and by[51][1:3] == (None, None)
    assert by[50][3] == sum(x[2] for x in brute(four)) and by[52][1:4] == ("00000000", 0, 0)
    f = np.float32
    exact = lambda rows: brute([(i, f(v).tolist(), k) for i, v, k in rows])
    assert [x for x in got if x[0] in (1, 2) and x not in exact(eight)][:3] == exact(four)[:3]


def test_empty_table(spark):
    assert V.product_codes(frame(spark, []), "vec_id", "embedding", "label").count() == 0
    assert V.product_codes(frame(spark, [(1, None, 1)]), "vec_id", "embedding", "label").count() == 0
