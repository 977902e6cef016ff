import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann

KIND = "vec_id long, embedding array<float>, query string, rank long"


def brute(rows, k, step):
    """Of rows (vec_id, vector), each once: the nearest of as many numbers."""
    good = {(i, tuple(np.array(v, np.float32).astype(float))) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v))}
    good = [(i, np.array(v)) for i, v in good]
    out = {}
    for i, q in good:
        if i % step == 0:
            unit = q / np.sqrt(q @ q)
            out[i] = [(j, -s) for s, j in sorted((-(v / np.sqrt(v @ v)) @ unit, j) for j, v in good if j != i and len(v) == len(q))[:k]]
    return out


def found(df, step, **options):
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % step == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert x.rank == len(got[x.query_id])
    return got


def recall(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert len(got[q]) == len(want[q])
        scores = dict(want[q])
        for i, s in got[q]:  # those found have the scores that brute force gives them
            assert i not in scores or s == pytest.approx(scores[i], abs=1e-12)
    return sum(sum(a >= want[q][-1][1] - 1e-12 for _, a in got[q]) for q in want) / max(1, sum(map(len, want.values())))


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    hot = r.normal(size=16).tolist()
    rows = [(i, hot if i % 3 == 0 else (r.normal(size=16) + (i % 5)).tolist()) for i in range(700)]
    rows += [(1000, None), (1010, [0.0] * 16), (1020, [None, *[1.0] * 15]), (1030, [float("nan")] * 16), (1040, [float("inf"), *[1.0] * 15]), (1050, (np.array(hot) * 2).tolist())]
    rows += [(2000 + i, r.normal(size=d).tolist()) for i, d in enumerate([1, 1, 1, 3, 3, 3, 3, 70, 70, 70] * 6)]  # vectors of other lengths have their own search
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in rows], KIND)
    want = brute(rows, 5, 10)
    assert recall(found(df, 10), want) >= 0.98
    assert recall(found(df, 10, query_bytes=2000), want) >= 0.98  # several passes


def test_rows_that_repeat_an_id(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same)] * 7 + [(i, same) for i in range(1, 9)] + [(50, [3.0, 0.0, -1.0]), (7, [1.0, 2.0, 4.0])]
    got = found(spark.createDataFrame([(i, v, "", 0) for i, v in rows], KIND), 50)
    assert got[0] == [(i, pytest.approx(1.0, abs=1e-12)) for i in range(1, 6)]
    assert recall(got, brute(rows, 5, 50)) == 1.0


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    got = {}
    for x in ann.op1_one_bit_neighbours(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert recall(got, brute(rows, 5, 50)) >= 0.95


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", 0), (1, [1.0, 1.0], "", 0), (2, [1.0, 0.0], "", 0)], KIND)
    got = ann.nearest(df, F.lit(True)).where("query_id = 0").orderBy("rank").collect()
    assert [(x.rank, x.vec_id) for x in got] == [(1, 2), (2, 1)]
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("d", [64, 100])
def test_estimates_are_within_their_bounds(d):
    r = np.random.default_rng(5)
    v, q = r.normal(size=(2000, d)), r.normal(size=(20, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q /= np.linalg.norm(q, axis=1)[:, None]
    turn = ann.rotation(d)
    bits, scalar = ann.encode(v, turn)
    assert bits.shape == (2000, -(-d // 64)) and bits.dtype == np.uint64
    guess, unit = ann.Queries(q @ turn).estimate(slice(0, 20), bits, scalar)
    assert (np.abs(guess - q @ v.T) <= 2.5 * unit).mean() > 0.97
