import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, retrieval

WORDS = [f"w{i}" for i in range(300)]


def docs(spark, n=400, seed=0):
    r = random.Random(seed)
    texts = [" ".join(["the"] * r.randint(1, 3) + [WORDS[min(299, int(r.expovariate(0.03)))] for _ in range(r.randint(1, 60))]) for _ in range(n)]
    texts += [None, "", "...", texts[3], texts[3], "the " * 5000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def asked(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(WORDS[:150]) for _ in range(r.randint(1, 12)))) for i in range(30)]
    rows += [(100, "the"), (101, "the the W5"), (102, "nowhere"), (103, ""), (104, None), (105, "w299"), (106, "w0 nowhere the")]
    return spark.createDataFrame(rows, "q long, text string")


def same(a, b, *order):
    a, b = (sorted(map(tuple, x.select(*order, "score", "rank").collect())) for x in (a, b))
    assert len(a) == len(b) and all(x[:2] == y[:2] and x[3] == y[3] and x[2] == pytest.approx(y[2], abs=2e-6) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("k", "segment_rows", "first", "block_bytes"), [(5, 16, 2, 16 << 20), (3, 50, 1, 2000), (20, 7, 4, 16 << 20), (1, 4096, 4, 16 << 20)])
def test_search_equals_the_scan(spark, tmp_path, k, segment_rows, first, block_bytes):
    d, q, path = docs(spark), asked(spark), str(tmp_path / "i")
    index.build_postings(d, path, "doc_id", segment_rows=segment_rows, buckets=8)
    got = index.search_text(spark, path, q, "q", "doc_id", k=k, first=first, block_bytes=block_bytes)
    same(got, retrieval.bm25(d, q, "doc_id", "q", k=k), "q", "doc_id")


def test_blocks_are_bounded_and_tell_their_best(spark, tmp_path):
    path = str(tmp_path / "i")
    index.build_postings(docs(spark), path, "doc_id", segment_rows=16, buckets=4)
    blocks = spark.read.parquet(f"{path}/blocks").where("bucket >= 0").collect()
    assert max(r.n for r in blocks) <= 16 and all(len(r.ords) == len(r.weights) == r.n for r in blocks)
    assert all(r.best == sorted(r.weights, reverse=True)[: index.BEST] for r in blocks)
    common = [r for r in blocks if r.term == "the"]
    assert len(common) > 20 and len({r.segment for r in common}) == len(common)
    keys = [k for r in spark.read.parquet(f"{path}/blocks").where("bucket = -1").collect() for k in r["keys"]]
    assert sorted(keys) == list(range(406))


def test_only_the_folders_of_asked_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    index.build_postings(docs(spark), path, "doc_id", segment_rows=16, buckets=64)
    one = spark.createDataFrame([(1, "w7")], "q long, text string")
    meta = spark.read.parquet(f"{path}/meta").first()
    rows = [r.asDict() for r in one.select(F.col("q").alias("k"), F.array(F.lit("w7")).alias("t")).collect()]
    _asked, _terms, buckets = index._asked(path, spark, rows, meta)
    assert len(buckets) == 1
    read = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(buckets))
    assert all(f"bucket={buckets[0]}/" in f for f in read.select("n").inputFiles()) or read.select(F.input_file_name()).distinct().count() <= 5
    same(index.search_text(spark, path, one, "q", "doc_id", k=4), retrieval.bm25(docs(spark), one, "doc_id", "q", k=4), "q", "doc_id")


def test_segments_that_cannot_matter_are_passed_over(spark, tmp_path, monkeypatch):
    n = 640
    texts = [f"common word{i % 7}" + (" rare rare" if i in (3, 500) else "") for i in range(n)]
    path = str(tmp_path / "i")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index.build_postings(d, path, "doc_id", segment_rows=16, buckets=4)
    held, stored = [], index.folders.stored
    monkeypatch.setattr(index.folders, "stored", lambda df, name: held.append((name, x := stored(df, name))) or x)
    q = spark.createDataFrame([(1, "rare common")], "q long, text string")
    same(index.search_text(spark, path, q, "q", "doc_id", k=2), retrieval.bm25(d, q, "doc_id", "q", k=2), "q", "doc_id")
    pairs = sum(x.count() for name, x in held if name == "index-pairs")
    assert pairs <= 4  # of 40 segments, all of which have the common word


def test_empty_index_and_queries(spark, tmp_path):
    path = str(tmp_path / "i")
    index.build_postings(docs(spark).limit(0), path, "doc_id")
    assert index.search_text(spark, path, asked(spark), "q", "doc_id").count() == 0
    index.build_postings(docs(spark), str(tmp_path / "j"), "doc_id")
    assert index.search_text(spark, str(tmp_path / "j"), asked(spark).limit(0), "q", "doc_id").count() == 0


def vectors(spark, n=600, d=8, seed=2):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, d)) * 3
    v = base[r.integers(0, 12, n)] + r.normal(size=(n, d)) * 0.4
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    rows += [(n + i, rows[5][1], 1) for i in range(40)]  # one vector many times
    rows += [(-1, None, 0), (-2, [0.0] * d, 0), (-3, [float("nan")] * d, 0), (-4, [1.0, None] + [0.0] * (d - 2), 0), (-5, [float("inf")] * d, 0)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(4)


@pytest.mark.parametrize(("k", "first", "threshold", "block_bytes"), [(5, 1, None, 32 << 20), (12, 3, None, 3000), (24, 2, 0.9, 32 << 20), (50, 1, None, 32 << 20)])
def test_vector_search_equals_the_scan(spark, tmp_path, k, first, threshold, block_bytes):
    points, path, seen = vectors(spark), str(tmp_path / "v"), []
    index.build_vectors(points, path, "vec_id", "v", ["label"], cells=24)
    q = points.where("vec_id % 20 = 0 or vec_id < 0").select(F.col("vec_id").alias("q"), "v")
    got = index.search_vectors(spark, path, q, "q", "vec_id", "v", k, threshold, first, block_bytes, seen)
    same(got, retrieval.dense(q, points, "q", "vec_id", "v", k, threshold), "q", "vec_id")
    assert k > 24 or sum(a for a, _ in seen) < 0.7 * sum(b for _, b in seen)  # cells passed over
    assert spark.read.parquet(f"{path}/vectors").count() == 640  # no vector is left out


def test_dense_leaves_out_what_has_no_direction_and_searches_each_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, 1.0, 0.0]), (8, None), (9, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.dense(df.withColumnRenamed("id", "q"), df, "q", "id", "v", 5)
    assert sorted((r.q, r.id, r["rank"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (6, 6, 1), (6, 7, 2), (7, 6, 2), (7, 7, 1)]


def test_whole_index(spark, tmp_path):
    path = str(tmp_path / "i")
    d = docs(spark, 60).withColumn("title", F.concat(F.lit("t"), "doc_id"))
    index.build(d, path, "doc_id", payload=["title"], cells=4, segment_rows=16)
    assert {r.title for r in spark.read.parquet(f"{path}/vectors").select("title").collect()} <= {f"t{i}" for i in range(70)}
    assert index.search_text(spark, path, asked(spark), "q", "doc_id").count() > 0
    with pytest.raises(ValueError, match="one length"):
        index.build_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "i long, v array<double>"), path, "i", "v")


def test_index_rows_counts_once(spark):
    rows = retrieval.index_rows(spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "B")], "id long, text string"), "id").collect()
    assert {r.id: {t: round(w, 4) for t, w in r.sparse.items()} for r in rows} == {1: {"a": pytest.approx(1.12, abs=0.3), "b": pytest.approx(0.8, abs=0.3)}, 2: {}, 3: {}, 4: {"b": pytest.approx(1.0, abs=0.4)}}
