"""Queries over whole inputs: nothing is cut off before it is counted, ranked or joined."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.chunking import split_text
from lodestone.operators import answers, embedding, retrieval
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def duck(sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con.execute(sql)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_context_has_the_whole_text_of_every_hit(spark):
    docs = {r.doc_id: r for r in catalog.read(spark, SF, "documents").collect()}
    hits = {}
    for r in catalog.hybrid_boost_postfilter_fallback(spark, SF).orderBy("item_id", "final_rank").collect():
        hits.setdefault(r.item_id, []).append(docs[r.doc_id])
    want = {i: md5("\n\n".join(f"### {x.source} ({x.lang})\n{x.text}" for x in xs)) for i, xs in hits.items()}
    assert any(len(x.text) > 500 for xs in hits.values() for x in xs)
    assert {r.item_id: r.md5 for r in catalog.context_listagg(spark, SF).collect()} == want


def test_prompt_has_the_whole_text_as_context(spark):
    rows = sorted(catalog.read(spark, SF, "conversations").collect(), key=lambda r: (r.conv_id, r.turn))
    want, last = {}, None
    for r in rows:
        past = last.text if last is not None and last.conv_id == r.conv_id else ""
        parts = [("History", past), ("Context", r.text), ("Question", r.text)]
        want[r.conv_id, r.turn] = md5("\n\n".join(f"### {h}\n{x}" for h, x in parts if x))
        last = r
    assert any(len(r.text) > 120 for r in rows)
    assert {(r.conv_id, r.turn): r.md5 for r in catalog.prompt_assembly(spark, SF).collect()} == want


def test_only_cache_items_are_cut(spark):
    hits = spark.createDataFrame([(1, k, f"t{k}", "x" * 600) for k in range(1, 9)], "q int, rank int, title string, text string")
    got = answers.cache_items(hits, "q", "rank", ["title"], "text").orderBy("rank").collect()
    assert [(r.title, len(r.text)) for r in got] == [(f"t{k}", 500) for k in range(1, 7)]


def test_hybrid_fuses_a_dense_and_a_sparse_list_of_four_times_k(spark):
    docs = [(r.doc_id, r.text or "") for r in catalog.read(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text or "") for r in catalog.read(spark, SF, "benchmark").collect()][:5]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def vector(t):
        v = [0.0] * 256
        for w in words(t):
            h = hashlib.md5(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 256] += 1 if h[4] < 128 else -1
        return v

    tf = {i: Counter(words(t)) for i, t in docs}
    mean = sum(sum(c.values()) for c in tf.values()) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    vectors = {i: vector(t) for i, t in docs}
    got = {}
    for r in catalog.hybrid_rrf_topk(spark, SF).collect():
        got.setdefault(r.item_id, {})[r.rank] = r.doc_id
    for item, text in items:
        q, v = Counter(words(text)), vector(text)
        size = lambda x: math.sqrt(sum(a * a for a in x))
        near = {i: round(sum(a * b for a, b in zip(v, w, strict=True)) / (size(v) * size(w)), 6) for i, w in vectors.items() if size(w)}
        sparse = {i: round(sum(n * idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, n in q.items() if c[w]), 6) for i, c in tf.items()}
        fused = Counter()
        for scores in (near, {i: s for i, s in sparse.items() if s > 0}):
            for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:16], 1):
                fused[i] += 1 / (60 + rank)
        want = sorted(fused, key=lambda i: (-round(fused[i], 6), i))[:16]
        assert [got[item][k] for k in sorted(got[item])] == want


def test_queries_in_blocks_find_the_same(spark):
    docs, items = catalog.read(spark, SF, "documents"), catalog.read(spark, SF, "benchmark")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieval.bm25(docs, items, "doc_id", "item_id", k=3, block_bytes=5000)) == rows(retrieval.bm25(docs, items, "doc_id", "item_id", k=3))
    points = catalog.read(spark, SF, "embeddings")
    asked = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    assert rows(retrieval.dense(asked, points, "q", "vec_id", "embedding", 3, block_bytes=2000)) == rows(retrieval.dense(asked, points, "q", "vec_id", "embedding", 3))


def test_searches_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (4, "a b a"), (None, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a"), (8, None), (9, "zzz")], "item_id long, text string")
    got = retrieval.bm25(docs, items, "doc_id", "item_id").collect()
    assert [(r.item_id, r.doc_id, r["rank"]) for r in got] == [(7, 3, 1), (7, 4, 2)]
    assert retrieval.bm25(docs.where("false"), items, "doc_id", "item_id").count() == retrieval.bm25(docs, items.where("false"), "doc_id", "item_id").count() == 0
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [1.0])], "id long, v array<double>")
    got = retrieval.dense(points.withColumnRenamed("id", "q"), points, "q", "id", "v", 5).where("q = 1").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (5, 1.0)]


def test_a_model_embeds_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(9)], "id long, text string")
    got = embedding.embed(df, "text", "v", lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch_rows=4).collect()
    assert {r.id: r.v and r.v[0] for r in got} == {i: None if i == 3 else float(i) for i in range(9)}
    assert all(r.v is None or r.v[1] <= 4 for r in got)


def test_chunks_are_counted_by_category(spark):
    sql = f"SELECT source, count(*) FROM ({catalog.oracle_sql()['split_text_chunks']}) JOIN documents USING (doc_id) GROUP BY source"
    got = {r.category: r.chunks for r in catalog.chunk_category_stats(spark, SF).collect()}
    assert got == dict(duck(sql).fetchall()) and sum(got.values()) > catalog.read(spark, SF, "documents").count()


def test_images_and_tables_are_counted_by_chunk(spark, tmp_path):
    plain = "word " * 400
    rows = [(1, f"{plain}![a](x.png)", "en", "s"), (2, f"a | b --- {plain}", "en", "s"), (3, "short", "en", "t"), (4, None, "en", "u")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.category: (r.chunks, r.with_images, r.with_tables) for r in catalog.chunk_category_stats(spark, str(tmp_path)).collect()}
    whole = sum(len(split_text(t)) for _, t, _, s in rows if s == "s")
    assert got == {"s": (whole, 1, 1), "t": (1, 0, 0)} and whole > 2
