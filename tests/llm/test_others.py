import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, sharding, toxicity, url_reputation
from tests.llm import corpus

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def check_shards(got, n):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n and set(by) <= set(range(24))
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("rows", [corpus.rows(1, 200), [(1, "a")], [], [(7, "same")] * 50 + [(None, "x")] * 30], ids=["mixed", "one", "none", "repeated"])
def test_sharding(spark, rows):
    got = sharding.assign(corpus.frame(spark, rows)).collect()
    check_shards(got, len(rows))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def walk(keys, shards, points, nodes, load):
    """One row after the other in ring order, as the operator's walk defines it."""
    room = list(load)
    carried, placed = [], {}
    arcs = {}
    for h, k in sorted(keys):
        node = next((i for i, (at, _s) in enumerate(nodes) if h <= at), 0)
        arcs.setdefault(node, []).append((h, k))
    if 0 in arcs:  # what lies over the end of the ring ranks last in the first arc
        arcs[0] = sorted(arcs[0], key=lambda x: (x[0] > nodes[0][0], x))
    for turn in range(2):
        for i, (_at, s) in enumerate(nodes):
            own = [k for _, k in arcs.get(i, [])] if turn == 0 else []
            take, before = own[: room[s]], list(carried)
            guests = before[: room[s] - len(take)]
            for k in take + guests:
                placed[k] = s
            room[s] -= len(take) + len(guests)
            carried = before[len(guests) :] + own[len(take) :]
    return placed


def test_sharding_is_the_ring_walk(spark):
    rows = [(i, "t") for i in range(500)]
    got = {r.doc_id: r.shard for r in sharding.assign(corpus.frame(spark, rows), points=8).collect()}
    nodes = [(r["at"], r["shard"]) for r in sharding._ring(spark, 24, 8).orderBy("node").collect()]
    hashes = {r.id: r.h for r in spark.range(500).select("id", F.shiftrightunsigned(F.xxhash64("id"), 64 - sharding.BITS).alias("h")).collect()}
    load = [500 // 24 + (i < 500 % 24) for i in range(24)]
    assert got == walk([(h, k) for k, h in hashes.items()], 24, 8, nodes, load)


def test_a_new_shard_moves_few_rows(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before, after = (sharding.assign(docs, shards=n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (24, 25))
    moved = before.join(after, "doc_id").where("s24 <> s25").count() / 20000
    assert 1 / 25 < moved < 0.25  # dealing by the id modulo the number of shards moves 0.96


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/71?x#y", "https://example.com#f", "x://h?q://z/", "http://b.net/de/1", "http://example.net/de/81", "https://q.org/es/", "http://spamcom/en/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://b.net/x", None, None)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(3, 0, 1), (3, 1, None), (None, 0, 0), (99, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.filter_urls(pages, labels).collect()}
    assert len(got) == len(urls) + 1
    assert [(got[i].host, got[i].path) for i in range(6)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/71"), ("example.com", ""), ("h", "")]
    assert [got[i].rule for i in range(10)] == [None, None, None, "example.com/en/7", None, None, "net/de/", "example.net/de/8", "org/es/", None]
    assert [got[i].verdict for i in (3, 6, 7, 8)] == ["allow", "block", "block", "block"]
    assert url_reputation.filter_urls(pages.where("false"), labels).count() == 0
    assert url_reputation.filter_urls(pages, labels.where("false")).count() == len(urls) + 1


def test_reputation_shrinks_and_blocks(spark):
    rows = [(f"bad.site{k % 3}.com", k % 10 > 0) for k in range(300)] + [(f"good.site{k % 3}.org", k % 10 == 0) for k in range(300)] + [("new.site0.com", True)] * 2
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.site0.com"].lower > 0.7 > got["good.site0.org"].mean
    assert got["new.site0.com"].lower < got["new.site0.com"].mean < 1


def test_language_on_small_corpus(spark):
    docs = corpus.frame(spark, [(1, "the cat and the dog that this is"), (2, "le chat et les chiens que une est"), (3, None), (4, " 12 !? "), (5, "THE DOG"), (None, "les chats")])
    train = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "fr"))
    got = {r.doc_id: r for r in language.identify(docs, train, keep=("part", "n_words")).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "en", None: "fr"}
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language.identify(docs, train.where("false")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.identify(docs.where("false"), train).count() == 0


@needs_tables
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language.op2_hyperdimensional_language(spark, SF).join(docs, "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98


def test_toxicity_edges(spark):
    rows = [(i, ("you are a nasty blorb " if i % 2 else "what a lovely day ") + f"w{i} " * (i % 5)) for i in range(200)] + [(500, None), (501, ""), (502, "x" * 20000), (None, "you blorb")]
    docs = corpus.frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(160)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    late = {r.doc_id: r.predicted for r in got if r.doc_id is not None and 160 <= r.doc_id < 200}
    assert sum(late[i] == i % 2 for i in late) >= 0.95 * len(late)
    empty = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


def test_isotonic_of_equal_scores():
    for y in ([0, 1, 0], [1, 0, 0], [0, 0, 1]):
        x, v = toxicity.isotonic(np.array([1.0, 1, 1]), np.array(y, float))
        assert x.tolist() == [1] and v.tolist() == pytest.approx([1 / 3])
    x, v = toxicity.isotonic(np.array([3.0, 1, 2, 2]), np.array([1.0, 0, 1, 0]))
    assert x.tolist() == [1, 2, 3] and v.tolist() == [0, 0.5, 1]
    assert len(toxicity.isotonic(np.zeros(0), np.zeros(0))[0]) == 0


@needs_tables
def test_toxicity_held_out(spark):
    label = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op4_boosted_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(label, "doc_id").toPandas()
    rank, ones = rows["score"].rank(), rows["toxic"] == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.93


def test_url_sql_of_rows_without_id(spark, tmp_path):
    import duckdb

    urls = ["http://b.net/de/1", "http://example.net/de/8", "http://c.org/x", None, "http://b.net/de/1"]
    pages = spark.createDataFrame([(None, u) for u in urls] + [(1, urls[0]), (2, urls[2])], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    got = url_reputation.filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(url_reputation.OP5_SQL).fetchall()))


def test_learning_takes_one_text_of_an_id_and_keeps_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"text {i} you fool!" if i % 2 else f"plain words {i}") for i in range(4000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    seen = []
    kept = toxicity.B.cut
    monkeypatch.setattr(toxicity.B, "cut", lambda df: seen.append(x := kept(df)) or x)
    toxicity.fit(docs, labels)
    texts = [x for x in seen if "text" in x.columns][0].collect()
    assert len(texts) == 40 and {r.doc_id for r in texts} == set(range(40))
    seen.clear()
    toxicity.fit(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")), spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")), fit_rows=900)
    assert 600 < [x for x in seen if "text" in x.columns][0].count() <= 900


def test_a_tree_takes_the_best_split():
    """The first split against all splits of all features, by their gain."""
    import numpy as np

    r = np.random.default_rng(2)
    x, y = np.round(r.normal(size=(300, 4)), 1), (r.random(300) < 0.4).astype(float)
    y[x[:, 2] > 0.3] = 1
    b = toxicity.Boosted(trees=1, depth=1, bins=400).fit(x, y)
    p = np.full(300, y.mean())
    g, h = p - y, p * (1 - p)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + b.ridge)
    gains = {(f, c): score(x[:, f] < c) + score(x[:, f] >= c) - score(np.ones(300, bool)) for f in range(4) for c in b.cuts[f] if min(h[x[:, f] < c].sum(), h[x[:, f] >= c].sum()) >= 2}
    (feature, cut), most = max(gains.items(), key=lambda kv: kv[1])
    f, k, value = b.model[0]
    assert f[1] == feature == 2 and gains[f[1], b.cuts[2][k[1]]] == pytest.approx(most)
    side = x[:, 2] >= b.cuts[2][k[1]]
    assert b.decide(x)[side][0] == pytest.approx(b.base - b.rate * g[side].sum() / (h[side].sum() + b.ridge))
