import random

import pytest

from lodestone.llm import components, decontaminate, ngram_join, substring_dedup
from tests.llm import brute, corpus


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize("width", [3, 13])
def test_substring_dedup(spark, width):
    rows = corpus.rows(4, 90)
    got = substring_dedup.remove_repeats(corpus.frame(spark, rows), width, keep=("lang", "n_words", "text"), with_spans=True).collect()
    assert sorted(key(r[:4]) for r in got) == sorted(key(r) for r in brute.substring_dedup(rows, width))
    for r in got:
        assert sum(s.n_words for s in r.spans) == r.n_removed and r.lang == "en"


def test_substring_dedup_text(spark):
    rows = [(2, "a b c d  e"), (1, "x a b c y"), (3, "A\tB"), (4, None)]
    got = substring_dedup.remove_repeats(corpus.frame(spark, rows), 3, with_text=True).orderBy("doc_id").collect()
    assert [r.kept_text for r in got] == ["x a b c y", "d e", "A\tB", None]
    assert substring_dedup.remove_repeats(corpus.frame(spark, [])).count() == 0


def near_copies(seed):
    r = random.Random(seed)
    rows = corpus.rows(seed, 60)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    for i in range(60):  # a chain of copies with few and with many changes
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            copy[r.randrange(120)] = f"v{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(copy)))
    for i in range(40):  # small sets on the threshold
        rows.append((2000 + i, " ".join(base[a] for a in range(i % 7, i % 7 + r.choice([5, 8, 9, 10])))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = near_copies(seed)
    got = ngram_join.similar_components(corpus.frame(spark, rows), sketch_bits=12).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(rows, 5, 80)))


def test_ngram_join_with_frequent_tokens(spark, monkeypatch):
    """All tokens in the frequent class: the index is of combinations."""
    rows = near_copies(3)
    monkeypatch.setattr(ngram_join, "_sketch", lambda docs, width, bits: (__import__("numpy").full(1 << 12, 200, "uint8"), 1))
    got = ngram_join.similar_components(corpus.frame(spark, rows)).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(rows, 5, 80)))


def test_ngram_join_with_signatures_dealt_by_chunk(spark):
    """Everything that two documents of a chunk share is dealt by chunk, in small chunks, in worker processes too."""
    rows = near_copies(4)
    rows = [(i, t) for i, t in rows if t is None or len(t) < 4000]
    got = ngram_join.similar_components(corpus.frame(spark, rows), heavy=1, chunk_bytes=2000).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(rows, 5, 80)))


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_components(corpus.frame(spark, [])).count() == 0


def test_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (7, 7), (None, 3), (60, 100)], "u long, v long")
    got = {r.node: r.component for r in components.connected(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 50, 60: 50}


def test_decontamination(spark):
    r = random.Random(6)
    rows = corpus.rows(6, 60)
    texts = [t for _, t in rows if t and len(t) > 200]
    items = [(k, " ".join(r.choice(texts).split()[3:20])) for k in range(12)] + [(50, "one"), (51, ""), (52, None), (53, "two  WORDS"), (53, "a, b; c"), (53, "one a"), (54, "not there at all"), (None, "a b c"), (3, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(key(x) for x in brute.contamination(rows, items, 10))
    for block in (1 << 20, 200):  # one pass, then several
        got = decontaminate.benchmark_hits(corpus.frame(spark, rows), bench, block_bytes=block, keep=("lang", "text", "n_words")).drop("items").collect()
        assert sorted(key(x[:6]) for x in got) == want
        assert {(x.doc_id, x.text) for x in got} == set(rows) and {x.lang for x in got} == {"en"}
    assert decontaminate.benchmark_hits(corpus.frame(spark, rows), bench.where("false")).where("contaminated").count() == 0


def test_decontamination_is_its_sql(spark, tmp_path):
    """Null and repeated item ids, items that hit the same texts."""
    import duckdb

    items = [(3, "the red fox"), (3, "a blue bird"), (None, "red fox runs"), (4, "bird sings"), (5, None), (11, "RED fox"), (None, "")]
    docs = [(1, "See the red fox runs to a blue bird."), (2, "a Blue bird sings"), (3, None), (4, "fox red the"), (5, "red fox runs")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = decontaminate.op7_wu_manber_decontamination(spark, str(tmp_path))
    for t in ("benchmark", "documents"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({decontaminate.OP7_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [r[3] for r in sorted(want)] == [3, 2, 0, 0, 2]


def test_ngram_join_in_rounds(spark):
    """Many pairs near the threshold: what rounds decide is what all pairs decide."""
    import random

    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(70):
        words = base.copy()
        for k in r.sample(range(200), r.choice([2, 3, 4, 5, 6])):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    want = {k[0]: k[2] for k in map(tuple, brute.components(rows, 5, 80))}
    docs = corpus.frame(spark, rows).select("doc_id", "text")
    pairs = [(max(a, b), min(a, b)) for a in range(70) for b in range(a)]
    open_ = spark.createDataFrame([(u, v, u, v, 900 - (u * 7 + v) % 300) for u, v in pairs], "u long, v long, cu long, cv long, bound long")
    none = spark.createDataFrame([], "node long, component long")
    for rounds in (0, 1, 4):
        got = {x.node: x.component for x in ngram_join._joined(docs, open_, none, 5, 80, rounds).collect()}
        assert {i: got.get(i, i) for i in range(70)} == want
