import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from lodestone.functions import chunking
from lodestone.operators import index, retrieval
from lodestone.plans import catalog

MB = 1 << 20


def peak(make) -> tuple[list, float]:
    """What an iterable gives, and the most MB that were taken meanwhile."""
    tracemalloc.start()
    try:
        found = list(make())
        return found, tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


class Seen:
    """A table that keeps the function that it is given."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):
        self.run = run
        return self


def test_chunks_are_made_in_parts(spark):
    columns = ["doc_id", "title", "url", "category", "doc_type"]
    seen = Seen(spark.createDataFrame([], ", ".join(f"{c} string" for c in [*columns, "text"])).schema)
    chunking.chunks(seen)
    texts = [f"{i} " + "some words here. " * 150 for i in range(4000)]
    texts[7], texts[8] = "long. " * 400_000, None
    batch = pa.RecordBatch.from_pydict({c: [str(i) if c == "doc_id" else "x" for i in range(4000)] for c in columns} | {"text": texts})
    found = list(seen.run(iter([batch])))
    assert sum(x.num_rows for x in found) == 4000 and [k for x in found for k in x.column("doc_id").to_pylist()] == [str(i) for i in range(4000)]
    assert len(found) >= 10 and max(x.num_rows for x in found) <= 1024  # the long one stands alone
    assert [x.num_rows for x in found if "7" in x.column("doc_id").to_pylist()] == [1]


def asked(terms: int = 100, queries: int = 100):
    return retrieval._Asked([Row(k=q, t=[f"w{t}" for t in range(terms)]) for q in range(queries)])


@pytest.mark.parametrize("part_tokens", [1 << 17, 1 << 12])
def test_common_words_of_many_queries_are_met_in_parts(monkeypatch, part_tokens):
    a = asked()
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": [[f"w{t}" for t in range(100)] * (1 + i % 3) for i in range(1000)]})
    shared = SimpleNamespace(value=(a, np.ones(100), 200.0))
    run = retrieval._scored(shared, 3, 1.2, 0.75)
    whole, most = peak(lambda: run(iter([batch])))
    assert most < 120  # 10,000,000 pairs of a token and a query took 472
    monkeypatch.setattr(retrieval, "PART_TOKENS", part_tokens, raising=False)
    monkeypatch.setattr(retrieval, "PART_PAIRS", 1 << 14, raising=False)
    rows = lambda xs: sorted((r["q"], r["k"], round(r["score"], 9)) for x in xs for r in x.to_pylist())
    assert rows(run(iter([batch]))) == rows(whole) and len(rows(whole)) == 300  # the k best of the task


def test_a_segment_is_scored_in_parts():
    weighted = index._Weighted(asked(), np.ones(100))
    ords = list(range(1000))
    blocks = pa.table({"segment": [1] * 100, "at": pa.array(range(100), pa.int32()), "ords": pa.array([ords] * 100, pa.list_(pa.int32())), "weights": [[1.0 + o % 7 for o in ords]] * 100, "qs": [list(range(100))] * 100})
    (found,), most = peak(lambda: [index._scores(SimpleNamespace(value=weighted), 3)((pa.scalar(1),), blocks)])
    assert most < 120 and found.num_rows == 300
    assert set(found.column("ord").to_pylist()) == {6, 13, 20} and set(found.column("score").to_pylist()) == {700.0}


def test_index_rows_are_made_in_parts_of_the_same_tokens(spark, monkeypatch):
    texts = [(i, " ".join(f"w{i * j % 97}" for j in range(50)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    seen = retrieval.index_rows(df, "id")
    assert seen._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # weights and vectors in one pass
    from lodestone.operators.embedding import embed as by_hand

    want = {r.id: r.v for r in by_hand(df, "text", "v").collect()}
    got = {r.id: r for r in seen.collect()}
    assert {i: r.vector for i, r in got.items()} == want and got[9].sparse == {} and got[1].sparse.keys() == {f"w{j}" for j in range(50)}


def test_texts_of_the_sparse_search_get_no_vectors(spark, tmp_path):
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(20)], f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    hits = catalog.hybrid_rrf_topk(spark, str(tmp_path))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # vectors, cosines, scores
    assert hits.where("rank = 1 and item_id = doc_id").count() == 20
