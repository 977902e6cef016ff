"""What a worker holds, and what is moved, in the pipeline's stages."""

import weakref

import pyarrow as pa

import corpus_pipeline as pipeline
from lodestone.llm import ngram_join, substring_dedup
from tests.llm import corpus


def test_one_chunk_at_a_time(spark, monkeypatch):
    live, most = weakref.WeakSet(), []

    class Counted(substring_dedup.Chunk):
        def __init__(self, *a):
            live.add(self)
            most.append(len(live))
            super().__init__(*a)

    monkeypatch.setattr(substring_dedup, "Chunk", Counted)
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(f"w{i}" for i in range(50))] * 2)], ["doc_id", "text"])
    blob = substring_dedup._close([rows])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([blob] * 3, pa.binary()), pa.array([None] * 3, pa.list_(pa.binary()))], ["chunk", "blob", "marks"])
    list(substring_dedup._ask(13, 30, 1, 1)(iter([batch])))
    list(substring_dedup._remove(13, [], True, False, ["doc_id", "n_removed", "kept_text"])(iter([batch])))
    assert len(most) == 6 and max(most) == 1


def test_kept_rows_stay_where_they_are_read(spark):
    docs = corpus.frame(spark, [(i if i % 7 else None, f"text {i}") for i in range(300)]).select(*pipeline.COLUMNS)
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 9)], "id long")
    got = ngram_join.without(docs, gone)
    want = sorted((str(i) if i % 7 else "None", f"text {i}") for i in range(300) if not i % 7 or i % 9)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()  # it would go below the bitmap's join
