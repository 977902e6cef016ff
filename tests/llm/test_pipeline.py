"""Every stage against brute force, on its own input."""

import re

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute, corpus

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rows = [(i, t) for i, t in corpus.rows(8, 50)]
    passage = next(t for _, t in rows if t and len(t.split()) > 60)
    items = [(1, " ".join(passage.split()[20:45]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus.frame(spark, rows).select(*pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_passages", "packed_sequences"]
    key = lambda x: tuple("" if v is None else str(v) for v in x)

    def stage(k, rows):
        got = pipeline.STAGES[k][1](spark, corpus.frame(spark, rows).select(*pipeline.COLUMNS), str(tmp_path))
        if k < 4:
            assert got.columns == pipeline.COLUMNS
        return got.collect()

    kept = stage(0, rows)
    want = [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")]
    assert sorted(key(r[:2]) for r in kept) == sorted(map(key, want))

    rows = want
    kept = stage(1, rows)
    gone = {i for i, _n, c in brute.components(rows, 5, 80) if i is not None and c != i}
    first = {}
    for i, t in rows:  # one row of those that share an id
        k = i if i is not None else ("text", t)
        first[k] = min(first.get(k, (i, t)), (i, t), key=lambda x: x[1] or "")
    want = [x for k, x in first.items() if k not in gone]
    assert sorted(key(r[:2]) for r in kept) == sorted(map(key, want))

    rows = want
    kept = {key((r.doc_id,)) + (brute.sha(brute.blank_words(r.text)),): r for r in stage(2, rows)}
    judged = brute.substring_dedup(rows, 13)
    assert set(kept) == {key((i,)) + (sha,) for i, n, cut, sha in judged if cut == 0 or cut < n}
    texts = {(key((i,)), brute.sha(brute.blank_words(t))): t for i, t in rows}
    for (i, sha), r in kept.items():  # untouched texts are as they were
        if ((i,), sha) in texts:
            assert r.text == texts[(i,), sha]

    rows = [(r.doc_id, r.text) for r in kept.values()]
    kept = stage(3, rows)
    want = [(x[0], t) for x, (_i, t) in zip(brute.contamination(rows, items, 10), rows, strict=True) if not x[5]]
    assert sorted(key(r[:2]) for r in kept) == sorted(map(key, want)) and len(want) < len(rows)

    packed = stage(4, want)
    assert {r.doc_id for r in packed} == {i for i, _ in want}
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == {i for i, _ in want}


def test_repeated_rows_of_a_group(spark):
    """One row goes on of rows that share a group's smallest id, and of equal rows without id."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base), (1, "other words of the same id"), (2, base), (3, "alone here"), (None, base), (None, base), (None, "x y"), (None, None), (None, None)]
    docs = corpus.frame(spark, rows).select(*pipeline.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert len(got) == 5 and sorted((d for d, _ in got if d is not None)) == [1, 3]
    assert sorted(str(t) for d, t in got if d is None) == sorted([str(None), base, "x y"])
