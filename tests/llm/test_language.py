"""Document vectors and cosines, one n-gram after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language
from tests.llm import corpus


def vector(text, dimensions):
    """Letters bound by place, bundled; runs of what is no letter are one boundary."""
    symbols = [0]
    for c in text:
        s = language.symbol(c)
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    letters = np.random.default_rng(23).integers(0, 2, (language.SYMBOLS, dimensions)).astype(int) * 2 - 1
    out = np.zeros(dimensions)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_scores_are_cosines(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus.rows(3, 60) if i is not None]
    lang = {i: "abc"[i % 3] for i, _ in rows}
    docs = corpus.frame(spark, rows)
    train = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, "abc")), (F.col("doc_id") % 3 + 1).cast("int")))
    sums = {k: sum(vector(t or "", 256) for i, t in rows if lang[i] == k) for k in "abc"}
    unit = language.prototypes(np.array([sums[k] for k in "abc"]))
    want = []
    for i, t in rows:
        v = vector(t or "", 256)
        cosine = unit @ v / max(np.linalg.norm(v), 1e-12)
        some = any(c.isalpha() for c in t or "")
        want.append((i, "abc"[int(cosine.argmax())] if some else "und", float(np.clip(cosine.max(), 0, 1)) if some else 0.0))
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, train, dimensions=256).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=1e-9)


def test_bundles_of_many_small_and_of_few_large_documents():
    r = np.random.default_rng(1)
    for n, most in ((1500, 4), (3, 9000)):
        doc = np.repeat(np.arange(n), r.integers(0, most, n))
        both = np.unique(doc * language.GRAMS + r.integers(0, language.GRAMS, len(doc)))
        doc, gram, count = both // language.GRAMS, both % language.GRAMS, r.integers(1, 9, len(both))
        got = language.bundles(doc, gram, count, n, 64)
        want = np.zeros((n, 64))
        np.add.at(want, doc, language.gram_vectors(gram, 64).astype(float) * count[:, None])
        assert (got == want).all()


def test_marks_are_no_letters(spark):
    docs = corpus.frame(spark, [(1, "the cat"), (2, "́̂ ̈"), (3, "é"), (4, "\U0001d510")])
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, docs.where("doc_id = 1")).collect()}
    assert got == {1: "en", 2: "und", 3: "en", 4: "en"}
