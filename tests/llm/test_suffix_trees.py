"""Suffix trees in small groups, with hashes that tell nothing, and on their own."""

import random

import numpy as np
import pytest
from pyspark import cloudpickle

from lodestone.llm import substring_dedup
from tests.llm import brute, corpus


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize("hashes", ["good", "alike"])
def test_small_groups(spark, monkeypatch, hashes):
    """Chunks of a few documents, prefixes extended to the full depth, many groups; then all words hash alike."""
    if hashes == "alike":  # the module goes to the workers as it is here
        monkeypatch.setattr(substring_dedup.Chunk, "prefix", lambda self, at, n, before=None: np.zeros(len(at), np.uint64))
        monkeypatch.setattr(substring_dedup.Chunk, "whole", lambda self: np.zeros(len(self.at), np.uint64))
        cloudpickle.register_pickle_by_value(substring_dedup)
    monkeypatch.setattr(substring_dedup, "CODEBOOK", 20)  # most words are spelled
    try:
        rows = corpus.rows(5, 80)
        got = substring_dedup.remove_repeats(corpus.frame(spark, rows), 4, leaves=16, hashes=64, chunk_bytes=600).collect()
    finally:
        if hashes == "alike":
            cloudpickle.unregister_pickle_by_value(substring_dedup)
    assert sorted(key(r[:4]) for r in got) == sorted(key(r) for r in brute.substring_dedup(rows, 4))


def test_a_passage_that_all_share(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = substring_dedup.remove_repeats(corpus.frame(spark, rows), with_spans=True, leaves=8, chunk_bytes=2000).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == {i: [(2, 70)] if i else [] for i in range(300)}


def test_subtree():
    """Nodes against all pairs."""
    r = np.random.default_rng(3)
    words = r.integers(0, 3, (400, 5)).astype(np.int32)
    for depth in (1, 3, 5):
        order, begin = substring_dedup.subtree(words, depth)
        node = np.empty(400, int)
        node[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, 400)))
        for a in range(0, 400, 7):
            assert ((words[:, :depth] == words[a, :depth]).all(axis=1) == (node == node[a])).all()
    assert len(substring_dedup.subtree(np.zeros((0, 5), np.int32), 5)[1]) == 0


def test_counted_prefixes_bound_groups(spark):
    """No prefix that is left as it is has more leaves than asked for."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=400))) for i in range(40)]
    docs = corpus.frame(spark, rows).select("doc_id", "text")
    size = sum(len(t) for _, t in rows)
    homed = docs.mapInArrow(substring_dedup._pack(6, 500 / (4 * size), 3000), "chunk long, n long, counts binary, words binary, blob binary")
    split = substring_dedup._prefixes(homed, 6, 500)
    assert len(split[0]) and len(split[1])
    found = {}
    for row in homed.select("blob").collect():
        chunk = substring_dedup.Chunk(bytes(row.blob), 6)
        code, open_ = None, np.arange(len(chunk.at))
        for j in range(6):
            code = chunk.prefix(chunk.at[open_], j + 1, code)
            more = np.isin(code, split[j])
            for v, c in zip(*np.unique(code[~more], return_counts=True), strict=True):
                found[j, int(v)] = found.get((j, int(v)), 0) + int(c)
            open_, code = open_[more], code[more]
    assert max(found.values()) <= 500 and sum(found.values()) + len(open_) == 40 * 395
