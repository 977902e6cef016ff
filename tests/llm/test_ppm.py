import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import ppm
from tests.llm import corpus


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(rows, held, order):
    """Plain PPM, one symbol after the other."""
    after = defaultdict(Counter)
    counts, n = Counter(), 0
    body = lambda t: b"\n" * order + " ".join(words(t)).encode() + b"\n"
    for (_i, t), h in zip(rows, held, strict=True):
        if not h:
            b = body(t)
            for i in range(order, len(b)):
                after[b[i - order : i]][b[i]] += 1
            counts.update([*words(t), "\n"])
            n += len(words(t)) + 1
    for k in range(order - 1, -1, -1):
        for longer in [x for x in after if len(x) == k + 1]:
            after[longer[1:]].update(after[longer].keys())
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        b, score = body(t), 0.0
        for j in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                have = {s: c for s, c in after.get(b[j - k : j], {}).items() if s not in gone}
                whole = 2 * sum(have.values())
                if b[j] in have:
                    score += math.log10((2 * have[b[j]] - 1) / whole)
                    break
                if have:
                    score += math.log10(len(have) / whole)
                gone |= set(have)
            else:
                score -= math.log10(256 - len(gone))
        tokens = [*words(t), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens)
        out.append((i, h, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_against_brute_force(spark, order):
    rows = corpus.rows(2, 24)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0 for i, _ in rows]
    column = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    got = [tuple(r) for r in ppm.score_documents(corpus.frame(spark, rows), column, order).collect()]
    key = lambda r: (-1 if r[0] is None else r[0], r[2], round(r[5], 3))
    got, want = sorted(got, key=key), sorted(brute(rows, held, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_nothing_to_learn_from(spark):
    got = ppm.score_documents(corpus.frame(spark, [(1, "ab"), (2, None)]), F.lit(True)).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx([-3 * math.log10(256), -math.log10(256)])
    assert ppm.score_documents(corpus.frame(spark, []), F.lit(False)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_texts_beat_the_base(spark):
    got = ppm.op10_ppm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_contexts_have_six_bytes_unless_asked_otherwise(spark):
    rows = corpus.rows(3, 24)
    held = [(i or 0) % 3 == 0 for i, _ in rows]
    got = ppm.score_documents(corpus.frame(spark, rows), F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 0).collect()
    want = brute(rows, held, 6)
    assert sum(r.score for r in got) == pytest.approx(sum(r[6] for r in want), rel=1e-5)
    assert sum(r.score for r in got) != pytest.approx(sum(r[6] for r in brute(rows, held, 5)), rel=1e-4)
