"""Small corpora with every awkward case, for brute-force comparison."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_words", T.StringType()),  # clashes with result columns
        T.StructField("part", T.StringType()),
    ]
)


def texts(seed=0, n=60, vocabulary=40):
    """Random texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(vocabulary * 20)]
    passage = " ".join(r.choice(words) for _ in range(30))
    out = [None, "", " \t\n", "one", "Two words.", "ONE", "a b c d", "a b c e", "A  b\tc d", "...", "x" * 5000]
    for i in range(n):
        body = [r.choice(words) for _ in range(r.choice([3, 6, 12, 13, 14, 40, 90, 300]))]
        kind = i % 6
        if kind == 1:
            body = body[:5] + passage.split() + body[5:]
        if kind == 2 and i > 8:
            body = out[-2].split() if out[-2] else body
            if len(body) > 50:
                body[r.randrange(len(body))] = "changed"
        if kind == 3:
            body = (body[:7] + ["\n"]) * 3
        out.append(" ".join(body))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], DOCS).repartition(3)


def rows(seed=0, n=60):
    found = list(enumerate(texts(seed, n)))
    found.append((None, found[-1][1]))
    found.append((len(found) - 2, "a repeated id " * 8))
    return found
