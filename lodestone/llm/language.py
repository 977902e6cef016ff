"""Language identification by hyperdimensional profiles.

Every symbol has a random vector of +1 and -1 (``dimensions`` of them). An n-gram's vector binds those of
its letters, each permuted by its place: rot^2(a) * rot(b) * c for n = 3. A document's vector bundles (adds)
its n-grams' vectors, a language's prototype bundles those of its training documents, and a document gets
the language whose prototype has the largest cosine with its vector.

A document's vector is written out, exactly, in slices of bounded size; a prototype is the sum of its training
documents' vectors, which every task adds up for itself first. Only the prototypes (languages x dimensions)
go to the driver and out again. The mean of the prototypes, which all languages share, is taken from each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B

SYMBOLS = 64
GRAMS = SYMBOLS**3
#: Documents and n-grams that are multiplied at a time.
DOCS, SOME = 512, 4096
_table: list[np.ndarray] = []
_alpha: list[np.ndarray] = []


def symbol(c: str) -> int:
    """0 if not a letter, 1-26 for a-z in either case, else one of 37 by the lower-case letter's number."""
    if not c.isalpha() and unicodedata.category(c)[0] != "M":
        return 0
    c = c.lower()[0]
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) * 2654435761 % 2**32 % 37


def _symbols(points: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append(np.array([0 if 0xD800 <= i < 0xE000 else symbol(chr(i)) for i in range(0x10000)], np.uint8))
    out = _table[0][np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        for p in np.unique(points[high]).tolist():
            out[points == p] = symbol(chr(p))
    return out


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of a slice; symbols that are no letters count as one boundary, as do both ends."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(lead))
    s = np.zeros(len(points) + 2 * n, np.int64)
    s[np.arange(len(points)) + 2 * doc + 1] = _symbols(points)
    doc = np.repeat(np.arange(n), np.diff(lead) + 2)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 3
    key = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    good = (doc[2:] == doc[:-2]) & (s[1:-1] > 0)
    both, count = np.unique(doc[:-2][good] * GRAMS + key[good], return_counts=True)
    return both // GRAMS, both % GRAMS, count


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does each document of a slice hold a letter? A mark without one is none."""
    if not _alpha:
        _alpha.append(np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x10000)]))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    is_letter = _alpha[0][np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        for p in np.unique(points[high]).tolist():
            is_letter[points == p] = chr(p).isalpha()
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    total = np.concatenate([[0], np.cumsum(is_letter)])
    return total[lead[1:]] > total[lead[:-1]]


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int = 23) -> np.ndarray:
    """The bound vectors of n-grams; symbol 0 has a vector of its own."""
    letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions)).astype(np.int8) * 2 - 1
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def bundles(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The sums of each row's n-gram vectors (doc ascending, each n-gram of it once): integers, exactly."""
    out = np.zeros((n, dimensions))
    kind = np.float32 if len(count) == 0 or np.bincount(doc, weights=count).max() < 1 << 23 else np.float64
    for lo in range(0, n, DOCS):
        a, b = np.searchsorted(doc, [lo, lo + DOCS])
        if a == b:
            continue
        row, own, times = doc[a:b] - lo, gram[a:b], count[a:b].astype(kind)
        used, column = np.unique(own, return_inverse=True)
        rows = min(DOCS, n - lo)
        order = np.argsort(column, kind="stable")
        edge = np.searchsorted(column[order], np.arange(0, len(used) + SOME, SOME))
        for k, first in enumerate(range(0, len(used), SOME)):
            at = order[edge[k] : edge[k + 1]]
            vectors = gram_vectors(used[first : first + SOME], dimensions)
            if 25 * len(at) > rows * len(vectors):
                table = np.zeros((rows, len(vectors)), kind)
                table[row[at], column[at] - first] = times[at]
                out[lo : lo + rows] += table @ vectors.astype(kind)
                continue
            at = at[np.argsort(row[at], kind="stable")]  # few of each: row by row
            for j in range(0, len(at), SOME):
                some = at[j : j + SOME]
                begin = np.flatnonzero(np.concatenate([[True], row[some][1:] != row[some][:-1]]))
                out[lo + row[some][begin]] += np.add.reduceat(vectors[column[some] - first] * times[some, None], begin, axis=0)
    return out


def _learn(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                doc, gram, count = gram_counts(data, offsets)
                names, of = np.unique(lang[lo:hi].astype(str), return_inverse=True)
                both, back = np.unique(of[doc] * GRAMS + gram, return_inverse=True)
                own = bundles(both // GRAMS, both % GRAMS, np.bincount(back, weights=count, minlength=len(both)), len(names), dimensions)
                for name, vector in zip(names.tolist(), own, strict=True):
                    sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], ["lang", "place", "n"])

    return run


def prototypes(sums: np.ndarray) -> np.ndarray:
    """Bundled vectors of unit length, less what they share, of unit length again."""
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1), 1e-12)[:, None]
    return unit


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit, dimensions = shared.value
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                n = hi - lo
                some = letters(data, offsets)
                pred, score = ["und"] * n, np.zeros(n)
                if names:
                    own = bundles(*gram_counts(data, offsets), n, dimensions)
                    cosine = own @ unit.T / np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
                    best = cosine.argmax(axis=1)
                    pred = [names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                    score = np.where(some, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, n) for c in batch.schema.names], pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, training: DataFrame, dimensions: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every text of docs (doc_id, text), learned from training (text, lang).

    Returns doc_id, the ``keep`` columns of docs but those with a name of a result column, lang_pred (a
    learned lang value, or ``und`` where the text is null or has no letter, or nothing was learned) and
    score (the cosine of the document's vector and the language's prototype, 0 to 1). lang, source and
    doc_id are no inputs of a prediction.

    Training rows with null lang or text teach nothing; every other row counts, whole. Marks without a
    letter are no letter. Rows without or with equal doc_id are predicted each by itself; equal cosines go
    to the first language in order. An empty table gives no rows. What a task or the driver holds is a
    vector of ``dimensions`` numbers for each language.
    """
    spark = docs.sparkSession
    learned = training.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_learn(dimensions), "lang string, place int, n double")
    rows = learned.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()  # languages x dimensions
    names = sorted(set(rows["lang"]))
    sums = np.zeros((len(names), dimensions))
    sums[np.searchsorted(names, rows["lang"]) if names else [], rows["place"]] = rows["n"]
    shared = spark.sparkContext.broadcast((names, prototypes(sums), dimensions))
    columns = ["doc_id", *[c for c in dict.fromkeys(keep) if c not in ("doc_id", "text", "lang_pred", "score")]]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*columns, "text"])
    found = docs.select(*columns, "text").mapInArrow(_predict(shared), kinds + ", lang_pred string, score double")
    return found if "text" in keep else found.drop("text")


def fold(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op2_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; learned from the folds but 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, docs.where(fold(4) != 2)).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
