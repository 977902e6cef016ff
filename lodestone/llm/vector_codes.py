"""Product codes of vectors, with codebooks fitted by rounds of assignment in integers, searched by partial distances.

Components become integers, and each vector is cut into equal parts with a codebook each. The nearest entry
of a part is found exactly: dimensions are taken in descending variance of the codebook; after the first
few, the entry with the least sum so far is completed, and from then on a mask drops entries whose sum
strictly exceeds the best complete distance, so that ties are kept for the lower index. Sums are integers
of 64 bits throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B

SCALE = 1024
#: Components of a larger magnitude could bring sums of squares beyond 64 bits.
LIMIT = 1 << 26
#: Rows of the sums by label that may be broadcast.
LABELS = 100_000
FIRST = 4  # dimensions before the first entry is completed
BLOCK = 4096  # vectors that are searched at a time


def nearest(x: np.ndarray, book: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` to each row of ``x``; ties go to the lower index.

    ``order`` has the dimensions as they are taken; by default descending variance over the codebook.
    """
    n, d = x.shape
    if not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    if order is None:
        order = by_variance(book)
    x, book = x[:, order], book[:, order]
    head = min(d, FIRST)
    sums = np.zeros((n, len(book)), np.int64)
    for j in range(head):
        gap = x[:, j, None] - book[None, :, j]
        sums += gap * gap
    first = sums.argmin(1)
    rest = x[:, head:] - book[first, head:]
    best = sums[np.arange(n), first] + (rest * rest).sum(1)  # a complete distance
    row, entry = np.nonzero(sums <= best[:, None])
    left = sums[row, entry]
    for j in range(head, d):
        gap = x[row, j] - book[entry, j]
        left += gap * gap
        alive = left <= best[row]
        if j < d - 1 and alive.mean() > 0.9:
            continue  # dropping takes a copy of what stays
        row, entry, left = row[alive], entry[alive], left[alive]
    # what is left is complete and no worse than the best known: the least distance, then the least index, of each row
    alive = left == np.minimum.reduceat(left, np.flatnonzero(np.diff(row, prepend=-1)))[row] if len(row) else np.zeros(0, bool)
    row, entry, left = row[alive], entry[alive], left[alive]
    at = np.flatnonzero(np.diff(row, prepend=-1))  # entries ascend within a row
    return entry[at], left[at]


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions in descending variance of the codebook's entries, equal ones in their order."""
    return np.argsort(-book.astype(float).var(0), kind="stable")


def _packed(d: int):
    """Batches of (id, label, vector) as blobs: the ids' and labels' Arrow columns and one block of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = np.floor(np.asarray(part.column("v").flatten(), np.float64) * SCALE).astype(np.int32)
                keys = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(c)])) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([x.tobytes()], pa.binary())], ["id", "label", "x"])

    return run


def _codes(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x parts) and distances."""
    size = books.shape[2]
    found = [nearest(x[:, p * size : (p + 1) * size], book) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)


def _sums(shared, d: int):
    """For each part and entry the number of parts assigned and their sum, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, k, size = books.shape
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64)
        for batch in batches:
            for blob in batch.column("x"):
                x = np.frombuffer(blob.as_buffer(), np.int32).reshape(-1, d).astype(np.int64)
                codes, _ = _codes(x, books)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=k)
                    np.add.at(total[p], codes[:, p], x[:, p * size : (p + 1) * size])
        part, entry = np.nonzero(count)
        if len(part):
            rows = total[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * size), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), lists], ["part", "entry", "n", "total"])

    return run


def _coded(shared, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(r, 1).flatten() for c in ("id", "label"))
                x = np.frombuffer(batch.column("x")[r].as_py(), np.int32).reshape(len(ids), d).astype(np.int64)
                codes, errors = _codes(x, books)
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + step] for i in range(0, len(text), step)]), pa.array(errors.sum(1))], ["id", "label", "code", "error"])

    return run


def _fitted(rows: DataFrame, blocks: DataFrame, d: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks (parts x entries x d / parts). What the driver sees is bounded by their size."""
    spark, size = rows.sparkSession, d // parts
    first = rows.orderBy("id", "v").limit(entries).select("v").collect()
    books = np.floor(np.array([r.v for r in first], np.float64).reshape(len(first), d) * SCALE).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, size).transpose(1, 0, 2))
    for _ in range(rounds if d else 0):
        each = blocks.select("x").mapInArrow(_sums(spark.sparkContext.broadcast(books), d), "part int, entry int, n long, total array<long>")
        summed = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).cast("array<long>").alias("total"))
        for r in summed.toLocalIterator():  # at most a row an entry
            books[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def product_codes(df: DataFrame, key: str, vector: str, label: str, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """key, code (two hex digits a part), error, label_error and codebooks_sha256 of each sound vector.

    Vectors that are null or hold nulls, NaN or infinities are left out. Components are floor(1024 * x). The
    first codebooks are the parts of the ``entries`` (256 at most) smallest keys, rows with equal keys in the
    order of their vectors; with fewer rows they are smaller. Empty clusters keep their entry. Repeated rows
    count as often as they occur. Vectors of each length have codebooks of their own, and label_error sums
    over all lengths. Vectors whose length is no multiple of ``parts``, or with a component of magnitude
    65,536 or more, whose sums could leave 64 bits, get null codes, errors and codebooks and take no part in
    fitting. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, label)}
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))")
    fits = F.expr(f"size(v) % {parts} = 0 and forall(v, x -> abs(x) < {LIMIT / SCALE})")
    lengths = sorted(r.n for r in rows.where(fits).select(F.size("v").alias("n")).distinct().collect())
    none = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    coded = none
    for d in lengths:
        own = rows.where(fits & (F.size("v") == d))
        blocks = B.cut(own.mapInArrow(_packed(d), f"id array<{kinds[key]}>, label array<{kinds[label]}>, x binary"))
        books = _fitted(own, blocks, d, parts, entries, rounds)
        found = blocks.mapInArrow(_coded(spark.sparkContext.broadcast(books), d), f"id {kinds[key]}, label {kinds[label]}, code string, error long")
        coded = coded.unionByName(found.withColumn("codebooks_sha256", F.lit(digest(books))))
    coded = B.cut(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = F.broadcast(sums) if sums.limit(LABELS + 1).count() <= LABELS else sums  # beyond that adaptive execution splits a label of many rows
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return met.select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")


def op12_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all sound vectors of ``embeddings``."""
    return product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Distances to all entries, in long form by position; no search."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, x.part, entry, sum((x.v - b.v) * (x.v - b.v)) AS dist FROM x JOIN b{r} b USING (part, pos) GROUP BY ALL),
a{r} AS (SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS (SELECT part, entry, pos, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS v FROM b{r} LEFT JOIN s{r} USING (part, entry, pos))""")
    return f"""
WITH k AS (SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
i AS (SELECT vec_id, w, unnest(e) AS c, generate_subscripts(e, 1) - 1 AS place FROM k),
x AS (SELECT vec_id, place // w AS part, place % w AS pos, floor({SCALE} * c::DOUBLE)::BIGINT AS v FROM i),
b0 AS (SELECT part, (dense_rank() OVER (ORDER BY vec_id)) - 1 AS entry, pos, v FROM x QUALIFY entry < {entries}),{",".join(steps)},
h AS (SELECT sha256(string_agg(v, ',' ORDER BY part, entry, pos)) AS h FROM b{rounds}),
c AS (SELECT vec_id, string_agg(substr('0123456789abcdef', (entry // 16 + 1)::INT, 1) || substr('0123456789abcdef', (entry % 16 + 1)::INT, 1), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


OP12_SQL = _sql()
