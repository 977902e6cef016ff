"""Nearest neighbours from randomly rotated one-bit codes.

Vectors are scaled to unit length, rotated at random, and kept as the signs of their coordinates: one bit
each. With x the rotated vector and s its signs over sqrt(d), the correction scalar <s, x> makes
<s, q> / <s, x> an unbiased estimate of <x, q>, whose error is within
``epsilon`` * sqrt((1 - <s, x>^2) / <s, x>^2 / (d - 1)) with high probability. A query scans the packed
codes; a vector whose estimate plus bound cannot reach the query's k-th best exact cosine is passed over,
and all others are reranked on the original vectors, in double precision.

Equal vectors are one entry of the index, with its smallest ids, so a vector that a third of all rows
repeat is scanned once. Queries go out in broadcasts of a bounded number of bytes; all rows are indexed.

The index is rows of up to 4,096 vectors of one length: their codes as 64-bit words, scalars and lengths, and
the original numbers as bytes that nobody decodes but for vectors that are reranked. A query's rotated
coordinates are rounded to 4 bits, so an estimate is an AND and a count of bits for each of the four places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _bytes as B

BLOCK = 4096
#: Bits of a query's coordinates.
PLACES = 4


def rotation(d: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed signs of each rotated unit vector, and its correction scalar."""
    x = unit @ turn
    return packed(x > 0), np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])


class Queries:
    """Unit queries, rotated and rounded to a few bits: the words of each place, and what undoes the rounding."""

    def __init__(self, turned: np.ndarray):
        self.d = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**PLACES - 1), 1e-300)
        number = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.places = [packed((number >> k) & 1 > 0) for k in range(PLACES)]
        self.sum = number.sum(axis=1) * self.step + self.d * self.low

    def estimate(self, some: slice, bits: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors), and a unit of their error: that of the code and that of the rounding."""
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        inside = np.zeros((len(self.low[some]), len(bits)), np.int64)
        for k, place in enumerate(self.places):
            for w in range(bits.shape[1]):
                inside += np.bitwise_count(place[some, None, w] & bits[None, :, w]).astype(np.int64) << k
        above = self.low[some, None] * ones + self.step[some, None] * inside  # the coordinates where the sign is positive
        guess = (2 * above - self.sum[some, None]) / np.sqrt(self.d) / scalar
        own = np.maximum(0, 1 - scalar**2) / scalar**2 / max(1, self.d - 1)
        return guess, np.sqrt(own + self.step[some, None] ** 2 / 12 / scalar**2)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column("embedding")
        lengths = column.value_lengths().to_numpy()
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = np.asarray(column.flatten(), np.float64)
        ids = np.stack([batch.column("least").to_numpy(), batch.column("name").to_numpy()], axis=1)
        for d in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == d)
            turn = turns[d] if d in turns else turns.setdefault(d, rotation(d))
            for a in range(0, len(of), BLOCK):
                at = of[a : a + BLOCK]
                v = flat[begin[at][:, None] + np.arange(d)]
                norm = _norm(v)
                bits, scalar = encode(v / norm[:, None], turn)
                blobs = [ids[at].tobytes(), bits.tobytes(), scalar.tobytes(), norm.tobytes(), v.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], ["d", "ids", "code", "scalar", "norm", "numbers"])


def _norm(v: np.ndarray) -> np.ndarray:
    """Lengths of vectors, also where the squares would leave the range of doubles."""
    top = np.abs(v).max(axis=1)
    scaled = v / top[:, None]
    return top * np.sqrt(np.einsum("ij,ij->i", scaled, scaled))


def _search(shared, k: int, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = {}, {}
        for d, (ids, q) in shared.value.items():
            norm = _norm(q)
            asked[d] = ids, q, norm, Queries((q / norm[:, None]) @ rotation(d))
            best[d] = [(np.zeros(0), np.zeros((0, 2), np.int64)) for _ in ids]
        for batch in batches:
            for d, *blobs in zip(*[batch.column(c) for c in ("d", "ids", "code", "scalar", "norm", "numbers")], strict=True):
                if d.as_py() in asked:
                    block(d.as_py(), *[b.as_buffer() for b in blobs], asked, best)
        rows = [(int(i), int(w[0]), int(w[1]), float(s)) for d, (ids, *_) in asked.items() for i, (score, who) in zip(ids, best[d], strict=True) for s, w in zip(score, who, strict=True)]
        for a in range(0, len(rows), 10_000):
            x = list(zip(*rows[a : a + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in x[:3]], pa.array(x[3], pa.float64())], ["query", "least", "rep", "score"])

    def block(d, name, code, scalar, size, numbers, asked, best) -> None:
        ids, q, norm, queries = asked[d]
        name, scalar, size = np.frombuffer(name, np.int64).reshape(-1, 2), np.frombuffer(scalar), np.frombuffer(size)
        bits, v = np.frombuffer(code, np.uint64).reshape(len(name), -1), np.frombuffer(numbers).reshape(len(name), d)
        exact = lambda i, at: np.einsum("ij,j->i", v[at] / size[at, None], q[i] / norm[i])
        for a in range(0, len(ids), 256):
            guess, unit = queries.estimate(slice(a, a + 256), bits, scalar)
            for i, (row, err) in enumerate(zip(guess, unit, strict=True), a):
                score, who = best[d][i]
                tried = np.zeros(len(name), bool)
                if len(score) < k:  # exact values of the best estimates first, for something to compare with
                    tried[np.argpartition(-row, k - 1)[:k] if len(name) > k else np.arange(len(name))] = True
                    score, who = _merge(score, who, exact(i, np.flatnonzero(tried)), name[tried], k)
                floor = score[-1] if len(score) >= k else -np.inf
                more = np.flatnonzero((row + epsilon * err + 1e-6 >= floor) & ~tried)
                if len(more):
                    score, who = _merge(score, who, exact(i, more), name[more], k)
                best[d][i] = score, who

    return run


def _merge(score, who, score2, who2, k: int):
    score, who = np.concatenate([score, score2]), np.concatenate([who, who2])
    order = np.lexsort((who[:, 0], -score))[:k]  # by the smallest id among equals
    return score[order], who[order]


def nearest(vectors: DataFrame, is_query, k: int = 5, epsilon: float = 2.5, query_bytes: int = 32 << 20) -> DataFrame:
    """The k nearest rows, by cosine in double precision, of each row for which ``is_query`` (a boolean Column) holds.

    vectors: vec_id, embedding (array of numbers). Candidates are all rows but the query's own, of vectors
    with as many numbers. Returns query_id, rank (from 1), vec_id, score; equal scores go to the smaller
    vec_id; all candidates where there are fewer than k. A neighbour is missed only where an estimate errs
    by more than its bound.

    Vectors that are null, zero, or hold a null or a number that is not finite take no part; nor do rows
    with a null vec_id. Rows that repeat a vec_id and its vector are one row, as query and as candidate; a
    query never finds its own id. A vec_id with several vectors has each of them. An empty table gives no
    rows. Queries are taken to the scan in blocks of ``query_bytes`` of distinct vectors (or one vector),
    one pass over the codes for each block.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = sound.where("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    sound = sound.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"), "asks")  # no negative zero
    kinds = "query_id long, rank int, vec_id long, score double"
    # the smallest ids of equal vectors are enough for any query
    by = Window.partitionBy("embedding").orderBy("vec_id")
    each = sound.groupBy("embedding", "vec_id").agg(F.max("asks").alias("asks"))
    few = each.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    few = B.cut(few.select("embedding", "ids", F.col("ids")[0].alias("least"), F.monotonically_increasing_id().alias("name")))  # the numbers hold once they are written
    index = B.cut(few.select("name", "least", "embedding").mapInArrow(_codes, "d int, ids binary, code binary, scalar binary, norm binary, numbers binary"))
    ask = B.cut(each.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").join(few, "embedding").select("query_id", "name"))
    distinct = few.join(ask.select("name").distinct(), "name").select("name", "embedding")
    found, block, room = None, {}, query_bytes

    def scan(block: dict[int, tuple[list, list]]) -> DataFrame:
        shared = spark.sparkContext.broadcast({d: (np.array(names), np.array(numbers, np.float64)) for d, (names, numbers) in block.items()})
        return index.mapInArrow(_search(shared, k + 1, epsilon), "query long, least long, rep long, score double")

    for row in distinct.toLocalIterator():
        size = 8 * len(row.embedding) + 16
        if block and size > room:
            found = B.cut(scan(block)) if found is None else found.unionByName(B.cut(scan(block)))
            block, room = {}, query_bytes
        names, numbers = block.setdefault(len(row.embedding), ([], []))
        names.append(row.name)
        numbers.append(row.embedding)
        room -= size
    if not block:
        return spark.createDataFrame([], kinds)
    found = scan(block) if found is None else found.unionByName(scan(block))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    top = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    near = top.join(few.select(F.col("name").alias("rep"), "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    near = B.cut(near.select(F.col("query").alias("name"), "near"))
    own = ask.join(near, "name").select("query_id", F.slice(F.expr("filter(near, x -> x.vec_id <> query_id)"), 1, k).alias("near"))
    own = own.select("query_id", F.posexplode("near").alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op1_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` whose vec_id is divisible by 50, against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
