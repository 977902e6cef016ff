"""Sparse, dense and hybrid retrieval for sets of questions in one plan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import batches as parted
from ..functions.text import tokens

#: Tokens of documents that a task has in hand at a time (or those of one document), and pairs of a token and a query.
PART_TOKENS, PART_PAIRS = 1 << 17, 1 << 20


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    return df.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def top(scored: DataFrame, query: str, score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each query with their rank; the limit is applied before the exchange too."""
    by = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return scored.withColumn(name, F.row_number().over(by).cast("long")).where(F.col(name) <= k)


def _best(score: np.ndarray, hit: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best of each query among the rows hit; equal scores, to 6 digits, go to the row first in order."""
    found_q, found_r = [], []
    rough = np.where(hit, np.floor(score * 1e6 + 0.5), -np.inf)
    for q in range(len(score)):
        some = np.flatnonzero(hit[q])
        if len(some) > k:
            floor = np.partition(rough[q][some], len(some) - k)[len(some) - k]
            some = some[rough[q][some] >= floor]
            some = some[np.lexsort((order[some], -rough[q][some]))[:k]]
        found_q.append(np.full(len(some), q))
        found_r.append(some)
    return np.concatenate(found_q), np.concatenate(found_r)


def _best_of(parts: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k best of each query among (q, key, score, rough); equal scores, to 6 digits, go to the smaller key."""
    if not parts:
        return []
    table = pa.Table.from_batches(parts)
    table = table.take(pc.sort_indices(table, sort_keys=[("q", "ascending"), ("rough", "descending"), ("key", "ascending")]))
    q = table.column("q").to_numpy()
    first = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return table.filter(pa.array(place < k)).combine_chunks().to_batches()


def _in_order(keys: pa.Array) -> np.ndarray:
    """Each row's place among the keys."""
    out = np.empty(len(keys), np.int64)
    out[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return out


def _blocks(rows: Iterator, size: Callable, block_bytes: int) -> Iterator[list]:
    """Rows of a query set in blocks of so many bytes (or one row), one at a time on the driver."""
    block, room = [], block_bytes
    for row in rows:
        if block and size(row) > room:
            yield block
            block, room = [], block_bytes
        block.append(row)
        room -= size(row)
    if block:
        yield block


def _union(parts: list[DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty()


class _Asked:
    """A block of queries as terms: for each term, the queries that have it and how often."""

    def __init__(self, rows: list):
        terms: dict[str, int] = {}
        at, query, times = [], [], []
        for q, row in enumerate(rows):
            for term, n in Counter(row["t"] or []).items():
                at.append(terms.setdefault(term, len(terms)))
                query.append(q)
                times.append(n)
        order = np.argsort(at, kind="stable") if at else np.zeros(0, np.int64)
        self.keys = [row["k"] for row in rows]
        self.terms = pa.array(list(terms), pa.string())
        self.query, self.times = np.array(query, np.int64)[order], np.array(times, float)[order]
        self.begin = np.searchsorted(np.array(at, np.int64)[order], np.arange(len(terms) + 1))

    def postings(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of a column of token lists, and the lists' lengths."""
        length = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        term = pc.index_in(words.flatten(), self.terms)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(length)), length)[known]
        n = max(1, len(self.terms))
        pair, tf = np.unique(row * n + term.drop_null().to_numpy(), return_counts=True)
        return pair // n, pair % n, tf, length


def _statistics(shared):
    """df of each asked term (place from 0), the number of rows (-1) and of tokens (-2) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            df, rows, total = np.zeros(len(asked.terms), np.int64), 0, 0
            for part in parted.parts(batch, "t", PART_TOKENS):
                _row, term, _tf, length = asked.postings(part.column("t"))
                df += np.bincount(term, minlength=len(df))
                rows, total = rows + len(length), total + int(length.sum())
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[at], [rows, total]]).astype(np.int64))], ["term", "n"])

    return run


def _scored(shared, k: int, k1: float, b: float, queries: int = 512, held_rows: int = 200_000):
    """The k best of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf, mean = shared.value
        names = pa.array(asked.keys)
        found: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for part in parted.parts(batch, "t", PART_TOKENS):
                every, term, tf, length = asked.postings(part.column("t"))
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[every] / mean))
                every, term, weight = every[weight > 0], term[weight > 0], weight[weight > 0]
                many = asked.begin[term + 1] - asked.begin[term]
                order = _in_order(part.column("k"))
                for lo, hi in parted.runs(np.bincount(every, weights=many, minlength=part.num_rows).astype(np.int64), PART_PAIRS, part.num_rows):
                    own = slice(*np.searchsorted(every, [lo, hi]))
                    row, n, first = every[own] - lo, many[own], asked.begin[term[own]]
                    at = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
                    query, of, value = asked.query[at], np.repeat(row, n), np.repeat(weight[own], n) * asked.times[at]
                    for a in range(0, len(asked.keys), queries):
                        some = slice(None) if len(asked.keys) <= queries else (query >= a) & (query < a + queries)
                        block = min(queries, len(asked.keys) - a)
                        score = np.bincount((query[some] - a) * (hi - lo) + of[some], weights=value[some], minlength=block * (hi - lo)).reshape(block, -1)
                        q, r = _best(score, score > 0, order[lo:hi], k)
                        best = score[q, r]
                        found.append(pa.RecordBatch.from_arrays([pa.array(q + a), part.column("k").take(pa.array(lo + r)), pa.array(best), pa.array(np.floor(best * 1e6 + 0.5))], ["q", "key", "score", "rough"]))
                        held += len(q)
                        if held > held_rows:
                            found = _best_of(found, k)
                            held = 0  # what is kept is at most k a query
        for x in _best_of(found, k):
            yield pa.RecordBatch.from_arrays([names.take(x.column("q")), x.column("key"), x.column("score")], ["q", "k", "score"])

    return run


def bm25(
    docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, text: str = "text", k: int = 10, k1: float = 1.2, b: float = 0.75, stop_share: float | None = None, block_bytes: int = 16 << 20
) -> DataFrame:
    """query_key, doc_key, score, rank: the k best documents of each query.

    The queries are a stated set, taken to all documents in blocks of ``block_bytes`` of tokens. For each
    block the documents are read twice: once for the statistics of the block's terms (a number a term goes
    to the driver), once to score every document where it stands, against all queries. Only the k best of
    a task go into an exchange, so the postings of a common word are never in one place.
    Scores are rounded to 6 digits before they are ranked; equal scores go to the smaller key.
    ``stop_share`` leaves out terms in more than that share of documents. Documents and queries without
    tokens find nothing.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    words = docs.select(F.col(doc_key).alias("k"), tokens(text).alias("t"))
    asked_rows = queries.select(F.col(query_key).alias("k"), tokens(text).alias("t")).toLocalIterator()
    parts = []
    for rows in _blocks(asked_rows, lambda r: 64 + sum(len(x) + 24 for x in r["t"] or []), block_bytes):
        asked = _Asked(rows)
        if not len(asked.terms):
            continue
        counted = words.mapInArrow(_statistics(spark.sparkContext.broadcast(asked)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        n = {r.term: r.n for r in counted.collect()}  # one row an asked term
        total, mean = n.get(-1, 0), n.get(-2, 0) / max(1, n.get(-1, 0))
        df = np.array([n.get(i, 0) for i in range(len(asked.terms))], float)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        if stop_share is not None:
            idf[df > stop_share * total] = 0
        shared = spark.sparkContext.broadcast((asked, idf, mean or 1.0))
        parts.append(words.mapInArrow(_scored(shared, k, k1, b), f"q {kinds[1]}, k {kinds[0]}, score double"))
    found = _union(parts, lambda: spark.createDataFrame([], f"q {kinds[1]}, k {kinds[0]}, score double"))
    found = found.select(F.col("q").alias(query_key), F.col("k").alias(doc_key), F.round("score", 6).alias("score"))
    return top(found, query_key, "score", doc_key, k)


def _cosines(shared, d: int, k: int, threshold: float | None, rows: int = 4096, queries: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = shared.value
        names = pa.array(keys)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                v = np.asarray(part.column("v").flatten(), np.float64).reshape(-1, d)
                size = np.sqrt(np.einsum("ij,ij->i", v, v))
                order = _in_order(part.column("k"))
                for a in range(0, len(keys), queries):
                    score = q[a : a + queries] @ (v / np.where(size > 0, size, 1)[:, None]).T
                    hit = np.broadcast_to(size > 0, score.shape)
                    hit = hit if threshold is None else hit & (np.floor(score * 1e6 + 0.5) / 1e6 >= threshold)
                    at, r = _best(score, hit, order, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at + a)), part.column("k").take(pa.array(r)), pa.array(score[at, r])], ["q", "k", "score"])

    return run


def dense(queries: DataFrame, points: DataFrame, query_key: str, point_key: str, vector: str, k: int = 10, threshold: float | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """query_key, point_key, score, rank by exact cosine, rounded to 6 digits; equal scores go to the smaller key.

    The queries are a stated set, met by all points in blocks of ``block_bytes`` of vectors, as a product
    of matrices; the k best of a batch go into the exchange. Vectors that are null, zero or hold a null,
    NaN or infinity take no part; vectors of each length are searched among themselves.
    """
    spark = points.sparkSession
    kinds = points.schema[point_key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    good = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists(v, x -> x <> 0)"
    sound = lambda df, key: df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(good)
    parts = []
    for block in _blocks(sound(queries, query_key).toLocalIterator(), lambda r: 64 + 8 * len(r["v"]), block_bytes):
        for d in sorted({len(r["v"]) for r in block}):
            rows = [r for r in block if len(r["v"]) == d]
            q = np.array([r["v"] for r in rows], float)
            shared = spark.sparkContext.broadcast(([r["k"] for r in rows], q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]))
            parts.append(sound(points, point_key).where(F.size("v") == d).mapInArrow(_cosines(shared, d, k, threshold), f"q {kinds[1]}, k {kinds[0]}, score double"))
    found = _union(parts, lambda: spark.createDataFrame([], f"q {kinds[1]}, k {kinds[0]}, score double"))
    found = found.select(F.col("q").alias(query_key), F.col("k").alias(point_key), F.round("score", 6).alias("score"))
    return top(found, query_key, "score", point_key, k)


def hybrid(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, text: str = "text", vector: str = "vector", k: int = 4, texts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Dense and sparse lists of four times the k hits that are kept in the end, fused to as many.

    ``texts`` are the same documents and queries where they need no vector: the sparse search reads its
    documents twice, and would make vectors each time that it reads docs whose vectors are made on the way.
    """
    lists = [dense(queries, docs, query_key, doc_key, vector, 4 * k), bm25(*(texts or (docs, queries)), doc_key, query_key, text, 4 * k)]
    return fuse(lists, query_key, doc_key, 4 * k)


def _weights(k1: float, b: float, mean: float, columns: list[str], vector: bool):
    """Batches with ``sparse``, a map of each distinct token of ``__t`` to its weight, in the order of first use, and the hashed ``vector``."""
    from .embedding import hashed_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parted.parts(batch, "__t", PART_TOKENS):
                words = part.column("__t")
                length = parted.lengths(words)
                coded = words.flatten().dictionary_encode()
                m = max(1, len(coded.dictionary))
                pair, first, tf = np.unique(np.repeat(np.arange(len(length)), length) * m + coded.indices.to_numpy(), return_index=True, return_counts=True)
                order = np.argsort(first, kind="stable")
                row, term, tf = pair[order] // m, pair[order] % m, tf[order]
                weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
                offsets = np.searchsorted(row, np.arange(len(length) + 1)).astype(np.int32)
                made = [pa.MapArray.from_arrays(pa.array(offsets), coded.dictionary.take(pa.array(term)), pa.array(weight))]
                if vector:
                    null = words.is_null().to_numpy(zero_copy_only=False)
                    v = hashed_tokens(words)
                    ends = np.concatenate([[0], np.cumsum(np.where(null, 0, v.shape[1]))]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), pa.array(np.ascontiguousarray(v[~null]).ravel())))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *made], [*columns, "sparse", "vector"][: len(columns) + len(made)])

    return run


def index_rows(chunks: DataFrame, key: str, text: str = "text", model=None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Chunks with what an index keeps of them: sparse (map of term to BM25 weight without idf), vector. See ``idf`` for the rest."""
    from .embedding import embed

    words = chunks.withColumn("__t", tokens(text))
    mean = words.agg(F.coalesce(F.avg(F.size("__t")), F.lit(1.0)).alias("m")).first()["m"] or 1.0
    columns = [c for c in chunks.columns if c != "vector"]
    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in columns) + ", sparse map<string,double>"
    if model is None:  # the vectors are made of the same tokens
        return words.mapInArrow(_weights(k1, b, mean, columns, True), schema + ", vector array<double>")
    return embed(words.mapInArrow(_weights(k1, b, mean, columns, False), schema), text, "vector", model)


def idf(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, df, idf over all chunks."""
    words = chunks.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.count()
    return words.withColumn("idf", F.round(F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6))


def fuse(lists: list[DataFrame], query_key: str, doc_key: str, k: int, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (constant + rank) over the lists; score, rank."""
    parts = None
    for w, x in zip(weights or [1.0] * len(lists), lists, strict=True):
        one = x.select(query_key, doc_key, (F.lit(w) / (constant + F.col("rank"))).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    summed = parts.groupBy(query_key, doc_key).agg(F.round(F.sum("s"), 6).alias("score"))
    return top(summed, query_key, "score", doc_key, k)


def with_columns_of(hits: DataFrame, docs: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Hits joined with columns of their documents. Up to ``most`` hits go to the scan of docs, so that texts stay where they are; hits should be cheap to count."""
    few = hits.limit(most + 1).count() <= most
    return docs.join(F.broadcast(hits) if few else hits, key)


def boost_and_filter(hits: DataFrame, query_key: str, boost, category: str, wanted: str, k: int, fallback: bool = True) -> DataFrame:
    """After the fused top: keep each query's category (where it has one), add ``boost``, and cut to k, in the fused order among equals.

    A query whose filter leaves nothing gets its unfiltered hits instead; its own score is kept, not the
    boosted one.
    """
    fits = F.col(wanted).isNull() | F.coalesce(F.col(category) == F.col(wanted), F.lit(False))
    by = Window.partitionBy(query_key)
    marked = hits.withColumn("__fits", fits).withColumn("__some", F.max("__fits").over(by))
    keep = F.col("__fits") | ~F.col("__some") if fallback else F.col("__fits")
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round(F.col("score") + boost, 6)), "rank")
    return marked.where(keep).withColumn("final_rank", F.row_number().over(order).cast("long")).where(F.col("final_rank") <= k).withColumn("fell_back", ~F.col("__some")).drop("__fits", "__some")
