"""A stored index of texts and vectors, and exact searches that read the parts of it that can matter.

``build`` writes below one path, all Parquet by Spark's writers:

* ``blocks``: one for each term of each segment (of at most ``segment_rows`` documents), in folders by a
  hash of the term: bucket, term, segment, n, best (the largest weights, descending), ords, weights; in
  folder -1 the keys of each segment, ascending (a document's ord is its place there);
* ``terms``: bucket, term, df, idf;
* ``vectors``: documents with a vector, in folders by cell: cell, key, unit (the vector at length 1), away
  (its distance from the cell's centre), payload columns;
* ``cells``: cell, centre, radius, rows;
* ``meta``: one row with the number of documents, the mean length and the parameters.

A common word is as many blocks as there are segments, so nothing of it is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import batches as parted
from ..functions.text import tokens
from ..sources import folders
from . import retrieval
from .embedding import embed

BEST = 16  # weights of a block that its head tells
#: Rounding to 6 digits may lift a score by half of the last; bounds give way by more.
SLACK = 2e-6


def _buckets(n: int):
    """The folder of a term; -1 without one."""
    return F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(n))).cast("int")


def _ddl(kind: str) -> str:
    return f"segment long, term string, n int, best array<double>, ords array<int>, weights array<double>, keys array<{kind}>"


def _postings(k1: float, b: float, mean: float, segment_rows: int, key_type: pa.DataType):
    """Blocks of each segment, and (with a null term) the segment's keys."""
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("best", pa.list_(pa.float64())), ("ords", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("keys", pa.list_(key_type))])

    def segment(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        table = table.take(pc.sort_indices(table, sort_keys=[("k", "ascending")]))
        length, m = parted.lengths(table.column("t").combine_chunks()), max(1, table.num_rows)
        names: dict[str, int] = {}
        pairs, tfs = [], []
        for lo, hi in parted.runs(length, retrieval.PART_TOKENS, m):  # few tokens in hand at a time; each pair of term and row is in one part
            coded = table.column("t").slice(lo, hi - lo).combine_chunks().flatten().dictionary_encode()
            at = np.fromiter((names.setdefault(t, len(names)) for t in coded.dictionary.to_pylist()), np.int64)
            pair, tf = np.unique(at[coded.indices.to_numpy()] * m + np.repeat(np.arange(lo, hi), length[lo:hi]), return_counts=True)
            pairs.append(pair)
            tfs.append(tf.astype(np.int32))
        pair, tf = np.concatenate([np.zeros(0, np.int64), *pairs]), np.concatenate([np.zeros(0, np.int32), *tfs])
        order = np.argsort(pair, kind="stable")
        pair, tf = pair[order], tf[order]
        term, row = pair // m, pair % m
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
        begin = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term)).astype(np.int32)
        n = np.diff(begin)
        down = np.lexsort((-weight, term))  # within a term, the best first
        head = np.minimum(n, BEST)
        at = np.arange(int(head.sum())) - np.repeat(np.cumsum(head) - head, head) + np.repeat(begin[:-1], head)
        lists = lambda offsets, x, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind))
        keys = pa.concat_arrays(table.column("k").chunks)
        none, many = pa.array([number], pa.int64()), len(n)
        yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.string()), pa.array([len(length)], pa.int32()), *[pa.nulls(1, f.type) for f in list(schema)[3:6]], pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)], schema=schema)
        if many:
            best = lists(np.append(0, np.cumsum(head)), weight[down][at], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(many, number)), pa.array(list(names), pa.string()).take(pa.array(term[begin[:-1]])), pa.array(n, pa.int32()), best, lists(begin, row, pa.int32()), lists(begin, weight, pa.float64()), pa.nulls(many, pa.list_(key_type))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, segment_rows):
                part = batch.slice(lo, segment_rows)
                if rows and rows + part.num_rows > segment_rows:
                    yield from segment(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
                    parted.release()
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from segment(pa.Table.from_batches(held), number)

    return run


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a bounded sample of unit vectors."""
    found = np.unique(sample, axis=0)
    found = found[np.random.default_rng(seed).permutation(len(found))[:cells]]
    for _ in range(rounds):
        at = (sample @ found.T).argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, at, sample)
        some = np.bincount(at, minlength=len(found)) > 0
        size = np.sqrt((total * total).sum(1))
        some &= size > 0
        found[some] = total[some] / size[some, None]
    return found


def _celled(shared, columns: list[str], d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            v = np.asarray(batch.column("unit").flatten(), np.float64).reshape(-1, d)
            v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            cell = (v @ centres.T).argmax(1)
            away = np.sqrt(((v - centres[cell]) ** 2).sum(1))
            units = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * d), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], units, pa.array(cell.astype(np.int32)), pa.array(away)], [*columns, "unit", "cell", "away"])

    return run


def sound(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a length and holds neither null, NaN nor infinity."""
    return df.where(f"size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists({vector}, x -> x <> 0)")


def build_vectors(points: DataFrame, path: str, key: str, vector: str, payload: list[str] | None = None, cells: int = 64, sample_rows: int = 20_000) -> None:
    """Writes ``vectors`` and ``cells``. The centres are fitted on about ``sample_rows`` rows, chosen by a hash of the vector; every vector is kept.

    Vectors that are null, zero, or hold a null, NaN or infinity are left out; all others must have one length.
    """
    spark, columns = points.sparkSession, ["key", *(payload or [])]
    rows = sound(points.select(F.col(key).alias("key"), *(payload or []), F.col(vector).cast("array<double>").alias("unit")), "unit")
    lengths = rows.groupBy(F.size("unit").alias("d")).agg(F.count("*").alias("n")).collect()
    if len(lengths) > 1:
        raise ValueError(f"vectors of one length are needed, not of {sorted(r.d for r in lengths)}")
    if not lengths:
        raise ValueError("no vector to index")
    d, n = lengths[0].d, lengths[0].n
    bound = min(1.0, sample_rows / n)
    chosen = rows.where(F.pmod(F.xxhash64("key", "unit"), F.lit(1 << 20)) < int(bound * (1 << 20)) + 1).select("unit")
    few = np.array([r.unit for r in chosen.limit(2 * sample_rows).collect()], np.float64)
    few /= np.sqrt(np.einsum("ij,ij->i", few, few))[:, None]
    centres = centres_of(few, cells)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "unit")
    placed = rows.mapInArrow(_celled(spark.sparkContext.broadcast(centres), columns, d), f"{kinds}, unit array<double>, cell int, away double")
    spread = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // len(centres)))  # a cell of many vectors is several files
    placed.repartition("cell", F.pmod(F.xxhash64("key", "unit"), F.lit(spread))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("rows"))
    all_ = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(F.broadcast(all_), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def build_postings(docs: DataFrame, path: str, key: str, text: str = "text", k1: float = 1.2, b: float = 0.75, segment_rows: int = 4096, buckets: int = 16) -> None:
    """Writes ``blocks``, ``terms`` and ``meta``. Texts are tokenized twice: for the mean length, and for the blocks. Null texts count as documents without a token."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    words = docs.select(F.col(key).alias("k"), tokens(text).alias("t"))
    n, total = words.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("t"), F.lit(0))), F.lit(0))).first()
    mean = (total / n if n else 0) or 1.0
    kind = docs.schema[key].dataType
    ddl = _ddl(kind.simpleString())
    made = words.mapInArrow(_postings(k1, b, mean, segment_rows, to_arrow_type(kind)), ddl).withColumn("bucket", _buckets(buckets))
    spread = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)  # several keys a partition, so that they are even
    dealt = made.repartition("bucket", F.pmod(F.col("segment") % 1_000_003, F.lit(spread))).sortWithinPartitions("bucket", "term", "segment")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema(ddl + ", bucket int").parquet(f"{path}/blocks").where("bucket >= 0")
    df = blocks.groupBy("bucket", "term").agg(F.sum("n").cast("long").alias("df"))
    idf = df.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    idf.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(n, float(mean), k1, b, buckets, kind.simpleString())], "documents long, mean double, k1 double, b double, buckets int, key_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def build(docs: DataFrame, path: str, key: str, text: str = "text", vector: str | None = None, model=None, payload: list[str] | None = None, **options) -> None:
    """Postings and vectors of the same documents; without a ``vector`` column texts are embedded by ``model`` (see ``embedding.embed``)."""
    known = {k: options[k] for k in ("cells", "sample_rows") if k in options}
    build_postings(docs, path, key, text, **{k: v for k, v in options.items() if k not in known})
    points = docs if vector else embed(docs.select(key, text, *(c for c in payload or [] if c not in (key, text))), text, "__vector", model)
    build_vectors(points, path, key, vector or "__vector", payload, **known)


def _asked(path: str, spark: SparkSession, rows: list, meta) -> tuple[retrieval._Asked, DataFrame, list[int]]:
    """A block of queries, its terms as a frame (term, at, bucket), and their buckets."""
    asked = retrieval._Asked(rows)
    table = pa.table({"term": asked.terms, "at": pa.array(np.arange(len(asked.terms), dtype=np.int32))})
    terms = spark.createDataFrame(table).withColumn("bucket", _buckets(meta.buckets))
    return asked, terms, sorted(r.bucket for r in terms.select("bucket").distinct().collect())


class _Weighted:
    """Terms by query with their part of the score: query, term, factor (times in the query x idf), in the order of queries."""

    def __init__(self, asked: retrieval._Asked, idf: np.ndarray):
        n = np.diff(asked.begin)
        term = np.repeat(np.arange(len(n)), n)
        order = np.argsort(asked.query, kind="stable")
        self.query, self.term = asked.query[order], term[order]
        self.factor = asked.times[order] * idf[self.term]
        self.queries, self.terms = len(asked.keys), len(n)


def _limits(shared, floor: np.ndarray):
    """For a segment's heads: the queries whose bound there reaches their floor."""

    def run(key: tuple, heads: pa.Table) -> pa.Table:
        w: _Weighted = shared.value
        most = np.zeros(w.terms)
        most[heads.column("at").to_numpy()] = heads.column("most").to_numpy()
        limit = np.bincount(w.query, weights=w.factor * most[w.term], minlength=w.queries)
        some = np.flatnonzero((limit > 0) & (limit + SLACK >= floor))
        return pa.table({"q": pa.array(some), "segment": pa.array(np.full(len(some), key[0].as_py())), "bound": pa.array(limit[some])})

    return run


def _scores(shared, k: int):
    """The k best of a segment for the queries that are held against it."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        w: _Weighted = shared.value
        wanted = np.zeros(w.queries, bool)
        wanted[np.asarray(blocks.column("qs")[0].as_py(), np.int64)] = True
        at = blocks.column("at").to_numpy()
        ords = blocks.column("ords").combine_chunks()
        n = pc.list_value_length(ords).to_numpy()
        rows = np.zeros(w.terms, np.int64)
        begin = np.zeros(w.terms, np.int64)
        rows[at], begin[at] = n, np.cumsum(n) - n
        ord_, weight = ords.flatten().to_numpy(), blocks.column("weights").combine_chunks().flatten().to_numpy()
        m = int(ord_.max()) + 1
        out_q, out_o, out_s = [], [], []
        use = np.flatnonzero(wanted[w.query] & (rows[w.term] > 0))
        query, term, factor = w.query[use], w.term[use], w.factor[use]
        asked = np.unique(query)
        load = np.bincount(np.searchsorted(asked, query), weights=rows[term], minlength=len(asked)).astype(np.int64)
        for lo, hi in parted.runs(np.maximum(load, m), retrieval.PART_PAIRS, 256):  # queries at a time
            own = (query >= asked[lo]) & (query <= asked[hi - 1])
            q, t, f = np.searchsorted(asked[lo:hi], query[own]), term[own], factor[own]
            many = rows[t]
            place = np.arange(int(many.sum())) + np.repeat(begin[t] - np.cumsum(many) + many, many)
            score = np.bincount(np.repeat(q, many) * m + ord_[place], weights=np.repeat(f, many) * weight[place], minlength=(hi - lo) * m).reshape(-1, m)
            best_q, best_o = retrieval._best(score, score > 0, np.arange(m), k)
            out_q.append(asked[lo + best_q])
            out_o.append(best_o)
            out_s.append(score[best_q, best_o])
        join = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))
        return pa.table({"q": join(out_q, np.int64), "segment": pa.array(np.full(sum(map(len, out_q)), key[0].as_py())), "ord": join(out_o, np.int32), "score": join(out_s, np.float64)})

    return run


def _floors(heads: DataFrame, weighted: _Weighted, k: int) -> np.ndarray:
    """A score that k documents reach at least, for each query: the k-th best weight of one of its terms over all blocks, where heads tell it."""
    floor = np.zeros(weighted.queries)
    if k > BEST:
        return floor
    best = heads.select("at", F.explode("best").alias("w"))
    kept = retrieval.top(best, "at", "w", "w", k, "r").where(F.col("r") == k)
    weight = np.zeros(weighted.terms)
    for r in kept.select("at", "w").toLocalIterator():  # at most a row an asked term
        weight[r.at] = r.w
    np.maximum.at(floor, weighted.query, weighted.factor * weight[weighted.term])
    return floor


def search_text(spark: SparkSession, path: str, queries: DataFrame, query_key: str, doc_key: str, text: str = "text", k: int = 10, first: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """query_key, doc_key, score, rank: the same rows as ``retrieval.bm25`` gives, from the index alone.

    Of ``blocks`` only the folders of asked terms are read. Heads of blocks (their best weights) bound
    what a segment can give a query. A first pass scores the ``first`` segments of the largest bounds of
    each query; a second one the segments whose bound reaches the query's k-th best score so far. Segments
    are scored where their blocks meet, against all queries held against them; only their k best go on.
    """
    meta = spark.read.parquet(f"{path}/meta").first()
    blocks = spark.read.schema(_ddl(meta.key_type) + ", bucket int").parquet(f"{path}/blocks")
    segments = blocks.where("bucket = -1").select("segment", "keys")
    kinds = segments.schema["keys"].dataType.elementType.simpleString(), queries.schema[query_key].dataType.simpleString()
    asked_rows = queries.select(F.col(query_key).alias("k"), tokens(text).alias("t")).toLocalIterator()
    parts = []
    for rows in retrieval._blocks(asked_rows, lambda r: 64 + sum(len(x) + 24 for x in r["t"] or []), block_bytes):
        found = _block_hits(spark, path, rows, meta, blocks, k, first)
        if found is not None:
            hits, keys = found
            by = Window.partitionBy("q").orderBy(F.desc("score"))  # equal scores all stay until their keys are known
            hits = hits.select("q", "segment", "ord", F.round("score", 6).alias("score")).withColumn("r", F.rank().over(by)).where(F.col("r") <= k)
            names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(keys))), "name": pa.array(keys)})).select(F.col("q").alias("__q"), F.col("name").cast(kinds[1]).alias(query_key))
            parts.append(hits.join(segments, "segment").select(F.col("q").alias("__q"), F.element_at("keys", F.col("ord") + 1).alias(doc_key), "score").join(F.broadcast(names), "__q"))
    found = retrieval._union(parts, lambda: spark.createDataFrame([], f"{query_key} {kinds[1]}, {doc_key} {kinds[0]}, score double"))
    return retrieval.top(found.select(query_key, doc_key, "score"), query_key, "score", doc_key, k)


def _block_hits(spark: SparkSession, path: str, rows: list, meta, blocks: DataFrame, k: int, first: int) -> tuple[DataFrame, list] | None:
    """The best (q, segment, ord, score) of a block of queries, some for each segment, and the queries' keys."""
    asked = retrieval._Asked(rows)
    if not len(asked.terms):
        return None
    asked, terms, buckets = _asked(path, spark, rows, meta)
    terms = F.broadcast(terms.select("term", "at"))  # bounded with the block of queries
    idf = np.zeros(len(asked.terms))
    for r in spark.read.parquet(f"{path}/terms").where(F.col("bucket").isin(buckets)).join(terms, "term").select("at", "idf").toLocalIterator():
        idf[r.at] = r.idf
    weighted = _Weighted(asked, idf)
    shared = spark.sparkContext.broadcast(weighted)
    own = blocks.where(F.col("bucket").isin(buckets)).join(terms, "term")
    heads = own.select("segment", "at", "best")
    floor = _floors(heads, weighted, k)
    ddl = "q long, segment long, bound double"
    bounds = heads.select("segment", "at", F.col("best")[0].alias("most")).groupBy("segment").applyInArrow(_limits(shared, floor), ddl)
    score = lambda pairs: (
        own.join(pairs.groupBy("segment").agg(F.collect_set("q").alias("qs")), "segment").select("segment", "at", "ords", "weights", "qs").groupBy("segment").applyInArrow(_scores(shared, k), "q long, segment long, ord int, score double")
    )
    early = folders.stored(retrieval.top(bounds, "q", "bound", "segment", first, "r").select("q", "segment"), "index-pairs")
    one = folders.stored(score(early), "index-hits")
    reached = retrieval.top(one.select("q", "segment", "ord", F.round("score", 6).alias("score")), "q", "score", "segment", k, "r").where(F.col("r") == k)
    for r in reached.select("q", "score").toLocalIterator():  # at most a row a query
        floor[r.q] = max(floor[r.q], r.score)
    late = heads.select("segment", "at", F.col("best")[0].alias("most")).groupBy("segment").applyInArrow(_limits(shared, floor), ddl).join(early, ["q", "segment"], "left_anti")
    late = folders.stored(late.select("q", "segment"), "index-pairs")
    return one.unionByName(score(late)), asked.keys


def _near(shared, d: int, k: int, threshold: float | None, held_rows: int = 200_000):
    """The k best of a task for the queries that are held against its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, need, gap, reach = shared.value  # unit queries, (queries x cells), distances to the centres, distance of the k-th best so far
        found: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                v = np.asarray(part.column("unit").flatten(), np.float64).reshape(-1, d)
                cell, away = part.column("cell").to_numpy(), part.column("away").to_numpy()
                order = retrieval._in_order(part.column("key"))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    asked = np.flatnonzero(need[:, c])
                    for a in range(0, len(asked), 512):
                        some = asked[a : a + 512]
                        # a vector whose distance from the centre differs from the query's by more than the k-th best distance cannot be nearer
                        near = np.abs(gap[some, c][:, None] - away[at][None]) <= reach[some][:, None] + SLACK
                        live = at[near.any(0)]
                        if not len(live):
                            continue
                        score = q[some] @ v[live].T
                        hit = near[:, near.any(0)]
                        if threshold is not None:
                            hit = hit & (np.floor(score * 1e6 + 0.5) / 1e6 >= threshold)
                        i, r = retrieval._best(score, hit, order[live], k)
                        best = score[i, r]
                        found.append(pa.RecordBatch.from_arrays([pa.array(some[i]), part.column("key").take(pa.array(live[r])), pa.array(best), pa.array(np.floor(best * 1e6 + 0.5))], ["q", "key", "score", "rough"]))
                        held += len(i)
                        if held > held_rows:
                            found = retrieval._best_of(found, k)
                            held = 0  # what is kept is at most k a query
        for x in retrieval._best_of(found, k):
            yield x.select(["q", "key", "score"])

    return run


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, query_key: str, point_key: str, vector: str, k: int = 10, threshold: float | None = None, first: int = 4, block_bytes: int = 32 << 20, seen: list | None = None) -> DataFrame:
    """query_key, point_key, score, rank: the same rows as ``retrieval.dense`` gives, from the cells that can hold a hit.

    Of unit vectors the largest cosine is the least distance. A first pass searches the ``first`` nearest
    cells of each query; a second one those that the triangle inequality leaves: whose centre is not
    farther than the k-th best distance and the cell's radius together. Within a cell, vectors are passed
    over by their own distance from the centre. Only the folders of these cells are read. ``seen`` gets
    (pairs of query and cell held against each other, all pairs) of each block of queries.
    """
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # bounded by the parameter of ``build_vectors``
    vectors = spark.read.parquet(f"{path}/vectors")
    kinds = vectors.schema["key"].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    d, many = len(cells[0].centre), max(r.cell for r in cells) + 1
    centre, radius = np.zeros((many, d)), np.full(many, -np.inf)
    for r in cells:
        centre[r.cell], radius[r.cell] = r.centre, r.radius
    asked = sound(queries.select(F.col(query_key).alias("k"), F.col(vector).cast("array<double>").alias("v")), "v").where(F.size("v") == d).toLocalIterator()
    parts = []
    for rows in retrieval._blocks(asked, lambda r: 64 + 8 * d + 9 * many, block_bytes):
        q = np.array([r["v"] for r in rows], np.float64)
        q /= np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        gap = np.sqrt(np.maximum(((q[:, None] - centre[None]) ** 2).sum(2), 0)) if len(q) * many * d < 1 << 24 else np.sqrt(np.maximum(2 - 2 * q @ centre.T + (centre**2).sum(1) - 1, 0))
        least = np.where(np.isfinite(radius), gap - radius, np.inf)
        cut = np.sort(least, 1)[:, min(first, many) - 1][:, None]
        need = (least <= cut) & np.isfinite(least)
        reach = np.full(len(q), 2.0 if threshold is None else np.sqrt(max(0.0, 2 - 2 * (threshold - 1e-6))))

        def hits(need, reach, q=q, gap=gap):
            shared = spark.sparkContext.broadcast((q, need, gap, reach))
            some = vectors.where(F.col("cell").isin(np.flatnonzero(need.any(0)).tolist())).select("cell", "key", "unit", "away")
            return some.mapInArrow(_near(shared, d, k, threshold), f"q long, key {kinds[0]}, score double").select("q", "key", F.round("score", 6).alias("score"))

        one = hits(need, reach)
        for r in retrieval.top(one, "q", "score", "key", k, "r").where(F.col("r") == k).toLocalIterator():  # at most a row a query
            reach[r.q] = min(reach[r.q], np.sqrt(max(0.0, 2 - 2 * (r.score - 1e-6))))
        late = (least <= reach[:, None] + SLACK) & np.isfinite(least) & ~need
        if seen is not None:
            seen.append((int((need | late).sum()), int(np.isfinite(least).sum())))
        found = one.unionByName(hits(late, reach)) if late.any() else one
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(rows))), "name": pa.array([r["k"] for r in rows])})).select(F.col("q").alias("__q"), F.col("name").cast(kinds[1]).alias(query_key))
        best = retrieval.top(found, "q", "score", "key", k).withColumnRenamed("q", "__q")
        parts.append(best.join(F.broadcast(names), "__q").select(query_key, F.col("key").alias(point_key), "score", "rank"))
    return retrieval._union(parts, lambda: spark.createDataFrame([], f"{query_key} {kinds[1]}, {point_key} {kinds[0]}, score double, rank long"))
