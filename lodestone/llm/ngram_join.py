"""N-gram Jaccard join with token-combination prefixes.

Tokens are distinct word shingles, in one global order: rarest first. A document of n tokens that keeps
at least o = ceil(t n) of them in any partner can lose at most n - o. A prefix of weight n - o + 1
therefore leaves every partner at least one signature in common:

* a token of the rare class is a signature by itself and weighs 1;
* the tokens of a frequent class are indexed as combinations of k = 2, and the prefix is extended: p
  tokens of a class weigh p - 1. There are as many frequent classes as an eighth of the tokens, so
  combinations stay few; documents of about the same size (bands) use the same classes.

Candidates are verified exactly, on whole sets. Groups are never expanded into all pairs: every
document is first paired with one leader (the smallest it meets of about its size), then with a few
drawn leaders of other components. After that, all pairs below a signature that are in different
components are bounded by histograms, in blocks, and verified where the bound allows the similarity: in
rounds of two pairs a component where they are many, as pairs inside a component need no look. Sets
that are equal are one node from the start, by a 128-bit sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B
from .components import connected

#: A signature that more documents of one chunk share than this is dealt to several partitions.
HEAVY = 64
CHUNK_BYTES = 8 << 20
SKETCH_PARTS = 64
#: Frequent tokens: counted more than this many times the mean count (and 64).
FREQUENT = 8
#: Buckets of the histograms that bound an overlap: by chance, d tokens that two sets do not share meet in about d * d / BUCKETS of them.
BUCKETS = 1024
#: Bands of set sizes: powers of 1.25, four to a band.
BOUNDS = np.array(sorted({-(-(5**k) // 4**k) for k in range(1, 120) if 5**k // 4**k < 2**40}), np.int64)


def shingles(data, offsets, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a slice's documents: hash and row, in order of rows. Fewer words than ``width`` make one shingle."""
    starts, ends, first = B.words(data, offsets)
    hashes = B.hash_words(data, starts, ends, lower=True)
    key, at = B.windows(hashes, first, width)
    doc = np.searchsorted(first, at, "right") - 1
    counts = np.diff(first)
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        if len(few):
            own = np.full(len(few), n, B.U64)
            for j in range(n):
                own = own * B.U64(0xD6E8FEB86659FD93) + hashes[first[few] + j]
            key, doc = np.concatenate([key, B.splitmix(own + B.U64(n))]), np.concatenate([doc, few])
    mixed = key ^ B.splitmix(doc.astype(B.U64) + B.U64(1))
    _, one = np.unique(mixed, return_index=True)
    key, doc = key[one], doc[one]
    order = np.argsort(doc.astype(np.uint16) if len(counts) < 65536 else doc, kind="stable")
    return key[order], doc[order]


def _count(width: int, bits: int):
    """Counts of hashed shingles over a task, as blobs of equal parts of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint16)  # a task's counts stop at the type's largest
        for batch in batches:
            for _lo, _hi, data, offsets in B.text_slices(batch.column("text")):
                key, _doc = shingles(data, offsets, width)
                at, n = np.unique((key >> B.U64(64 - bits)).astype(np.int32 if bits < 32 else np.int64), return_counts=True)
                table[at] = np.minimum(table[at] + n, 65535)
        each = len(table) // SKETCH_PARTS
        for k in range(SKETCH_PARTS):
            part = table[k * each : (k + 1) * each]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([B.pack(B.shrink(part))], pa.binary())], ["part", "blob"])

    return run


def _total():
    """Adds up each part's counts and gives them as one byte each: exact to 128, then an eighth of a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                (part,) = B.unpack(blob.as_py())
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        for k, s in sums.items():
            level = np.where(s <= 128, s, np.minimum(255, 128 + 8 * np.log2(np.maximum(s, 1) / 128))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(s.sum())], pa.int64()), pa.array([B.pack(level)], pa.binary())], ["part", "n", "blob"])

    return run


def _sketch(docs: DataFrame, width: int, bits: int) -> tuple[np.ndarray, int]:
    """Each hashed shingle's count over all documents (one byte of level), and the level from which a shingle is frequent.

    The table has 2**bits bytes whatever the input; it orders the tokens and classes them, so that a
    collision makes a prefix less selective, never a result wrong.
    """
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_count(width, bits), "part int, blob binary")
    rows = counted.repartitionById(min(SKETCH_PARTS, max(8, B.parts(spark))), F.pmod("part", F.lit(min(SKETCH_PARTS, max(8, B.parts(spark)))))).mapInArrow(_total(), "part int, n long, blob binary").collect()
    table, each, n = np.zeros(1 << bits, np.uint8), (1 << bits) // SKETCH_PARTS, 0
    for row in rows:
        table[row.part * each : (row.part + 1) * each] = B.unpack(row.blob)[0]
        n += row.n
    most = max(64, FREQUENT * n / len(table))
    return table, int(most if most <= 128 else min(255, 128 + 8 * np.log2(most / 128)))


def _bands(n: int) -> list[int]:
    s = int(np.searchsorted(BOUNDS, n, "right"))
    return [s // 4] + [s // 4 - 1] * (s % 4 == 0 and s >= 4) + [s // 4 + 1] * (s % 4 == 3)


def combinations(tokens: np.ndarray, need: int, n: int) -> tuple[list[int], list[np.ndarray]]:
    """For frequent tokens in global order that must bring ``need`` of weight: how many are single signatures, and the signatures of combinations."""
    single, out = 0, []
    for band in _bands(n):
        low = int(BOUNDS[4 * band - 1]) if band else 1
        if low < 32:
            single = max(single, need)
            continue
        classes = B.U64(low // 8)
        of = B.splitmix(tokens + B.U64(band)) % classes
        order = np.argsort(of, kind="stable")
        nth = np.empty(len(tokens), np.int64)
        begin = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
        nth[order] = np.arange(len(tokens)) - np.repeat(begin, np.diff(np.append(begin, len(tokens))))
        weight = np.cumsum(nth > 0)
        size = int(np.searchsorted(weight, need)) + 1
        if size > len(tokens):  # cannot happen: an eighth of the tokens is lost at most
            raise AssertionError("a prefix is too light")
        order = order[order < size]
        a, of = tokens[order], of[order]
        for gap in range(1, len(a)):
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            x, y = np.minimum(a[gap:][same], a[:-gap][same]), np.maximum(a[gap:][same], a[:-gap][same])
            out.append(B.splitmix(x * B.U64(3) + B.splitmix(y) + B.U64(band)))
    return single, out


def signatures(key: np.ndarray, doc: np.ndarray, rows: int, table: np.ndarray, frequent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a slice's documents (those of at least 4 tokens; smaller sets can only equal each other)."""
    level = table[(key >> B.U64(64 - int(len(table)).bit_length() + 1)).astype(np.int64)]
    order = np.argsort((level.astype(B.U64) << B.U64(56)) | (key >> B.U64(8)))
    order = order[np.argsort(doc[order].astype(np.uint16) if rows < 65536 else doc[order], kind="stable")]
    key, level = key[order], level[order]
    n = np.bincount(doc, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    weight = n - -(-least * n // 100) + 1
    rare = np.bincount(doc[order], weights=level < frequent, minlength=rows).astype(np.int64)
    take = np.where(n >= 4, np.minimum(weight, rare), 0)
    more, where = [], []
    for d in np.flatnonzero((n >= 4) & (rare < weight)).tolist():
        single, combined = combinations(key[first[d] + rare[d] : first[d + 1]], int(weight[d] - rare[d]), int(n[d]))
        take[d] += single
        for c in combined:
            more.append(c)
            where.append(np.full(len(c), d))
    nth = np.arange(len(key)) - first[doc]
    good = nth < take[doc]
    return np.concatenate([key[good], *more]), np.concatenate([doc[good], *where])


def _index(width: int, least: int, parts: int, shared, heavy_from: int, chunk_bytes: int):
    """What a chunk gives: every document's size and set sum (part -1 - k), and the signatures of one document of each set, dealt by hash."""

    def flush(held, metas) -> Iterator[pa.RecordBatch]:
        ids, n, one, two = (np.concatenate(x) for x in zip(*metas, strict=True))
        sig, who = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.lexsort((ids, two, one, n))
        same = (n[order][1:] == n[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        chief = np.ones(len(ids), bool)
        chief[order[1:][same]] = False
        good = chief[who]
        sig, who = sig[good], who[good]
        by = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by] = np.arange(len(ids))
        who = rank[who]  # documents by id, so that ids make short differences
        ids_by, n_by = ids[by], n[by]
        part = (sig % B.U64(parts)).astype(np.int64)
        rows = [(int(ids[0]) % parts, 1, B.pack(ids, n, one, two))]
        # what many documents of this chunk share is dealt by chunk as well; the home partition gets a mark, one document
        unique, back, times = np.unique(sig, return_inverse=True, return_counts=True)
        often = (times > heavy_from)[back]
        salt = B.splitmix(ids_by[:1].view(B.U64) + B.U64(len(sig)))
        spread = (B.splitmix(sig ^ salt) % B.U64(parts)).astype(np.int64)
        heavy = np.flatnonzero(often)
        first = heavy[np.unique(back[heavy], return_index=True)[1]]
        for kind, at_all, to in ((0, np.flatnonzero(~often), part), (4, heavy, spread), (5, first, part)):
            order = at_all[np.lexsort((who[at_all], to[at_all]))]
            edge = np.searchsorted(to[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[p] : edge[p + 1]]
                docs, counts = np.unique(who[at], return_counts=True)
                base = ids_by[docs]
                rows.append((p, kind, B.pack(sig[at], base[:1], B.shrink(np.diff(base)), B.shrink(n_by[docs]), B.shrink(counts))))
                if len(rows) >= 64:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, frequent), held, metas, size, base = shared.value, [], [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                key, doc = shingles(data, offsets, width)
                rows = hi - lo
                n = np.bincount(doc, minlength=rows)
                sums = []
                for salt in (5, 9):
                    total = np.zeros(len(key) + 1, B.U64)
                    np.cumsum(B.splitmix(key + B.U64(salt)), out=total[1:])
                    at = np.concatenate([[0], np.cumsum(n)])
                    sums.append(total[at[1:]] - total[at[:-1]])
                sig, who = signatures(key, doc, rows, table, frequent, least)
                held.append((sig, who + base))
                metas.append((ids[lo:hi], n, *sums))
                base += rows
                size += len(data)
                if size >= chunk_bytes:
                    yield from flush(held, metas)
                    held, metas, size, base = [], [], 0, 0
        if metas:
            yield from flush(held, metas)

    return run


def _rows(rows) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


def _leaders(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For runs sorted by size: the place of the smallest of about each one's size (no more than 1.25 times)."""
    start = np.zeros(len(n), bool)
    start[begin] = True
    while True:
        lead = np.maximum.accumulate(np.where(start, np.arange(len(n)), 0))
        bad = 4 * n > 5 * n[lead]
        if not bad.any():
            return lead
        fresh = bad & ~np.concatenate([[False], bad[:-1] & (lead[1:] == lead[:-1])])
        start |= fresh


def _meet(parts: int):
    """Below each signature of a partition: every document's smallest leader (kind 2), and the runs (kind 3, dealt by run, each set of members once).

    Signatures of kind 4 are frequent ones, of which this partition has the documents of some chunks only;
    those of kind 5 are marks, one document a chunk, that tell their home partition so. Their runs are
    named by the signature (kind 6), so that the parts of one run meet again as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 4: [], 5: []}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 1:
                    yield _rows([(0, 1, blob.as_py())])
                    continue
                sig, base, step, n, counts = B.unpack(blob.as_py())
                ids = np.cumsum(np.concatenate([base, step.astype(np.int64)]))
                counts = counts.astype(np.int64)
                held[kind].append((sig, np.repeat(ids, counts), np.repeat(n.astype(np.int64), counts), np.full(len(sig), kind, np.int8)))
        marked = np.unique(np.concatenate([x[0] for x in held[5]])) if held[5] else np.zeros(0, B.U64)
        for own in (held[0] + held[5], held[4]):
            if own:
                yield from _runs_below(*(np.concatenate(x) for x in zip(*own, strict=True)), marked, parts)
                own.clear()

    return run


def _runs_below(sig, ids, n, kind, marked, parts: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(sig)
    sig = sig[order]
    more = np.zeros(len(sig), bool)
    more[1:] = sig[1:] == sig[:-1]
    more[:-1] |= more[1:]
    if len(marked):  # a lone document still belongs to a run whose rest is elsewhere
        more |= _in(marked, sig)
    order, sig = order[more], sig[more]
    ids, n, kind = ids[order], n[order], kind[order]
    order = np.lexsort((kind, ids, n, sig))
    sig, ids, n, kind = sig[order], ids[order], n[order], kind[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids, n, kind = sig[fresh], ids[fresh], n[fresh], kind[fresh]
    if not len(sig):
        return
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(begin, len(sig)))
    lead = _leaders(n, begin)
    led = np.flatnonzero(lead != np.arange(len(lead)))
    led = led[np.lexsort((ids[lead[led]], n[lead[led]], ids[led]))]
    led = led[np.concatenate([[True], ids[led][1:] != ids[led][:-1]])] if len(led) else led
    part = (B.splitmix(ids[led].view(B.U64)) % B.U64(parts)).astype(np.int64)
    led = led[np.argsort(part, kind="stable")]
    edge = np.searchsorted(np.sort(part), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)).tolist():
        some = led[edge[p] : edge[p + 1]]
        yield _rows([(p, 2, B.pack(ids[some], ids[lead[some]], B.shrink(n[lead[some]])))])
    shared = _in(marked, sig[begin]) | (kind[begin] == 4)
    total = np.add.reduceat(B.splitmix(ids.view(B.U64)), begin) + length.astype(B.U64)
    far = (length == 1) | ((length == 2) & (4 * n[begin + length - 1] > 5 * n[begin])) | shared
    _, one = np.unique(np.where(far, B.U64(0), total), return_index=True)
    one = one[~far[one]]
    part = (total[one] % B.U64(parts)).astype(np.int64)
    one = one[np.argsort(part, kind="stable")]
    edge = np.searchsorted(np.sort(part), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)).tolist():
        runs = one[edge[p] : edge[p + 1]]
        size = length[runs]
        at = np.arange(int(size.sum())) + np.repeat(begin[runs] - np.cumsum(size) + size, size)
        yield _rows([(p, 3, B.pack(total[runs], B.shrink(size), ids[at], B.shrink(n[at])))])
    at = np.flatnonzero(np.repeat(shared, length) & (kind != 5))
    for k in range(0, len(at), 1 << 16):
        some = at[k : k + (1 << 16)]
        yield _rows([(0, 6, B.pack(sig[some], ids[some], B.shrink(n[some])))])


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


def _first_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of a partition with the smallest of its leaders, as a pair."""
    held = [B.unpack(blob.as_py()) for batch in batches for blob in batch.column("blob")]
    if held:
        ids, lead, n = (np.concatenate([x[k].astype(np.int64) for x in held]) for k in range(3))
        order = np.lexsort((lead, n, ids))
        ids, lead = ids[order], lead[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, lead = ids[first], lead[first]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids, lead)), pa.array(np.minimum(ids, lead))], ["u", "v"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of a partition once, as rows."""
    seen: set[int] = set()
    for batch in batches:
        for blob in batch.column("blob"):
            name, size, ids, n = B.unpack(blob.as_py())
            size = size.astype(np.int64)
            new = np.array([x not in seen for x in name.tolist()], bool)
            seen.update(name.tolist())
            keep = np.repeat(new, size)
            name = np.repeat(name, size)[keep].view(np.int64)
            ids, n = ids[keep], n[keep].astype(np.int64)
            for k in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (name, ids, n)], ["run", "doc_id", "n"])


def _open(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                columns = [x.astype(np.int64) if x.dtype != B.U64 else x.view(np.int64) for x in B.unpack(blob.as_py())]
                for k in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in columns], names)

    return run


def _rows_of(index: DataFrame, kind: int, *names: str) -> DataFrame:
    return index.where(F.col("kind") == kind).select("blob").mapInArrow(_open(list(names)), ", ".join(f"{c} long" for c in names))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed: a third of the bytes of their sets of shingles."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())], ["doc_id", "text"])


def _overlap(width: int, least: int, rows: int = 256):
    """Pairs of texts whose sets are similar enough; a text that many pairs of a slice share is opened once."""

    def similar(a: list[bytes], b: list[bytes]) -> list[bool]:
        import zstandard

        place: dict[bytes, int] = {}
        at = [[place.setdefault(x, len(place)) for x in side] for side in (a, b)]
        open_ = zstandard.ZstdDecompressor()
        sets: list[np.ndarray] = []
        for lo, hi, data, offsets in B.text_slices(pa.array([open_.decompress(x) for x in place], pa.large_binary())):
            key, doc = shingles(data, offsets, width)
            edge = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
            sets += [np.sort(key[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        good = []
        for i, j in zip(*at, strict=True):
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            good.append(100 * both >= least * (len(x) + len(y) - both) and both > 0)
        return good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                good = pa.array(similar(part.column("a").to_pylist(), part.column("b").to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("u").filter(good), part.column("v").filter(good)], ["u", "v"])

    return run


def _near(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ends (id), and of a few others.

    Which documents those are goes to the scan as a bitmap of at most 2**20 words of 64 bits, a bound
    that holds whatever the input; a join on ids decides exactly afterwards.
    """
    near = docs.select("doc_id", "text").join(F.broadcast(_marks(ends)), F.expr(f"({_SPOT.format('doc_id')}) div 64 = word"))
    return near.where(_MARKED).select("doc_id", "text")


_SPOT = "pmod(xxhash64(cast({} as long)), 67108864L)"
_BIT = "shiftleft(1L, cast(pmod({}, 64) as int))"
_MARKED = f"(bits & {_BIT.format(_SPOT.format('doc_id'))}) <> 0"


def _marks(ends: DataFrame) -> DataFrame:
    """The bitmap (word, bits) of the ids in ends."""
    return ends.selectExpr(f"{_SPOT.format('id')} as s").groupBy(F.expr("s div 64").alias("word")).agg(F.bit_or(F.expr(_BIT.format("s"))).alias("bits"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (id). Only rows that the bitmap of those ids marks are moved, to be joined; the others stay where they are read."""
    columns = [F.col(c) for c in docs.columns]
    met = docs.join(F.broadcast(_marks(gone)), F.expr(f"({_SPOT.format('doc_id')}) div 64 = word"), "left")
    rest = met.where(f"not coalesce({_MARKED}, false)").select(*columns)
    # no anti-join: Spark would push it below the join with the bitmap, and move every row
    there = gone.distinct().select("id", F.lit(True).alias("there"))
    return rest.unionByName(met.where(_MARKED).select(*columns).join(there, F.col("doc_id") == F.col("id"), "left").where("there is null").select(*columns))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs u, v whose sets are similar enough; only the texts of documents in pairs travel, compressed, and are opened into sets where a pair meets."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    texts = _near(docs, ends).mapInArrow(_squeezed, "doc_id long, text binary")
    a, b = texts.toDF("u", "a"), texts.toDF("v", "b")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_overlap(width, least), "u long, v long")


def _members(runs: DataFrame, comp: DataFrame) -> DataFrame:
    """The members, with their components, of runs that hold more than one component; major: the component with most."""
    return _mixed(B.cut_small(runs.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("run", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))))


def _mixed(member: DataFrame) -> DataFrame:
    sized = member.groupBy("run", "comp").agg(F.count("*").alias("c"))
    major = B.cut_small(sized.groupBy("run").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("major")).where("k > 1"))
    return B.cut_small(member.join(major, "run").select("run", "doc_id", "n", "comp", "major"))


def _merged(member: DataFrame) -> DataFrame:
    """Runs whose members of the smallest and of the largest hash are the same, as one run of all their members.

    The copies of one text meet below hundreds of signatures, each time nearly all of them. Whoever meets
    below one of the runs meets in the merged one as well, which never has more members than they have in all.
    """
    h = F.xxhash64("doc_id")
    of = B.cut_small(member.groupBy("run").agg(F.xxhash64(F.min(h), F.max(h)).alias("merged")))
    return _mixed(B.cut_small(member.join(of, "run").select(F.col("merged").alias("run"), "doc_id", "n", "comp").distinct()))


_CLOSE = "5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n and x.comp <> y.comp"
_ENDS = ["greatest(x.doc_id, y.doc_id) as u", "least(x.doc_id, y.doc_id) as v"]


def _leading(member: DataFrame, leaders: int = 3) -> DataFrame:
    """At most ``leaders`` pairs for each document: with documents of other components, drawn by hash, that lead runs of its."""
    draws = [F.min_by(F.struct("doc_id", "n", "comp"), F.xxhash64("doc_id", F.lit(k))) for k in range(leaders)]
    lead = B.cut_small(member.groupBy("run").agg(F.array(*draws).alias("y")))
    met = member.join(lead, "run").select(F.struct("doc_id", "n", "comp").alias("x"), "run", F.posexplode("y").alias("k", "y"))
    met = met.where("5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n and x.comp <> y.comp")
    one = met.groupBy("x.doc_id", "k").agg(F.min_by(F.struct("x", "y"), F.xxhash64("run", "k")).alias("p"))
    return one.select("p.x", "p.y").selectExpr("greatest(x.doc_id, y.doc_id) as u", "least(x.doc_id, y.doc_id) as v").distinct()


def _histograms(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                key, doc = shingles(data, offsets, width)
                bucket = (key >> B.U64(32)).astype(np.int64) % BUCKETS
                rows = []
                for a, b in pairwise(np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()):
                    counts = np.bincount(bucket[a:b], minlength=BUCKETS)
                    most = counts.max()
                    if most > 65535:
                        counts[:] = 65535  # bounds nothing, excludes nothing
                    rows.append(counts.astype(np.uint8 if most < 256 else np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "histogram"])

    return run


def _bounded(least: int):
    """Of units (rows sorted by unit, then side), the pairs of both sides whose histograms allow the similarity."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        unit, side, ids, n, comp, major = (rows.column(c).to_numpy() for c in ("unit", "side", "doc_id", "n", "comp", "major"))
        table = rows.column("histogram").to_pylist()
        small = all(len(x) == BUCKETS for x in table)
        table = np.frombuffer(b"".join(x if small or len(x) == 2 * BUCKETS else np.frombuffer(x, np.uint8).astype(np.uint16).tobytes() for x in table), np.uint8 if small else np.uint16).reshape(-1, BUCKETS)
        rough = table.reshape(len(table), BUCKETS // 8, 8).sum(axis=2, dtype=np.uint16 if small else np.uint32)
        run, runs = rows.column("run").to_numpy(), rows.column("runs").combine_chunks()
        runs = runs if isinstance(runs, pa.Array) else runs.chunk(0)
        of, start = runs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())])
        u, v, cu, cv, bound = [], [], [], [], []
        edge = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            m = a + int((side[a:b] == 0).sum())
            ys = np.arange(m, b)
            for x in range(a, m):
                fit = (comp[ys] != comp[x]) & ((comp[ys] == major[ys]) | (ids[x] > ids[ys])) & (5 * n[ys] >= 4 * n[x]) & (5 * n[x] >= 4 * n[ys])
                y = ys[fit]
                for counts in (rough, table):
                    most = np.minimum(counts[y], counts[x]).sum(axis=1, dtype=np.int64)
                    may = (100 + least) * most >= least * (n[x] + n[y])
                    y, most = y[may], most[may]
                if len(y):  # a pair counts below the first of the runs that it shares
                    mine = set(of[start[x] : start[x + 1]].tolist())
                    own = np.array([next(r for r in of[start[k] : start[k + 1]].tolist() if r in mine) == run[x] for k in y.tolist()])
                    y, most = y[own], most[own]
                up = ids[y] > ids[x]
                u.append(np.maximum(ids[y], ids[x]))
                v.append(np.minimum(ids[y], ids[x]))
                cu.append(np.where(up, comp[y], comp[x]))
                cv.append(np.where(up, comp[x], comp[y]))
                bound.append(1000 * most // (n[x] + n[y] - most))
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v, cu, cv, bound)]
        pair = np.unique(np.stack(found), axis=1)
        del rows, table, rough
        B.release()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["u", "v", "cu", "cv", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            unit = held.column("unit").to_numpy()
            last = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if len(unit) and (unit != unit[-1]).any() else 0
            if last:
                yield pairs(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield pairs(held.combine_chunks())

    return run


def _apart(docs: DataFrame, member: DataFrame, width: int, least: int, block: int = 1024) -> DataFrame:
    """All pairs below a signature in different components (cu, cv), but those that an exact bound excludes; bound: the most that the similarity can be, in thousandths.

    The documents outside a run's largest component are its queries, and all its members are the rows;
    both are dealt in blocks, and a unit of work is one block against one block, so that a large run is
    many units. The bound on an overlap is the sum of the smaller counts of two histograms of ``BUCKETS`` buckets, first with eight buckets in one.
    """
    n = B.parts(docs.sparkSession)
    needed = _near(docs, member.select(F.col("doc_id").alias("id"))).mapInArrow(_histograms(width), "doc_id long, histogram binary")
    size = B.cut_small(member.groupBy("run").agg(F.ceil(F.count("*") / block).cast("int").alias("ys"), F.ceil(F.count_if(F.expr("comp <> major")) / block).cast("int").alias("xs")))
    of = member.groupBy("doc_id").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    rows = member.join(size, "run").join(needed.join(of, "doc_id"), "doc_id")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    x = rows.where("comp <> major").withColumn("i", dealt("xs")).withColumn("j", spread("ys")).withColumn("side", F.lit(0))
    y = rows.withColumn("j", dealt("ys")).withColumn("i", spread("xs")).withColumn("side", F.lit(1))
    unit = x.unionByName(y).select(F.xxhash64("run", "i", "j").alias("unit"), "side", "run", "runs", "doc_id", "n", "comp", "major", "histogram")
    unit = unit.repartition(n, "unit").sortWithinPartitions("unit", "side", "doc_id")
    return unit.mapInArrow(_bounded(least), "u long, v long, cu long, cv long, bound long").distinct()


def _joined(named: DataFrame, open_: DataFrame, comp: DataFrame, width: int, least: int, rounds: int = 4) -> DataFrame:
    """The components after all pairs (u, v, cu, cv, bound) are decided.

    While there are many more pairs than components, a round verifies two pairs of each component, the one
    of the largest bound and one drawn by hash; pairs that the links put into one component need no look
    any more. What is left after that is verified whole.
    """
    for k in range(rounds):
        sides = open_.select(F.col("cu").alias("c"), "u", "v", "bound").unionByName(open_.select(F.col("cv").alias("c"), "u", "v", "bound"))
        pair = F.struct("u", "v")
        best = B.cut_small(sides.groupBy("c").agg(F.max_by(pair, F.struct("bound", F.xxhash64("u", "v"))).alias("p"), F.min_by(pair, F.xxhash64("u", "v", F.lit(k))).alias("q")))
        if open_.count() <= 4 * best.count():
            break
        some = B.cut_small(best.select("p.u", "p.v").unionByName(best.select("q.u", "q.v")).distinct())
        links = B.cut_small(_verified(named, some, width, least))
        if links.isEmpty():
            break
        comp = B.cut_small(connected(links.unionByName(comp.toDF("u", "v"))))
        left = open_.join(some, ["u", "v"], "left_anti").select("u", "v", "bound")
        left = left.join(comp.toDF("u", "cu"), "u", "left").join(comp.toDF("v", "cv"), "v", "left")
        left = left.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"), "bound")
        open_ = B.cut_small(left.where("cu <> cv"))
    return B.cut_small(connected(_verified(named, open_.select("u", "v"), width, least).unionByName(comp.toDF("u", "v"))))


def _linked(named: DataFrame, width: int, least: int, sketch_bits: int, heavy: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id and n_shingles, and the components; rows that share a doc_id have the same text."""
    spark = named.sparkSession
    n = B.parts(spark)
    shared = spark.sparkContext.broadcast(_sketch(named, width, sketch_bits))
    index = named.mapInArrow(_index(width, least, n, shared, heavy, chunk_bytes), "part int, kind int, blob binary")
    index = B.cut(index.repartitionById(n, F.col("part")).mapInArrow(_meet(n), "part int, kind int, blob binary"))

    meta = _rows_of(index, 1, "doc_id", "n", "one", "two")
    full = meta.where("n > 0")
    chief = B.cut_small(full.groupBy("n", "one", "two").agg(F.min("doc_id").alias("v"), F.count("*").alias("c")).where("c > 1"))
    equal = full.join(chief, ["n", "one", "two"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")

    dealt = lambda kind: index.where(F.col("kind") == kind).repartitionById(n, F.col("part")).select("blob")
    led = B.cut_small(dealt(2).mapInArrow(_first_leaders, "u long, v long").distinct())
    links = _verified(named, led, width, least).unionByName(equal)
    comp = B.cut_small(connected(links))
    runs = B.cut_small(dealt(3).mapInArrow(_runs, "run long, doc_id long, n long").unionByName(_rows_of(index, 6, "run", "doc_id", "n").distinct()))
    pairs = B.cut_small(_leading(_members(runs, comp)).join(led, ["u", "v"], "left_anti"))
    comp = B.cut_small(connected(_verified(named, pairs, width, least).unionByName(comp.toDF("u", "v"))))
    rest = B.cut_small(_apart(named, _merged(_members(runs, comp)), width, least).join(led.unionByName(pairs), ["u", "v"], "left_anti"))
    comp = _joined(named, rest, comp, width, least)

    return meta.select("doc_id", F.col("n").alias("n_shingles")), comp


def similar_components(docs: DataFrame, width: int = 5, least: int = 80, sketch_bits: int = 24, heavy: int = HEAVY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles have a Jaccard similarity of at least ``least`` per cent.

    Lower-cases A-Z; words are runs of bytes other than 0x20 and 0x09-0x0D. Returns for each row of docs
    doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included).

    Null and empty texts, and those without words, have no shingle and no link. A row without doc_id has
    no link and no component. Rows that share a doc_id are one node: what links to any of their texts
    links to it. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id is not null")
    again = B.cut_small(named.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("again")))
    if again.isEmpty():
        whole, comp = _linked(named, width, least, sketch_bits, heavy, chunk_bytes)
    else:  # texts are nodes of their own until they are linked
        node = F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
        texts = named.join(again, "doc_id", "left").select("doc_id", "text", "again", node.alias("node"))
        of = B.cut_small(texts.where("again").select("node", F.col("doc_id").alias("id")).distinct())
        whole, comp = _linked(texts.select(F.col("node").alias("doc_id"), "text"), width, least, sketch_bits, heavy, chunk_bytes)
        named_by = lambda df, c: df.join(of.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("id", c)).drop("id")
        whole = named_by(whole, "doc_id")
        comp = B.cut_small(connected(named_by(named_by(comp, "node"), "component").select(F.col("node").alias("u"), F.col("component").alias("v"))))
    lone = docs.where("doc_id is null").mapInArrow(_sizes(width), "doc_id long, n_shingles long")
    return whole.unionByName(lone).join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                _key, doc = shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.bincount(doc, minlength=hi - lo))], ["doc_id", "n_shingles"])

    return run


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: five-word shingles, similarity of 0.8 or more."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS s
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""
