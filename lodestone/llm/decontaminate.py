"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words. Patterns are windows of ``width`` consecutive words of a benchmark item (an item
with fewer words is one pattern). For patterns of one length m, a *block* is two consecutive words
(one where m is 1), as in Wu and Manber's algorithm:

* SHIFT, by block: how far the search window may move, i.e. m-2 less the rightmost place of the block
  in any pattern, and m-1 for a block of no pattern;
* HASH: where the shift is 0, the block that ends the window selects a bucket of test strings;
* the whole window is compared with the bucket's strings (word symbols first, then the bytes).

The search moves many windows at once: each document is divided into stretches of start positions,
each with its own cursor, and one numpy step looks up and moves all cursors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B

#: 0-9, a-z (A-Z once lower-cased) and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
STRETCH = 512


def _normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    low = B.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class WuManber:
    """Patterns of one length in words, as sequences of word ids (1.. in the patterns' vocabulary)."""

    def __init__(self, patterns: np.ndarray, vocabulary: int):
        self.patterns, self.m = patterns, patterns.shape[1]
        self.block = min(2, self.m)
        self.base = vocabulary + 1
        blocks = {}
        last = self.m - self.block
        codes = self.code(patterns, np.arange(last + 1)[None, :] + np.zeros((len(patterns), 1), np.int64))
        for j in range(last + 1):
            for c in np.unique(codes[:, j]).tolist():
                blocks[c] = last - j
        self.keys = np.array(sorted(blocks), np.int64)
        self.shift = np.array([blocks[k] for k in self.keys.tolist()], np.int64)
        order = np.argsort(codes[:, last], kind="stable")
        self.by_suffix, self.suffix = order, codes[order, last]

    def code(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code of the block that begins at each place; -1 where a word isn't in the vocabulary."""
        a = np.take_along_axis(rows, at, 1) if rows.ndim == 2 else rows[at]
        if self.block == 1:
            return np.where(a > 0, a, -1)
        b = np.take_along_axis(rows, at + 1, 1) if rows.ndim == 2 else rows[at + 1]
        return np.where((a > 0) & (b > 0), a * self.base + b, -1)

    def search(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's first word, pattern) of every occurrence within the word ranges begin..end."""
        m, block = self.m, self.block
        lengths = np.maximum(end - begin - m + 1, 0)
        pieces = -(-lengths // STRETCH)
        doc = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cursor = begin[doc] + nth * STRETCH
        stop = np.minimum(cursor + STRETCH, begin[doc] + lengths[doc])
        found_at, found = [], []
        while len(cursor):
            code = self.code(ids, cursor + m - block)
            k = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            known = self.keys[k] == code
            move = np.where(known, self.shift[k], m - block + 1)
            if (zero := move == 0).any():
                at, c = cursor[zero], code[zero]
                lo, hi = np.searchsorted(self.suffix, c, "left"), np.searchsorted(self.suffix, c, "right")
                n = hi - lo
                who = np.repeat(np.arange(len(at)), n)
                pattern = self.by_suffix[np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                place = at[who]
                for j in range(m):
                    same = ids[place + j] == self.patterns[pattern, j]
                    place, pattern = place[same], pattern[same]
                found_at.append(place)
                found.append(pattern)
                move[zero] = 1
            cursor = cursor + move
            keep = cursor < stop
            cursor, stop = cursor[keep], stop[keep]
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(found_at), cat(found)


class Patterns:
    """The search tables of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        seen: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = [None if i is None else str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _first = B.words(data, np.array([0, len(data)]), WORD)
            ids = [seen.setdefault(w, len(seen) + 1) for w in _normal(data, starts, ends)]
            for a in range(max(1, len(ids) - width + 1) if ids else 0):
                window = tuple(ids[a : a + width])
                by_length.setdefault(len(window), {}).setdefault(window, set()).add(k)
        self.spelling = [b"", *seen]
        flat = np.frombuffer(b"".join(self.spelling), np.uint8)
        ends = np.cumsum([len(w) for w in self.spelling])
        hashes = B.hash_words(flat, ends[:-1], ends[1:]) if seen else np.zeros(0, B.U64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        self.machines = []
        for m, table in sorted(by_length.items()):
            keys = list(table)
            self.machines.append((WuManber(np.array(keys, np.int64).reshape(-1, m), len(seen)), [sorted(table[k]) for k in keys]))

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, self.ids[k], 0)

    def hits(self, data, starts, ends, first) -> tuple[np.ndarray, list[set[int]]]:
        """Per word: is it inside an occurrence; per document: the items that occur."""
        ids = self.word_ids(B.hash_words(data, starts, ends, lower=True))
        cover = np.zeros(len(starts) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(len(first) - 1)]
        low = B.LOWER[data]
        for machine, owners in self.machines:
            at, pattern = machine.search(ids, first[:-1], first[1:])
            if not len(at):
                continue
            good = np.ones(len(at), bool)
            for j in range(machine.m):  # direct comparison: the words' bytes, once for each pair of word and id
                pair, back = np.unique(np.stack([at + j, machine.patterns[pattern, j]]), axis=1, return_inverse=True)
                same = np.array([low[starts[w] : ends[w]].tobytes() == self.spelling[i] for w, i in pair.T.tolist()])
                good &= same[back.ravel()]
            at, pattern = at[good], pattern[good]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + machine.m, -1)
            docs = np.searchsorted(first, at, "right") - 1
            for d, p in set(zip(docs.tolist(), pattern.tolist(), strict=True)):
                items[d].update(owners[p])
        return np.cumsum(cover)[:-1] > 0, items


_built: dict[str, Patterns] = {}


def _patterns(name: str, items, width: int) -> Patterns:
    """A block's tables, built once in a worker; the worker keeps those of one block."""
    if name not in _built:
        _built.clear()
        _built[name] = Patterns(items.value, width)
    return _built[name]


def _result(rows: pa.RecordBatch, first: np.ndarray, hit: np.ndarray, found: list[set[str]], text: bool, keep: list[str]) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    mine = [sorted(x - {None}) for x in found]
    out = {
        "doc_id": rows.column("doc_id"),
        "n_words": pa.array(np.diff(first)),
        "n_hit": pa.array(n_hit),
        "n_items": pa.array([len(x) for x in found], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in mine], pa.string()),
        "items": pa.array(mine, pa.list_(pa.string())),
        "contaminated": pa.array(n_hit > 0),
    }
    out |= {c: rows.column(c) for c in ["text"] * text + keep}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _scan(name: str, items, width: int, text: bool, keep: list[str]):
    """The results of a benchmark of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _patterns(name, items, width)
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                starts, ends, first = B.words(data, offsets, WORD)
                hit, found = t.hits(data, starts, ends, first)
                yield _result(batch.slice(lo, hi - lo), first, hit, [{t.items[i] for i in k} for k in found], text, keep)

    return run


def _marks(name: str, items, width: int):
    """Of one block of several: the rows that it hits, with the places and lengths of the runs of words hit, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _patterns(name, items, width)
        for batch in batches:
            for lo, _hi, data, offsets in B.text_slices(batch.column("text")):
                starts, ends, first = B.words(data, offsets, WORD)
                hit, found = t.hits(data, starts, ends, first)
                rows = []
                for i in (i for i, k in enumerate(found) if k):
                    edge = np.diff(np.concatenate([[0], hit[first[i] : first[i + 1]].astype(np.int8), [0]]))
                    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).astype(np.int64)
                    rows.append((batch.column("row")[lo + i].as_py(), runs.tobytes(), list({t.items[x] for x in found[i]})))
                if rows:
                    row, runs, ids = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(runs, pa.binary()), pa.array(ids, pa.list_(pa.string()))], ["row", "runs", "ids"])

    return run


def _together(text: bool, keep: list[str]):
    """Rows with what all blocks marked in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                starts, _ends, first = B.words(data, offsets, WORD)
                hit, found = np.zeros(len(starts), bool), []
                for i, marks in enumerate(batch.column("marks").slice(lo, hi - lo).to_pylist()):
                    found.append({x for m in marks or [] for x in m["ids"]})
                    for m in marks or []:
                        for a, b in np.frombuffer(m["runs"], np.int64).reshape(2, -1).T.tolist():
                            hit[first[i] + a : first[i] + b] = True
                yield _result(batch.slice(lo, hi - lo), first, hit, found, text, keep)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, bool]]:
    """The items in blocks of so many bytes, one at a time on the driver; is it the last?"""
    block, room = [], block_bytes
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        size = len((text or "").encode()) + 16
        if block and size > room:
            yield block, False
            block, room = [], block_bytes
        block.append((item, text))
        room -= size
    yield block, True


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Which words of each document lie inside an occurrence of a window of a benchmark item.

    docs: doc_id, text (other columns are ignored); benchmark: item_id, text. Returns for each row of
    docs doc_id, n_words, n_hit, n_items, items_sha256, items (array of item ids as strings),
    contaminated and the ``keep`` columns, but those with a name of a result column; no shuffle, one pass over the texts.

    What is broadcast is bounded: items go out in blocks of ``block_bytes`` of item text (or one item).
    A benchmark of one block takes one pass. For several, the texts are dealt and written once, each block
    passes over them and gives the marks of the rows that it hits, and these meet their rows.

    Null and empty texts have no words and no hits; an item without words occurs nowhere. Items are told by
    their ids: those that share an id are one item of several texts, and so are those without id, which
    n_items counts but the list of ids leaves out. Repeated documents each count for themselves. An empty benchmark hits nothing.
    """
    result = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated", "row", "marks")
    text, keep = "text" in keep, [c for c in dict.fromkeys(keep) if c not in (*result, "text")]
    found = docs.select("doc_id", "text", *keep)
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema}
    mine = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, contaminated boolean"
    schema = ", ".join([kinds["doc_id"], mine, *[kinds["text"]] * text, *[kinds[c] for c in keep]])
    context, n = docs.sparkSession.sparkContext, B.parts(docs.sparkSession)
    rows = marks = None
    for items, last in _blocks(benchmark, block_bytes):
        shared, name = context.broadcast(items), uuid.uuid4().hex
        if last and rows is None:
            return found.mapInArrow(_scan(name, shared, width, text, keep), schema)
        if rows is None:
            rows = B.cut_by(found.withColumn("row", F.monotonically_increasing_id()), n, "row")
        one = B.cut(rows.select("row", "text").mapInArrow(_marks(name, shared, width), "row long, runs binary, ids array<string>"))
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.groupBy("row").agg(F.collect_list(F.struct("runs", "ids")).alias("marks"))
    return rows.join(marks.hint("merge"), "row", "left").drop("row").mapInArrow(_together(text, keep), schema)


def op7_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against every item of ``benchmark``, windows of 10 words."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_hits(docs, items).drop("items")


OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s, least(len(w), 10) AS m
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
       FROM d, lens, unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
f AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (s, m)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM f, unnest(range(0, m)) AS u(k) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(g.n, 0)::BIGINT AS n_items,
       sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)
"""
