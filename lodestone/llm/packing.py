"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids and pieces of at most ``capacity`` ids. Pieces are dealt into groups of a
bounded number; every group is evolved on several islands, whose elites migrate to the next island
between epochs. A solution is a set of bins (sequences), and its genes are whole bins:

* crossover injects well-filled bins of one parent whole into the other, drops the other's bins that
  hold a piece twice, and places the pieces thus displaced by best fit;
* mutation dissolves some of the least filled bins and places their pieces by best fit.

The bins that even the best solutions leave underfilled are pooled over all groups and evolved again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _bytes as B

END_ID = 1
#: Words that a worker remembers: about 50 MB.
CACHE_WORDS = 1_000_000
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True
#: Words of lower-case letters a-z and U+00DF-U+00FF.
_PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


class WordEncoder:
    """Token ids of texts, for tokenizers that split at white space and lower-case.

    No token reaches over white space, so a text's ids are those of its words in a row, and each distinct
    word is encoded once and remembered (at most CACHE_WORDS of them). Words are also divided between a
    letter a-z and one of ``.,;:!?``, where the tokenizer's own pattern always divides them. Words with
    ``<|``, which may begin a special token, are kept as they are spelt.
    """

    kind = np.uint32  # of remembered ids

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for words that normalisation leaves as they are
        self.bare.normalizer = None
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.table, self.bits = np.zeros(1 << 16, B.U64), 16
        self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.pool, self.used, self.count = np.zeros(1 << 16, self.kind), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot in the table of open addresses, or -1."""
        mask = B.U64((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        have = self.table[slot]
        slot[have == 0] = -1
        left = np.flatnonzero((have != keys) & (have != 0))
        step = 0
        while len(left):
            step += 1
            try_ = ((keys[left] + B.U64(step)) & mask).astype(np.int64)
            have = self.table[try_]
            slot[left] = np.where(have == keys[left], try_, -1)
            left = left[(have != keys[left]) & (have != 0)]
        return slot

    def put(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Distinct keys that the table does not hold."""
        if 2 * (self.count + len(keys)) > len(self.table):
            held = np.flatnonzero(self.table)
            old = self.table[held], self.at[held], self.size[held]
            self.bits = int(2 * (self.count + len(keys))).bit_length()
            self.table = np.zeros(1 << self.bits, B.U64)
            self.at, self.size, self.count = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint32), 0
            self.put(*old)
        self.count += len(keys)
        mask, step, left = B.U64((1 << self.bits) - 1), 0, np.arange(len(keys))
        while len(left):
            slot = ((keys[left] + B.U64(step)) & mask).astype(np.int64)
            free = np.flatnonzero(self.table[slot] == 0)
            slots, one = np.unique(slot[free], return_index=True)
            won = left[free[one]]
            self.table[slots], self.at[slots], self.size[slots] = keys[won], at[won], size[won]
            lost = np.ones(len(left), bool)
            lost[free[one]] = False
            left = left[lost]
            step += 1

    def _ids(self, spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each has."""
        plain = [bool(_PLAIN_WORD(w)) for w in spelt]
        rows: list = [None] * len(spelt)
        easy = [i for i, x in enumerate(plain) if x]
        for k in range(0, len(easy), 512):
            some = easy[k : k + 512]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(spelt[i] for i in some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(some) and stop[-1] == len(ids):  # a plain word is one run of letters: one end each
                for i, a, b in zip(some, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
                    rows[i] = ids[a:b]
        hard = [i for i, x in enumerate(rows) if x is None]
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([spelt[i].decode() for i in hard], add_special_tokens=False), strict=True):
            rows[i] = np.array(e.ids, np.uint32)
        return np.concatenate(rows), np.array([len(x) for x in rows], np.int64)

    def learn(self, keys: np.ndarray, spelt: list[bytes]) -> None:
        flat, size = self._ids(spelt)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + 2 * len(flat), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.put(keys, self.used + np.cumsum(size) - size, size)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents in a row, and where each document's ids begin."""
        starts, ends, first = B.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        inner = np.zeros(len(data) + 1, bool)
        inner[1:-1] = _PUNCT[data[1:]] & _PLAIN[data[:-1]]
        inner[offsets] = False
        begins, stops = inner.copy(), inner
        begins[starts] = True
        stops[ends] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        first = np.searchsorted(starts, offsets)
        keys = B.hash_words(data, starts, ends, lower=True)
        special = np.zeros(len(keys), bool)
        if len(marks := np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))):
            special[np.unique(np.searchsorted(starts, marks, "right") - 1)] = True
            keys[special] = B.splitmix(B.hash_words(data, starts[special], ends[special]))
        keys |= B.U64(1 << 63)  # 0 marks a free slot
        if self.count > CACHE_WORDS:
            self.forget()
        slot = self.find(keys)
        if len(new := np.flatnonzero(slot < 0)):
            unique, one = np.unique(keys[new], return_index=True)
            chosen = new[one]
            raw, low = data.tobytes(), B.LOWER[data].tobytes()
            self.learn(unique, [(raw if s else low)[a:b] for a, b, s in zip(starts[chosen].tolist(), ends[chosen].tolist(), special[chosen].tolist(), strict=True)])
            slot = self.find(keys)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        end = np.cumsum(size)
        ids = self.pool[np.arange(int(end[-1])) + np.repeat(at - end + size, size)].astype(np.uint32)
        return ids, np.concatenate([[0], end])[first]


def _pieces(path: str, capacity: int):
    encoder: list[WordEncoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoder:
            encoder.append(WordEncoder(path))
        for batch in batches:
            docs = batch.column("doc_id")
            for lo, _hi, data, offsets in B.text_slices(batch.column("text")):
                ids, begin = encoder[0].encode(data, offsets)
                rows: list[tuple] = []
                end = np.array([END_ID], np.uint32)
                for d, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    own = np.concatenate([ids[a:b], end])
                    for k, s in enumerate(range(0, len(own), capacity)):
                        piece = own[s : s + capacity]
                        rows.append((lo + d, k, s, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
                row, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Every document's ids, then END_ID, cut into pieces of ``capacity``: doc_id, piece, start, length, ids_crc32. Null counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece long, start long, length long, ids_crc32 long")


class Bins:
    """Bins with room, by room: best fit is the smallest room that suffices."""

    def __init__(self, capacity: int, fill: np.ndarray):
        self.capacity, self.fill = capacity, fill.tolist()
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        for k, f in enumerate(self.fill):
            if 0 < f < capacity:
                self._offer(k, capacity - f)

    def _offer(self, k: int, room: int) -> None:
        have = self.by_room.get(room)
        if have:
            have.append(k)
        else:
            self.by_room[room] = [k]
            self.mask |= 1 << room

    def place(self, length: int) -> int:
        rest = self.mask >> length
        if rest:
            room = length + (rest & -rest).bit_length() - 1
            have = self.by_room[room]
            k = have.pop()
            if not have:
                self.mask ^= 1 << room
        else:
            k, room = len(self.fill), self.capacity
            self.fill.append(0)
        self.fill[k] += length
        if room > length:
            self._offer(k, room - length)
        return k


class Islander:
    """A population of solutions of one group: each is an array of bins by piece."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths.astype(np.int64), capacity, np.random.default_rng(seed)
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.found: list[tuple[tuple, np.ndarray, np.ndarray]] = []

    def fit(self, bins: np.ndarray, fill: np.ndarray, pieces: np.ndarray) -> None:
        """Places pieces (longest first) into bins and adds the solution."""
        room = Bins(self.capacity, fill)
        order = pieces[np.argsort(-self.lengths[pieces], kind="stable")]
        bins[order] = [room.place(n) for n in self.lengths[order].tolist()]
        self.add(bins)

    def add(self, bins: np.ndarray) -> None:
        bins = np.unique(bins, return_inverse=True)[1].ravel()
        fill = np.bincount(bins, weights=self.lengths).astype(np.int64)
        self.found.append(((len(fill), -float((fill.astype(float) ** 2).sum())), bins, fill))

    def begin(self) -> None:
        n, none = len(self.lengths), np.zeros(0, np.int64)
        self.fit(np.empty(n, np.int64), none, np.arange(n))
        for _ in range(3):  # the longest as they are, a share of the rest in any order
            some = self.random.random(n) < 0.05 + 0.2 * self.random.random()
            start = Bins(self.capacity, none)
            bins = np.empty(n, np.int64)
            order = np.flatnonzero(some)
            self.random.shuffle(order)
            bins[order] = [start.place(k) for k in self.lengths[order].tolist()]
            self.fit(bins, np.array(start.fill, np.int64), np.flatnonzero(~some))

    def done(self) -> bool:
        return bool(self.found) and self.found[0][0][0] <= self.least

    def evolve(self, generations: int, size: int = 6) -> None:
        self.found.sort(key=lambda x: x[0])
        for _ in range(generations):
            if self.done():
                break
            a, b = self.random.choice(min(len(self.found), size), 2, replace=len(self.found) < 2)
            self.cross(self.found[a], self.found[b])
            self.mutate(self.found[-1])
            self.found.sort(key=lambda x: x[0])
            del self.found[size:]

    def cross(self, one, other) -> None:
        _, bins_a, fill_a = one
        _, bins_b, fill_b = other
        full = np.flatnonzero(fill_a >= np.quantile(fill_a, 0.5))
        give = self.random.random(len(fill_a)) < 0
        give[self.random.choice(full, max(1, min(len(full), 24)), replace=False)] = True
        injected = give[bins_a]
        twice = np.zeros(len(fill_b), bool)
        twice[bins_b[injected]] = True
        child = bins_b.copy()
        child[injected] = bins_a[injected] + len(fill_b)
        displaced = np.flatnonzero(twice[bins_b] & ~injected)
        fill = np.concatenate([np.where(twice, 0, fill_b), np.where(give, fill_a, 0)])
        self.fit(child, fill, displaced)

    def mutate(self, one) -> None:
        _, bins, fill = one
        open_ = np.argsort(fill)[: max(2, min(len(fill), 40))]
        gone = np.zeros(len(fill), bool)
        gone[self.random.choice(open_, max(1, len(open_) // 4), replace=False)] = True
        some = self.random.choice(len(fill), max(1, min(len(fill), 8)), replace=False)
        gone[some] = True
        self.fit(bins.copy(), np.where(gone, 0, fill), np.flatnonzero(gone[bins]))


def _epoch(capacity: int, generations: int, size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (lengths,) = B.unpack(row["lengths"])
                x = Islander(lengths, capacity, seed * 1_000_003 + row["grp"] * 31 + row["island"])
                for blob in (row["solutions"], row["elite"]):
                    for bins in B.unpack(blob) if blob else []:
                        x.add(bins.astype(np.int64))
                if not x.found:
                    x.begin()
                x.evolve(generations, size)
                keep = [B.shrink(f[1]) for f in x.found[:size]]
                row |= {"solutions": B.pack(*keep), "elite": B.pack(keep[0]), "bins": x.found[0][0][0], "cost": x.found[0][0][1]}
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in _ISLANDS.names}], schema=_ISLANDS)

    return run


_ISLANDS = pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("solutions", pa.binary()), ("elite", pa.binary()), ("bins", pa.int64()), ("cost", pa.float64())])
_ISLANDS_DDL = "grp long, island int, lengths binary, solutions binary, elite binary, bins long, cost double"
_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32", "row"]


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(_ORDER, ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)


def _evolved(pieces: DataFrame, capacity: int, group_pieces: int, islands: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """pieces with bin (a number within grp), grp and fill. Groups hold ``group_pieces`` on average, dealt by a hash of ``row``, so that equal pieces spread."""
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    wide = min(groups, max(1, B.parts(pieces.sparkSession)))

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": [key[0]], "lengths": [B.pack(_sorted(frame)["length"].to_numpy(np.uint32))]})

    start = pieces.groupBy("grp").applyInPandas(gather, "grp long, lengths binary")
    start = start.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths")
    none = F.lit(None).cast("binary")
    state = start.select("grp", "island", "lengths", none.alias("solutions"), none.alias("elite"), F.lit(0).cast("long").alias("bins"), F.lit(0.0).alias("cost"))
    for epoch in range(epochs):
        dealt = state.repartitionById(wide * islands, F.pmod(F.col("grp") * islands + F.col("island"), F.lit(wide * islands)).cast("int"))
        state = B.cut(dealt.mapInArrow(_epoch(capacity, generations, 6, seed + epoch), _ISLANDS_DDL))
        if epoch < epochs - 1:  # each island's elite goes to the next one
            moved = state.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
            state = state.join(moved, ["grp", "island"]).select("grp", "island", "lengths", "solutions", F.col("guest").alias("elite"), "bins", "cost")
    best = state.groupBy("grp").agg(F.min_by("elite", F.struct("bins", "cost", "island")).alias("elite"))

    def settle(key: tuple, own: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        own = _sorted(own)
        (bins,) = B.unpack(chosen["elite"].iloc[0])
        own["bin"] = bins.astype(np.int64)
        own["fill"] = own.groupby("bin")["length"].transform("sum")
        return own

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", bin long, fill long"
    return pieces.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(settle, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, group_pieces: int = 8192, islands: int = 3, epochs: int = 2, generations: int = 60, open_below: float = 0.995
) -> DataFrame:
    """Pack the token ids of all documents into as few sequences of ``capacity`` ids as the search finds.

    Returns for each piece doc_id, piece, start, length, ids_crc32, sequence_id and offset (its place in
    the sequence, gapless from 0). Only documents longer than ``capacity`` are cut. Null and empty texts
    are one END_ID. Rows without or with equal doc_id are packed like any other. An empty table gives no
    rows. ``group_pieces`` bounds what an island holds; bins filled to less than ``open_below`` after the
    first evolution are pooled over all groups and evolved once more.
    """
    shape = dict(capacity=capacity, islands=islands, epochs=epochs, generations=generations)
    cut = B.cut(token_pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()))  # the numbers hold once they are written
    whole = cut.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = B.cut(_evolved(cut.where(F.col("length") < capacity), group_pieces=group_pieces, seed=1, **shape))
    closed = first.where(F.col("fill") >= open_below * capacity).select(*cut.columns, (F.col("grp") * (1 << 32) + F.col("bin") + (1 << 61)).alias("sequence_id"))
    open_ = first.where(F.col("fill") < open_below * capacity).select(*cut.columns)
    second = _evolved(open_, group_pieces=group_pieces, seed=2, **shape)
    second = second.select(*cut.columns, (F.col("grp") * (1 << 32) + F.col("bin") + (1 << 62)).alias("sequence_id"))
    by = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    mixed = closed.unionByName(second).withColumn("offset", F.coalesce(F.sum("length").over(by), F.lit(0)).cast("long"))
    return mixed.unionByName(whole).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` in sequences of 4096 ids of word_bpe_49k."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
