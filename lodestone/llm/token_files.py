"""Token ids as files: shards of whole documents, each compressed by a Re-Pair grammar of its own.

A shard's ids are rewritten round by round: adjacent pairs of symbols are counted, the most frequent ones
become nonterminals, and their occurrences are replaced, the more frequent pair first where two overlap;
rounds end when they bring next to nothing. Kept are the terminals, the rules (two symbols each), the
number of ids that each rule expands to, the rewritten sequence, and the number of ids before every
``STEP``-th symbol of it. A reader of ids a to b finds the first symbol by these sums and expands only
what it needs.

Files are Parquet, written and read by Spark: ``shards`` (part, shard, start, n_tokens, doc_ids,
doc_tokens, body) and ``parts`` (part, start). Parts are ranges of doc_id in ascending order, shards follow
each other within a part, and a shard's first id is number parts.start + shards.start of all.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _bytes as B
from .packing import WordEncoder

END_ID = 2
SHARD_TOKENS = 1 << 19
#: Symbols between two sums of the index.
STEP = 256
LEAST = 5  # a rule takes two symbols and a length, and saves a symbol each time
ROUND_RULES = 12_000
ENOUGH = 0.05  # the share of symbols that a round saves, if another one is to follow
#: Distinct pretokens that a worker remembers.
CACHE_PRETOKENS = 1_500_000
_NONE = np.uint16(0xFFFF)
_CLASS = {"letter": 0, "number": 1, "other": 2, "space": 3}
_UNKNOWN = 255
_encoders: dict[str, ByteEncoder] = {}


class ByteEncoder(WordEncoder):
    """Token ids of texts by a byte-level tokenizer, each distinct pretoken encoded once and remembered.

    Pretokens are contractions, runs of letters, numbers or other characters with a space before them, and
    runs of white space without the last one before a word. A pretoken's ids do not depend on its
    neighbours. Which class a character beyond ASCII has is asked of the tokenizer itself when the
    character is first met. Texts with a special token's string go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte is a character in the vocabulary
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.classify(np.arange(128))
        self.forget()

    def classify(self, points: np.ndarray) -> None:
        """With which of a letter, a digit and a mark does the character form one pretoken?"""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            kinds = [k for k, c in (("letter", "a"), ("number", "1"), ("other", "!")) if len(cut(c + chr(p))) == 1]
            self.classes[p] = _CLASS[kinds[0] if kinds else "space"]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        out = self.classes[data]
        wide = np.flatnonzero(data >= 0xC0)
        if not len(wide):
            return out
        size = 2 + (data[wide] >= 0xE0) + (data[wide] >= 0xF0)
        point = data[wide].astype(np.int64) & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for j in (1, 2, 3):
            more = size > j
            point[more] = point[more] << 6 | data[wide[more] + j] & 0x3F
        kind = self.classes[point]
        if (kind == _UNKNOWN).any():
            self.classify(np.unique(point[kind == _UNKNOWN]))
            kind = self.classes[point]
        for j in range(4):
            out[wide[size > j] + j] = kind[size > j]
        return out

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pretokens begin; they cover all bytes."""
        n, space = len(data), _CLASS["space"]
        kind = self.kinds(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        run = cut.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        begins = run[:n].copy()
        blank = (data == 0x20) & (kind == space)
        follows = np.flatnonzero(begins[1:] & ~cut[1:n] & (kind[:-1] == space)) + 1  # what comes after white space
        last = follows - 1
        for _ in range(3):  # the first byte of the character before
            last -= (data[last] & 0xC0) == 0x80
        begins[last] = True
        begins[follows[blank[follows - 1]]] = False
        quote = np.flatnonzero((data[: n - 1] == 0x27) & begins[: n - 1] & ~cut[1:n])
        if len(quote):
            one, two = data[quote + 1], np.where(quote + 2 < n, data[np.minimum(quote + 2, n - 1)], 0)
            two[cut[np.minimum(quote + 2, n)]] = 0
            short = np.isin(one, list(b"stmd"))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            end = quote[short | long] + 2 + long[short | long]
            begins[quote[short | long] + 1] = False
            begins[end[end < n]] = True
        return np.flatnonzero(begins)

    def learn(self, keys: np.ndarray, spelt: list[bytes]) -> None:
        # a space and what is no white space: in a row, such pretokens are cut apart again just so
        easy = np.array([len(w) > 1 and w[0] == 0x20 and (0x21 <= w[1] <= 0x7E or 0xC3 <= w[1] <= 0xC9) for w in spelt], bool)
        some, rest = ([w for w, x in zip(spelt, easy.tolist(), strict=True) if x is y] for y in (True, False))
        rows = [self.tokenizer.encode_batch_fast([b"".join(some[k : k + 64]).decode()], add_special_tokens=False)[0].ids for k in range(0, len(some), 64)]
        hard = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
        flat = np.fromiter((i for ids in [*rows, *hard] for i in ids), np.uint32)
        stop = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum(list(map(len, some + rest)))) + 1
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        size = np.diff(stop, prepend=0)
        self.put(np.concatenate([keys[easy], keys[~easy]]), self.used + stop - size, size)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents in a row, and where each document's ids begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            own = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([i for ids in own for i in ids], np.uint32), np.cumsum([0, *map(len, own)])
        starts = self.pretokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = B.hash_words(data, starts, ends) | B.U64(1 << 63)  # 0 marks a free slot
        if self.count > CACHE_PRETOKENS:
            self.forget()
        slot = self.find(keys)
        if len(new := np.flatnonzero(slot < 0)):
            unique, one = np.unique(keys[new], return_index=True)
            chosen = new[one]
            self.learn(unique, [raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)])
            slot = self.find(keys)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        end = np.cumsum(size)
        ids = self.pool[np.arange(int(end[-1])) + np.repeat(at - end + size, size)]
        return ids, np.concatenate([[0], end])[np.searchsorted(starts, offsets)]


def _encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that occur often enough for a rule, and how often each does."""
    keys = np.sort(keys)
    at = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    at = np.concatenate([[0], at, [len(keys)]])
    n = at[1:] - at[:-1]
    often = np.flatnonzero(n >= LEAST)
    return keys[at[often]], n[often]


def _ranks(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Each key's place among the chosen ones, through a table by hash; of chosen keys that share a slot the first has it."""
    kind, width = keys.dtype.type, 8 * keys.dtype.itemsize
    bits = max(12, int(4 * len(chosen)).bit_length())
    slot = lambda k: (k * kind(0x9E3779B1 if width == 32 else 0x9E3779B97F4A7C15)) >> kind(width - bits)
    held, place = np.zeros(1 << bits, kind), np.full(1 << bits, _NONE, np.uint16)
    at = slot(chosen)[::-1]
    held[at], place[at] = chosen[::-1], np.arange(len(chosen) - 1, -1, -1, dtype=np.uint16)
    at = slot(keys)
    rank = place[at]
    rank[held[at] != keys] = _NONE
    return rank


def _apart(rank: np.ndarray) -> np.ndarray:
    """Where pairs (by the rank of the one that begins at each symbol) have a better rank than both that they overlap."""
    wide = np.full(len(rank) + 2, _NONE, np.uint16)
    wide[1:-1] = rank
    same = np.flatnonzero((wide[1:] == wide[:-1]) & (wide[1:] != _NONE))
    if len(same):  # aaaa: the second, fourth, ... pair of a run overlaps the one before it
        first = np.concatenate([[True], np.diff(same) > 1])
        begin = same[np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))]
        wide[same[(same - begin) % 2 == 0] + 1] = _NONE
    won = wide[1:-1] < wide[:-2]
    won &= wide[1:-1] < wide[2:]
    return np.flatnonzero(won)


class Grammar:
    """A sequence of ids as rules and symbols. Symbols below len(terminals) are ids, those from there on rules, in the order they were made."""

    def __init__(self, terminals: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, rounds: np.ndarray, sequence: np.ndarray, sums: np.ndarray):
        self.terminals, self.left, self.right, self.sizes, self.rounds, self.sequence, self.sums = terminals, left, right, sizes, rounds, sequence, sums
        self._flat: tuple | None = None

    @classmethod
    def of(cls, ids: np.ndarray, max_symbols: int = 1 << 16) -> Grammar:
        """Symbols have 16 bits where the distinct ids leave room for rules, else 32."""
        top = int(ids.max()) + 1 if len(ids) else 0
        if top <= 1 << 24:
            seen = np.zeros(top, bool)
            seen[ids] = True
            terminals = np.flatnonzero(seen).astype(np.uint32)
            number = np.zeros(top, np.uint32)
            number[terminals] = np.arange(len(terminals))
        else:
            terminals, number = np.unique(ids), None
        small = len(terminals) <= max_symbols // 2
        kind, wide, shift = (np.uint16, np.uint32, 16) if small else (np.uint32, np.uint64, 32)
        seq = number.astype(kind)[ids] if number is not None else np.searchsorted(terminals, ids).astype(kind)
        total, most = len(terminals), max_symbols if small else 1 << 31
        left, right, sizes, rounds = [], [], [np.ones(total, np.int64)], []
        while len(seq) > 1 and total < most:
            keys = seq[:-1].astype(wide)
            keys <<= wide(shift)
            keys |= seq[1:]
            pairs, n = _counted(keys)
            if not len(pairs):
                break
            pairs = pairs[np.argsort(-n, kind="stable")[: min(ROUND_RULES, most - total)]]
            rank = _ranks(keys, pairs)
            at = _apart(rank)
            rank = rank[at]
            used = np.bincount(rank, minlength=len(pairs)) >= LEAST
            if not used.any():
                break
            number = np.where(used, total + np.cumsum(used) - 1, 0)[rank]
            at, number = at[number > 0], number[number > 0]
            pairs = pairs[used]
            a, b = (pairs >> wide(shift)).astype(np.int64), (pairs & wide((1 << shift) - 1)).astype(np.int64)
            size = np.concatenate(sizes)
            left.append(a)
            right.append(b)
            sizes.append(size[a] + size[b])
            rounds.append(len(pairs))
            total += len(pairs)
            seq[at] = number
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            before, seq = len(seq), seq[keep]
            if len(at) < before * ENOUGH:
                break
        size = np.concatenate(sizes)
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        sums = np.concatenate([[0], np.cumsum(size[seq])])[::STEP]
        return cls(terminals, cat(left), cat(right), size[len(terminals) :], np.array(rounds, np.int64), seq, sums)

    def body(self) -> bytes:
        return B.pack(*[B.shrink(x) for x in (self.terminals, self.left, self.right, self.sizes, self.rounds, self.sequence, self.sums)])

    @classmethod
    def from_body(cls, body: bytes) -> Grammar:
        return cls(*B.unpack(body))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all symbols in a row, where each symbol's begin, and how many it has."""
        if self._flat is None:
            size = np.concatenate([np.ones(len(self.terminals), np.int64), self.sizes.astype(np.int64)])
            begin = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.uint32)
            out[: len(self.terminals)] = self.terminals
            done = 0
            for n in self.rounds.tolist():  # a round's rules use what earlier rounds made
                a, b = self.left[done : done + n].astype(np.int64), self.right[done : done + n].astype(np.int64)
                both = np.stack([a, b], 1).ravel()
                to = int(begin[len(self.terminals) + done])
                k = size[both]
                end = np.cumsum(k)
                out[to : to + int(end[-1])] = out[np.arange(int(end[-1])) + np.repeat(begin[both] - end + k, k)]
                done += n
            self._flat = out, begin, size
        return self._flat

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop, found by the sums of lengths; nothing else is expanded."""
        out, begin, size = self.flat()
        block = max(0, int(np.searchsorted(self.sums, start, "right")) - 1) if start else 0
        last = len(self.sequence) if stop is None else int(np.searchsorted(self.sums, stop, "left")) * STEP
        some = self.sequence[block * STEP : last].astype(np.int64)
        k = size[some]
        end = np.cumsum(k)
        if not len(end):
            return np.zeros(0, np.uint32)
        found = out[np.arange(int(end[-1])) + np.repeat(begin[some] - end + k, k)]
        skip = start - int(self.sums[block])
        return found[skip:] if stop is None else found[skip : max(skip, stop - start + skip)]


def _shards(path: str, end_id: int, shard_tokens: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        ids, keys, lengths, held, start, shard = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            doc_ids = pa.concat_arrays(keys)
            values = [[part], [shard], [start], [len(whole)], None, [lengths], [Grammar.of(whole).body()]]
            arrays = [pa.array(v, f.type) if v is not None else pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids) for v, f in zip(values, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            docs = batch.column("doc_id")
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                found, begin = encoder.encode(data, offsets)
                at = 0
                n = np.diff(begin) + 1
                while at < hi - lo:  # documents until the shard is full
                    room = np.searchsorted(np.cumsum(n[at:]), max(1, shard_tokens - held)) + 1
                    to = min(hi - lo, at + int(room))
                    piece = np.insert(found[begin[at] : begin[to]], begin[at + 1 : to + 1] - begin[at], end_id)
                    ids.append(piece)
                    keys.append(docs.slice(lo + at, to - at))
                    lengths += n[at:to].tolist()
                    held, at = held + len(piece), to
                    if held >= shard_tokens:
                        yield row()
                        start, shard = start + held, shard + 1
                        ids, keys, lengths, held = [], [], [], 0
        if ids:
            yield row()
        B.release()

    return run


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(kind)), ("doc_tokens", pa.list_(pa.int64())), ("body", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, mode: str = "errorifexists") -> None:
    """Writes every whole text's ids, then ``end_id``, in ascending order of doc_id.

    Null texts are empty. Rows without doc_id come first; rows that share a doc_id stand in the order of a
    hash of their texts, and may lie in several parts. A shard ends with the document that fills it. An
    empty table gives files without rows. Columns other than doc_id and text are not kept.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(B.parts(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    ddl = f"part int, shard int, start long, n_tokens long, doc_ids array<{kind.simpleString()}>, doc_tokens array<long>, body binary"
    shards = dealt.mapInArrow(_shards(tokenizer, end_id, shard_tokens, _schema(to_arrow_type(kind))), ddl)
    shards.write.mode(mode).option("compression", "uncompressed").parquet(f"{path}/shards")
    each = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each.select("part", before.cast("long").alias("start")).coalesce(1).write.mode(mode).parquet(f"{path}/parts")


def _located(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``before``, the number of ids before them in all files. There is one row of ``parts`` for each partition that wrote."""
    parts = spark.read.parquet(f"{path}/parts").withColumnRenamed("start", "part_start")
    return spark.read.parquet(f"{path}/shards").join(F.broadcast(parts), "part").withColumn("before", F.col("part_start") + F.col("start"))


def _decoded(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs = batch.column("doc_ids").slice(k, 1).flatten()
                n = batch.column("doc_tokens").slice(k, 1).flatten().to_numpy()
                ids = Grammar.from_body(batch.column("body")[k].as_py()).ids().astype("<u4")
                ends = np.cumsum(n)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                columns = [docs, pa.array(batch.column("before")[k].as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            B.release()

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and ids (array<long>) if asked for."""
    shards = _located(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    ddl = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return shards.select("before", "doc_ids", "doc_tokens", "body").mapInArrow(_decoded(with_ids), ddl)


def read_range(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The ids number ``start`` to ``start + length`` of all: a row (start, ids) for each shard that has some. Other shards' bodies are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, n, body in zip(*[batch.column(c).to_pylist() for c in ("before", "n_tokens", "body")], strict=True):
                a, b = max(0, start - before), min(n, start + length - before)
                ids = Grammar.from_body(body).ids(a, b)
                yield pa.RecordBatch.from_arrays([pa.array([before + a]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["start", "ids"])

    some = _located(spark, path).where((F.col("before") < start + length) & (F.col("before") + F.col("n_tokens") > start))
    return some.select("before", "n_tokens", "body").mapInArrow(run, "start long, ids array<long>")


def op11_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as ids of byte_bpe_50k in files of a new folder, and what is read back from them."""
    import public_tokenizers

    path = f"{B.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path, with_ids=False)
