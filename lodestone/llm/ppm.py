"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``order``, with the counts of the symbols that follow each.
A symbol is coded in the longest context seen in training. By estimation D, of n occurrences there of d
distinct symbols, a symbol that came c times has (2c - 1) / 2n, and d / 2n is the escape, which is paid
where the symbol has not followed; the next shorter context is then tried with the symbols of the longer
one excluded. Updates are exclusive too: below ``order``, a symbol counts once for each longer context
that it has followed, as if it were added only where the longer context did not have it yet. Below order 0 the bytes that are left are equally likely. A document is its words, A-Z lower-cased, joined by one space, and an end symbol.

The trie is never in one place. It is divided by the last two bytes of the context, so that a part holds
whole chains of contexts of order 2 and more; the counts of orders 1 and 0 (65,792 numbers) go to every
part. Texts are packed into batches. A batch asks, once, for each distinct (context, symbol) that occurs
in it and brings its training counts along; the parts add up the counts, answer with log-probabilities,
and the batch sums them by document. Word counts for the base score travel the same way. What is
gathered thus grows with the corpus, and no task holds more than a batch or a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B

BATCH_BYTES = 6 << 20
END = 0x0A  # separators become spaces, so no text holds it
SLICES = 16
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, END]] = True


def normal(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Each document as its words, lower-cased, joined by a space, and END: bytes and offsets."""
    starts, ends, first = B.words(data, offsets)
    counts = np.diff(first)
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    np.add.at(change, ends, -1)
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    last = np.zeros(len(starts), bool)
    last[first[1:][counts > 0] - 1] = True
    low = B.LOWER[data]
    mask[ends[~last]] = True
    low[ends[~last]] = 0x20
    size = np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    out = np.full(len(size) + int(size.sum()), END, np.uint8)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[mask]
    return out, at


def grams(body: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the ``order`` bytes before it (END before the beginning) and itself, as one number."""
    n = len(offsets) - 1
    padded = np.full(len(body) + order * n, END, np.uint8)
    at = np.arange(len(body)) + np.repeat(order * np.arange(1, n + 1), np.diff(offsets))
    padded[at] = body
    key = np.zeros(len(body), B.U64)
    for j in range(order, -1, -1):
        key <<= B.U64(8)
        key |= padded[at - j]
    return key


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs in training."""
    every = np.sort(keys)
    unique = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    seen = np.sort(keys[train])
    return unique, np.searchsorted(seen, unique, "right") - np.searchsorted(seen, unique, "left")


class Index:
    """The places of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.place = np.zeros(1 << self.bits, B.U64), np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = np.flatnonzero(self.place[slot] < 0)
            slots, one = np.unique(slot[free], return_index=True)
            won = left[free[one]]
            self.keys[slots], self.place[slots] = keys[won], won
            lost = np.ones(len(left), bool)
            lost[free[one]] = False
            left, step = left[lost], step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        at = (keys * B.U64(0x9E3779B97F4A7C15)) >> B.U64(64 - self.bits)
        return ((at + B.U64(step)) & B.U64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that are all there."""
        slot = self._slot(keys, 0)
        left, step = np.flatnonzero(self.keys[slot] != keys), 0
        while len(left):
            step += 1
            try_ = self._slot(keys[left], step)
            slot[left] = try_
            left = left[self.keys[try_] != keys[left]]
        return self.place[slot]


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Order:
    """The contexts of one order in training, and what the exclusion of a longer context's symbols leaves."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count  # (context, symbol), sorted
        context = key >> B.U64(8)
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.begin, self.context = begin, context[begin]
        self.total = np.add.reduceat(count, begin) if len(begin) else count[:0]
        self.distinct = np.diff(np.append(begin, len(key)))

    def shorter(self, order: int) -> Order:
        """Contexts of one byte less; a symbol counts once for each longer context that it has followed."""
        return Order(*np.unique(self.key & B.U64((1 << 8 * (order + 1)) - 1), return_counts=True))

    def excluded(self, longer: Order, order: int) -> np.ndarray:
        """For each context of ``longer``: the occurrences, in its suffix of this order, of the symbols that follow it."""
        at, _ = _lookup(self.key, longer.key & B.U64((1 << 8 * (order + 1)) - 1))
        own = self.count[at] if len(self.count) else np.zeros(len(at), np.int64)
        return np.add.reduceat(own, longer.begin) if len(longer.begin) else own[:0]


def code_lengths(unique: np.ndarray, count: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of each (context, symbol) in unique.

    unique and count are complete for the last two context bytes that occur among them; pairs[c, s]
    is the number of contexts of order 2 that end with byte c and that symbol s has followed in training.
    """
    seen = count > 0
    top = Order(unique[seen], count[seen])
    tables = {order: top}
    for k in range(order - 1, 1, -1):
        tables[k] = tables[k + 1].shorter(k)
    c, s = np.nonzero(pairs)
    tables[1] = Order((c * 256 + s).astype(B.U64), pairs[c, s])
    zero = (pairs > 0).sum(axis=0)
    tables[0] = Order(np.flatnonzero(zero).astype(B.U64), zero[zero > 0])
    out = np.zeros(len(unique))
    left = np.arange(len(unique))
    above = None  # the next longer context's place for each of left, or -1
    for k in range(order, -1, -1):
        t = tables[k]
        at, there = _lookup(t.context, (unique[left] >> B.U64(8)) & B.U64((1 << 8 * k) - 1))
        total, distinct = np.where(there, t.total[at] if len(t.total) else 0, 0), np.where(there, t.distinct[at] if len(t.distinct) else 0, 0)
        if above is not None and len(tables[k + 1].context):
            used = above >= 0
            total = total - np.where(used, t.excluded(tables[k + 1], k)[above], 0)
            distinct = distinct - np.where(used, tables[k + 1].distinct[above], 0)
        place, hit = _lookup(t.key, unique[left] & B.U64((1 << 8 * (k + 1)) - 1))
        if hit.any():
            out[left[hit]] += np.log10((2 * t.count[place[hit]] - 1) / (2 * total[hit]))
        pay = ~hit & (distinct > 0)
        out[left[pay]] += np.log10(distinct[pay] / (2 * total[pay]))
        above = np.where(there, at, -1)[~hit]
        left = left[~hit]
    out[left] -= np.log10(256 - len(tables[0].key)) if len(left) else 0
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, as ``normal`` gives them, packed with ids and flags."""
    held, size, seq = [], 0, 0
    base = TaskContext.get().partitionId() << 32

    def out():
        body, sizes, ids, known, test = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([base + seq]), pa.array([B.pack(body, B.shrink(sizes), ids, known, test, level=3)], pa.binary())], ["batch", "blob"])

    for batch in batches:
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        test = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
        for lo, hi, data, offsets in B.text_slices(batch.column("text")):
            body, at = normal(data, offsets)
            held.append((body, np.diff(at), ids[lo:hi], known[lo:hi], test[lo:hi]))
            size += len(body)
            if size >= BATCH_BYTES:
                yield out()
                held, size, seq = [], 0, seq + 1
    if held:
        yield out()


class Batch:
    """A batch opened, with what it asks for in the order of the parts."""

    def __init__(self, blob: bytes, order: int, parts: int):
        body, sizes, self.ids, self.known, test = B.unpack(blob)
        self.test = test.astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        self.gram = grams(body, self.offsets, order)
        starts, ends, self.first = B.words(body, self.offsets, ~_BLANK)
        self.word = B.hash_words(body, starts, ends)
        self.body = body
        self.parts = parts

    def asks(self):
        train = np.repeat(~self.test, np.diff(self.offsets))
        gram = counted(self.gram, train)
        train_words = np.repeat(~self.test, np.diff(self.first))
        word = counted(self.word, train_words)
        return gram, word

    def by_part(self, gram: np.ndarray, word: np.ndarray):
        """Orders that sort both by part, and where the parts begin."""
        out = []
        for part in (B.splitmix((gram >> B.U64(8)) & B.U64(0xFFFF)) % B.U64(self.parts), B.splitmix(word) % B.U64(self.parts)):
            order = np.argsort(part.astype(np.uint16) if self.parts < 65536 else part, kind="stable")
            out.append((order, np.searchsorted(part[order], np.arange(self.parts + 1, dtype=B.U64))))
        return out


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=B.U64(0)) if len(sorted_keys) else sorted_keys


def _ask(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("batch").to_pylist(), batch.column("blob"), strict=True):
                b = Batch(blob.as_py(), order, parts)
                (gram, gram_n), (word, word_n) = b.asks()
                (go, ge), (wo, we) = b.by_part(gram, word)
                rows = []
                for p in range(parts):
                    g, w = go[ge[p] : ge[p + 1]], wo[we[p] : we[p + 1]]
                    if len(g) or len(w):
                        rows.append((p, 0, name, B.pack(_steps(gram[g]), B.shrink(gram_n[g]), _steps(word[w]), B.shrink(word_n[w]))))
                ends = int((~b.test).sum())
                rows.append((name % parts, 1, name, B.pack(np.array([ends], np.int64))))
                yield _rows(rows)

    return run


def _rows(rows) -> pa.RecordBatch:
    part, kind, name, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(name, pa.int64()), pa.array(blob, pa.binary())], ["part", "kind", "name", "blob"])


_ASKED = "part int, kind int, name long, blob binary"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part: training tokens, distinct ones and ends (slice -1), and its contexts of order 2 by last byte and symbol, in slices."""
    tokens, ends, words, three = 0, 0, [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            arrays = B.unpack(blob.as_py())
            if kind == 0:
                gram, word, n = np.cumsum(arrays[0], dtype=B.U64), np.cumsum(arrays[2], dtype=B.U64), arrays[3].astype(np.int64)
                tokens += int(n.sum())
                words.append(word[n > 0])
                three.append(np.unique(gram[arrays[1] > 0] & B.U64(0xFFFFFF)))
            else:
                ends += int(arrays[0][0])
    distinct = len(np.unique(np.concatenate(words))) if words else 0
    three = np.unique(np.concatenate(three)) if three else np.zeros(0, B.U64)
    pairs = np.bincount((three & B.U64(0xFFFF)).astype(np.int64), minlength=65536).reshape(SLICES, -1)
    rows = [(-1, B.pack(np.array([tokens, distinct, ends], np.int64))), *[(k, B.pack(x)) for k, x in enumerate(pairs) if x.any()]]
    name, blob = zip(*rows, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(blob, pa.binary())], ["slice", "blob"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each slice's arrays."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
            (x,) = B.unpack(blob.as_py())
            sums[k] = sums[k] + x if k in sums else x
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([B.pack(x)], pa.binary())], ["slice", "blob"])


def _answer(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked = 0, []
        for batch in batches:
            for p, kind, name, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("name").to_pylist(), batch.column("blob"), strict=True):
                if kind == 0:
                    part = p
                    g, gn, w, wn = B.unpack(blob.as_py())
                    asked.append((name, np.cumsum(g, dtype=B.U64), gn.astype(np.int64), np.cumsum(w, dtype=B.U64), wn.astype(np.int64)))
        if not asked:
            return
        merged = []
        for i in (1, 3):
            keys, counts = np.concatenate([x[i] for x in asked]), np.concatenate([x[i + 1] for x in asked])
            by = np.argsort(keys)
            keys, counts = keys[by], counts[by]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            merged.append((keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts))
        (gram, gram_n), (word, word_n) = merged
        length = code_lengths(gram, gram_n, shared.value, order).astype(np.float32)
        for name, g, _gn, w, _wn in asked:
            blob = B.pack(length[np.searchsorted(gram, g)], B.shrink(word_n[np.searchsorted(word, w)]))
            yield _rows([(part, 0, name, blob)])

    return run


def _score(order: int, parts: int, tokens: int, distinct: int, ends: int):
    floor = np.log10(tokens + 0.1 * (distinct + 1))

    def one(blob: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        b = Batch(blob, order, parts)
        (gram, _), (word, _) = b.asks()
        (go, _), (wo, _) = b.by_part(gram, word)
        parts_ = [B.unpack(x) for _, x in sorted(answers)]
        length, count = np.empty(len(gram)), np.empty(len(word), np.int64)
        length[go] = np.concatenate([x[0] for x in parts_])
        count[wo] = np.concatenate([x[1].astype(np.int64) for x in parts_]) if len(word) else 0
        sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        score = sums(length[Index(gram).find(b.gram)], b.offsets)
        of = count[Index(word).find(b.word)]
        n = np.diff(b.first) + 1
        base = sums(np.log10(of + 0.1), b.first) + np.log10(ends + 0.1) - n * floor
        known = sums((of > 0).astype(np.int64), b.first) + (ends > 0)
        m = len(b.ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(b.ids, mask=b.known == 0), pa.array(b.test), pa.array(n), pa.array(known), pa.array(np.full(m, tokens)), pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, answers = None, []
        for batch in batches:
            for n, kind, part, blob in zip(batch.column("name").to_pylist(), batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                if n != name:
                    name, answers = n, []
                if kind == 0:
                    answers.append((part, blob.as_py()))
                else:
                    yield one(blob.as_py(), answers)

    return run


def score_documents(docs: DataFrame, held_out, order: int = 6) -> DataFrame:
    """log10 probabilities of documents under a PPM model learned from those where ``held_out`` (a boolean Column) is not true.

    Returns for each row of docs doc_id, held_out, n_tokens (words and the end), n_known (of these, seen
    in training), train_tokens, base_score (unigram words, 0.1 added to each count) and score.

    Null and empty texts are the end alone. Rows without or with equal doc_id are scored like any other,
    from their own text. The log-probability of a byte travels as a 32-bit float, so a score is exact to about
    seven digits. Without any training row every byte has probability 1/256. An empty table gives
    no rows. Words are told by 64-bit hashes.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7: a context and its symbol share 64 bits")
    n = B.parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    batches = B.cut(rows.mapInArrow(_batches, "batch long, blob binary"))
    asked = B.dealt_once(batches.mapInArrow(_ask(order, n), _ASKED).repartitionById(n, F.col("part")))
    sums = asked.mapInArrow(_totals, "slice int, blob binary").repartitionById(SLICES + 1, F.col("slice") + 1).mapInArrow(_added, "slice int, blob binary")
    sums = {row.slice: B.unpack(row.blob)[0] for row in sums.collect()}  # SLICES + 1 rows of bounded size
    tokens, distinct, ends = sums.get(-1, np.zeros(3, np.int64)).tolist()
    train, distinct = tokens + ends, distinct + (ends > 0)
    pairs = np.stack([sums.get(k, np.zeros(65536 // SLICES, np.int64)) for k in range(SLICES)])
    shared = docs.sparkSession.sparkContext.broadcast(pairs.reshape(256, 256))
    answers = asked.mapInArrow(_answer(shared, order), _ASKED)
    texts = batches.select(F.lit(0).alias("part"), F.lit(1).alias("kind"), F.col("batch").alias("name"), "blob")
    met = answers.unionByName(texts).repartition(n, "name").sortWithinPartitions("name", "kind")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(_score(order, n, train, distinct, ends), kinds)


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; one tenth, by the crc32 of doc_id, is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
