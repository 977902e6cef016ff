"""Substring deduplication with prefix-partitioned suffix trees over words.

Every word position of every text begins a suffix; suffixes are kept to the depth that decides, ``width``
words. They are divided by *variable-length prefixes*: counts over all documents tell which one-word
prefixes hold more leaves than a task should, those are extended by a word, and again, to the full depth
if need be; prefixes are then dealt to groups of a bounded number of leaves, and a task builds the subtree
of one group at a time: its suffixes sorted word by word, the common prefix of neighbours, and from these
the internal nodes. The leaves below a node of depth ``width`` are the occurrences of one repeated
sequence: all outside the document with the smallest id are marked, and marks that touch merge into
the maximal repeated spans.

Two things keep the exchange small. A chunk of the input first merges its own equal suffixes, so it sends
one leaf for each distinct sequence, with its smallest document. And before any words are sent, chunks
exchange short hashes of their leaves, only to leave out those that nobody else can have: no node of that
depth lies above them. Hashes never decide that two sequences are equal; the words do, by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B

CHUNK_BYTES = 3 << 20
#: Leaves that a task holds at a time, about; prefixes that may have more are extended.
GROUP_LEAVES = 1 << 19
#: Hashes that a task compares at a time, about.
GROUP_HASHES = 1 << 22
#: Words of the codebook, and how often a word must come in a chunk to be counted for it.
CODEBOOK, CODED_FROM = 1 << 18, 4
_STEP = B.U64(0xD6E8FEB86659FD93)


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """Non-negative integers as their bytes, place by place, which compress better apart."""
    x = B.shrink(x)
    places = x.view(np.uint8).reshape(len(x), x.itemsize)
    return [np.ascontiguousarray(places[:, k]) for k in range(x.itemsize)]


def _unplane(planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view(np.int64).ravel()


def _bundle(*columns: np.ndarray, whole: tuple[np.ndarray, ...] = ()) -> bytes:
    """Columns of non-negative integers, and arrays that stay as they are, as one blob."""
    planes = [_planes(c) for c in columns]
    return B.pack(np.array([len(p) for p in planes], np.uint8), *whole, *[a for p in planes for a in p], level=3)


def _unbundle(blob: bytes, whole: int = 0) -> list[np.ndarray]:
    sizes, *planes = B.unpack(blob)
    kept, planes = planes[:whole], planes[whole:]
    at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]).tolist()
    return [*kept, *[_unplane(planes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]]


def _dealt(group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, and where each begins in it."""
    order = np.argsort(group.astype(np.uint16) if groups < 65536 else group, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group.astype(np.int64), minlength=groups))])


def _taken(words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some words of a binary column: their lengths, and their bytes one after the other."""
    some = words.take(pa.array(at))
    _, offsets, data = some.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(some) + 1, some.offset * 8)
    return np.diff(offsets), np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0) if len(ascending) else ascending


def _close(rows: list[pa.RecordBatch]) -> bytes:
    table, sink = pa.Table.from_batches(rows).combine_chunks(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _spelled(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words of these lengths, which stand in data one after the other, as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Chunk:
    """A chunk's documents, their words, and their suffixes of at least ``width`` words (of rows with a doc_id)."""

    def __init__(self, blob: bytes, width: int):
        self.rows = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        self.width = width
        text = self.rows.column("text")
        kind = np.int32 if text.nbytes < 1 << 31 else np.int64  # of places in the chunk
        data, offsets, starts, ends, first, hashes, byte, word = [], [np.zeros(1, np.int64)], [], [], [np.zeros(1, np.int64)], [], 0, 0
        for _lo, _hi, part, offs in B.text_slices(text):
            s, e, f = B.words(part, offs)
            hashes.append(_hash(part, s, e))
            data.append(part)
            starts.append((s + byte).astype(kind))
            ends.append((e + byte).astype(kind))
            offsets.append(offs[1:] + byte)
            first.append(f[1:] + word)
            byte, word = byte + len(part), word + len(s)
        self.data, self.offsets, self.starts, self.ends, self.first, self.hashes = (np.concatenate(x) for x in (data, offsets, starts, ends, first, hashes))
        counts = np.diff(self.first)
        known = self.rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(counts), dtype=kind), counts)
        at = np.arange(len(doc), dtype=kind)
        at = at[(at + width <= self.first[1:][doc]) & known[doc]]
        self.at, self.ids = at, self.rows.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc[at]]

    def prefix(self, at: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
        """The code of the first n words of suffixes, from that of the first n - 1."""
        return self.hashes[at + n - 1] if before is None else before * _STEP + self.hashes[at + n - 1]

    def spell(self) -> None:
        """Each word's place in the chunk's dictionary of words."""
        code = _spelled(self.data[B.WORD_BLANK[self.data]], self.ends - self.starts).dictionary_encode()
        self.words, self.dictionary = code.indices.to_numpy(), code.dictionary

    def whole(self) -> np.ndarray:
        """The hashes of the suffixes."""
        n = len(self.hashes) - self.width + 1
        code = self.hashes[: max(0, n)].copy()
        for j in range(1, self.width):
            code *= _STEP
            code += self.hashes[j : j + n]
        return B.splitmix(code[self.at])

    def nodes(self) -> None:
        """The suffixes in order of ``key``; equal ones, by their words, are a node of the chunk's own."""
        self.spell()
        key = self.whole()
        order = np.argsort(key).astype(self.at.dtype)
        key = key[order]
        same = key[1:] == key[:-1]
        unlike = self._unlike(order, same)
        if unlike.any():  # equal hashes of unlike words: there the words tell the order
            run = np.concatenate([[0], np.cumsum(~same)])
            mixed = np.isin(run, run[1:][unlike])
            own = order[mixed]
            order[mixed] = own[np.lexsort((*[self.words[self.at[own] + j] for j in range(self.width - 1, -1, -1)], key[mixed]))]
            unlike = self._unlike(order, same)
        begin = np.concatenate([[True], ~same | unlike]) if len(key) else np.zeros(0, bool)
        self.order, self.of = order, np.cumsum(begin, dtype=order.dtype) - 1
        begin = np.flatnonzero(begin)
        self.key, self.head = key[begin], self.at[order[begin]]
        self.least = np.minimum.reduceat(self.ids[order], begin) if len(begin) else np.zeros(0, np.int64)

    def _unlike(self, order: np.ndarray, same: np.ndarray) -> np.ndarray:
        out = np.zeros(len(same), bool)
        pair = np.flatnonzero(same)
        a, b = self.at[order[pair]], self.at[order[pair + 1]]
        for j in range(self.width):
            out[pair] |= self.words[a + j] != self.words[b + j]
        return out

    def asked(self, bits: int, groups: int):
        """For each group of hashes: the nodes (their places, ascending) and their hashes, shortened to ``bits`` and divided by groups."""
        short = self.key >> B.U64(64 - bits)
        order, edge = _dealt(short % B.U64(groups), groups)
        for g in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[g] : edge[g + 1]]
            yield g, at, (short[at] // B.U64(groups)).astype(np.int64)


def _hash(data, starts, ends) -> np.ndarray:
    return B.hash_words(data, starts, ends)


def _pack(width: int, share: float, chunk_bytes: int):
    """Documents in chunks, with the counts of prefixes that hold more than ``share`` of a chunk's suffixes, and of common words."""

    def common(chunk: Chunk) -> bytes:
        chunk.spell()
        count = np.bincount(chunk.words, minlength=len(chunk.dictionary)) if len(chunk.words) else np.zeros(0, np.int64)
        often = np.flatnonzero(count >= CODED_FROM)
        lengths, spelled = _taken(chunk.dictionary, often)
        return _bundle(count[often], lengths, whole=(spelled,))

    def heavy(chunk: Chunk) -> bytes:
        at, code, rows = chunk.at, None, []
        least = share * len(at)
        for n in range(1, width):
            code = chunk.prefix(at, n, code)
            bucket = (B.splitmix(code) >> B.U64(48)).astype(np.int32)  # what shares a bucket with few is no candidate
            some = np.bincount(bucket, minlength=1 << 16)[bucket] > least
            at, code = at[some], code[some]
            values, back, counts = np.unique(code, return_inverse=True, return_counts=True)
            often = counts > least
            rows.append((np.full(int(often.sum()), n), values[often], counts[often]))
            keep = often[back]
            at, code = at[keep], code[keep]
            if not len(at):
                break
        level, code, count = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, B.U64), np.zeros(0, np.int64))
        return B.pack(level.astype(np.uint8), code.astype(B.U64), B.shrink(count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            blob = _close(held)
            held.clear()  # the chunk is opened from the blob
            chunk = Chunk(blob, width)
            columns = [pa.array([name]), pa.array([len(chunk.at)]), *[pa.array([x], pa.binary()) for x in (heavy(chunk), common(chunk), blob)]]
            del chunk
            B.release()
            return pa.RecordBatch.from_arrays(columns, ["chunk", "n", "counts", "words", "blob"])

        for batch in batches:
            for lo, hi, data, _offsets in B.text_slices(batch.column("text")):
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
                if size >= chunk_bytes:
                    yield out()
                    size, name = 0, name + 1
        if held:
            yield out()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's chunks, added up where several are at hand."""
    for batch in batches:
        level, code, n = (np.concatenate(x) for x in zip(*[B.unpack(blob.as_py()) for blob in batch.column("counts")], strict=True))
        order = np.lexsort((code, level))
        level, code, n = level[order], code[order], n[order].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (level[1:] != level[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, begin) if len(begin) else n
        yield pa.RecordBatch.from_arrays([pa.array(level[begin].astype(np.int32)), pa.array(code[begin].view(np.int64)), pa.array(n)], ["level", "code", "n"])


def _prefixes(homed: DataFrame, width: int, leaves: int) -> list[np.ndarray]:
    """By length, the prefixes to extend: those that may have more than ``leaves`` leaves, an eighth of which the chunks may have left out."""
    rows = homed.select("counts").mapInArrow(_counts, "level int, code long, n long").groupBy("level", "code").agg(F.sum("n").alias("n")).where(F.col("n") > leaves - leaves // 8)
    found: list[list[int]] = [[] for _ in range(width)]
    for row in rows.toLocalIterator():
        found[row.level - 1].append(row.code)
    return [np.sort(np.array(x, np.int64).view(B.U64)) for x in found]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("words"):
            spelled, count, lengths = _unbundle(blob.as_py(), 1)
            yield pa.RecordBatch.from_arrays([_spelled(spelled, lengths).cast(pa.binary()), pa.array(count)], ["word", "n"])


def _codebook(homed: DataFrame, most: int) -> pa.Array:
    """The ``most`` commonest words, commonest first: in the exchange a short number stands for them, others are spelled. Decides nothing else."""
    rows = homed.select("words").mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return pa.array([bytes(r.word) for r in rows.orderBy(F.desc("n"), "word").limit(most).select("word").toLocalIterator()], pa.large_binary())


_DEALT = "part int, sub int, chunk long, blob binary"


def _rows(rows: list[tuple], names: tuple[str, ...] = ("part", "sub", "chunk", "blob")) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "sub": pa.int32(), "chunk": pa.int64(), "kept": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[c]) for c, x in zip(names, zip(*rows, strict=True), strict=True)], list(names))


def _ask(width: int, bits: int, n: int, subs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                chunk = Chunk(blob.as_py(), width)
                chunk.nodes()
                rows = [(g % n, g // n, name, _bundle(_steps(short))) for g, _at, short in chunk.asked(bits, n * subs)]
                del chunk  # before the next one is opened
                B.release()
                if rows:
                    yield _rows(rows)

    return run


def _groups(batches: Iterator[pa.RecordBatch], opened) -> Iterator[tuple[int, int, list[tuple]]]:
    """(part, sub, [(chunk, opened blob)]) of rows sorted by part and sub, one group at a time."""
    key, held = None, []
    for batch in batches:
        for part, sub, chunk, blob in zip(*[batch.column(c).to_pylist() for c in ("part", "sub", "chunk")], batch.column("blob"), strict=True):
            if key != (part, sub):
                if held:
                    yield *key, held
                key, held = (part, sub), []
            held.append((chunk, opened(blob.as_py())))
    if held:
        yield *key, held


def _reply(n: int):
    """Of each group of hashes: which of a chunk's are another chunk's too, as bits in the order they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sub, held in _groups(batches, lambda b: np.cumsum(_unbundle(b)[0])):
            every = np.concatenate([x for _, x in held])
            every.sort()
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            del every
            rows = []
            for chunk, own in held if len(twice) else ():
                hit = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
                if hit.any():
                    rows.append((chunk, sub * n + part, int(hit.sum()), B.pack(np.packbits(hit))))
            held.clear()  # before the next group is gathered
            B.release()
            if rows:
                yield _rows(rows, ("chunk", "sub", "kept", "blob"))

    return run


def _leaves(width: int, bits: int, hash_groups: int, n: int, subs: int, shared):
    """The leaves that another chunk may have, dealt by prefix: words, smallest document, place among the chunk's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, book = shared.value
        for batch in batches:
            for name, blob, replies in zip(batch.column("chunk").to_pylist(), batch.column("blob"), batch.column("replies"), strict=True):
                if not replies.is_valid:
                    continue
                answers = {r["sub"]: r["blob"] for r in replies.as_py()}
                chunk = Chunk(blob.as_py(), width)
                chunk.nodes()
                kept = np.zeros(len(chunk.key), bool)
                for g, at, _short in chunk.asked(bits, hash_groups):
                    if g in answers:
                        kept[at] = np.unpackbits(B.unpack(answers[g])[0], count=len(at)).astype(bool)
                coded = pc.index_in(chunk.dictionary, book).fill_null(-1).to_numpy(zero_copy_only=False)
                yield from dealt(name, chunk, np.flatnonzero(kept), split, coded, len(book))
                del chunk, kept, coded
                B.release()

    def dealt(name: int, chunk: Chunk, node: np.ndarray, split: list[np.ndarray], coded: np.ndarray, common: int) -> Iterator[pa.RecordBatch]:
        head = chunk.head[node]
        code, open_, so_far = np.zeros(len(node), B.U64), np.arange(len(node)), None
        for j, table in enumerate(split):
            so_far = chunk.prefix(head[open_], j + 1, so_far)
            code[open_] = so_far
            more = table[np.minimum(np.searchsorted(table, so_far), len(table) - 1)] == so_far if len(table) else np.zeros(len(open_), bool)
            open_, so_far = open_[more], so_far[more]
            if not len(open_):
                break
        order, edge = _dealt(B.splitmix(code) % B.U64(n * subs), n * subs)
        number, rare, rows = coded.astype(np.uint32), coded < 0, []
        for g in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[g] : edge[g + 1]]
            words = chunk.words[head[at][None, :] + np.arange(chunk.width, dtype=head.dtype)[:, None]]  # a row for each depth
            used = np.unique(words[rare[words]])
            number[used] = common + np.arange(len(used), dtype=np.uint32)
            least = chunk.least[node[at]]
            low = int(least.min())
            lengths, spelled = _taken(chunk.dictionary, used)
            numbers = (_steps(node[at]), least.view(B.U64) - np.int64(low).view(B.U64), number[words].ravel(), lengths)
            rows.append((g % n, g // n, name, _bundle(*numbers, whole=(np.array([low], np.int64), spelled))))
            if len(rows) >= 64:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return run


def subtree(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of rows of words, and where the leaves of each internal node of that depth (or lone leaves) begin in it."""
    order = np.lexsort(words.T[::-1])
    common = np.zeros(max(0, len(order) - 1), np.int64)  # the common prefix of neighbours
    going = np.ones(len(common), bool)
    for j in range(words.shape[1]):
        going &= words[order[1:], j] == words[order[:-1], j]
        common += going
    return order, np.flatnonzero(np.concatenate([[True], common < depth])) if len(order) else np.zeros(0, np.int64)


def _trees(width: int, common: int):
    """The subtrees of a partition, one group at a time: marks for the chunks."""

    def opened(blob: bytes) -> tuple:
        low, spelled, node, least, words, lengths = _unbundle(blob, 2)
        return np.cumsum(node), least + low[0], words.astype(np.int32).reshape(width, -1), _spelled(spelled, lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, _sub, held in _groups(batches, opened):
            code = pa.chunked_array([x[3] for _, x in held]).combine_chunks().dictionary_encode().indices.to_numpy()
            base = np.cumsum([0] + [len(x[3]) for _, x in held]).tolist()
            least = np.concatenate([x[1] for _, x in held])
            words = np.empty((width, len(least)), np.int32)
            nodes, at = [], 0
            held.reverse()
            for b in base[:-1]:  # a chunk's words go as they are put into the group's array
                chunk, x = held.pop()
                own = x[2]
                rare = own >= common
                own[rare] = common + code[b + own[rare] - common]
                words[:, at : at + own.shape[1]] = own
                at += own.shape[1]
                nodes.append((chunk, x[0]))
            words = words.T
            del code, own, rare, x
            order, begin = subtree(words, width)
            late = np.zeros(len(order), bool)
            late[order] = least[order] > np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(order))))
            rows, at = [], 0
            for chunk, node in nodes:
                mine = node[late[at : at + len(node)]]
                at += len(node)
                if len(mine):
                    rows.append((chunk, _bundle(_steps(mine))))
            del words, least, order, begin, late, nodes, node, mine
            B.release()
            if rows:
                yield _rows(rows, ("chunk", "blob"))

    return run


def _remove(width: int, keep: list[str], with_text: bool, with_spans: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, marks in zip(batch.column("blob"), batch.column("marks"), strict=True):
                chunk = Chunk(blob.as_py(), width)
                chunk.nodes()
                late = np.zeros(len(chunk.key), bool)
                for mark in marks.as_py() or []:
                    late[np.cumsum(_unbundle(mark)[0])] = True
                leaf = late[chunk.of] | (chunk.ids[chunk.order] > chunk.least[chunk.of])
                at = chunk.at[chunk.order[leaf]]
                n = len(chunk.starts) + 1
                gone = np.bincount(at, minlength=n)
                gone -= np.bincount(at + width, minlength=n)
                gone = np.cumsum(gone, out=gone)[:-1] > 0
                found = _kept(chunk.rows, chunk.data, chunk.starts, chunk.ends, chunk.first, gone)
                del chunk, late, leaf, at, gone
                B.release()
                yield found

    def _kept(rows, data, starts, ends, first, gone) -> pa.RecordBatch:
        stay = np.flatnonzero(~gone)
        per = np.searchsorted(stay, first)  # each document's kept words
        change = np.zeros(len(data) + 1, np.int8)
        change[starts[stay]] += 1
        np.add.at(change, ends[stay], -1)
        mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        last = np.zeros(len(stay), bool)
        last[per[1:][per[1:] > per[:-1]] - 1] = True
        blank = ends[stay[~last]]  # more words follow in the document, so a separator stands here
        mask[blank] = True
        data = data.copy()
        data[blank] = 0x20
        size = np.concatenate([[0], np.cumsum(ends[stay] - starts[stay] + ~last)])[per]
        text = data[mask].tobytes()
        pieces = [text[a:b] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
        total = np.concatenate([[0], np.cumsum(gone)])
        n_gone = total[first[1:]] - total[first[:-1]]
        out = {
            "doc_id": rows.column("doc_id"),
            "n_words": pa.array(np.diff(first)),
            "n_removed": pa.array(n_gone),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()),
        }
        if with_text:  # as it was where nothing is removed
            as_was = rows.column("text")
            out["kept_text"] = pa.array([as_was[i].as_py() if not g else x.decode() for i, (g, x) in enumerate(zip(n_gone.tolist(), pieces, strict=True))], pa.string())
        if with_spans:
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            inside = np.zeros(len(gone) + 1, bool)
            inside[first[:-1]] = True
            begin = np.flatnonzero((edge[:-1] == 1) | (gone & inside[:-1]))
            stop = np.flatnonzero((edge[1:] == -1) | (gone & inside[1:])) + 1
            doc = np.searchsorted(first, begin, "right") - 1
            spans: list[list[dict]] = [[] for _ in range(len(first) - 1)]
            for d, x, y in zip(doc.tolist(), begin.tolist(), stop.tolist(), strict=True):
                spans[d].append({"first_word": int(x - first[d]), "n_words": y - x})
            out["spans"] = pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())])))
        for c in keep:
            out[c] = rows.column(c)
        return pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return run


def remove_repeats(
    docs: DataFrame, width: int = 13, keep: tuple[str, ...] = (), with_text: bool = False, with_spans: bool = False, leaves: int = GROUP_LEAVES, hashes: int = GROUP_HASHES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts in a document with a smaller doc_id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; windows are judged on the input. Returns for
    each row of docs doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    if asked for, kept_text (the text itself where nothing is removed), spans (maximal removed runs of
    words) and the ``keep`` columns of docs, except those with a name of a result column.

    Null and empty texts have no words. A row without doc_id is judged by no window and judges none. Rows
    that share a doc_id do not judge each other; each is judged by its own text. Equal sequences are told
    by their words' bytes. An empty table gives no rows.

    A task holds one chunk of ``chunk_bytes`` of text (or one document), about ``hashes`` hashes or the
    subtree of about ``leaves`` leaves, whatever the input; a sequence that every chunk has brings one
    leaf a chunk. The texts are moved once, to where the answers about their chunk will arrive.
    """
    spark = docs.sparkSession
    n = B.parts(spark)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text + ["spans"] * with_spans
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in keep if c != "text"])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"] + 1
    most = max(1, leaves // 2)  # of one prefix
    share = min(1.0, most / (4 * size))  # of at most size / 2 suffixes, an eighth of that
    packed = rows.mapInArrow(_pack(width, share, chunk_bytes), "chunk long, n long, counts binary, words binary, blob binary")
    homed = B.cut_by(packed, n, "chunk")
    total = homed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    book = _codebook(homed, CODEBOOK)
    split = spark.sparkContext.broadcast((_prefixes(homed, width, most), book))

    bits, hash_subs = min(64, size.bit_length() + 2), -(-max(1, total) // (n * hashes))
    by_group = lambda df, n: df.repartitionById(n, F.col("part")).sortWithinPartitions("part", "sub")
    asked = by_group(homed.select("chunk", "blob").mapInArrow(_ask(width, bits, n, hash_subs), _DEALT), n)
    replies = B.cut(asked.mapInArrow(_reply(n), "chunk long, sub int, kept long, blob binary"))
    left = replies.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("n")).first()["n"]
    trees = min(n, -(-max(1, left) // leaves))  # fewer, larger groups repeat fewer words
    subs = max(1, round(left / (trees * leaves)))
    replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("sub", "blob")).alias("replies"))
    met = homed.select("chunk", "blob").join(replies.hint("merge"), "chunk")
    dealt = by_group(met.mapInArrow(_leaves(width, bits, n * hash_subs, trees, subs, split), _DEALT), trees)
    marks = dealt.mapInArrow(_trees(width, len(book)), "chunk long, blob binary").groupBy("chunk").agg(F.collect_list("blob").alias("marks"))

    kinds = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string", "spans": "array<struct<first_word:long,n_words:long>>", "doc_id": "long"}
    kinds |= {c: docs.schema[c].dataType.simpleString() for c in keep}
    names = names + keep
    whole = homed.select("chunk", "blob").join(marks.hint("merge"), "chunk", "left")
    return whole.mapInArrow(_remove(width, keep, with_text, with_spans, names), ", ".join(f"`{c}` {kinds[c]}" for c in names))


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, windows of 13 words."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS s FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
c AS (SELECT DISTINCT x.doc_id, i + k AS i FROM x JOIN m USING (s), unnest(range(0, 13)) AS u(k) WHERE m.least < x.doc_id),
l AS (SELECT d.doc_id, c.i IS NOT NULL AS gone, u.i, w[u.i] AS word FROM d CROSS JOIN unnest(range(1, len(w) + 1)) AS u(i) LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = u.i),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
