"""Vectorised UTF-8 text handling shared by the operators of this subpackage.

Texts arrive as Arrow string columns. They are processed in slices of about a megabyte so that the
numpy temporaries (about 8 bytes for each byte of text) stay small whatever the batch holds; one
document is never divided, so a single very long text makes one larger slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 17
U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = np.asarray(x, U64) + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: 0x20 and 0x09-0x0D separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BLANK = ~IS_SPACE
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = splitmix(np.arange(256, dtype=U64) + U64(77))
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_trim: list = []


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those up to HASH_BYTES are kept for the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, HASH_BYTES), base, U64)
        full[0] = 1
        have = np.cumprod(full, dtype=U64)
        if n <= HASH_BYTES:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Gives freed memory back to the system, so that a worker that serves many stages holds what the present one needs."""
    pa.default_memory_pool().release_unused()
    if not _trim:
        _trim.append(getattr(ctypes.CDLL(None), "malloc_trim", None))
    if _trim[0] is not None:
        _trim[0](0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of a slice, and where each document's words begin.

    A word is a maximal run, within one document, of bytes for which ``word`` holds.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``second`` gives an independent one.

    Words are in order. A word's hash does not depend on where it stands, so some of them are hashed at a time.
    """
    if not len(starts):
        return np.zeros(0, U64)
    base, inverse = (_R, _R_INV) if not second else (_R * 5 & (2**64 - 1), pow(_R * 5 & (2**64 - 1), -1, 1 << 64))
    table = _BYTE[LOWER] if lower else _BYTE
    if second:
        table = splitmix(table)
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + HASH_BYTES, "right")))
        some = data[lo : int(ends[to - 1])]
        total = np.zeros(len(some) + 1, U64)
        np.cumsum(table[some] * powers(base, len(some)), out=total[1:])
        start, end = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = splitmix((total[end] - total[start]) * powers(inverse, len(some) + 1)[start] + (end - start).astype(U64))
        at = to
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``width`` consecutive words within a document, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key = np.zeros(n, U64)
    for j in range(width):
        key *= U64(0xD6E8FEB86659FD93)
        key += hashes[j : j + n]
    good = np.ones(n, bool)
    for j in range(1, width):  # a window that starts up to width-1 words before a document's first word crosses it
        at = first[1:-1] - j
        good[at[(at >= 0) & (at < n)]] = False
    # documents shorter than width are crossed as well: their neighbours' firsts lie within the window
    at = np.flatnonzero(good)
    return splitmix(key[at]), at


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob."""
    import zstandard

    head = np.array([len(arrays)], np.int64).tobytes() + b"".join(f"{a.dtype.str}:{len(a)}".ljust(24).encode() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    kinds = [raw[8 + 24 * i : 32 + 24 * i].decode().strip().rsplit(":", 1) for i in range(n)]
    at += 24 * n
    for kind, size in kinds:
        kind, size = np.dtype(kind), int(size)
        out.append(np.frombuffer(raw, kind, size, at))
        at += kind.itemsize * size
    return out


def shrink(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the smallest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def parts(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark) -> str | None:
    """Where the cluster keeps checkpoints; one is set only where none is set (as in tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not where:  # one process, as in tests: its own folder is shared
            import tempfile

            where = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def small_batches(spark) -> None:
    """From now on about 4 MB of rows at most go to a Python worker at a time, where Spark's own limits (10,000 rows, 64 MB) let it and the JVM hold a multiple of that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def cut(df):
    """The frame with its lineage cut, written to the cluster's shared checkpoint folder.

    A checkpointed frame keeps the size estimate of the plan it came from, which joins multiply; over the
    turns of a loop it becomes a number of many thousand digits. The frame is therefore built anew on the
    checkpointed rows, with no estimate; adaptive execution goes by the sizes it measures.
    """
    from pyspark.sql import DataFrame

    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def dealt_once(df):
    """A frame that ends in an exchange, for two readers: both take the same shuffle files, which are made anew where an executor is lost."""
    from pyspark.sql import DataFrame

    spark = df.sparkSession
    frame = df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False), spark)


def cut_by(df, n: int, key: str):
    """The frame dealt by ``key`` to n partitions and cut there; joins on the key do not move it again.

    A checkpoint keeps the partitioning of a plan that is not adaptive, so the plan of this frame is not.
    """
    spark = df.sparkSession
    shared_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(n, key).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def cut_small(df):
    """As ``cut``, for rows of a few numbers: an eighth of the shuffle partitions is enough for them."""
    return cut(df.coalesce(max(8, parts(df.sparkSession) // 8)))
