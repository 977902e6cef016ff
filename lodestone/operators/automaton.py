"""Large lexicons over texts: an Aho-Corasick automaton of all entries, one pass a text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of entries that one automaton takes; a larger lexicon is several, with a pass over the texts for each.
BLOCK_BYTES = 32 << 20
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, entries: list[str]) -> ahocorasick.Automaton:
    """Built once a worker; the last two are remembered."""
    if key not in _built:
        while len(_built) > 1:
            del _built[next(iter(_built))]
        made = ahocorasick.Automaton()
        for i, e in enumerate(entries):
            made.add_word(e, (i, len(e)))
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _blocks(entries: list[str], limit: int) -> Iterator[tuple[int, list[str]]]:
    first, block, size = 0, [], 0
    for e in entries:
        n = len(e.encode()) + 64
        if block and size + n > limit:
            yield first, block
            first, block, size = first + len(block), [], 0
        block.append(e)
        size += n
    if block:
        yield first, block


def occurrences(df: DataFrame, text: str, entries: list[str], whole_words: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df's other columns with entry (place in the list) and times, for each distinct entry that occurs in a text.

    Texts and entries are compared as they are; lower both for any case. ``whole_words``: a letter, digit or
    underscore may stand neither before nor after. Empty entries and null texts match nothing; of equal
    entries the first counts. Occurrences may overlap.
    """
    import hashlib

    spark, columns = df.sparkSession, [c for c in df.columns if c not in (text, "entry", "times")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", entry int, times long"
    parts = []
    for first, block in _blocks(entries, block_bytes):
        key = hashlib.md5("\0".join(block).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(block)
        places = {}
        for i, e in enumerate(block):
            places.setdefault(e, i)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key, first=first) -> Iterator[pa.RecordBatch]:
            names = {}
            distinct = [e for i, e in enumerate(shared.value) if e and names.setdefault(e, i) == i]
            numbers = [names[e] for e in distinct]
            machine = _automaton(key, distinct) if distinct else None
            word = lambda c: c.isalnum() or c == "_"
            for batch in batches:
                row, entry, times = [], [], []
                for r, t in enumerate(batch.column(text).to_pylist() if machine else []):
                    found: dict[int, int] = {}
                    for end, (i, n) in machine.iter(t or ""):
                        if not whole_words or not ((end + 1 < len(t) and word(t[end + 1])) or (end >= n and word(t[end - n]))):
                            found[i] = found.get(i, 0) + 1
                    row += [r] * len(found)
                    entry += [first + numbers[i] for i in found]
                    times += found.values()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in columns], pa.array(entry, pa.int32()), pa.array(times, pa.int64())], [*columns, "entry", "times"])

        parts.append(df.select(*columns, text).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_lists(df: DataFrame, keys: list[str], text: str, lists: dict[str, list[str]], weight=lambda w: 1, bonus: dict[str, list[str]] | None = None, bonus_weight: int = 10, least: int = 1) -> DataFrame:
    """keys, name, score: what ``rules.best`` tells of each text, for lexicons of any size; texts below ``least`` have no row.

    An entry counts once a text, by its weight in each list that has it; a list whose ``bonus`` words all
    occur gets ``bonus_weight`` more. The first of equal lists wins. ``keys`` tell rows apart.
    """
    entries = list(dict.fromkeys([w for ws in lists.values() for w in ws] + [w for ws in (bonus or {}).values() for w in ws]))
    place = {w: i for i, w in enumerate(entries)}
    rows = [(place[w], o, name, weight(w)) for o, (name, ws) in enumerate(lists.items()) for w in ws]
    order = {name: o for o, name in enumerate(lists)}
    table = df.sparkSession.createDataFrame(rows, "entry int, o int, name string, w long")  # as large as the lexicon, which the driver holds
    hits = occurrences(df.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t")), "__t", entries)
    said = hits.join(F.broadcast(table) if len(rows) <= 1_000_000 else table, "entry").select(*keys, "o", "name", "w")
    for name, ws in (bonus or {}).items():
        full = hits.where(F.col("entry").isin([place[w] for w in set(ws)])).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") == len(set(ws)))
        said = said.unionByName(full.select(*keys, F.lit(order[name]).alias("o"), F.lit(name).alias("name"), F.lit(bonus_weight).cast("long").alias("w")))
    sums = said.groupBy(*keys, "o", "name").agg(F.sum("w").alias("score")).where(F.col("score") >= least)
    top = sums.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("o")).alias("o"), "name")).alias("x"))
    return top.select(*keys, "x.name", "x.score")
