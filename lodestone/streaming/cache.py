"""The answer cache over a stream of requests, as a stateful operator with expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "cache_key string, kind string, id long, at_ms long, hit boolean, answer long, hits long"


@contextmanager
def keyed_state(spark: SparkSession):
    """While streams are started: the state store that states, timers and expiry need. The setting is restored."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class AnswerCache(StatefulProcessor):
    """For each message of a bucket: the answer that is cached, until when, and its hits so far (one value state).

    A request without a live answer caches its own id for ``ttl_ms``; others are hits. When event time
    passes the end, the answer goes, with a row that tells its hits: by the bucket's timer, which stands at
    the first end to come, or by the next request if that comes first. The state is read and written once
    for a bucket and batch, whatever the number of requests.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "keys array<string>, answers array<long>, ends array<long>, hits array<long>")

    def load(self) -> dict:
        """key -> (answer, end, hits)."""
        if not self.live.exists():
            return {}
        keys, answers, ends, hits = self.live.get()
        return dict(zip(keys, zip(answers, ends, hits, strict=True), strict=True))

    def store(self, live: dict, timer: int | None) -> None:
        """Keeps what is live; its first end takes the place of the timer that was set."""
        first = min((end for _, end, _ in live.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if not live:
            self.live.clear()
        else:
            self.live.update((list(live), *map(list, zip(*live.values(), strict=True))))

    def rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"hit": "boolean", "answer": "Int64", "hits": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        live = self.load()
        timer = min((end for _, end, _ in live.values()), default=None)
        out = []
        for k, at, i in zip(found["cache_key"].tolist(), found["at_ms"].tolist(), found["id"].tolist(), strict=True):
            now = live.get(k)
            if now is not None and at >= now[1]:
                out.append((k, "expired", now[0], now[1], None, now[0], now[2]))
                now = None
            if now is not None:
                live[k] = now[0], now[1], now[2] + 1
                out.append((k, "request", i, at, True, now[0], None))
            else:
                live[k] = i, at + self.ttl_ms, 0
                out.append((k, "request", i, at, False, None, None))
        self.store(live, timer)
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live, fired, mark = self.load(), expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        gone = {k: x for k, x in live.items() if x[1] <= fired or x[1] < mark}
        self.store({k: x for k, x in live.items() if k not in gone}, None)  # the timer that fired goes by itself
        if gone:
            yield self.rows([(k, "expired", answer, end, None, answer, hits) for k, (answer, end, hits) in gone.items()])

    def close(self) -> None:
        pass


def replayed(requests: DataFrame, key: str, id: str, at: str, ttl_seconds: int = 86400, late: str = "0 seconds", buckets: int = 512) -> DataFrame:
    """Rows (see OUTPUT) of a stream of requests: ``request`` with hit and the answer it got, ``expired`` for each answer whose time has passed.

    Requests later than ``late`` after the newest of an earlier batch are dropped by the watermark. Start the
    query within ``keyed_state``. Keys are dealt into ``buckets`` by a hash. State is one answer a live key,
    and one value a bucket, which a batch reads and writes whole: with very many live keys there should be
    more buckets. A batch's requests of one bucket meet in one task, so batches bound it
    (``maxFilesPerTrigger``).
    """
    rows = requests.withWatermark(at, late).select(F.col(key).alias("cache_key"), F.col(id).cast("long").alias("id"), F.unix_millis(at).alias("at_ms"), F.col(at).alias("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(AnswerCache(1000 * ttl_seconds), OUTPUT, "Append", "EventTime")
