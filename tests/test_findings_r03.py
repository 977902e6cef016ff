import pandas as pd
from pyspark.sql import functions as F

from lodestone.streaming import cache, replay


class Handle:
    """Counts what is asked of the state store."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, *schema):
        return self

    getMapState = getValueState

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    # of the map state
    values = lambda self: iter([])
    containsKey = lambda self, key: setattr(self, "calls", self.calls + 1)
    updateValue = lambda self, key, value: setattr(self, "calls", self.calls + 1)


def test_cache_asks_the_state_store_a_few_times_a_batch():
    handle, keys = Handle(), [f"k{i % 50}" for i in range(2000)]
    rows = pd.DataFrame({"cache_key": keys, "id": range(2000), "at_ms": [i * 10 for i in range(2000)]})
    own = cache.AnswerCache(1500)
    own.init(handle)
    out = pd.concat(own.handleInputRows((3,), iter([rows[:1200], rows[1200:]]), None))
    assert handle.calls <= 5 and len(handle.timers) == 1
    assert (out["kind"] == "request").sum() == 2000 and set(out["cache_key"]) == set(keys)
    assert out["hit"].sum() == 2000 - 50 * 14  # a key is asked for every 500 ms: one answer for three requests
    assert (out["kind"] == "expired").sum() == 50 * 13 and set(out["hits"].dropna()) == {2}


def test_cache_keys_of_one_bucket_do_not_meet(spark, tmp_path):
    said = [(i, f"m{i % 7}", 86_400_000 + 400 * i) for i in range(300)]
    e = spark.createDataFrame(said, "id long, m string, ms long").withColumn("at", F.timestamp_millis("ms"))
    replay.deal(e, "ms", 3, str(tmp_path / "in"))
    found = []
    for buckets in (1, 512):
        out = str(tmp_path / f"out{buckets}")
        with cache.keyed_state(spark):
            replay.run(cache.replayed(replay.arriving(spark, str(tmp_path / "in"), e.schema), "m", "id", "at", 10, buckets=buckets), out, str(tmp_path / f"cp{buckets}"))
        found.append(sorted(map(str, spark.read.parquet(out).collect())))
    assert found[0] == found[1] and len(found[0]) > 300
