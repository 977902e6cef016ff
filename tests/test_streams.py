import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import writers
from lodestone.streaming import cache, replay


def rows(spark, path):
    return sorted(map(str, spark.read.parquet(path).collect()))


def test_cache_expires_by_event_time(spark, tmp_path):
    hour = 3_600_000
    day = 24 * hour
    said = [(1, "a", 0), (2, "a", hour // 2), (3, "b", hour), (4, "a", hour + 5), (5, "b", 2 * hour - 1), (6, "c", 9 * hour), (7, "a", 9 * hour + 1)]
    said = [(i, m, t + day) for i, m, t in said]
    e = spark.createDataFrame(said, "id long, m string, ms long").withColumn("at", F.timestamp_millis("ms"))
    replay.deal(e, "ms", 3, str(tmp_path / "in"))
    before = spark.conf.get(cache.PROVIDER)
    with cache.keyed_state(spark):
        n = replay.run(cache.replayed(replay.arriving(spark, str(tmp_path / "in"), e.schema), "m", "id", "at", 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert n >= 3 and spark.conf.get(cache.PROVIDER) == before
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.hit, r.answer) for r in got if r.kind == "request") == [(1, False, None), (2, True, 1), (3, False, None), (4, False, None), (5, True, 3), (6, False, None), (7, False, None)]
    # the last answers of a and c have not expired: no event came after their time
    assert sorted((r.cache_key, r.answer, r.at_ms - day, r.hits) for r in got if r.kind == "expired") == [("a", 1, hour, 1), ("a", 4, 2 * hour + 5, 0), ("b", 3, 2 * hour, 1)]
    with cache.keyed_state(spark):  # nothing new
        replay.run(cache.replayed(replay.arriving(spark, str(tmp_path / "in"), e.schema), "m", "id", "at", 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_a_lost_epoch_is_merged_again_without_a_change(spark, tmp_path):
    path, source, checkpoint = str(tmp_path / "t"), str(tmp_path / "in"), tmp_path / "cp"
    df = spark.createDataFrame([(k, n, f"{k}-{n}") for n in range(6) for k in range(5)], "k long, n long, v string")
    replay.deal(df.where("n < 4"), "n", 2, source)
    take = lambda: replay.merge(replay.arriving(spark, source, df.schema), path, "k", "n", str(checkpoint), 4)
    assert take() == 2
    want = [(k, 3, f"{k}-3") for k in range(5)]
    got = lambda: sorted((r.k, r.n, r.v) for r in spark.read.parquet(path).collect())
    assert got() == want
    last = max((checkpoint / "commits").iterdir(), key=lambda f: f.name)  # written, but not committed
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert take() >= 1 and got() == want
    df.where("n >= 4").coalesce(1).write.mode("append").parquet(source)
    take()
    assert got() == [(k, 5, f"{k}-5") for k in range(5)]
    df.where("n = 1").coalesce(1).write.mode("append").parquet(source)  # late rows do not replace newer ones
    take()
    assert got() == [(k, 5, f"{k}-5") for k in range(5)]


def test_only_touched_folders_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, "old", i) for i in range(200)], "id long, v string, n long")
    assert writers.upsert_touched(spark, old, path, "id", buckets=8) == list(range(8))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in spark.read.parquet(path).inputFiles() for f in [f.removeprefix("file:").replace("//", "")]}
    before = files()
    new = spark.createDataFrame([(7, "a", 1, 1), (7, "b", 2, 2), (999, "c", 3, 1)], "id long, v string, n long, at int")
    touched = writers.upsert_touched(spark, new, path, "id", "at", 8)
    assert 1 <= len(touched) <= 2
    kept = {f: t for f, t in before.items() if not any(f"bucket={b}/" in f for b in touched)}
    assert kept and kept.items() <= files().items()  # the same names and times
    got = {r.id: (r.v, r.n) for r in spark.read.parquet(path).collect()}
    assert len(got) == 201 and got[7] == ("b", 2) and got[999] == ("c", 3) and got[8] == ("old", 8)
    first = rows(spark, path)
    writers.upsert_touched(spark, new, path, "id", "at", 8)
    assert rows(spark, path) == first
    assert writers.upsert_touched(spark, new.limit(0), path, "id", "at", 8) == [] and rows(spark, path) == first


@pytest.mark.parametrize("n", [0, 1, 5])
def test_deal_keeps_every_row_in_order(spark, tmp_path, n):
    df = spark.range(n).withColumn("x", F.col("id") % 3)
    replay.deal(df, "x", 3, str(tmp_path / "in"))
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "in")).count() == n
