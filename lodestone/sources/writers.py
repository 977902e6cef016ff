"""Writers: index tables with idempotent upsert, feedback, cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from . import folders


def check_vectors(df: DataFrame, column: str, dimension: int) -> DataFrame:
    """The same rows; a vector of another dimension fails the job."""
    bad = F.raise_error(F.concat(F.lit(f"{column} must have {dimension} numbers, not "), F.size(column).cast("string")))
    return df.withColumn(column, F.when(F.size(column) == dimension, F.col(column)).otherwise(F.coalesce(bad.cast(df.schema[column].dataType.simpleString()))))


def create_index(chunks: DataFrame, path: str) -> None:
    """Replaces the index, one folder for each category."""
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)


def merged(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table after an upsert: new rows replace old ones by key. Of new rows with one key the last by ``order`` counts (any, without one)."""
    if order is None:
        last = new.dropDuplicates([key])
    else:
        last = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def recover(spark: SparkSession, path: str) -> None:
    """Ends an upsert whose driver was lost: where the index is gone, the finished one beside it, or the one set aside, takes its place."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        for beside in (path + ".next", path + ".old"):
            if fs.exists(at(beside + "/_SUCCESS")):
                fs.rename(at(beside), at(path))
                break


def upsert(spark: SparkSession, chunks: DataFrame, path: str, key: str = "chunk_id", order: str | None = None) -> None:
    """Adds chunks and replaces those with the same key; the same call again changes nothing. Creates the index where there is none.

    The new index is written beside the old one, which is set aside before the new one takes its name and
    deleted after that; at any moment one of them is whole, and ``recover`` (called first here) finds it.
    """
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, path)
    if not fs.exists(at(path)):
        create_index(merged(chunks.limit(0), chunks, key, order), path)
        return
    merged(spark.read.parquet(path), chunks, key, order).write.mode("overwrite").partitionBy("category").parquet(path + ".next")
    fs.delete(at(path + ".old"), True)
    fs.rename(at(path), at(path + ".old"))
    fs.rename(at(path + ".next"), at(path))
    fs.delete(at(path + ".old"), True)


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def upsert_touched(spark: SparkSession, rows: DataFrame, path: str, key: str, order: str | None = None, buckets: int = 64) -> list[int]:
    """As ``upsert``, for a table in folders by a hash of the key: only folders that get rows are read and replaced. Gives their numbers.

    Creates the table where there is none (``buckets`` must stay as they are then). Columns that the table
    has not are dropped. The merged rows are stored apart before they replace the folders; as the same call
    again changes nothing, a run that was lost is simply repeated.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    new = _bucketed(rows, key, buckets)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        first = merged(new.limit(0), new, key, order).drop(*[c for c in [order] if c])
        first.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return list(range(buckets))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if touched:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        whole = folders.stored(merged(old, new, key, order), "merged")
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def merged_payload(old, new):
    """A map after a partial update: the new keys replace the old ones, and keys whose value is null or empty go. Null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    o, n = (F.coalesce(F.col(c) if isinstance(c, str) else c, none) for c in (old, new))
    kept = F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k))
    return F.map_filter(F.map_concat(kept, n), lambda k, v: F.coalesce(v, F.lit("")) != "")


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """The same rows; an empty index is an error that says so."""
    if df.isEmpty():
        raise ValueError(f"{name} holds no points; index the documents first")
    return df


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object to a line."""
    df.write.mode(mode).json(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Likes and dislikes only."""
    write_lines(feedback.where("type in ('like', 'dislike')").select("type", "question", "answer"), path, "append")


def cache_rows(answers: DataFrame, now, ttl_seconds: int = 86400) -> DataFrame:
    """Rows of the result cache: key (md5 of the lower-cased, stripped message), answer, expires_at."""
    return answers.select(F.md5(X.strip(F.lower("message"))).alias("cache_key"), "answer", (now + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
