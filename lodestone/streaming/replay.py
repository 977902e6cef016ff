"""Tables as streams: rows dealt into files that arrive in order, streams run to their end, and a sink that may repeat an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import writers


def deal(df: DataFrame, by: str, batches: int, path: str) -> None:
    """Writes the rows as ``batches`` generations of files, in ascending order of a number; equal numbers stay together."""
    cuts = [c for c in dict.fromkeys(df.approxQuantile(by, [i / batches for i in range(1, batches)], 0.001))]
    low = None
    for high in [*cuts, None]:
        some = df if low is None else df.where(F.col(by) > low)
        some = some if high is None else some.where(F.col(by) <= high)
        some.repartition(1).write.mode("append").parquet(path)
        low = high


def arriving(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """The files of a folder as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Appends all that has arrived to Parquet files and ends; the number of batches."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def merging(path: str, key: str, order: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: the table at ``path`` keeps each key's last row by ``order``.

    What an epoch merges depends on its rows only, and a row that is already there replaces itself: an epoch
    that is run again, after a loss between its write and its commit, changes nothing.
    """

    def sink(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        new = rows.withColumn("__order", F.col(order))
        if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
            known = spark.read.parquet(path).drop("bucket")
            met = new.join(known.select(F.col(key).alias("__key"), F.col(order).alias("__known")), F.col(key) == F.col("__key"), "left")
            new = met.where("__known is null or __order >= __known").drop("__key", "__known")
        writers.upsert_touched(spark, new, path, key, "__order", buckets)

    return sink


def merge(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 16) -> int:
    """Merges all that has arrived into the table at ``path`` and ends; the number of batches."""
    query = stream.writeStream.foreachBatch(merging(path, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)
