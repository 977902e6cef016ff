"""Takes new chat messages from a growing folder, checks and routes each, and files them by queue.

    python -m jobs.chat_stream --messages FOLDER --out OUT --checkpoint CHECKPOINT [--config chat_stream.json]

FOLDER may be a pattern. A file stream with ``availableNow``: each run takes the files that came since the last one and ends. Writes
``messages`` (Parquet, folders by epoch and queue) and ``totals`` (Parquet, folders by epoch: messages and
characters by queue and role) below OUT.

An epoch's rows stand in folders of its number, and writing an epoch replaces just these. So a run that was
lost after writing and before its checkpoint was committed is repeated without a row too many.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lodestone.operators import rules
from lodestone.sources import folders

log = logging.getLogger("chat_stream")
DEFAULTS = json.loads(Path(__file__).with_suffix(".json").read_text())


def routed(messages: DataFrame, config: dict) -> DataFrame:
    """conv_id, turn, role, text with category, score and the queue: rejected, blocked, operator, a category or general."""
    top = rules.best("text", config["routes"], least=config["least_score"])
    queue = (
        F.when(~rules.valid_message("text"), "rejected")
        .when(rules.offensive("text", config["offensive"]), "blocked")
        .when(rules.asks_operator("text", config["operator_words"], config["operator_phrases"]), "operator")
        .otherwise(F.coalesce(top.getField("name"), F.lit("general")))
    )
    return messages.select("conv_id", "turn", "role", "text", top.getField("name").alias("category"), F.coalesce(top.getField("score"), F.lit(0)).cast("long").alias("score"), queue.alias("queue"))


def write_epoch(rows: DataFrame, epoch: int, out: str) -> None:
    """Replaces the epoch's folders; the same call again changes nothing."""
    spark, seen = rows.sparkSession, Observation(f"epoch_{epoch}")
    replaced = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", *by)
    kept = rows.withColumn("epoch", F.lit(epoch).cast("long")).observe(seen, F.count("*").alias("messages"), F.count_if(F.col("queue") == "rejected").alias("rejected"))
    replaced(kept, "queue").parquet(f"{out}/messages")
    log.info("epoch %s: wrote %s to %s/messages", epoch, seen.get, out)
    if not seen.get["messages"]:
        return
    # from what was just written, so that the stream's input is read once
    written = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema if f.name != 'queue')}, epoch long, queue string").parquet(f"{out}/messages")
    totals = written.where(F.col("epoch") == epoch).groupBy("epoch", "queue", "role").agg(F.count("*").alias("messages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    replaced(totals.coalesce(1)).parquet(f"{out}/totals")


def run(spark: SparkSession, messages: str, out: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes what is new and waits for the end; the number of epochs that this run wrote."""
    config = DEFAULTS | (config or {})
    epochs = []

    def sink(rows: DataFrame, epoch: int) -> None:
        write_epoch(routed(rows, config), epoch, out)
        epochs.append(epoch)

    new = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(messages)
    query = new.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %s rows in %s epochs", messages, sum(p.numInputRows for p in query.recentProgress), len(epochs))
    return len(epochs)


def output(spark: SparkSession, out: str) -> DataFrame:
    """All messages filed so far."""
    return spark.read.option("mergeSchema", "false").parquet(f"{out}/messages")


def job2_chat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages after two runs into one new folder; the second finds nothing new."""
    out = folders.new_folder(spark, "chat-stream")
    for _ in range(2):  # a stream's path is a folder or a pattern, and the table may be one file
        run(spark, f"{sf_dir}/conversations.parque[t]", f"{out}/out", f"{out}/checkpoint")
    return output(spark, f"{out}/out").select("conv_id", "turn", "role", F.md5("text").alias("md5"), "category", "score", F.col("queue").cast("string").alias("queue"))


def job2_sql() -> str:
    from lodestone.plans import oracles as O

    c, low = DEFAULTS, "lower(trim(coalesce(text, '')))"
    quoted = ", ".join(f"'{w}'" for w in c["operator_words"])
    return f"""WITH {O._best(c["routes"], least=c["least_score"])}
SELECT conv_id, turn, role, md5(text) AS md5, name AS category, coalesce(score, 0)::BIGINT AS score,
  CASE WHEN NOT coalesce(length(text) BETWEEN 1 AND 1000, false) THEN 'rejected' WHEN {O._whole(c["offensive"])} THEN 'blocked'
    WHEN {low} IN ({quoted}) OR {O._any(c["operator_phrases"], low)} THEN 'operator' ELSE coalesce(name, 'general') END AS queue
FROM conversations LEFT JOIN best USING (conv_id, turn)"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("messages", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file; its values replace those of chat_stream.json")
    x = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("chat_stream").getOrCreate()
    try:
        run(spark, x.messages, x.out, x.checkpoint, json.loads(Path(x.config).read_text()) if x.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
