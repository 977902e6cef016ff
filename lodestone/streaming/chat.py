"""Structured Streaming: message source, token events, the workflow state machine, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dialogue, rules

ENVELOPE = "event string, status string, meta map<string,string>, data struct<timestamp:timestamp,user_uuid:string,chat_id:string,text:string,answered_to:long,role:string>"


def kafka_messages(spark: SparkSession, servers: str, topic: str, group: str = "llm-workers") -> DataFrame:
    """The raw values of a topic."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("kafka.group.id", group)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid messages, rejects) of a frame with a JSON ``value``: NEW_MESSAGE events with 1 to 1000 characters of text."""
    parsed = raw.withColumn("m", F.from_json("value", ENVELOPE))
    good = F.coalesce((F.col("m.event") == "NEW_MESSAGE") & rules.valid_message("m.data.text"), F.lit(False))
    return parsed.where(good).select("m.event", "m.meta", "m.data.*"), parsed.where(~good).select("value")


def workflow(messages: DataFrame, steps: dict[str, int], chat: str = "chat_id", order: str = "seq") -> DataFrame:
    """``dialogue.replay`` as a stateful operator: the state of a chat outlives the batch. messages have the columns of ``flags``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None, 0, None)
        rows = []
        for x in pd.concat(list(frames)).sort_values(order).itertuples():
            now, action = dialogue.advance(now, x, steps)
            rows.append((key[0], int(getattr(x, order)), action, now[0], now[1]))
        state.update(now)
        yield pd.DataFrame(rows, columns=[chat, "seq", "action", "active", "step"])

    kind = messages.schema[chat].dataType.simpleString()
    return messages.groupBy(chat).applyInPandasWithState(run, f"{chat} {kind}, seq long, action string, active string, step long", "active string, step long, suggested string", "append", GroupStateTimeout.NoTimeout)


def to_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str, chat: str = "chat_id"):
    """Events keyed by chat, the event's name as a header."""
    header = F.array(F.struct(F.lit("event_name").alias("key"), F.col("event").cast("binary").alias("value")))
    out = events.select(F.col(chat).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), header.alias("headers"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", "true").option("checkpointLocation", checkpoint)


def ndjson_tokens(raw: DataFrame) -> DataFrame:
    """Tokens of a line-by-line JSON stream (``value``): bad lines and empty tokens are skipped; kind is token, done or error."""
    m = F.from_json("value", "response string, done boolean, error string")
    rows = raw.withColumn("m", m).where("m is not null")
    kind = F.when(F.col("m.error").isNotNull(), "error").when(F.coalesce(F.col("m.done"), F.lit(False)), "done").otherwise("token")
    return rows.select(kind.alias("kind"), F.coalesce("m.error", "m.response").alias("data")).where("kind <> 'token' or coalesce(data, '') <> ''")
