"""The per-chat workflow state machine, over ordered messages in one expression, and token events."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon
from ..functions.text import col
from . import rules

_Flags = namedtuple("_Flags", ["escalate", "agree", "next", "stop", "node"])

# What a message does: escalate, start, stop, step, finish, missing (the workflow has no steps), answer.
_STATE = "struct<active:string,step:long,suggested:string,log:array<struct<seq:long,action:string,active:string,step:long>>>"
_ACTION = """case when x.escalate then 'escalate'
  when x.agree and s.active is null and s.suggested is not null then if(steps[s.suggested] is null, 'missing', if(steps[s.suggested] <= 0, 'finish', 'start'))
  when s.active is not null and x.stop then 'stop'
  when s.active is not null and (x.next or x.agree) then if(steps[s.active] is null, 'missing', if(s.step >= steps[s.active], 'finish', 'step'))
  else 'answer' end"""
_FOLD = f"""
aggregate(messages, cast(named_struct('active', null, 'step', 0L, 'suggested', null, 'log', array()) as {_STATE}),
  (s, x) -> transform(array(named_struct('a', {_ACTION}, 'opens', not x.escalate and x.agree and s.active is null and s.suggested is not null)), d ->
    named_struct(
      'active', case when d.opens then s.suggested when d.a in ('stop', 'finish', 'missing') then null else s.active end,
      'step', case when d.a = 'start' then 1L when d.a = 'step' then s.step + 1 when d.a = 'stop' or d.opens then 0L when d.a = 'finish' then steps[s.active] else s.step end,
      'suggested', if(d.a = 'answer', x.node, s.suggested),
      'log', concat(s.log, array(named_struct('seq', x.seq, 'action', d.a,
         'active', case when d.opens then s.suggested when d.a in ('stop', 'finish', 'missing') then null else s.active end,
         'step', case when d.a = 'start' then 1L when d.a = 'step' then s.step + 1 when d.a = 'stop' or d.opens then 0L when d.a = 'finish' then steps[s.active] else s.step end)))))[0])
"""


def flags(messages: DataFrame, text: str, lexicons: dict | None = None) -> DataFrame:
    """Adds escalate, agree, next, stop and node (the workflow that an answer suggests)."""
    x = {"offensive": lexicon.OFFENSIVE, "words": lexicon.OPERATOR_WORDS, "phrases": lexicon.OPERATOR_PHRASES, "agree": lexicon.AGREE, "next": lexicon.NEXT, "stop": lexicon.STOP, "nodes": lexicon.NODES, "bonus": None} | (lexicons or {})
    node = F.coalesce(rules.graph_node(text, x["nodes"], x["bonus"]).getField("name"), F.lit("general_guide"))
    return messages.withColumns(
        {
            "escalate": rules.asks_operator(text, x["words"], x["phrases"]) | rules.offensive(text, x["offensive"]),
            "agree": rules.agrees(text, x["agree"]),
            "next": rules.contains_any(text, x["next"]),
            "stop": rules.contains_any(text, x["stop"]),
            "node": node,
        }
    )


def step_map(steps: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for k, n in steps.items() for v in (k, n)]).cast("map<string,bigint>")


def replay(messages: DataFrame, chat: str, order: str, steps: dict[str, int]) -> DataFrame:
    """What each message of each chat does: chat, seq, action, active workflow and step after it.

    messages have the columns of ``flags``; steps: the number of steps of each workflow. A chat's messages
    are folded in order, as the state of a message needs all before it.
    """
    one = F.struct(F.col(order).cast("long").alias("seq"), "escalate", "agree", "next", "stop", "node")
    chats = messages.groupBy(chat).agg(F.array_sort(F.collect_list(one)).alias("messages")).withColumn("steps", step_map(steps))
    return chats.select(chat, F.explode(F.expr(_FOLD).getField("log")).alias("l")).select(chat, "l.*")


def replay_sorted(messages: DataFrame, chat: str, order: str, steps: dict[str, int]) -> DataFrame:
    """As ``replay``, for chats of any length: messages are sorted by chat and order, and a task goes over them once.

    The state of the chat at hand is all that is kept; it is carried from one batch to the next. A chat's
    messages are in one task, as each needs the state before it, but never in memory together.
    """
    names = ["escalate", "agree", "next", "stop", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), (None, 0, None)
        for batch in batches:
            out = []
            for key, seq, *flags in zip(*[batch.column(c).to_pylist() for c in ("__chat", "__seq", *names)], strict=True):
                if key != at:
                    at, state = key, (None, 0, None)
                state, action = advance(state, _Flags(*flags), steps)
                out.append((seq, action, state[0], state[1]))
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("__chat"), *columns], [chat, "seq", "action", "active", "step"])

    rows = messages.select(F.col(chat).alias("__chat"), F.col(order).cast("long").alias("__seq"), *names)
    dealt = rows.repartition("__chat").sortWithinPartitions("__chat", "__seq")
    return dealt.mapInArrow(run, f"{chat} {messages.schema[chat].dataType.simpleString()}, seq long, action string, active string, step long")


def step_reply(title, steps, step) -> Column:
    """struct<reply, is_finished, next_step>: the text of the step (from 0) of a workflow with its progress; null steps are an unknown workflow."""
    n, s = F.size(col(steps)), col(step).cast("int")
    after = s + 1
    go_on = F.when(after < n, "\n\nКогда будете готовы перейти к следующему действию, напишите **«Далее»** или **«Готово»**.").otherwise("\n\nЭто финальный шаг регламента. Напишите **«Завершить»** или задайте уточняющий вопрос.")
    body = F.concat(F.lit("📋 **"), col(title), F.lit("** (Шаг "), after.cast("string"), F.lit(" из "), n.cast("string"), F.lit(")\n\n"), F.element_at(col(steps), after), go_on)
    done = F.concat(F.lit("🎉 **Отлично! Все шаги процесса «"), col(title), F.lit("» успешно пройдены.**\nЕсли у вас есть ещё вопросы или нужно уточнить детали по какому-либо шагу, я готов помочь!"))
    known, over = col(steps).isNotNull(), s >= n
    reply = F.when(~known, "Данный процесс не найден в базе пошаговых инструкций.").when(over, done).otherwise(body)
    return F.struct(reply.alias("reply"), (~known | over).alias("is_finished"), F.when(~known, s).when(over, n).otherwise(after).alias("next_step"))


def advance(state: tuple, x, steps: dict[str, int]) -> tuple[tuple, str]:
    """One message: (active, step, suggested) and flags to the next state and the action. The stream's form of ``replay``."""
    active, step, suggested = state
    if x.escalate:
        return state, "escalate"
    if x.agree and active is None and suggested is not None:
        total = steps.get(suggested)
        if total is None:
            return (suggested, 0, suggested), "missing"
        return (suggested, 1 if total > 0 else 0, suggested), "start" if total > 0 else "finish"
    if active is not None and x.stop:
        return (None, 0, suggested), "stop"
    if active is not None and (x.next or x.agree):
        total = steps.get(active)
        if total is None:
            return (None, step, suggested), "missing"
        return ((None, total, suggested), "finish") if step >= total else ((active, step + 1, suggested), "step")
    return (active, step, x.node), "answer"


def token_events(messages: DataFrame, chat: str, key: str, text: str, error: str | None = None, redirect: str | None = None) -> DataFrame:
    """NEW_TOKEN events with ids from 0 and one END_GENERATION event with the whole text for each message.

    Stateless, so it runs alike on tables and streams. A message with an error gives the error's text as
    token 0 and an END with meta error; one that is redirected gives only an END.
    """
    body = F.coalesce(F.col(text), F.lit("")) if error is None else F.coalesce(F.col(error), F.col(text), F.lit(""))
    failed = F.lit(False) if error is None else F.col(error).isNotNull()
    sent = F.lit(False) if redirect is None else F.coalesce(F.col(redirect), F.lit(False))
    pieces = F.when(sent, F.array().cast("array<string>")).when(failed, F.array(body)).otherwise(F.filter(F.split(body, r"(?<=\s)"), lambda x: x != ""))
    end = F.struct(F.size(pieces).cast("long").alias("id"), F.lit("END_GENERATION").alias("event"), F.when(sent, "").otherwise(body).alias("token"), F.when(sent, "redirected").when(failed, "Error").otherwise("Done").alias("details"))
    events = F.concat(F.transform(pieces, lambda x, i: F.struct(i.cast("long").alias("id"), F.lit("NEW_TOKEN").alias("event"), x.alias("token"), F.lit(None).cast("string").alias("details"))), F.array(end))
    return messages.select(chat, key, F.explode(events).alias("e")).select(chat, key, "e.*")


def assembled(events: DataFrame, *keys: str) -> DataFrame:
    """The tokens of each message, in order, as one text."""
    tokens = events.where("event = 'NEW_TOKEN'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("t"))
    return tokens.select(*keys, F.size("t").cast("long").alias("n_tokens"), F.array_join(F.transform("t", lambda x: x["token"]), "").alias("all_text"))
