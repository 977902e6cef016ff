"""Answer assembly: context, citations, links, fallback text, history, cache.

The headings and sentences of node answers, node contexts and fallbacks are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.text import col, strip


def context(hits: DataFrame, query: str, order: str, title: str, section: str, text: str) -> DataFrame:
    """Each query's hits, in order, as ``### title (section)`` blocks with a blank line between."""
    block = F.concat(F.lit("### "), F.col(title), F.lit(" ("), F.col(section), F.lit(")\n"), F.col(text))
    rows = hits.select(query, F.struct(F.col(order).alias("o"), block.alias("b")).alias("s")).groupBy(query).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(query, F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("context"))


def cache_items(hits: DataFrame, query: str, order: str, keep: list[str], text: str, items: int = 6) -> DataFrame:
    """What a chat keeps of each query's first hits: ``keep`` and the first 500 characters of the text."""
    by = Window.partitionBy(query).orderBy(order)
    first = hits.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= items)
    return first.select(query, order, *keep, F.substring(text, 1, 500).alias(text))


def citations(hits: DataFrame, query: str, url: str, order: str) -> DataFrame:
    """The first hit of each address of a query; those without address are left out."""
    by = Window.partitionBy(query, url).orderBy(order)
    return hits.where(F.coalesce(F.col(url), F.lit("")) != "").withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def history(messages: DataFrame, chat: str, order: str, first: int = 2, last: int = 5) -> DataFrame:
    """The messages before the newest, ``first`` to ``last`` counted from the end."""
    by = Window.partitionBy(chat).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(by).cast("long")).where(F.col("back").between(first, last))


def plain_names(answer, banned: str, instead: str) -> Column:
    """Words that begin with a banned name, in any case, become another name."""
    return F.regexp_replace(col(answer), rf"(?iU){banned}\w*", instead)


def sanitized(answer, valid, portal: str, banned: str, instead: str) -> Column:
    """Banned names replaced, links canonical, and those that are then not among the valid ones (array, canonical too) down to their label."""
    canonical = F.transform(col(valid), lambda u: X.canonical_url(u, portal))
    return known_links(X.rewrite_links(plain_names(answer, banned, instead), portal), canonical)


def known_links(answer, valid) -> Column:
    """Markdown links to addresses that are not in ``valid`` (array) become their label."""
    links = F.regexp_extract_all(col(answer), F.lit(r"\[[^\]]+\]\(https?://[^)]+\)"), 0)
    unknown = F.filter(links, lambda x: ~F.array_contains(col(valid), F.regexp_extract(x, r"\((.*)\)$", 1)))
    return F.aggregate(unknown, col(answer), lambda s, x: F.replace(s, x, F.regexp_extract(x, r"^\[([^\]]+)\]", 1)))


def with_source(answer, source_title, source_url, heading: str = "Источник") -> Column:
    """Without a source block at the end, and with the canonical source instead."""
    body = strip(F.regexp_replace(col(answer), rf"(?isU)\n+\W*{heading}\w*\W*:.*$", ""))
    return F.when(F.coalesce(col(source_url), F.lit("")) != "", F.concat(body, F.lit(f"\n\n{heading}: ["), col(source_title), F.lit("]("), col(source_url), F.lit(")"))).otherwise(body)


def invalid_answer(answer) -> Column:
    return F.length(strip(F.coalesce(col(answer), F.lit("")))) < 20


def fallback_answer(text, lines: int = 6) -> Column:
    """The first lines of a text that are not blank."""
    kept = F.filter(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.slice(kept, 1, lines), "\n")


def node_answer(node) -> Column:
    """What a workflow node (struct with title, law_references, channel, fee, deadlines, workflow_steps) answers by itself; null without a node."""
    n = col(node)
    lines = lambda f, mark: F.array_join(F.transform(n.getField(f), mark), "\n")
    parts = [
        F.concat(F.lit("### "), n.getField("title")),
        F.concat(F.lit("**Нормативное регулирование:** "), F.array_join(n.getField("law_references"), ", ")),
        F.concat(F.lit("**Способ подачи:** "), n.getField("channel")),
        F.concat(F.lit("**Стоимость:** "), n.getField("fee")),
        F.concat(F.lit("**Регламентные сроки:**\n"), lines("deadlines", lambda d: F.concat(F.lit("• "), d))),
        F.concat(F.lit("**Пошаговый порядок действий:**\n"), lines("workflow_steps", lambda s, i: F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(".** "), s))),
    ]
    return F.when(n.isNotNull(), F.concat_ws("\n\n", *parts))


def fallback(node, source_title, text) -> Column:
    """The node's answer, else the first lines of the best hit under its title."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), strip), lambda x: x != ""), 1, 6)
    found = F.concat(F.lit("По вашему вопросу найдена официальная инструкция:\n\n📌 **"), col(source_title), F.lit("**\n\n"), F.array_join(lines, "\n\n"))
    return F.coalesce(node_answer(node), F.when(col(text).isNotNull(), found))


def offer_once(answer, offer: str) -> Column:
    return F.when(col(answer).contains(offer), col(answer)).otherwise(F.concat(col(answer), F.lit("\n\n" + offer)))


def cache_key(message) -> Column:
    return F.md5(X.strip(F.lower(col(message))))


def cached(requests: DataFrame, cache: DataFrame, message: str, at: str, order: str = "expires_at") -> DataFrame:
    """Requests with the answer that was cached for the same message and has not expired; cache: cache_key, answer, expires_at.

    Of several rows of a key the last by ``order`` counts, also where it has expired: it has replaced the others.
    """
    last = cache.groupBy("cache_key").agg(F.max(F.struct(F.col(order).alias("o"), "expires_at", "answer")).alias("c")).select("cache_key", "c.answer", "c.expires_at")
    live = requests.withColumn("cache_key", cache_key(message)).join(last, "cache_key", "left")
    fresh = F.col("expires_at") > F.col(at)
    return live.withColumn("hit", F.coalesce(fresh, F.lit(False))).withColumn("answer", F.when(fresh, F.col("answer"))).drop("expires_at")


def least_loaded(agents: DataFrame, chats: DataFrame, agent: str, assigned: str) -> DataFrame:
    """Agents with their numbers of chats, least first; equal loads by agent."""
    load = chats.groupBy(F.col(assigned).alias("__a")).agg(F.count("*").alias("__n"))
    return agents.join(load, F.col(agent) == F.col("__a"), "left").select(agent, F.coalesce("__n", F.lit(0)).cast("long").alias("active_chats"))


def assigned(agents: DataFrame, chats: DataFrame, agent: str, owner: str, spare: int = 0) -> DataFrame:
    """The one agent who takes an escalated chat: the least loaded, by number among equals; without agents the spare one is created."""
    first = least_loaded(agents, chats, agent, owner).orderBy("active_chats", agent).limit(1)
    new = agents.sparkSession.createDataFrame([(spare, 0, True)], f"{agent} {agents.schema[agent].dataType.simpleString()}, active_chats long, created boolean")
    both = first.withColumn("created", F.lit(False)).unionByName(new)
    return both.orderBy("created").limit(1)


def updated(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """State after a batch of partial updates: a field takes the last value that is not null.

    Updates of one key are applied by ``order``; without it a key must not repeat. Keys that are new are added.
    """
    fields = [c for c in old.columns if c != key and c in new.columns]
    if order is not None:
        last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("x")))).getField("x").alias(f"__{c}")
        n = new.groupBy(key).agg(*[last(c) for c in fields])
    else:
        n = new.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    met = old.join(n, key, "full_outer")
    return met.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns if c != key])


def prompt(question, past, found) -> Column:
    """What goes to a model: history (if any), context and question, each under its heading."""
    part = lambda head, c: F.when(F.coalesce(col(c), F.lit("")) != "", F.concat(F.lit(f"### {head}\n"), col(c)))
    return F.concat_ws("\n\n", part("History", past), part("Context", found), part("Question", question))


def node_context(node) -> Column:
    """A workflow node (struct with title, law_references, channel, fee, deadlines, workflow_steps, effects) as context for a model; null gives nothing, null effects no line."""
    n = col(node)
    lines = lambda f, mark: F.transform(n.getField(f), lambda x: F.concat(F.lit(mark), x))
    parts = F.concat(
        F.array(
            F.concat(F.lit("=== ГРАФОВЫЙ БЛОК ЗНАНИЙ: "), n.getField("title"), F.lit(" ===")),
            F.concat(F.lit("Нормативная база: "), F.array_join(n.getField("law_references"), ", ")),
            F.concat(F.lit("Способ и канал подачи: "), n.getField("channel")),
            F.concat(F.lit("Финансовые условия: "), n.getField("fee")),
            F.lit("Регламентные сроки:"),
        ),
        lines("deadlines", "  • "),
        F.array(F.lit("Пошаговый регламент:")),
        lines("workflow_steps", "  "),
        F.array_compact(F.array(F.concat(F.lit("Правовые последствия: "), n.getField("effects")), F.lit("=" * 42))),
    )
    return F.when(n.isNotNull(), F.array_join(parts, "\n")).otherwise("")


def with_roles(messages: DataFrame, users: DataFrame, author: str, user: str, role: str) -> DataFrame:
    """Messages with their authors' roles; messages of unknown authors are left out. AQE broadcasts users where they are few."""
    return messages.join(users.select(F.col(user).alias("__u"), role), F.col(author) == F.col("__u")).drop("__u")
