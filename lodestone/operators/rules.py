"""Lexicon rules over messages: guardrail, routing, workflow nodes, triggers. No joins: small lexicons become expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from ..functions import lexicon
from ..functions.text import col


def _hits(text: Column, words: list[str], weight=lambda w: 1) -> Column:
    return reduce(add, [F.when(text.contains(w), weight(w)).otherwise(0) for w in words], F.lit(0))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words], F.lit(False))


def offensive(message, patterns=lexicon.OFFENSIVE) -> Column:
    """Does a whole word match one of the patterns, in any case?"""
    return F.coalesce(col(message).rlike("|".join(rf"(?iU)\b({p})\b" for p in patterns)), F.lit(False))


def guardrail(message, patterns=lexicon.OFFENSIVE) -> Column:
    """struct<is_blocked, reason>."""
    bad = offensive(message, patterns)
    return F.struct(bad.alias("is_blocked"), F.when(bad, "toxicity").alias("reason"))


def best(message, lists: dict[str, list[str]], weight=lambda w: 1, extra: dict[str, Column] | None = None, least: int = 1) -> Column:
    """struct<name, score>: the list with the largest sum of weights of contained entries; the first of equals; null below ``least``."""
    text = F.lower(F.coalesce(col(message), F.lit("")))
    scores = [(name, _hits(text, words, weight) + (extra or {}).get(name, F.lit(0))) for name, words in lists.items()]
    rows = F.array(*[F.struct(s.cast("long").alias("score"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores)])
    top = F.array_max(rows)
    return F.when(top.getField("score") >= least, F.struct(top.getField("name").alias("name"), top.getField("score").alias("score")))


def route(message, lists=lexicon.ROUTES, lines=lexicon.LINES) -> Column:
    """struct<line, name, category_filter, badge_color, score> of a message; the legal category is resolved by the statute's number."""
    text = F.lower(F.coalesce(col(message), F.lit("")))
    legal = F.when(text.contains("44"), "44fz").when(text.contains("223"), "223fz").otherwise("legislation")
    pairs = lambda values: F.create_map(*[F.lit(v) for p in values.items() for v in p])
    by_name, names = {k: v for k, v in lines.items() if k is not None}, pairs(lexicon.LINE_NAMES)

    def told(top: Column) -> Column:
        name = top.getField("name")
        line, badge = (F.coalesce(pairs({k: v[i] for k, v in by_name.items()})[name], F.lit(lines[None][i])) for i in (0, 1))
        return F.struct(line.alias("line"), names[line].alias("name"), F.when(name == "legal", legal).otherwise(name).alias("category_filter"), badge.alias("badge_color"), F.coalesce(top.getField("score"), F.lit(0).cast("long")).alias("score"))

    return F.transform(F.array(best(message, lists)), told)[0]  # so that the best list is found once


def graph_node(message, nodes=lexicon.NODES, bonus: dict[str, list[str]] | None = None) -> Column:
    """struct<name, score> of the workflow node: phrases weigh 3, words 1, a node whose bonus words all occur 10 more; null below 2."""
    bonus = {"fas_complaint_44fz": ["фас", "жалоб"]} if bonus is None else bonus
    text = F.lower(F.coalesce(col(message), F.lit("")))
    extra = {k: F.when(reduce(lambda a, b: a & b, [text.contains(w) for w in ws]), 10).otherwise(0) for k, ws in bonus.items()}
    return best(message, nodes, lambda w: 3 if " " in w else 1, extra, least=2)


def category(message, lists=lexicon.CATEGORIES) -> Column:
    return best(message, lists).getField("name")


def asks_operator(message, words=lexicon.OPERATOR_WORDS, phrases=lexicon.OPERATOR_PHRASES) -> Column:
    text = F.lower(F.trim(F.coalesce(col(message), F.lit(""))))
    return text.isin(words) | _any(text, phrases)


def agrees(message, words=lexicon.AGREE) -> Column:
    """The message begins with one of the words, as a prefix of any length."""
    text = F.lower(F.trim(F.coalesce(col(message), F.lit(""))))
    return reduce(or_, [text.startswith(w) for w in words], F.lit(False))


def contains_any(message, words: list[str]) -> Column:
    return _any(F.lower(F.trim(F.coalesce(col(message), F.lit("")))), words)


def relevant(message, cached, least: int = 2, length: int = 3) -> Column:
    """Do at least ``least`` of the message's words of more than ``length`` characters occur in the cached text?"""
    words = F.filter(F.split(F.lower(F.coalesce(col(message), F.lit(""))), r"\s+"), lambda w: (F.length(w) > length) & F.lower(col(cached)).contains(w))
    return F.coalesce(F.size(words) >= least, F.lit(False))


def valid_message(text, least: int = 1, most: int = 1000) -> Column:
    return F.coalesce(F.length(col(text)).between(least, most), F.lit(False))
