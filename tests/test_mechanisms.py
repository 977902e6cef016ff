"""Automata, page trees, quantiles, folds and records against plain Python."""

import json
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import pages
from lodestone.operators import automaton, dialogue, quantiles, rules
from lodestone.sources import readers, writers


def test_exact_quantiles(spark):
    r = random.Random(4)
    groups = {"a": [r.gauss(0, 1e6) for _ in range(700)], "b": [3.0] * 400 + [r.random() for _ in range(50)], None: [-1e308, 1e308, 0.0], "one": [7.5], "two": [1.0, 2.0], "neg": [-float(i) for i in range(33)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("gone", None), ("b", float("inf"))]
    r.shuffle(rows)
    shares = [0.0, 0.013, 0.5, 0.95, 1.0]
    got = {(x.g, x.share): (x.quantile, x.n) for x in quantiles.exact(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g", shares).collect()}
    assert len(got) == len(groups) * len(shares)
    for (g, p), (q, n) in got.items():
        assert n == len(groups[g])
        if g is not None:
            assert q == pytest.approx(float(np.quantile(groups[g], p)), rel=1e-12, abs=1e-12)
    assert got[None, 0.5][0] == 0.0 and got[None, 1.0][0] == 1e308
    assert quantiles.exact(spark.createDataFrame([], "g string, v double"), "v", "g", shares).count() == 0


def test_merged_sketches_keep_their_rank(spark):
    df = spark.range(20_000).select(F.lit("x").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"))
    held = quantiles.sketches(df.where("v < 50000"), "v", "g").unionByName(quantiles.sketches(df.where("v >= 50000"), "v", "g"))
    one = held.groupBy("g").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    values = sorted(r.v for r in df.collect())
    for r in quantiles.of_sketches(one, "g", [0.1, 0.5, 0.9]).collect():
        assert abs(np.searchsorted(values, r.quantile) / len(values) - r.share) < 0.02 and r.quantile in values


WORDS = ["he", "she", "his", "hers", "a", "é_x", "of the", "the"]


def test_occurrences_equal_a_search_for_each_entry(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("hersia é_xofthe. ") for _ in range(r.randint(0, 80))) for _ in range(150)] + [None, "", "she", "ushers of the x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("entry", F.lit("clash")).repartition(3)
    entries = [*WORDS, "", "he"]
    for whole in (False, True):
        want = []
        for i, t in enumerate(texts):
            for k, w in enumerate(WORDS):
                pattern = rf"(?=(?<!\w){re.escape(w)}(?!\w))" if whole else rf"(?={re.escape(w)})"
                if n := len(re.findall(pattern, t or "")):
                    want.append((i, k, n))
        for block in (1 << 20, 100):  # one automaton, and several
            got = automaton.occurrences(df, "t", entries, whole, block)
            assert sorted(map(tuple, got.select("id", "entry", "times").where("entry < 8").collect())) == want
    assert automaton.occurrences(df, "t", []).count() == 0


def test_a_large_lexicon_takes_one_pass(spark):
    entries = [f"w{i}x" for i in range(100_000)]
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7919 + j * 101) % 120_000}x" for j in range(50))) for i in range(40)], "id long, t string")
    got = automaton.occurrences(df, "t", entries)
    assert got.groupBy("id").agg(F.sum("times").alias("n")).agg(F.sum("n")).first()[0] == sum((i * 7919 + j * 101) % 120_000 < 100_000 for i in range(40) for j in range(50))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_best_lists_equal_the_expression(spark):
    r = random.Random(2)
    lists = {"x": ["he", "of the"], "y": ["she", "he", "a"], "z": ["his"], "none": []}
    df = spark.createDataFrame([(i, " ".join(r.choice([*WORDS, "qq", "HE"]) for _ in range(r.randint(0, 6)))) for i in range(120)] + [(200, None)], "id long, t string")
    weight = lambda w: 3 if " " in w else 1
    extra = {"z": F.when(F.lower("t").contains("his") & F.lower("t").contains("qq"), 10).otherwise(0)}
    top = rules.best("t", lists, weight, extra, 2)
    want = {r.id: (r.n, r.s) for r in df.select("id", top.getField("name").alias("n"), top.getField("score").alias("s")).where("n is not null").collect()}
    got = {r.id: (r["name"], r.score) for r in automaton.best_lists(df, ["id"], "t", lists, weight, {"z": ["his", "qq"]}, 10, 2).collect()}
    assert got == want


class Tree(HTMLParser):
    """A plain tree of nodes, searched afterwards."""

    def __init__(self, html):
        super().__init__()
        self.root = self.at = {"tag": None, "attrs": {}, "up": None, "down": []}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        node = {"tag": tag, "attrs": given, "up": self.at, "down": []}
        self.at["down"].append(node)
        if tag not in pages.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in pages.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node["tag"] != tag:
            node = node["up"]
        if node is not None and node["up"] is not None:
            self.at = node["up"]

    def walk(self, node=None):
        for x in (node or self.root)["down"]:
            yield x
            yield from self.walk(x)


def by_tree(html, base):
    tree = Tree(html)
    nodes = list(tree.walk())
    tests = [lambda n: n["tag"] == "main", lambda n: n["tag"] == "article", lambda n: "content" in n["attrs"].get("class", "").split(), lambda n: "region-content" in n["attrs"].get("class", "").split()]
    box = next((n for t in tests for n in nodes if t(n) and n["tag"] not in pages.VOID), tree.root)
    out = []
    for n in tree.walk(box):
        src = n["tag"] == "img" and (n["attrs"].get("src") or n["attrs"].get("data-src"))
        if src and not any(d in src.lower() for d in ("icon", "logo", "badge", "avatar", "pixel", "counter", "svg")) and urljoin(base, src) not in out:
            out.append(urljoin(base, src))
    return out


def test_page_images_equal_a_search_of_the_tree(spark):
    r = random.Random(5)
    pieces = ["<main>", "</main>", "<article class=x>", "</article>", "<div class='a content'>", "<p class=region-content>", "</p>", "</div>", "<br>", "<img src=1.png>", "<img data-src='/2.png' />", "<IMG SRC='Logo.png'>", "<img>", "<img src='' data-src=3.png src=4.png>", "text &amp; ", "<!-- <img src=no.png> -->", "<li>", "</span>", "<script>'<img src=s.png>'</script>", "<img src=//h.example/5.png>"]
    docs = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(400)]
    base = "https://s.example/a/b?c"
    df = spark.createDataFrame([(i, d, base) for i, d in enumerate(docs)] + [(1000, None, base), (1001, "<img src=x.png>", None), (1002, "<img src=x.png>", "ftp://x/"), (1003, "", base)], "id long, html string, base string").withColumn("images", F.lit(1))
    got = {r.id: r.images for r in pages.container_images(df, "html", "base").collect()}
    assert [got[i] for i in range(400)] == [by_tree(d, base) for d in docs]
    assert got[1000] == got[1001] == got[1002] == got[1003] == []


def test_a_long_chat_is_folded_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        n = 30_000
        df = spark.range(n).select((F.col("id") % 7 == 0).cast("long").alias("chat"), F.col("id").alias("seq"), (F.col("id") % 97 == 5).alias("escalate"), (F.col("id") % 3 == 1).alias("agree"), (F.col("id") % 5 == 2).alias("next"), (F.col("id") % 41 == 0).alias("stop"), F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), (F.col("id") % 3 + 1).cast("int")).alias("node"))
        steps = {"u": 3, "v": 0}
        got = [tuple(r) for r in dialogue.replay_sorted(df, "chat", "seq", steps).orderBy("chat", "seq").collect()]
        want = []
        for c in (0, 1):
            state = (None, 0, None)
            for r in df.where(F.col("chat") == c).orderBy("seq").collect():
                state, action = dialogue.advance(state, r, steps)
                want.append((c, r.seq, action, state[0], state[1]))
        assert got == want and len(got) == n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_records_of_any_shape(spark, tmp_path):
    shapes = {"a.json": '[{"t": 1}, 5, null, {"t": 2, "x": {"y": [1]}}]', "sub/c.jsonl": '{"t": 3}\r\nnoise\n[1]\n\n{"t": "4"}', "b.json": ' {"t": 5}\n', "d.json": "", "e.json": "null", "f.json": "[]", "z.txt": '{"t": 9}'}
    (tmp_path / "sub").mkdir()
    for name, body in shapes.items():
        (tmp_path / name).write_text(body)
    got = readers.directory_records(spark, str(tmp_path)).select("file", "place", F.to_json("record").alias("r")).orderBy("file", "place").collect()
    assert [(r.file, r.place, json.loads(r.r)) for r in got] == [("a.json", 1, {"t": 1}), ("a.json", 2, {"t": 2, "x": {"y": [1]}}), ("b.json", 1, {"t": 5}), ("c.jsonl", 1, {"t": 3}), ("c.jsonl", 2, {"t": "4"})]
    assert sorted(r.t for r in readers.json_records(spark, str(tmp_path / "a.json"), "t long").collect()) == [1, 2]
    rows = spark.createDataFrame([(1, None, "k"), (2, '{"a": 1}', "l")], "id long, s string, record string")
    assert [(r.id, r.j) for r in readers.records(rows, "s").select("id", F.to_json("record").alias("j")).collect()] == [(2, '{"a":1}')]


def test_payloads(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "e": ""}, {"b": "3", "c": None, "a": ""}), (None, {"x": "y"}), ({"k": "v"}, None)], "o map<string,string>, n map<string,string>")
    assert [r.m for r in df.select(writers.merged_payload("o", "n").alias("m")).collect()] == [{"b": "3"}, {"x": "y"}, {"k": "v"}]
