import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.functions import chunking as K, text as X
from lodestone.operators import rules

PORTAL = "https://portal.example"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "value, want",
    [
        ("вход в ЛК – «тест»  по 44 фз!!!", 'вход в ЛК - "тест" по 44-ФЗ!'),
        ("Ёлка.....", "Елка..."),
        ("223–ФЗ и 135фз, 144фз", "223-ФЗ и 135-ФЗ, 144фз"),
        ("  ??  ", "?"),
    ],
)
def test_normalize(spark, value, want):
    assert one(spark, X.normalize_basic("x"), value) == want


def test_terms(spark):
    got = one(spark, X.expand_terms("x"), "Как войти в ЛК и лк, а ЛКА нет; ЭП и УПД")
    assert got == "Как войти в личный кабинет (ЛК) и личный кабинет (лк), а ЛКА нет; электронная подпись (ЭП) и универсальный передаточный документ (УПД)"
    assert one(spark, X.present_terms("x"), "эп ГК РФ") == ["ГК РФ", "ЭП"]
    assert one(spark, X.search_query("x"), " ЛК ") == "search_query: личный кабинет (ЛК)"


@pytest.mark.parametrize(
    "value, want",
    [
        (None, f"{PORTAL}/knowledgebase/main"),
        ("", f"{PORTAL}/knowledgebase/main"),
        (f' "{PORTAL}/knowledgebase/article/details/123" ', f"{PORTAL}/knowledgebase/article/details/ais/123"),
        (f"{PORTAL}/knowledgebase/article/506376).", f"{PORTAL}/knowledgebase/article/details/ais/506376"),
        (f"{PORTAL}/knowledgebase/article/details/48caq6vpp4pn97wbaxsf", f"{PORTAL}/knowledgebase/article/details/cms/48caq6vpp4pn97wbaxsf"),
        (f"{PORTAL}/knowledgebase/regulations", f"{PORTAL}/knowledgebase/article/regulation/cms"),
        (f"{PORTAL}/cms/Media/docs/a_b%20c.pdf", f"{PORTAL}/cms/Media/docs/a%20b%20c.pdf"),
        (f"{PORTAL}/", f"{PORTAL}/knowledgebase/main"),
        ("http://portal.example/x", f"{PORTAL}/x"),
        ("https://other.example/y,", "https://other.example/y"),
    ],
)
def test_canonical_url(spark, value, want):
    assert one(spark, X.canonical_url("x", PORTAL), value) == want


def test_small_functions(spark):
    assert one(spark, X.step_number("x"), "сделайте ШАГ 2.1 потом") == "Шаг 2.1"
    assert one(spark, X.step_number("x"), "подшаг") is None
    assert one(spark, X.image_links("x"), "![a](i.png) <IMG src='j.png'> ![](data:x) ![b](i.png)") == ["i.png", "j.png"]
    assert one(spark, X.page_images("x", F.lit("https://s.example/a/b")), '<img src="/x.png"><img data-src="y.png"><img src="logo.png">') == ["https://s.example/x.png", "https://s.example/a/y.png"]
    assert one(spark, X.clean_html("x"), "<p>a</p>\n\n<b>c") == "a\nc"
    assert one(spark, K.html_text("x"), "<p>a &amp; b</p><script>x</script>") == "a & b"
    assert one(spark, K.nfkc("x"), "ﬁ①") == "fi1"
    assert one(spark, X.uuid5(X.DNS, "x"), "a|b") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a|b"))
    assert one(spark, X.clean_model_output("x"), "```\nx\nsearch_query: да\n```") == "search_query: да"
    assert one(spark, X.document_type("x"), "Регламент ЭП") == "legislation"
    assert one(spark, X.l2_normalized("x"), [3.0, 4.0], "array<double>") == [0.6, 0.8]
    assert one(spark, X.cosine("x", "x"), [0.0], "array<double>") is None


def test_rules(spark):
    assert one(spark, rules.route("x"), "ошибка плагина криптопро").line == "L2"
    assert one(spark, rules.route("x"), "жалоба в фас по 223-фз").category_filter == "223fz"
    assert one(spark, rules.route("x"), "привет").category_filter is None
    assert one(spark, rules.graph_node("x"), "как подать жалобу в фас").name == "fas_complaint_44fz"
    assert one(spark, rules.graph_node("x"), "токен") is None
    assert one(spark, rules.asks_operator("x"), " Оператор ") and one(spark, rules.asks_operator("x"), "прошу, позови человека!")
    assert one(spark, rules.agrees("x"), "дата") and not one(spark, rules.agrees("x"), "нет")
    assert one(spark, rules.contains_any("x", ["ок"]), "срок")
    assert one(spark, rules.relevant("x", F.lit("подача жалобы")), "подача жалобы в") and not one(spark, rules.relevant("x", F.lit("подача")), "подача жалобы")
    assert not one(spark, rules.offensive("x"), None)


@given(st.text(alphabet="ab .,;\n-1é", max_size=3000))
@settings(max_examples=60, deadline=None)
def test_splitter_properties(text):
    pieces = K.split_text(text, 200, 40)
    assert all(p and len(p) <= 200 and p == p.strip() for p in pieces)
    assert set("".join(pieces)) - {" ", "\n"} == set(text) - {" ", "\n"}
    assert bool(pieces) == bool(text.strip())


def test_splitter_edges():
    assert K.split_text(None) == K.split_text("  ") == []
    assert K.split_text("x" * 750) == ["x" * 750]
    assert [len(p) for p in K.split_text("x" * 751)] == [750, 121]
    late = "a" * 300 + ". " + "b" * 600
    assert K.split_text(late)[0] == "a" * 300 + "."


def test_tables():
    head = "| a | b |\n|---|---|"
    small = head + "\n| 1 | 2 |"
    assert K.split_table(small) == [small]
    big = head + "".join(f"\n| {i} | {'x' * 90} |" for i in range(20))
    pieces = K.split_table(big)
    assert len(pieces) > 1 and all(p.startswith(head) and len(p) <= 750 for p in pieces)
    assert sum(p.count("x" * 90) for p in pieces) == 20


def test_articles_and_statutes():
    doc = {"title": "T", "category": "c", "text": "Вводный текст длиннее двадцати знаков\n# A\nтекст\n### B\n![i](p.png) Шаг 2\n## C\n| a |\n|---|\n| 1 |\nпосле"}
    got = K.chunk_article(doc)
    assert [c["section"] for c in got] == ["Введение", "A", "A > B", "A > C", "A > C (Таблица)", "A > C"]
    assert got[2]["images"] == ["p.png"] and got[2]["step_number"] == "Шаг 2"
    assert got[1]["text"].startswith("[Документ: T | Раздел: A | Категория: c]\n\n")
    law = {"title": "L", "category": "legislation", "text": "преамбула\nСтатья 1. Первая\nкоротко\nСтатья 2. Вторая\n1. " + "а " * 300 + "\n2. " + "б " * 300}
    assert [c["section"] for c in K.chunk_statute(law)] == ["Статья 1. Первая", "Статья 2. Вторая | Пункт 1. а а а а а а", "Статья 2. Вторая | Пункт 2. б б б б б б"]
    assert [c["section"] for c in K.chunk_statute({"title": "L", "category": "x", "text": "нет статей"})] == ["L | Часть 1"]


def test_recursive_splitter():
    text = ("Слово за словом. " * 30 + "\n\n") * 8 + "x" * 3000
    pieces = K.split_recursive(text, 400, 80)
    assert all(0 < len(p) <= 400 for p in pieces) and K.split_recursive(" ") == [] and K.split_recursive("a\n\nb") == ["a\n\nb"]
    assert set("".join(pieces)) - {" "} == set(text) - {" ", "\n"}
    words = [f"w{i}" for i in range(300)]
    joined = " ".join(K.split_recursive(" ".join(words), 100, 20)).split()
    assert list(dict.fromkeys(joined)) == words


def test_node_context(spark):
    from lodestone.operators import answers

    node = F.struct(F.lit("T").alias("title"), F.lit("C").alias("channel"), F.lit("").alias("fee"), F.array(F.lit("l")).alias("law_references"), F.array().cast("array<string>").alias("deadlines"), F.array(F.lit("1"), F.lit("2")).alias("workflow_steps"), F.lit(None).cast("string").alias("effects"))
    assert spark.range(1).select(answers.node_context(node).alias("x")).first().x == "=== ГРАФОВЫЙ БЛОК ЗНАНИЙ: T ===\nНормативная база: l\nСпособ и канал подачи: C\nФинансовые условия: \nРегламентные сроки:\nПошаговый регламент:\n  1\n  2\n" + "=" * 42
