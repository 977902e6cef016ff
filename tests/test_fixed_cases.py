"""Rules on hand-made cases with what must come out."""

from pyspark.sql import functions as F

from lodestone.functions import chunking, text as X
from lodestone.operators import answers, dialogue, documents, rules

STATUTE = ["по 44 фз", "44–ФЗ и 223фз", "пункт 63 - Фз.", "1444фз", "44 фзыв", "нет", ""]
STEPS = ["Шаг 2. нажать", "сделайте ШАГ 2.1", "Этап  3", "шага нет", "перешаг 4", ""]
SYMBOLS = ["a/b-c: «x»", "ok_1 (да), 2.5 %", "  ё Ё\t! ", "日本 x", ""]
THINKING = ["мысли ...done thinking.  ответ ", "ответ без мыслей", "...done thinking.", ""]
NORMAL = [("ﬁne  “x” …", 'fine "x" ...'), ("Ⅳ ёж — 44фз!!!", "IV еж - 44-ФЗ!"), ("１２３ ½", "123 1⁄2"), ("  а б  ", "а б"), ("???....", "?...")]
EXPAND = [
    ("Подписать УПД и мчд", "Подписать универсальный передаточный документ (УПД) и машиночитаемая доверенность (мчд)"),
    ("упди", "упди"),
    ("ПЭП, ЭП", "простая электронная подпись (ПЭП), электронная подпись (ЭП)"),
]
FILES = [("a_b.pdf", "https://p.example/docs/a%20b.pdf"), ("Файл 1.docx", "https://p.example/docs/%D0%A4%D0%B0%D0%B9%D0%BB%201.docx"), ("known.pdf", "https://k.example/1")]
ROUTES = [
    ("Не работает плагин криптопро", "L2", "Линия технической поддержки (ЭЦП, КриптоПро, МЧД, ПО)", "ecp_mchd", "#0284c7", 2),
    ("как подать жалоба в фас по 223", "L7", "Линия правовой экспертизы (44-ФЗ / 223-ФЗ / ФАС)", "223fz", "#7c3aed", 2),
    ("добрый день", "L1", "Линия общей поддержки и навигации по Порталу Поставщиков", None, "#16a34a", 0),
]
CATEGORY = [("Продление сессии и шаг снижения", "quotation_session"), ("кредит или депозит", "services"), ("загрузка yml, xsd-схема", "ste_catalog"), ("рутокен, укэп", "ecp_mchd"), ("пусто", None)]
MESSAGES = [("дай оператора", False, True, False, False), ("оператор", True, False, False, False), ("да, давай", False, True, False, False), ("Готово", False, True, True, False), ("стоп", False, False, False, True), ("вот сука", True, False, False, False)]
REPLIES = [
    ("Жалоба", ["один", "два"], 0, False, 1, "📋 **Жалоба** (Шаг 1 из 2)\n\nодин\n\nКогда будете готовы перейти к следующему действию, напишите **«Далее»** или **«Готово»**."),
    ("Жалоба", ["один", "два"], 1, False, 2, "📋 **Жалоба** (Шаг 2 из 2)\n\nдва\n\nЭто финальный шаг регламента. Напишите **«Завершить»** или задайте уточняющий вопрос."),
    ("Жалоба", ["один", "два"], 2, True, 2, "🎉 **Отлично! Все шаги процесса «Жалоба» успешно пройдены.**\nЕсли у вас есть ещё вопросы или нужно уточнить детали по какому-либо шагу, я готов помочь!"),
    ("Иное", None, 4, True, 4, "Данный процесс не найден в базе пошаговых инструкций."),
]
TOKENS = [(1, "а б", None, False), (2, "в", "сбой", False), (3, "г", None, True)]
PORTAL = "https://p.example"
SANITIZE = [
    ("См. [статью](http://p.example/knowledgebase/article/12) и [чужое](https://x.example/a). Росэлторга нет.", "См. [статью](https://p.example/knowledgebase/article/details/ais/12) и чужое. Портал нет."),
    ("росэлторг", "Портал"),
]
NODE = ("Жалоба", ["ст. 105"], "ЕИС", "бесплатно", ["5 дней", "10 дней"], ["написать", "подать"])
NODE_TEXT = "### Жалоба\n\n**Нормативное регулирование:** ст. 105\n\n**Способ подачи:** ЕИС\n\n**Стоимость:** бесплатно\n\n**Регламентные сроки:**\n• 5 дней\n• 10 дней\n\n**Пошаговый порядок действий:**\n**1.** написать\n**2.** подать"
ARTICLES = [
    ("1", None, "Закон", "т" * 60, "<p>", ["a", "b"], "k"), ("", None, " ", "к" * 10, "x.PDF", ["a"], "k"), (None, "", "t", "", None, None, None), ("4", None, "t", None, "", [], "l"),
    (None, "5", "t", "ц" * 49, "", ["a"], "k"), ("6", None, "", "ч" * 70, "x.pdf", None, "l"),
]
STATUSES = [("u1", 200), ("u1", 404), ("u2", 200), ("u3", 404), ("", 200), (None, 200), ("u4", 500)]
TABLE = "| a | b |\n|---|---|\n" + "".join(f"| {k} | {'т' * 80} |\n" for k in range(12))
GUIDE = f"Вступление к инструкции для всех.\n# Вход\nШаг 1. Откройте ![k](a.png) страницу.\n## Кнопка подачи\nТекст без картинок.\n## Прочее\nЕщё текст.\n{TABLE}После.\n# Итог\nКонец."
LAW = "Преамбула.\nСтатья 1. Общее\nКоротко.\nСтатья 2. Порядок\n" + "".join(f"{k}. " + "слово " * 90 + "\n" for k in (1, 2))
_HEAD = "| a | b |\n|---|---|"
_ROWS = [f"| {k} | {'т' * 80} |" for k in range(12)]
_PART = lambda k: (f"{k}. " + "слово " * 90).strip()
#: doc_id, section, step, images, body
CHUNKS = [
    (1, "Введение", None, "", "Вступление к инструкции для всех."),
    (1, "Вход", "Шаг 1", "a.png", "# Вход\nШаг 1. Откройте ![k](a.png) страницу."),
    (1, "Вход > Кнопка подачи", None, "a.png", "## Кнопка подачи\nТекст без картинок."),
    (1, "Вход > Прочее", None, "", "## Прочее\nЕщё текст."),
    (1, "Вход > Прочее (Таблица)", None, "", "\n".join([_HEAD, *_ROWS[:8]])),
    (1, "Вход > Прочее (Таблица)", None, "", "\n".join([_HEAD, *_ROWS[8:]])),
    (1, "Вход > Прочее", None, "", "После."),
    (1, "Итог", None, "", "# Итог\nКонец."),
    (2, "Статья 1. Общее", None, "", "Статья 1. Общее\nКоротко."),
    (2, "Статья 2. Порядок | Пункт 1. слово слово", None, "", _PART(1)),
    (2, "Статья 2. Порядок | Пункт 2. слово слово", None, "", _PART(2)),
]


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "id long, " + schema)


def outs(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("id").collect()]


def test_text_rules(spark):
    apply = lambda rows, f: outs(frame(spark, rows, "t string").select("id", f("t").alias("out")), "out")
    assert apply(STATUTE, X.canonical_statutes) == ["по 44-ФЗ", "44-ФЗ и 223-ФЗ", "пункт 63-ФЗ.", "1444фз", "44 фзыв", "нет", ""]
    assert apply(STEPS, X.step_number) == ["Шаг 2", "Шаг 2.1", "Этап  3", None, None, None]
    assert apply(SYMBOLS, X.plain_symbols) == ["a b c x", "ok 1 да , 2.5", "ё Ё", "x", ""]
    assert apply(THINKING, X.after_thinking) == ["ответ", "ответ без мыслей", "", ""]
    assert apply([a for a, _ in NORMAL], X.normalize_basic) == [b for _, b in NORMAL]
    assert apply([a for a, _ in EXPAND], X.expand_terms) == [b for _, b in EXPAND]
    assert apply([a for a, _ in FILES], lambda t: X.document_url(t, "https://p.example/docs/", {"known.pdf": "https://k.example/1"})) == [b for _, b in FILES]
    assert apply([a for a, _ in CATEGORY], rules.category) == [b for _, b in CATEGORY]
    assert apply([a for a, _ in SANITIZE], lambda t: answers.sanitized(t, F.array(F.lit(f"{PORTAL}/knowledgebase/article/12")), PORTAL, "росэлторг", "Портал")) == [b for _, b in SANITIZE]


def test_links_are_replaced_where_they_stand(spark):
    """The main page's address is the beginning of an article's."""
    said = [f"[a]({PORTAL}/knowledgebase/article/12) {PORTAL}/knowledgebase/", None, "", f"{PORTAL}/knowledgebase/ {PORTAL}/knowledgebase/article/7 [x](http://o.example/) [m]({PORTAL}/knowledgebase/)", "plain"]
    got = outs(frame(spark, said, "t string").select("id", X.rewrite_links("t", PORTAL).alias("out")), "out")
    main, article = f"{PORTAL}/knowledgebase/main", f"{PORTAL}/knowledgebase/article/details/ais/"
    assert got == [f"[a]({article}12) {main}", "", "", f"{main} {article}7 [x](http://o.example/) [m]({main})", "plain"]


def test_routes_and_triggers(spark):
    got = frame(spark, [r[0] for r in ROUTES], "t string").select("id", rules.route("t").alias("r")).select("id", "r.*")
    assert outs(got, "line", "name", "category_filter", "badge_color", "score") == [r[1:] for r in ROUTES]
    assert outs(dialogue.flags(frame(spark, [r[0] for r in MESSAGES], "t string"), "t"), "escalate", "agree", "next", "stop") == [r[1:] for r in MESSAGES]


def test_step_replies(spark):
    df = frame(spark, [r[:3] for r in REPLIES], "title string, steps array<string>, step int")
    got = df.select("id", dialogue.step_reply("title", "steps", "step").alias("r")).select("id", "r.*")
    assert outs(got, "is_finished", "next_step", "reply") == [r[3:] for r in REPLIES]


def test_failed_and_redirected_tokens(spark):
    df = frame(spark, TOKENS, "chat long, t string, failure string, moved boolean").withColumnRenamed("id", "turn")
    got = sorted(tuple(r) for r in dialogue.token_events(df, "chat", "turn", "t", "failure", "moved").select("chat", "id", "event", "token", "details").collect())
    assert got == [
        (1, 0, "NEW_TOKEN", "а ", None), (1, 1, "NEW_TOKEN", "б", None), (1, 2, "END_GENERATION", "а б", "Done"),
        (2, 0, "NEW_TOKEN", "сбой", None), (2, 1, "END_GENERATION", "сбой", "Error"), (3, 0, "END_GENERATION", "", "redirected"),
    ]


SHAPE = "struct<title:string,law_references:array<string>,channel:string,fee:string,deadlines:array<string>,workflow_steps:array<string>>"


def test_nodes(spark):
    df = frame(spark, [(NODE, "T", "x"), (None, "T", " a \n\nb"), (None, None, None)], f"node {SHAPE}, title string, text string")
    assert outs(df.select("id", answers.fallback("node", "title", "text").alias("out")), "out") == [NODE_TEXT, "По вашему вопросу найдена официальная инструкция:\n\n📌 **T**\n\na\n\nb", None]


def test_article_issues(spark):
    df = frame(spark, ARTICLES, "staticId string, key string, title string, text string, raw string, kinds array<string>, category string")
    got = dict(tuple(r) for r in documents.issues(df, ["staticId", "key"], "title", "text", "raw", "kinds", "category").collect())
    assert got == {
        "articles": 6, "valid": 2, "mean_chars": 55, "issue:only_pdf_link": 2, "issue:no_id": 1, "issue:no_text": 2, "issue:short_text": 1,
        "category:k": 3, "category:l": 2, "category:unknown_category": 1, "section:a": 3, "section:b": 1,
    }
    many = df.limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(13))).alias("n"), "*").drop("category").withColumn("category", F.concat(F.lit("c"), "n"))
    assert sum(r.name.startswith("category:") for r in documents.issues(many, ["staticId", "key"], "title", "text", "raw", "kinds", "category").collect()) == 10


def test_url_totals(spark):
    assert tuple(documents.url_totals(spark.createDataFrame(STATUSES, "url string, status int"), "url", "status").first()) == (4, 1, 2, 25.0)


def test_guide_and_law(spark):
    df = spark.createDataFrame([(1, "Руководство", "", "k", "instruction", GUIDE), (2, "ФЗ", "", "k", "legislation", LAW)], "doc_id long, title string, url string, category string, doc_type string, text string")
    title = {1: "Руководство", 2: "ФЗ"}
    got = [(r.doc_id, r.section, r.step_number, " ".join(r.images), r.text) for r in chunking.chunks(df).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(i, w, s, m, f"[Документ: {title[i]} | Раздел: {w} | Категория: k]\n\n{b}") for i, w, s, m, b in CHUNKS]


def test_repeated_keys_in_cache_and_state(spark):
    asked = spark.createDataFrame([(1, " Hi", 10), (2, "hi\n", 30), (3, "other", 1)], "id long, message string, at int")
    rows = [("hi", "old", 1, 99), ("hi", "new", 2, 20), ("HI ", "older", 0, 50)]
    cache = spark.createDataFrame(rows, "message string, answer string, written int, expires_at int").select(answers.cache_key("message").alias("cache_key"), "answer", "written", "expires_at")
    assert outs(answers.cached(asked, cache, "message", "at", "written"), "hit", "answer") == [(True, "new"), (False, None), (False, None)]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    new = spark.createDataFrame([(1, "A", None, 2), (1, "B", 7, 1), (3, None, 3, 1), (1, None, None, 3)], "id long, x string, y int, at int")
    assert outs(answers.updated(old, new, "id", "at"), "id", "x", "y") == [(1, "A", 7), (2, "b", 2), (3, None, 3)]
