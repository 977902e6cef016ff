"""Queries whose inputs are built from the tables' rows by expressions, for rules whose cases the tables do not hold. SQL computes the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, lexicon, text as X
from ..operators import answers, dialogue, documents, rules
from ..sources import folders, readers, writers
from ..streaming import chat

PORTAL = "https://p.example"
STATUTE_NUMBERS, STATUTE_GAPS, STATUTE_ENDS = ["44", "223", "63", "135", "149", "1444"], [" ", "", "–", " - "], ["фз", "ФЗ", "фзыв"]
STEP_WORDS = ["Шаг", "шаг", "ШАГ", "Этап", "перешаг"]
SYMBOLS = " a/b-c: «x» ok_1 (да), 2.5 % Ё\t!"
TERM_KEYS = sorted(lexicon.TERMS)
ROUTE_PHRASES = ["добрый день", *[w for ws in lexicon.ROUTES.values() for w in ws[:3]], "жалоба в фас по 223", "статья 44"]
CATEGORY_PHRASES = ["пусто", *[w for ws in lexicon.CATEGORIES.values() for w in ws[:2]]]
TRIGGERS = ["дай оператора", "оператор", "да, давай", "Готово", "стоп", "вот сука", "срок", "привет"]
GUIDE_WORDS = ["Вступление к инструкции номер ", "\n# Вход ", "\nШаг 1. Откройте ![k](a", ".png) страницу.\n## Кнопка подачи\nТекст ", " без картинок.\n## Прочее\nЕщё ", ".\n", "После ", ".\n# Итог\nКонец "]


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _said(spark, d):
    return _read(spark, d, "conversations")


def _one_of(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _statutes():
    return F.concat("text", F.lit(" "), _one_of(STATUTE_NUMBERS, F.col("turn")), _one_of(STATUTE_GAPS, F.col("conv_id")), _one_of(STATUTE_ENDS, F.col("conv_id") + F.col("turn")), F.lit(" и далее"))


def statute_forms(spark, d):
    return _said(spark, d).select("conv_id", "turn", X.canonical_statutes(_statutes()).alias("out"))


def step_numbers(spark, d):
    said = F.concat("text", F.lit(" "), _one_of(STEP_WORDS, F.col("conv_id")), F.lit(" "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ".1").otherwise(""), F.lit(" далее"))
    return _said(spark, d).select("conv_id", "turn", X.step_number(said).alias("out"))


def plain_symbols(spark, d):
    return _said(spark, d).select("conv_id", "turn", X.plain_symbols(F.concat("text", F.lit(SYMBOLS))).alias("out"))


def after_thinking(spark, d):
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("мысли: "), "text", F.lit("\n...done thinking. \n "), "text", F.lit(" ")))
    return _said(spark, d).select("conv_id", "turn", X.after_thinking(said).alias("out"))


def full_normalize(spark, d):
    """The query as it goes to the search: normalised, expanded, marked."""
    from .catalog import TERMS

    said = F.concat(F.lit("  “ "), "text", F.lit(" —  44фз???!! "))
    return _said(spark, d).select("conv_id", "turn", F.md5(X.search_query(said, TERMS)).alias("md5"))


def default_expand(spark, d):
    said = F.concat("text", F.lit(" ("), _one_of(TERM_KEYS, F.col("conv_id") * 7 + F.col("turn")), F.lit(") и "), _one_of([k + "ы" for k in TERM_KEYS], F.col("turn")))
    return _said(spark, d).select("conv_id", "turn", X.expand_terms(said).alias("out"))


def document_urls(spark, d):
    name = F.concat(F.lit("Файл_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "_x y").otherwise(""), F.lit(".pdf"))
    return _read(spark, d, "pages").select("page_id", X.document_url(name, f"{PORTAL}/docs/", {"Файл_3.pdf": "https://k.example/3"}).alias("out"))


def default_route(spark, d):
    said = F.concat("text", F.lit(" "), _one_of(ROUTE_PHRASES, F.col("conv_id") + F.col("turn")), F.lit(" "), _one_of(ROUTE_PHRASES, F.col("conv_id")))
    return _said(spark, d).select("conv_id", "turn", rules.route(said).alias("r")).select("conv_id", "turn", "r.line", "r.name", "r.category_filter", "r.badge_color", "r.score")


def default_category(spark, d):
    said = F.concat("text", F.lit(" "), _one_of(CATEGORY_PHRASES, F.col("conv_id") + F.col("turn")), F.lit(" "), _one_of(CATEGORY_PHRASES, F.col("conv_id")))
    return _said(spark, d).select("conv_id", "turn", rules.category(said).alias("out"))


def default_triggers(spark, d):
    said = F.when(F.col("turn") % 2 == 0, _one_of(TRIGGERS, F.col("conv_id"))).otherwise(F.concat(_one_of(TRIGGERS, F.col("conv_id") + F.col("turn")), F.lit(" "), "text"))
    return dialogue.flags(_said(spark, d).withColumn("t", said), "t").select("conv_id", "turn", "escalate", "agree", "next", "stop")


def step_replies(spark, d):
    """The first words of a message as the steps of a workflow."""
    steps = F.when(F.col("conv_id") % 5 != 0, F.slice(F.split("text", " "), 1, 3))
    df = _said(spark, d).select("conv_id", "turn", F.col("role").alias("title"), steps.alias("steps"), (F.col("turn") % 4).cast("int").alias("step"))
    return df.select("conv_id", "turn", dialogue.step_reply("title", "steps", "step").alias("r")).select("conv_id", "turn", "r.is_finished", F.col("r.next_step").cast("long").alias("next_step"), "r.reply")


def failed_and_redirected_tokens(spark, d):
    df = _said(spark, d).withColumn("failure", F.when(F.col("turn") % 3 == 1, F.concat(F.lit("сбой "), F.col("turn").cast("string")))).withColumn("moved", F.when(F.col("conv_id") % 4 == 0, F.col("turn") % 2 == 0))
    return dialogue.token_events(df, "conv_id", "turn", "text", "failure", "moved").select("conv_id", "turn", F.col("id").alias("place"), "event", "token", "details")


def answer_sanitize(spark, d):
    """A source that is valid for two pages of three, one that never is, and a banned name."""
    own = F.concat(F.lit(f"{PORTAL}/knowledgebase/article/"), F.col("page_id").cast("string"))
    said = F.concat(F.lit("См. [статью]("), F.replace(own, F.lit("https"), F.lit("http")), F.lit("), [главную]("), F.lit(f"{PORTAL}/knowledgebase/"), F.lit(") и [чужое]("), "url", F.lit("). Росэлторга нет: "), own)
    valid = F.array(F.when(F.col("page_id") % 3 != 0, own).otherwise(F.lit(f"{PORTAL}/knowledgebase/")))
    return _read(spark, d, "pages").select("page_id", answers.sanitized(said, valid, PORTAL, "росэлторг", "Портал").alias("out"))


def _node():
    """A workflow node of a document; every third has none, every second of the others no effects."""
    i = F.col("doc_id").cast("string")
    items = lambda *x: F.array(*[F.concat(F.lit(v), i) for v in x])
    node = F.struct(
        F.coalesce("source", F.lit("")).alias("title"), items("ст. ", "п. ").alias("law_references"), F.coalesce("lang", F.lit("")).alias("channel"), F.lit("бесплатно").alias("fee"), items("срок ", "ещё ").alias("deadlines"), items("написать ", "подать ", "ждать ").alias("workflow_steps"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("итог "), i)).alias("effects")
    )
    return F.when(F.col("doc_id") % 3 != 0, node)


def node_fallback(spark, d):
    """A node's own answer, else the first lines of the document, else nothing."""
    text = F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit(" \n "), "text"))
    return _read(spark, d, "documents").select("doc_id", F.md5(answers.fallback(_node(), "source", text)).alias("md5"))


def node_contexts(spark, d):
    """What a node tells a model."""
    return _read(spark, d, "documents").select("doc_id", answers.node_context(_node()).alias("context"))


def _articles(spark, d):
    """Pages as articles: some without an id, a title or a text, some that only link to a file, with section types."""
    p, i = _read(spark, d, "pages"), F.col("page_id")
    raw = F.when(i % 11 == 0, F.concat(F.lit("<a href='x.PDF'>"), i.cast("string"), F.lit("</a>"))).when(i % 13 == 0, "").when(i % 17 == 0, F.concat(F.lit("<p>кратко "), i.cast("string"), F.lit("</p>"))).otherwise(F.col("html"))
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return p.select(F.when(i % 5 != 0, i.cast("string")).alias("staticId"), F.when(i % 10 == 0, "").when(i % 5 == 0, F.concat(F.lit("i"), i.cast("string"))).alias("id"), F.when(i % 7 == 0, " ").otherwise(host).alias("title"), "page_id", "url", raw.alias("raw"), X.clean_html(raw).alias("text"), F.when(i % 4 != 0, F.array(F.concat(F.lit("s"), (i % 3).cast("string")), host)).alias("kinds"), host.alias("category"))


def article_issues(spark, d):
    return documents.issues(_articles(spark, d), ["staticId", "id"], "title", "text", "raw", "kinds", "category")


def url_status_totals(spark, d):
    p = _read(spark, d, "pages").select(F.when(F.col("page_id") % 6 != 0, F.regexp_extract("url", "^[^/]*//[^/]+", 0)).alias("url"), _one_of([200, 404, 200, 500], F.col("page_id")).alias("status"))
    return documents.url_totals(p, "url", "status")


def longest_documents(spark, d):
    return documents.largest(_read(spark, d, "documents"), "doc_id", "text")


def _guide():
    """A guide with headings of two levels, a step, an image and a table of twelve rows, in words of a document."""
    i, c = F.col("doc_id").cast("string"), F.substring(F.md5("text"), 1, 1)
    w = [F.lit(x) for x in GUIDE_WORDS]
    rows = F.concat(*[F.concat(F.lit(f"| {k} | "), F.repeat(c, F.lit(80)), F.lit(" |\n")) for k in range(12)])
    return F.concat(w[0], i, w[1], i, w[2], i, w[3], i, w[4], i, w[5], F.lit("| a | b |\n|---|---|\n"), rows, w[6], i, w[7], i, F.lit("."))


def _law():
    """A statute with a preamble, a short article and one in numbered parts."""
    word = F.substring(F.md5("text"), 1, 5)
    part = lambda k: F.concat(F.lit(f"{k}. "), F.repeat(F.concat(word, F.lit(" ")), F.lit(90)), F.lit("\n"))
    return F.concat(F.lit("Преамбула.\nСтатья 1. Общее "), F.col("doc_id").cast("string"), F.lit("\nКоротко.\nСтатья 2. Порядок\n"), part(1), part(2))


def guide_and_law_chunks(spark, d):
    docs = _read(spark, d, "documents").where("text is not null")
    law = F.col("doc_id") % 4 == 0
    df = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("title"), F.lit("").alias("url"), F.lit("k").alias("category"), F.when(law, "legislation").otherwise("instruction").alias("doc_type"), F.when(law, _law()).otherwise(_guide()).alias("text"))
    return chunking.chunks(df).select("doc_id", "chunk_index", "section", "step_number", F.array_join("images", " ").alias("images"), F.md5("text").alias("md5"))


def message_snippets(spark, d):
    """The line of a log for each message."""
    return _said(spark, d).select("conv_id", "turn", X.snippet(F.concat(F.lit("a\nb "), "text")).alias("line"))


def cache_items(spark, d):
    """What a chat keeps of its first six messages."""
    got = answers.cache_items(_said(spark, d).withColumn("text", F.concat_ws(" ", *["text"] * 6)), "conv_id", "turn", ["role"], "text")
    return got.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def embedding_report(spark, d):
    """Questions with what the search gets of them: normalised text, vector's length and norm."""
    from ..operators import embedding
    from .catalog import TERMS

    asked = _read(spark, d, "benchmark").select("item_id", X.search_query("text", TERMS).alias("normalized"))
    v = embedding.embed(asked.where("normalized is not null"), "normalized", "vector")
    return v.select("item_id", F.md5("normalized").alias("normalized_md5"), F.size("vector").cast("long").alias("dimension"), F.round(X.norm("vector"), 6).alias("norm"))


def _article_files(spark, d) -> str:
    """The articles as files of JSON arrays, 100 to a file."""
    n = F.length("raw")
    one = F.to_json(F.struct("staticId", "id", F.col("title").alias("largeName"), F.col("category").alias("serviceName"), F.when(n % 2 == 0, F.col("raw")).alias("detailText"), F.when(n % 2 == 1, F.col("raw")).alias("previewText"), F.when((n % 3 > 0) & (F.col("page_id") % 10 != 0), F.col("url")).alias("url")))
    path = folders.new_folder(spark, "articles")
    arrays = _articles(spark, d).groupBy(F.expr("page_id div 100").alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ", "), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return path


def article_scan(spark, d):
    """Articles read from JSON files that were written from the pages: cleaned, without stubs, with ids, titles, types and addresses."""
    got = readers.articles(spark, _article_files(spark, d), PORTAL)
    return got.select("doc_id", "title", "url", "category", "doc_type", F.md5("text").alias("md5"))


def _regulation_files(spark, d) -> str:
    """Pages as files of regulations, each an object with a list of pages; some without an id."""
    p, i = _read(spark, d, "pages"), F.col("page_id")
    one = F.struct(F.when(i % 6 != 0, F.concat(F.lit("r"), i.cast("string"))).otherwise("").alias("contentItemId"), F.regexp_extract("url", "://([^/]+)", 1).alias("displayText"), F.when(i % 4 != 0, F.col("url")).alias("url"), F.struct("html").alias("content"))
    files = p.groupBy(F.expr("page_id div 100").alias("file")).agg(F.to_json(F.struct(F.collect_list(one).alias("pages"))).alias("value"))
    path = folders.new_folder(spark, "regulations")
    files.write.partitionBy("file").text(path)
    return path


def _cleaned_files(spark, d) -> str:
    """Documents as files of a cleaned knowledge base: 500 ids to a file, an array in the order of ids."""
    one = F.struct("doc_id", F.to_json(F.struct("text", F.col("source").alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("category"))).alias("o"))
    rows = _read(spark, d, "documents").groupBy(F.expr("doc_id div 500").alias("file")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    path = folders.new_folder(spark, "cleaned")
    rows.select("file", F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["o"]), ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    return path


def regulation_scan(spark, d):
    """Regulations read from JSON files that were written from the pages."""
    got = readers.regulations(spark, _regulation_files(spark, d), PORTAL)
    return got.select("doc_id", "title", "url", "doc_type", "file_name", F.md5("text").alias("md5"))


def document_union(spark, d):
    """All documents of three kinds of files, in the order of their sources."""
    parts = [readers.articles(spark, _article_files(spark, d), PORTAL), readers.regulations(spark, _regulation_files(spark, d), PORTAL), readers.cleaned(spark, _cleaned_files(spark, d))]
    return readers.union(*parts).groupBy("source_ord", "doc_type").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.countDistinct("doc_id").alias("ids"))


def directory_ingest(spark, d):
    """Records of a folder of files, numbered within their files."""
    got = readers.directory_records(spark, _cleaned_files(spark, d), "*.txt")
    get = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    return got.select("place", get("url").alias("url"), F.md5(get("text")).alias("md5"))


def file_inventory(spark, d):
    """Files below a folder by extension."""
    return readers.inventory(spark, _cleaned_files(spark, d)).where("ext = 'txt'").select("ext", "files")


def feedback_log(spark, d):
    """Likes and dislikes of messages, appended in two runs and read back; other kinds are not kept."""
    path = folders.new_folder(spark, "feedback")
    rows = _said(spark, d).select(_one_of(["like", "dislike", "other"], F.col("turn")).alias("type"), F.md5("text").alias("question"), F.concat("role", F.lit(" "), F.col("conv_id").cast("string")).alias("answer"), "conv_id")
    for k in range(2):
        writers.append_feedback(rows.where(F.col("conv_id") % 2 == k), path)
    return spark.read.schema("type string, question string, answer string").json(path)


def cache_written(spark, d):
    """Rows of the result cache for answered messages."""
    rows = _said(spark, d).select(F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("message"), F.concat_ws("/", "conv_id", "turn").alias("answer"))
    cache = writers.cache_rows(rows, F.lit("2024-05-01 12:00:00").cast("timestamp"), 3600)
    return cache.select("cache_key", "answer", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def token_lines(spark, d):
    """Lines of a model's stream: words of messages, the end, errors and noise."""
    i = F.col("turn")
    line = F.when(i % 4 == 0, F.to_json(F.struct(F.col("text").alias("response")))).when(i % 4 == 1, F.concat(F.lit('{"done": true, "response": "'), "role", F.lit('"}'))).when(i % 4 == 2, F.concat(F.lit('{"error": "e'), i.cast("string"), F.lit('"}'))).otherwise(F.when(F.col("conv_id") % 2 == 0, F.lit('{"response": ""}')).otherwise(F.concat(F.lit("noise "), "role")))
    return chat.ndjson_tokens(_said(spark, d).select(line.alias("value"))).select("kind", F.md5("data").alias("md5"))


def parsed_envelopes(spark, d):
    """Messages in envelopes, as they come from a topic; other events, long texts and noise are rejected."""
    data = F.struct(F.col("conv_id").cast("string").alias("chat_id"), F.when(F.col("turn") % 5 == 0, F.repeat("text", F.lit(9))).otherwise(F.col("text")).alias("text"), "role", F.col("turn").alias("answered_to"))
    body = F.to_json(F.struct(F.when(F.col("turn") % 3 == 2, "NEW_TOKEN").otherwise("NEW_MESSAGE").alias("event"), F.create_map(F.lit("k"), F.col("role")).alias("meta"), data.alias("data")))
    good, _bad = chat.parse(_said(spark, d).select(F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("noise "), body)).otherwise(body).alias("value")))
    return good.select(F.col("chat_id").cast("long").alias("conv_id"), F.col("answered_to").alias("turn"), "role", F.element_at("meta", "k").alias("meta"), F.md5("text").alias("md5"))


def _values(rows, names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


def _pick(values, by: str) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + f"][(({by}) % {len(values)} + 1)::INT]"


def _chunk_sql() -> str:
    """Each chunk of a guide or statute as a row, in words of its document."""
    head, rows = "'| a | b |' || chr(10) || '|---|---|'", [f"chr(10) || '| {k} | ' || repeat(c, 80) || ' |'" for k in range(12)]
    guide = [
        ("'Введение'", "NULL", "''", "'Вступление к инструкции номер ' || doc_id"),
        ("'Вход ' || doc_id", "'Шаг 1'", "'a' || doc_id || '.png'", "'# Вход ' || doc_id || chr(10) || 'Шаг 1. Откройте ![k](a' || doc_id || '.png) страницу.'"),
        ("'Вход ' || doc_id || ' > Кнопка подачи'", "NULL", "'a' || doc_id || '.png'", "'## Кнопка подачи' || chr(10) || 'Текст ' || doc_id || ' без картинок.'"),
        ("'Вход ' || doc_id || ' > Прочее'", "NULL", "''", "'## Прочее' || chr(10) || 'Ещё ' || doc_id || '.'"),
        ("'Вход ' || doc_id || ' > Прочее (Таблица)'", "NULL", "''", " || ".join([head, *rows[:8]])),
        ("'Вход ' || doc_id || ' > Прочее (Таблица)'", "NULL", "''", " || ".join([head, *rows[8:]])),
        ("'Вход ' || doc_id || ' > Прочее'", "NULL", "''", "'После ' || doc_id || '.'"),
        ("'Итог'", "NULL", "''", "'# Итог' || chr(10) || 'Конец ' || doc_id || '.'"),
    ]
    part = lambda k: f"'{k}. ' || repeat(w || ' ', 89) || w"
    law = [
        ("'Статья 1. Общее ' || doc_id", "NULL", "''", "'Статья 1. Общее ' || doc_id || chr(10) || 'Коротко.'"),
        *[(f"'Статья 2. Порядок | Пункт {k}. ' || substr(repeat(w || ' ', 6), 1, 0) || w || ' ' || w", "NULL", "''", part(k)) for k in (1, 2)],
    ]
    branches = [f"SELECT doc_id, title, {i} AS chunk_index, {s} AS section, {n} AS step_number, {m} AS images, {b} AS body FROM d WHERE doc_id % 4 {'=' if x is law else '<>'} 0" for x in (guide, law) for i, (s, n, m, b) in enumerate(x)]
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS title, substr(md5(text), 1, 1) AS c, substr(md5(text), 1, 5) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, chunk_index::BIGINT AS chunk_index, section, step_number, images, md5('[Документ: ' || title || ' | Раздел: ' || section || ' | Категория: k]' || chr(10) || chr(10) || body) AS md5 FROM ({' UNION ALL '.join(branches)})"""


def oracle_sql() -> dict[str, str]:
    from . import catalog as C, oracles as O

    edge, rest = "(^|[^\\p{L}\\p{N}_])", "([^\\p{L}\\p{N}_]|$)"
    statute = lambda x: f"regexp_replace({x}, '{edge}(44|223|63|135|149)[\\s]*[-–—]?[\\s]*(?i:фз){rest}', '\\1\\2-ФЗ\\3', 'g')"
    numbers = f"text || ' ' || {_pick(STATUTE_NUMBERS, 'turn')} || {_pick(STATUTE_GAPS, 'conv_id')} || {_pick(STATUTE_ENDS, 'conv_id + turn')} || ' и далее'"
    steps = f"text || ' ' || {_pick(STEP_WORDS, 'conv_id')} || ' ' || turn || CASE WHEN turn % 2 = 0 THEN '.1' ELSE '' END || ' далее'"
    plain = O.strip("regexp_replace(regexp_replace(translate(x, '-/:_" + '"' + "()' || chr(39), '         '), '[^0-9A-Za-zА-Яа-яЁё .,]+', ' ', 'g'), ' +', ' ', 'g')")
    norm = O.normalized
    routed = f"r AS (SELECT conv_id, turn, text || ' ' || {_pick(ROUTE_PHRASES, 'conv_id + turn')} || ' ' || {_pick(ROUTE_PHRASES, 'conv_id')} AS text FROM conversations)"
    sorted_into = f"r AS (SELECT conv_id, turn, text || ' ' || {_pick(CATEGORY_PHRASES, 'conv_id + turn')} || ' ' || {_pick(CATEGORY_PHRASES, 'conv_id')} AS text FROM conversations)"
    lines = _values([(k or "", line, badge, lexicon.LINE_NAMES[line]) for k, (line, badge) in lexicon.LINES.items()], "k, line, badge, title")
    terms = _values([(i, k, lexicon.TERMS[k]) for i, k in enumerate(TERM_KEYS)], "i, k, m")
    low, L = "lower(trim(t))", lexicon
    said = f"CASE WHEN turn % 2 = 0 THEN {_pick(TRIGGERS, 'conv_id')} ELSE {_pick(TRIGGERS, 'conv_id + turn')} || ' ' || text END"
    node = "(doc_id % 3 <> 0)"
    answer = "'### ' || coalesce(source, '') || n || '**Нормативное регулирование:** ст. ' || doc_id || ', п. ' || doc_id || n || '**Способ подачи:** ' || coalesce(lang, '') || n || '**Стоимость:** бесплатно' || n || '**Регламентные сроки:**' || chr(10) || '• срок ' || doc_id || chr(10) || '• ещё ' || doc_id || n || '**Пошаговый порядок действий:**' || chr(10) || '**1.** написать ' || doc_id || chr(10) || '**2.** подать ' || doc_id || chr(10) || '**3.** ждать ' || doc_id"
    told = "'=== ГРАФОВЫЙ БЛОК ЗНАНИЙ: ' || coalesce(source, '') || ' ===' || n || 'Нормативная база: ст. ' || doc_id || ', п. ' || doc_id || n || 'Способ и канал подачи: ' || coalesce(lang, '') || n || 'Финансовые условия: бесплатно' || n || 'Регламентные сроки:' || n || '  • срок ' || doc_id || n || '  • ещё ' || doc_id || n || 'Пошаговый регламент:' || n || '  написать ' || doc_id || n || '  подать ' || doc_id || n || '  ждать ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN n || 'Правовые последствия: итог ' || doc_id ELSE '' END || n || repeat('=', 42)"
    article = f"{PORTAL}/knowledgebase/article/details/ais/' || page_id"
    main = f"{PORTAL}/knowledgebase/main"
    raw = "CASE WHEN page_id % 11 = 0 THEN '<a href=''x.PDF''>' || page_id || '</a>' WHEN page_id % 13 = 0 THEN '' WHEN page_id % 17 = 0 THEN '<p>кратко ' || page_id || '</p>' ELSE html END"
    clean = O.strip("regexp_replace(regexp_replace(raw, '<[^>]+>', chr(10), 'g'), chr(10) || '+', chr(10), 'g')")
    art = "raw IS NOT NULL AND NOT (contains(lower(raw), '.pdf') AND length(t) < 200) AND length(t) >= 50"
    return {
        "statute_forms": f"SELECT conv_id, turn, {statute(numbers)} AS out FROM conversations",
        "step_numbers": f"SELECT conv_id, turn, upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS out FROM (SELECT conv_id, turn, nullif(regexp_extract({steps}, '(?i){edge}(Шаг\\s+\\d+(?:\\.\\d+)?|Этап\\s+\\d+)', 2), '') AS x FROM conversations)",
        "plain_symbols": f"SELECT conv_id, turn, {plain} AS out FROM (SELECT conv_id, turn, text || '{SYMBOLS}' AS x FROM conversations)",
        "after_thinking": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE {O.strip('text')} END AS out FROM conversations",
        "full_normalize": f"WITH z AS (SELECT conv_id, turn, {statute(norm(chr(39) + '  “ ' + chr(39) + ' || text || ' + chr(39) + ' —  44фз???!! ' + chr(39)))} AS text FROM conversations), {O.expanded('z')} SELECT conv_id, turn, md5('search_query: ' || t) AS md5 FROM r",
        "default_expand": f"SELECT conv_id, turn, text || ' (' || m || ' (' || k || ')) и ' || {_pick([k + 'ы' for k in TERM_KEYS], 'turn')} AS out FROM conversations JOIN {terms} ON i = (conv_id * 7 + turn) % {len(TERM_KEYS)}",
        "document_urls": f"SELECT page_id, CASE WHEN page_id = 3 THEN 'https://k.example/3' ELSE '{PORTAL}/docs/' || url_encode('Файл ' || page_id || CASE WHEN page_id % 2 = 0 THEN ' x y' ELSE '' END || '.pdf') END AS out FROM pages",
        "default_route": f"WITH {routed}, {O._best(L.ROUTES, table='r')} SELECT conv_id, turn, line, title AS name, CASE WHEN name <> 'legal' THEN name WHEN name IS NULL THEN NULL WHEN contains(lower(text), '44') THEN '44fz' WHEN contains(lower(text), '223') THEN '223fz' ELSE 'legislation' END AS category_filter, badge AS badge_color, coalesce(score, 0)::BIGINT AS score FROM r LEFT JOIN best USING (conv_id, turn) JOIN {lines} ON k = coalesce(name, '')",
        "default_category": f"WITH {sorted_into}, {O._best(L.CATEGORIES, table='r')} SELECT conv_id, turn, name AS out FROM r LEFT JOIN best USING (conv_id, turn)",
        "default_triggers": f"WITH s AS (SELECT conv_id, turn, {said} AS t FROM conversations) SELECT conv_id, turn, {low} IN ({', '.join(chr(39) + w + chr(39) for w in L.OPERATOR_WORDS)}) OR {O._any(L.OPERATOR_PHRASES, low)} OR {O._whole(L.OFFENSIVE, 't')} AS escalate, {O._any(L.AGREE, low, 'starts_with')} AS agree, {O._any(L.NEXT, low)} AS next, {O._any(L.STOP, low)} AS stop FROM s",
        "step_replies": """WITH s AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 <> 0 THEN string_split(text, ' ')[1:3] END AS w, turn % 4 AS step FROM conversations),
          t AS (SELECT *, len(w) AS n FROM s)
          SELECT conv_id, turn, w IS NULL OR step >= n AS is_finished, CASE WHEN w IS NULL THEN step WHEN step >= n THEN n ELSE step + 1 END::BIGINT AS next_step,
            CASE WHEN w IS NULL THEN 'Данный процесс не найден в базе пошаговых инструкций.' WHEN step >= n THEN '🎉 **Отлично! Все шаги процесса «' || role || '» успешно пройдены.**' || chr(10) || 'Если у вас есть ещё вопросы или нужно уточнить детали по какому-либо шагу, я готов помочь!'
              ELSE '📋 **' || role || '** (Шаг ' || (step + 1) || ' из ' || n || ')' || chr(10) || chr(10) || w[(step + 1)::INT] || chr(10) || chr(10) || CASE WHEN step + 1 < n THEN 'Когда будете готовы перейти к следующему действию, напишите **«Далее»** или **«Готово»**.' ELSE 'Это финальный шаг регламента. Напишите **«Завершить»** или задайте уточняющий вопрос.' END END AS reply FROM t""",
        "failed_and_redirected_tokens": """WITH s AS (SELECT conv_id, turn, conv_id % 4 = 0 AND turn % 2 = 0 AS moved, turn % 3 = 1 AS failed, CASE WHEN turn % 3 = 1 THEN 'сбой ' || turn ELSE text END AS t FROM conversations),
          w AS (SELECT *, CASE WHEN moved THEN []::VARCHAR[] WHEN failed THEN [t] ELSE regexp_extract_all(t, '\\s|[^\\s]+\\s?') END AS w FROM s)
          SELECT conv_id, turn, (i - 1)::BIGINT AS place, 'NEW_TOKEN' AS event, w[i] AS token, NULL::VARCHAR AS details FROM w, range(1, 100000) r(i) WHERE i <= len(w)
          UNION ALL SELECT conv_id, turn, len(w)::BIGINT, 'END_GENERATION', CASE WHEN moved THEN '' ELSE t END, CASE WHEN moved THEN 'redirected' WHEN failed THEN 'Error' ELSE 'Done' END FROM w""",
        "answer_sanitize": f"""SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'См. [статью]({article} || '), главную' ELSE 'См. статью, [главную]({main})' END || ' и чужое. Портал нет: {article} AS out FROM pages""",
        "node_fallback": f"""WITH x AS (SELECT *, chr(10) || chr(10) AS n FROM documents), y AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda v: {O.strip("v")}), lambda v: v <> '')[1:6], chr(10) || chr(10)) AS lines FROM x)
          SELECT doc_id, md5(CASE WHEN {node} THEN {answer} WHEN doc_id % 9 <> 0 AND text IS NOT NULL THEN 'По вашему вопросу найдена официальная инструкция:' || n || '📌 **' || source || '**' || n || lines END) AS md5 FROM y""",
        "node_contexts": f"WITH x AS (SELECT *, chr(10) AS n FROM documents) SELECT doc_id, CASE WHEN {node} THEN {told} ELSE '' END AS context FROM x",
        "article_issues": f"""WITH a AS (SELECT page_id, page_id % 10 = 0 AS no_id, page_id % 7 = 0 AS no_title, {raw} AS raw, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages), b AS (SELECT *, {clean} AS t FROM a), c AS (SELECT *, length(t) AS n, contains(lower(raw), '.pdf') AND length(t) < 200 AS pdf FROM b),
          v AS (SELECT *, NOT pdf AND NOT no_id AND NOT no_title AND host <> '' AND n > 0 AS valid FROM c)
          SELECT * FROM (
            SELECT 'articles' AS name, count(*) AS rows FROM v UNION ALL SELECT 'valid', count(*) FROM v WHERE valid HAVING count(*) > 0 UNION ALL SELECT 'mean_chars', round(avg(n))::BIGINT FROM v WHERE valid HAVING count(*) > 0
            UNION ALL SELECT 'issue:only_pdf_link', count(*) FROM v WHERE pdf HAVING count(*) > 0 UNION ALL SELECT 'issue:no_id', count(*) FROM v WHERE NOT pdf AND no_id HAVING count(*) > 0
            UNION ALL SELECT 'issue:no_title', count(*) FROM v WHERE NOT pdf AND (no_title OR host = '') HAVING count(*) > 0 UNION ALL SELECT 'issue:no_text', count(*) FROM v WHERE NOT pdf AND n = 0 HAVING count(*) > 0
            UNION ALL SELECT 'issue:short_text', count(*) FROM v WHERE NOT pdf AND n BETWEEN 1 AND 49 HAVING count(*) > 0
            UNION ALL SELECT 'section:' || s, count(*) FROM (SELECT unnest(['s' || page_id % 3, host]) AS s FROM v WHERE page_id % 4 <> 0) GROUP BY s
            UNION ALL (SELECT 'category:' || host AS name, count(*) AS rows FROM v GROUP BY host ORDER BY rows DESC, name LIMIT 10))""",
        "url_status_totals": f"SELECT count(*) AS urls, count(*) FILTER (s = 200) AS ok, count(*) FILTER (s = 404) AS lost, round(100.0 * count(*) FILTER (s = 200) / greatest(count(*), 1), 2) AS percent FROM (SELECT regexp_extract(url, '^[^/]*//[^/]+') AS u, max({_pick([200, 404, 200, 500], 'page_id')}) AS s FROM pages WHERE page_id % 6 <> 0 AND regexp_extract(url, '^[^/]*//[^/]+') <> '' GROUP BY u)",
        "longest_documents": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 10",
        "guide_and_law_chunks": _chunk_sql(),
        "message_snippets": "SELECT conv_id, turn, replace(substr('a' || chr(10) || 'b ' || text, 1, 120), chr(10), ' ') AS line FROM conversations",
        "cache_items": f"SELECT conv_id, turn, role, length(t)::BIGINT AS n_chars, md5(t) AS md5 FROM (SELECT conv_id, turn, role, substr({' || chr(32) || '.join(['text'] * 6)}, 1, 500) AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 6)",
        "article_scan": f"""WITH a AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN page_id::VARCHAR WHEN page_id % 10 = 0 THEN NULL ELSE 'i' || page_id END AS key, {raw} AS raw, regexp_extract(url, '://([^/]+)', 1) AS host, url AS u FROM pages),
          b AS (SELECT *, {clean} AS t, coalesce(key, 'unknown') AS k FROM a), c AS (SELECT *, CASE WHEN length(raw) % 3 > 0 AND page_id % 10 <> 0 AND coalesce(u, '') <> '' THEN u ELSE '{PORTAL}/knowledgebase/article/details/ais/' || k END AS url FROM b WHERE {art})
          SELECT 'art_' || k AS doc_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE host END AS title, {O.canonical(PORTAL)} AS url, host AS category, 'instruction' AS doc_type, md5(t) AS md5 FROM c""",
        "regulation_scan": f"""WITH a AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, CASE WHEN page_id % 4 <> 0 AND coalesce(url, '') <> '' THEN url ELSE '{PORTAL}/knowledgebase/article/details/cms/r' || page_id END AS url, coalesce(html, '') AS raw FROM pages WHERE page_id % 6 <> 0), b AS (SELECT *, {clean} AS t FROM a)
          SELECT 'reg_r' || page_id AS doc_id, host AS title, CASE WHEN page_id % 4 = 0 AND length('r' || page_id) < 20 THEN url ELSE {O.canonical(PORTAL)} END AS url, 'legislation' AS doc_type, 'r' || page_id || '.html' AS file_name, md5(t) AS md5 FROM b WHERE length(t) >= 50""",
        "document_union": f"""WITH a AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN page_id::VARCHAR WHEN page_id % 10 = 0 THEN 'unknown' ELSE 'i' || page_id END AS k, {raw} AS raw FROM pages), b AS (SELECT *, {clean} AS t FROM a),
          r AS (SELECT page_id, coalesce(html, '') AS raw FROM pages WHERE page_id % 6 <> 0), q AS (SELECT *, {clean} AS t FROM r)
          SELECT 0 AS source_ord, 'instruction' AS doc_type, count(*) AS documents, sum(length(t))::BIGINT AS chars, count(DISTINCT k) AS ids FROM b WHERE {art} HAVING count(*) > 0
          UNION ALL SELECT 1, 'legislation', count(*), sum(length(t))::BIGINT, count(DISTINCT page_id) FROM q WHERE length(t) >= 50 HAVING count(*) > 0
          UNION ALL SELECT 2, 'instruction', count(*), sum(length(text))::BIGINT, count(DISTINCT (doc_id, text)) FROM documents WHERE coalesce(text, '') <> '' HAVING count(*) > 0""",
        "directory_ingest": "SELECT row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS place, 'u' || doc_id AS url, md5(text) AS md5 FROM documents",
        "file_inventory": "SELECT 'txt' AS ext, count(DISTINCT doc_id // 500) AS files FROM documents",
        "feedback_log": "SELECT CASE turn % 3 WHEN 0 THEN 'like' ELSE 'dislike' END AS type, md5(text) AS question, role || ' ' || conv_id AS answer FROM conversations WHERE turn % 3 < 2",
        "cache_written": f"SELECT md5({O.strip('lower(text)')}) AS cache_key, conv_id || '/' || turn AS answer, '2024-05-01 13:00:00' AS expires_at FROM conversations",
        "token_lines": "SELECT CASE turn % 4 WHEN 0 THEN 'token' WHEN 1 THEN 'done' ELSE 'error' END AS kind, md5(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN role ELSE 'e' || turn END) AS md5 FROM conversations WHERE turn % 4 < 3 AND NOT (turn % 4 = 0 AND coalesce(text, '') = '')",
        "parsed_envelopes": "SELECT conv_id, turn, role, role AS meta, md5(t) AS md5 FROM (SELECT *, CASE WHEN turn % 5 = 0 THEN repeat(text, 9) ELSE text END AS t FROM conversations) WHERE turn % 3 <> 2 AND conv_id % 7 <> 0 AND length(t) BETWEEN 1 AND 1000",
        "embedding_report": f"""WITH z AS (SELECT item_id AS conv_id, 0 AS turn, {norm("text")} AS text FROM benchmark), {O.expanded("z")}, said AS (SELECT conv_id AS item_id, 'search_query: ' || t AS t FROM r)
          SELECT item_id, md5(t) AS normalized_md5, 256::BIGINT AS dimension, 1.0::DOUBLE AS norm FROM said""",
    }


def queries() -> dict:
    return {n: globals()[n] for n in oracle_sql()}
