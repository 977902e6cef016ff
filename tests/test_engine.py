import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import answers, dialogue, retrieval
from lodestone.plans import catalog
from lodestone.sources import readers, writers
from lodestone.streaming import chat

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def test_readers(spark, tmp_path):
    long = "текст статьи " * 20
    rows = [
        {"staticId": "1", "largeName": " Закон ", "serviceName": "s", "selfServicePortal": "", "detailText": f"<p>{long}</p>", "sectionTypes": ["a"]},
        {"id": "2", "detailText": None, "previewText": "<a href='x.PDF'>скачать файл по этой ссылке, здесь всё очень подробно</a> x.pdf" + "y" * 20},
        {"id": "3", "previewText": "коротко"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows), "utf-8")
    got = readers.articles(spark, str(tmp_path / "a.json"), "https://p.example").collect()
    assert [(r.doc_id, r.title, r.doc_type, r.url) for r in got] == [("art_1", "Закон", "legislation", "https://p.example/knowledgebase/article/details/ais/1")]
    (tmp_path / "r.json").write_text(json.dumps({"pages": [{"contentItemId": "z", "displayText": "R", "content": {"html": long}}, {"contentItemId": "", "content": {"html": long}}]}), "utf-8")
    assert [r.doc_id for r in readers.regulations(spark, str(tmp_path / "r.json"), "https://p.example").collect()] == ["reg_z"]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>' + "слово " * 30 + "</w:t></w:r></w:p><w:p/></w:document>")
    for name in ("b_x.docx", "a_x.docx"):
        (tmp_path / name).write_bytes(body.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    files = readers.files(spark, str(tmp_path / "*.docx"), "https://p.example/docs/", readers.docx_text, legislation=False)
    assert [(r.file_name, r.title, r.url) for r in files.collect()] == [("a_x.docx", "a x", "https://p.example/docs/a%20x.docx")]
    assert readers.union(readers.articles(spark, str(tmp_path / "a.json"), "https://p.example"), files).count() == 2
    (tmp_path / "j1.txt").write_text('[{"t": "a"}, 5, {"t": "b"}]')
    (tmp_path / "j2.txt").write_text('{"t": "c"}\nnoise\n{"t": "d"}\n')
    assert sorted(r.t for r in readers.json_records(spark, str(tmp_path / "j*.txt"), "t string").collect()) == ["a", "b", "c", "d"]
    assert {r.ext: r.files for r in readers.inventory(spark, str(tmp_path)).collect()} == {"json": 2, "docx": 3, "txt": 2}


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], "chunk_id string, text string, category string")
    writers.create_index(old, path)
    new = spark.createDataFrame([("2", "B", "y"), ("3", "c", "y")], "chunk_id string, text string, category string")
    for _ in range(2):
        writers.upsert(spark, new, path)
        got = spark.read.parquet(path).orderBy("chunk_id").collect()
        assert [(r.chunk_id, r.text, r.category) for r in got] == [("1", "a", "x"), ("2", "B", "y"), ("3", "c", "y")]
    bad = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="must have"):
        writers.check_vectors(bad, "v", 2).collect()
    assert writers.check_vectors(bad, "v", 1).count() == 1


def test_filter_falls_back_by_query(spark):
    hits = spark.createDataFrame([(q, d, 1.0 / r, r, c, w) for q, w in ((1, "a"), (2, "b"), (3, None)) for r, (d, c) in enumerate([(10, "a"), (11, "c"), (12, "a")], 1)], "q int, d int, score double, rank long, cat string, want string")
    got = retrieval.boost_and_filter(hits, "q", F.when(F.col("d") == 12, 5.0).otherwise(0.0), "cat", "want", 2).orderBy("q", "final_rank").collect()
    assert [(r.q, r.d, r.fell_back) for r in got] == [(1, 12, False), (1, 10, False), (2, 12, True), (2, 10, True), (3, 12, False), (3, 10, False)]


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    valid = F.array(F.lit("http://a.example/1"))
    assert one(answers.known_links(F.lit("[x](http://a.example/1) [y](http://b.example)"), valid)) == "[x](http://a.example/1) y"
    assert one(answers.with_source(F.lit("текст\n\n**Источник:** [z](q)"), F.lit("T"), F.lit("U"))) == "текст\n\nИсточник: [T](U)"
    assert one(answers.offer_once(F.lit("a"), "b")) == "a\n\nb" and one(answers.offer_once(F.lit("a b"), "b")) == "a b"


SCRIPT = ["как подать жалобу в фас", "Да", "Далее", "срок", "привет", "Стоп", "спасибо", "да", "позови оператора", "далее", "далее", "далее"]


def test_workflow_in_batch_and_as_a_stream(spark, tmp_path):
    steps = {"fas_complaint_44fz": 2}
    rows = [(f"c{k}", i, t) for k in range(2) for i, t in enumerate(SCRIPT[k:])]
    df = spark.createDataFrame(rows, "chat_id string, seq long, text string")
    batch = dialogue.replay(dialogue.flags(df, "text"), "chat_id", "seq", steps).orderBy("chat_id", "seq").collect()
    first = [(r.action, r.active, r.step) for r in batch if r.chat_id == "c0"]
    assert first[:6] == [("answer", None, 0), ("start", "fas_complaint_44fz", 1), ("step", "fas_complaint_44fz", 2), ("finish", None, 2), ("answer", None, 2), ("answer", None, 2)]
    assert first[7] == ("missing", "general_guide", 0) and first[8][0] == "escalate"
    df.where("seq < 5").coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = chat.workflow(dialogue.flags(source, "text"), steps)
    go = lambda: out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    go()
    df.where("seq >= 5").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    go()
    stream = spark.read.parquet(str(tmp_path / "out")).orderBy("chat_id", "seq").collect()
    assert [tuple(r) for r in stream] == [tuple(r) for r in batch]


def test_events(spark):
    df = spark.createDataFrame([("c", 1, "a b", None, None), ("c", 2, "x", "bad", None), ("c", 3, "x", None, True)], "chat_id string, id0 int, text string, err string, red boolean")
    got = dialogue.token_events(df, "chat_id", "id0", "text", "err", "red").orderBy("id0", "id").collect()
    assert [(r.id0, r.id, r.event, r.token, r.details) for r in got] == [
        (1, 0, "NEW_TOKEN", "a ", None), (1, 1, "NEW_TOKEN", "b", None), (1, 2, "END_GENERATION", "a b", "Done"),
        (2, 0, "NEW_TOKEN", "bad", None), (2, 1, "END_GENERATION", "bad", "Error"), (3, 0, "END_GENERATION", "", "redirected"),
    ]
    raw = spark.createDataFrame([(json.dumps({"event": "NEW_MESSAGE", "data": {"text": t, "chat_id": "1"}}),) for t in ("hi", "", "x" * 1001)] + [("noise",)], "value string")
    good, bad = chat.parse(raw)
    assert [r.text for r in good.collect()] == ["hi"] and bad.count() == 3
    lines = spark.createDataFrame([('{"response": "a"}',), ("bad",), ('{"response": ""}',), ('{"done": true}',), ('{"error": "e"}',)], "value string")
    assert [(r.kind, r.data) for r in chat.ndjson_tokens(lines).collect()] == [("token", "a"), ("done", None), ("error", "e")]


@needs_tables
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    text = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(text, r)) for r in want.fetchall())


def test_lost_upsert_is_recovered(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("1", "a", "x", 1), ("1", "b", "x", 2)], "chunk_id string, text string, category string, at int")
    writers.upsert(spark, rows, path, order="at")  # creates it
    assert [r.text for r in spark.read.parquet(path).collect()] == ["b"]
    os.rename(path, path + ".next")  # the driver was lost between two renames
    writers.upsert(spark, rows.where("at = 1").withColumn("chunk_id", F.lit("2")), path)
    assert sorted((r.chunk_id, r.text) for r in spark.read.parquet(path).collect()) == [("1", "b"), ("2", "a")]
    assert sorted(os.listdir(tmp_path)) == ["index"]
    with pytest.raises(ValueError, match="holds no points"):
        writers.require_rows(rows.where("false"), "index")


def test_rejects_and_other_sources(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = readers.rejects(spark, str(tmp_path / "*.docx"), readers.docx_text).collect()
    assert [r.file_name for r in got] == ["bad.docx"] and "BadZipFile" in got[0].reason
    if __import__("importlib.util").util.find_spec("pypdf") is None:
        with pytest.raises(RuntimeError, match="pypdf"):
            readers.rejects(spark, str(tmp_path / "*.docx"), readers.pdf_text)
    (tmp_path / "kb.json").write_text(json.dumps([{"text": "t", "title": "T", "url": "u"}, {"text": ""}]), "utf-8")
    kb = readers.cleaned(spark, str(tmp_path / "kb.json"))
    assert [(r.title, r.doc_type) for r in kb.collect()] == [("T", "instruction")]
    assert readers.lookup(kb, "url", "u").count() == 1 and readers.union(kb, readers.inline(spark, [("Закон", "v", "x")])).count() == 2


def test_without_agents_one_is_created(spark):
    agents, chats = spark.createDataFrame([], "id long"), spark.createDataFrame([], "owner long")
    assert answers.assigned(agents, chats, "id", "owner").collect()[0].asDict() == {"id": 0, "active_chats": 0, "created": True}
