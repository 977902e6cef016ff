import ast
import logging
import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from jobs import chat_stream, kb_build

ROOT = Path(__file__).parent.parent
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def snapshot(spark, path):
    return sorted(map(str, spark.read.parquet(path).collect()))


def documents(path, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array(["s"] * len(rows), pa.string())}), path)


def pages(path, rows):
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string())}), path)


LONG = "words of an article that go on for a while and then end here. " * 30


def test_kb_build_reports_and_reruns(spark, tmp_path, caplog):
    documents(tmp_path / "d.parquet", [(1, LONG, "en"), (2, LONG, "fr"), (3, None, "en"), (4, "short", "en"), (5, "x" * 60, "fr"), (6, " ", None), (7, "y" * 60, None)])
    pages(tmp_path / "p.parquet", [(1, "http://portal.example.com/knowledgebase/", f"<h1>T</h1><p>{LONG}</p>"), (2, None, "<a href='x.PDF'>only a file that is described in a few words, no more</a>"), (3, "", "<p>" + "z" * 70 + "</p>")])
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO):
        for n in range(2):
            kb_build.build(spark, str(tmp_path / "d.parquet"), str(tmp_path / "p.parquet"), out)
            got = snapshot(spark, f"{out}/chunks")
            report = {r.name: r.value for r in spark.read.json(f"{out}/report").collect()}
            assert n == 0 or (got, report) == first
            first = got, report
    assert "read" in caplog.text and "wrote" in caplog.text
    assert {k: v for k, v in report.items() if ":" not in k and "chars" not in k and k != "chunks"} == {"read": 10, "empty": 2, "stub": 1, "short": 1, "repeated": 1, "kept": 5}
    assert report["chunks"] == len(got) == sum(v for k, v in report.items() if k.startswith("chunks:"))
    assert {r.doc_id for r in spark.read.parquet(f"{out}/chunks").collect()} == {"doc-1", "doc-5", "doc-7", "page-1", "page-3"}
    ids = [r.chunk_id for r in spark.read.parquet(f"{out}/chunks").collect()]
    assert len(set(ids)) == len(ids)


def test_kb_build_replaces_only_the_categories_asked_for(spark, tmp_path):
    d, p, out = str(tmp_path / "d.parquet"), str(tmp_path / "p.parquet"), str(tmp_path / "out")
    documents(d, [(1, "a" * 60, "en"), (2, "b" * 60, "fr")])
    pages(p, [(1, "", "<p>" + "z" * 70 + "</p>")])
    kb_build.build(spark, d, p, out)
    files = {f.name for f in (tmp_path / "out/chunks/category=en").iterdir()}
    documents(d, [(1, "A" * 60, "en"), (2, "B" * 60, "fr"), (3, "C" * 60, "fr")])
    kb_build.build(spark, d, p, out, {"categories": ["fr"]})
    assert {f.name for f in (tmp_path / "out/chunks/category=en").iterdir()} == files
    assert sorted((r.doc_id, r.text[-1]) for r in spark.read.parquet(f"{out}/chunks").collect()) == [("doc-1", "a"), ("doc-2", "B"), ("doc-3", "C"), ("page-1", "z")]


def test_kb_build_of_empty_tables(spark, tmp_path):
    documents(tmp_path / "d.parquet", [])
    pages(tmp_path / "p.parquet", [])
    for _ in range(2):
        kb_build.build(spark, str(tmp_path / "d.parquet"), str(tmp_path / "p.parquet"), str(tmp_path / "out"))
    assert {r.name: r.value for r in spark.read.json(str(tmp_path / "out/report")).collect()}["chunks"] == 0


def messages(path, rows):
    pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array(["user"] * len(rows)), "text": pa.array([r[2] for r in rows], pa.string())}), path)


SAID = [(1, 0, "que les eau"), (1, 1, "casino now"), (1, 2, "that it."), (2, 0, None), (2, 1, ""), (2, 2, "x" * 1001), (2, 3, "hello"), (2, 3, "hello")]


def test_chat_stream_takes_what_is_new(spark, tmp_path, caplog):
    source = tmp_path / "in"
    source.mkdir()
    messages(source / "a.parquet", SAID)
    take = lambda: chat_stream.run(spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    with caplog.at_level(logging.INFO):
        assert take() == 1
    assert "read" in caplog.text and "wrote" in caplog.text
    rows = lambda: sorted((r.epoch, r.conv_id, r.turn, r.queue) for r in chat_stream.output(spark, str(tmp_path / "out")).collect())
    first = rows()
    assert first == [(0, 1, 0, "beta"), (0, 1, 1, "blocked"), (0, 1, 2, "operator"), (0, 2, 0, "rejected"), (0, 2, 1, "rejected"), (0, 2, 2, "rejected"), (0, 2, 3, "general"), (0, 2, 3, "general")]
    assert take() == 0 and rows() == first
    kept = {f.name for f in (tmp_path / "out/messages").rglob("*.parquet")}
    messages(source / "b.parquet", [(3, 0, "sch keit")])
    assert take() == 1 and rows() == [*first, (1, 3, 0, "gamma")]
    assert kept < {f.name for f in (tmp_path / "out/messages").rglob("*.parquet")}  # what was filed stays as it is
    totals = sorted((r.epoch, r.queue, r.role, r.messages, r.chars) for r in spark.read.parquet(str(tmp_path / "out/totals")).collect())
    assert totals == [(0, "beta", "user", 1, 11), (0, "blocked", "user", 1, 10), (0, "general", "user", 2, 10), (0, "operator", "user", 1, 8), (0, "rejected", "user", 3, 1001), (1, "gamma", "user", 1, 8)]


def test_chat_stream_repeats_a_lost_epoch(spark, tmp_path):
    """The run dies after an epoch is written and before its commit: the next run writes the same epoch again."""
    source = tmp_path / "in"
    source.mkdir()
    messages(source / "a.parquet", SAID)
    out, checkpoint = str(tmp_path / "out"), tmp_path / "checkpoint"
    chat_stream.run(spark, str(source), out, str(checkpoint))
    before = snapshot(spark, f"{out}/messages"), snapshot(spark, f"{out}/totals")
    for f in (checkpoint / "commits").iterdir():  # as if it had not been committed
        f.unlink()
    messages(source / "b.parquet", [(3, 0, "sch keit")])
    assert chat_stream.run(spark, str(source), out, str(checkpoint)) == 2
    after = spark.read.parquet(f"{out}/messages")
    assert sorted(map(str, after.where("epoch = 0").collect())) == before[0] and after.where("epoch = 1").count() == 1
    assert sorted(map(str, spark.read.parquet(f"{out}/totals").where("epoch = 0").collect())) == before[1]


def test_chat_stream_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert chat_stream.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")) == 0
    messages(tmp_path / "in/a.parquet", [])
    assert chat_stream.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")) in (0, 1)


@needs_tables
@pytest.mark.parametrize("name", ["job1_kb_build", "job2_chat_stream"])
def test_job_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_jobs_import_nothing_of_llm():
    for f in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        names = [n for x in ast.walk(ast.parse(f.read_text())) for n in ([a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or "", *(f"{x.module}.{a.name}" for a in x.names)] if isinstance(x, ast.ImportFrom) else [])]
        assert not any("llm" in n or "corpus_pipeline" in n for n in names)


