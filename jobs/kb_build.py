"""Builds the knowledge base: texts and web pages become clean, distinct documents, then chunks with ids by category.

    python -m jobs.kb_build --documents DOCS --pages PAGES --out OUT [--config kb_build.json]

Writes below OUT, all by Spark's writers:

* ``chunks`` (Parquet, a folder for each category): doc_id, chunk_index, chunk_count, chunk_id, title, url, section, text;
* ``report`` (JSON lines): what was read, dropped by reason and written, and the chunks of each category.

A second run over the same tables gives the same files' rows. With ``categories`` in the configuration only
those are built, and only their folders are replaced.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lodestone.functions import chunking, text as X
from lodestone.operators import documents as D
from lodestone.sources import folders, readers

log = logging.getLogger("kb_build")
DEFAULTS = json.loads(Path(__file__).with_suffix(".json").read_text())
COLUMNS = ["doc_id", "chunk_index", "chunk_count", "chunk_id", "title", "url", "section", "text", "category"]


def sources(documents: DataFrame, pages: DataFrame, config: dict) -> DataFrame:
    """Both tables in the shape of documents, with ``raw``: what the text was cleaned from."""
    docs = documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("raw"), X.strip(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("source", F.lit("")).alias("title"), F.lit("").alias("url"), F.coalesce("lang", F.lit("")).alias("category")
    )
    address = X.canonical_url("url", config["portal"])
    web = pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("doc_id"), F.col("html").alias("raw"), X.clean_html("html").alias("text"), F.lit("").alias("title"), address.alias("url"), F.lit(config["page_category"]).alias("category"))
    both = docs.unionByName(web).withColumn("doc_type", X.document_type("title"))
    return both if config["categories"] is None else both.where(F.col("category").isin(config["categories"]))


def fate(config: dict):
    """Why a document goes, or ``kept``."""
    least = F.when(F.col("category") == config["page_category"], config["min_page_chars"]).otherwise(config["min_chars"])
    stub = F.coalesce(F.lower("raw").contains(".pdf"), F.lit(False)) & (F.length("text") < 200)
    return F.when(F.col("text") == "", "empty").when(stub, "stub").when(F.length("text") < least, "short").otherwise("kept")


def build(spark: SparkSession, documents: str, pages: str, out: str, config: dict | None = None) -> None:
    """Reads both tables once and writes chunks and report below ``out``."""
    config = DEFAULTS | (config or {})
    read, distinct, wrote = Observation("read"), Observation("distinct"), Observation("wrote")
    found = sources(spark.read.parquet(documents), spark.read.parquet(pages), config).withColumn("fate", fate(config))
    counts = [F.count_if(F.col("fate") == k).alias(k) for k in ("empty", "stub", "short", "kept")]
    found = found.observe(read, F.count("*").alias("documents"), *counts).where("fate = 'kept'")
    one = D.first_of_equal(found, "text", ["doc_id"]).observe(distinct, F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
    chunks = D.with_ids(chunking.chunks(one.select(*readers.DOCUMENT[:5], "doc_id")), config["collection"]).select(*COLUMNS)
    chunks = chunks.observe(wrote, F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    mode = "static" if config["categories"] is None else "dynamic"
    chunks.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("category").parquet(f"{out}/chunks")
    a, b, c = read.get, distinct.get, wrote.get
    rows = [("read", a["documents"]), *[(k, a[k]) for k in ("empty", "stub", "short")], ("repeated", a["kept"] - b["documents"]), ("kept", b["documents"]), ("kept_chars", b["chars"] or 0), ("chunks", c["chunks"]), ("chunk_chars", c["chars"] or 0)]
    log.info("read %s and %s: %s", documents, pages, a)
    log.info("wrote %s/chunks: %s", out, c)
    each = chunk_counts(spark, out).select(F.concat(F.lit("chunks:"), "category").alias("name"), F.col("chunks").alias("value"))
    totals = spark.createDataFrame(rows, "name string, value long")
    totals.unionByName(each).coalesce(1).write.mode("overwrite").json(f"{out}/report")


def chunk_counts(spark: SparkSession, out: str) -> DataFrame:
    """Chunks by category, from the folders' names and the files' footers. No category is empty, though its folder stands for null."""
    try:
        chunks = spark.read.parquet(f"{out}/chunks")
    except Exception as e:  # a table without rows has no folder of a category
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "category string, chunks long")
    return chunks.groupBy(F.coalesce(F.col("category").cast("string"), F.lit("")).alias("category")).agg(F.count("*").alias("chunks"))


def job1_kb_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks after two runs into one new folder."""
    out = folders.new_folder(spark, "kb-build")
    for _ in range(2):
        build(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/pages.parquet", out)
    return spark.read.parquet(f"{out}/chunks").select("doc_id", "chunk_index", "chunk_count", "chunk_id", "category", "url", "section", F.md5("text").alias("md5"))


def job1_sql() -> str:
    """The same chunks, made from a table ``kb`` that takes the place of documents."""
    from lodestone.plans import oracles as O

    clean = O.strip("regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', chr(10), 'g'), chr(10) || '+', chr(10), 'g')")
    ident = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('{DEFAULTS['collection']}|' || doc_id || '|' || chunk_index || '|' || sha1(text)))"
    kb = f"""
raw AS (SELECT 'doc-' || doc_id AS doc_id, text AS r, {O.strip("coalesce(text, '')")} AS text, coalesce(source, '') AS source, '' AS url, coalesce(lang, '') AS category FROM documents
  UNION ALL SELECT 'page-' || page_id, html, {clean}, '', {O.canonical(DEFAULTS["portal"])}, '{DEFAULTS["page_category"]}' FROM pages),
kb AS (SELECT *, 'x' AS lang FROM raw WHERE length(text) >= {DEFAULTS["min_chars"]} AND NOT (contains(lower(r), '.pdf') AND length(text) < 200) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)"""
    made = (O._split() + "," + O._STRUCTURED).replace("documents", "kb").replace("coalesce(st.lang, '')", "coalesce(d.category, '')")
    return f"""WITH RECURSIVE {kb},{made}, h AS (SELECT doc_id, chunk_index, chunk_count, section, text, {ident} AS h FROM sc)
SELECT h.doc_id, chunk_index, chunk_count, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id,
  nullif(category, '') AS category, url, section, md5(h.text) AS md5 FROM h JOIN kb USING (doc_id)"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "pages", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file; its values replace those of kb_build.json")
    x = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("kb_build").getOrCreate()
    try:
        build(spark, x.documents, x.pages, x.out, json.loads(Path(x.config).read_text()) if x.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
