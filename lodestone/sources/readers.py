"""Readers. All have explicit schemas; files that cannot be read give no rows of their own."""

from __future__ import annotations

import importlib.util
import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import text as X

ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("staticId", "id", "largeName", "serviceName", "sectionTypes", "selfServicePortal", "detailText", "previewText", "url")])
REGULATION = T.StructType([T.StructField("pages", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("contentItemId", "displayText", "url")] + [T.StructField("content", T.StructType([T.StructField("html", T.StringType())]))])))])
DOCUMENT = ["text", "title", "url", "category", "doc_type", "file_name", "doc_id"]


def keep_content(df: DataFrame, raw: str, clean: str) -> DataFrame:
    """Without stubs that only link to a pdf (under 200 characters) and texts under 50."""
    stub = F.coalesce(F.lower(raw).contains(".pdf"), F.lit(False)) & (F.length(clean) < 200)
    return df.where(~stub & (F.length(clean) >= 50))


def articles(spark: SparkSession, path: str, portal: str) -> DataFrame:
    """A JSON array of articles as documents; the first content field that is filled counts."""
    df = spark.read.schema(ARTICLE).json(path, multiLine=True)
    df = df.withColumn("raw", X.first_filled("selfServicePortal", "detailText", "previewText"))
    df = keep_content(df.withColumn("text", X.clean_html("raw")), "raw", "text")
    key = F.coalesce(F.nullif("staticId", F.lit("")), F.nullif("id", F.lit("")), F.lit("unknown"))
    title = X.strip(F.coalesce("largeName", F.lit("Без названия")))
    url = X.canonical_url(F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(f"{portal}/knowledgebase/article/details/ais/"), key)), portal)
    return df.select(
        "text", title.alias("title"), url.alias("url"), X.strip(F.coalesce("serviceName", F.lit("kb_article"))).alias("category"), X.document_type(title).alias("doc_type"), F.concat(key, F.lit(".html")).alias("file_name"), F.concat(F.lit("art_"), key).alias("doc_id")
    )


def regulations(spark: SparkSession, path: str, portal: str) -> DataFrame:
    """The pages of a regulations file as documents."""
    df = spark.read.schema(REGULATION).json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.*")
    df = df.withColumn("text", X.clean_html("content.html")).where("coalesce(contentItemId, '') <> '' and length(text) >= 50")
    url = X.canonical_url(F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(f"{portal}/knowledgebase/article/details/cms/"), F.col("contentItemId"))), portal)
    return df.select("text", F.coalesce("displayText", F.lit("")).alias("title"), url.alias("url"), F.lit("regulations").alias("category"), F.lit("legislation").alias("doc_type"), F.concat("contentItemId", F.lit(".html")).alias("file_name"), F.concat(F.lit("reg_"), "contentItemId").alias("doc_id"))


def docx_text(content: bytes) -> str:
    """Paragraphs with text, one to a line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(content: bytes) -> str:
    """The text of pages that have any; needs pypdf."""
    from pypdf import PdfReader

    return "\n".join(t for t in (p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages) if t.strip())


def extracted(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """Of equal files the first by name: file_name, sha, text, and the error of one that cannot be parsed.

    An extractor whose library is missing fails here, on the driver, before any file is read.
    """
    if extract is pdf_text and importlib.util.find_spec("pypdf") is None:
        raise RuntimeError("reading PDF needs pypdf; pass an extractor")

    @pandas_udf("struct<text:string,error:string>")
    def run(x: pd.Series) -> pd.DataFrame:
        def one(content):
            try:
                return extract(bytes(content)), None
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, EOFError) as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(c) for c in x], columns=["text", "error"])

    df = spark.read.format("binaryFile").load(path).withColumn("file_name", F.regexp_extract("path", "[^/]+$", 0)).withColumn("sha", F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy("sha").orderBy("file_name"))
    return df.withColumn("n", first).where("n = 1").withColumn("r", run("content")).select("file_name", "sha", X.strip("r.text").alias("text"), "r.error")


def rejects(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """Files without a document: file_name and why (the parser's error, or too little text)."""
    df = extracted(spark, path, extract).where("text is null or length(text) <= 100")
    return df.select("file_name", F.coalesce("error", F.lit("100 characters of text or fewer")).alias("reason"))


def files(spark: SparkSession, path: str, base_url: str, extract: Callable[[bytes], str], legislation: bool = True) -> DataFrame:
    """Binary files as documents: of equal contents the first by name; texts over 100 characters. ``rejects`` has the others."""
    df = extracted(spark, path, extract).where("length(text) > 100")
    title = F.replace(F.regexp_replace("file_name", "[.][^.]*$", ""), F.lit("_"), F.lit(" "))
    kind = F.when(F.lower(title).rlike("регламент|фз"), "legislation").otherwise("instruction") if legislation else F.lit("instruction")
    return df.select("text", title.alias("title"), X.document_url("file_name", base_url).alias("url"), F.lit("official_docs").alias("category"), kind.alias("doc_type"), "file_name", F.col("file_name").alias("doc_id"))


def union(*sources: DataFrame) -> DataFrame:
    """All documents, with the order of their sources."""
    marked = [s.select(*DOCUMENT, F.lit(i).alias("source_ord")) for i, s in enumerate(sources)]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return out


def records(df: DataFrame, value: str) -> DataFrame:
    """df's other columns with ``record``, a VARIANT: the objects of a string that is a JSON document, an array of them, or one to a line.

    The string is parsed once; elements of an array are taken from the parsed value, not printed and parsed
    again. Lines that are no JSON, and what is no object, give nothing.
    """
    others = [c for c in df.columns if c not in (value, "record")]
    rows = df.withColumn("__s", X.strip(value)).withColumn("__l", F.filter(F.split("__s", r"\r?\n"), lambda x: X.strip(x) != ""))
    # the parser stops at the end of the first value, so a line counts as one by its last character too
    alone = lambda x: ((x.startswith("{") & x.endswith("}")) | (x.startswith("[") & x.endswith("]"))) & F.try_parse_json(x).isNotNull()
    ends = X.strip(F.try_element_at("__l", F.lit(1))), X.strip(F.try_element_at("__l", F.lit(-1)))
    by_line = F.coalesce((F.size("__l") > 1) & (alone(ends[0]) | alone(ends[1])), F.lit(False))
    rows = rows.withColumn("__v", F.when(~by_line, F.try_parse_json("__s")))
    lines = F.transform("__l", lambda x: F.try_parse_json(x))
    listed = F.when(F.schema_of_variant("__v").startswith("ARRAY"), F.try_variant_get("__v", "$", "array<variant>"))
    each = F.coalesce(listed, F.when(F.col("__v").isNotNull(), F.array("__v")).otherwise(lines))
    found = rows.select(*others, F.explode(each).alias("record"))
    return found.where(F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that are a JSON document, an array of them, or one to a line; what is no object is dropped. Files are read in the order of their names where the result is sorted by ``file``."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    found = records(whole, "value")
    return found.select(F.from_json(F.to_json("record"), schema).alias("r")).where("r is not null").select("r.*")


def directory_records(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """file (name), place and record (VARIANT) of all files below a folder, numbered in the order of names and of records within them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).withColumn("path", F.col("_metadata.file_path"))
    rows = records(files, "value").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "path", "record", F.monotonically_increasing_id().alias("__i"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("__i")).cast("long")).select("file", "place", "record")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files by extension: count, bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1))
    return df.groupBy(ext.alias("ext")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def inline(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Documents given in place: title, url, text."""
    df = spark.createDataFrame(rows, "title string, url string, text string")
    return df.select("text", "title", "url", F.lit("kb_article").alias("category"), X.document_type("title").alias("doc_type"), F.lit("").alias("file_name"), F.sha1("url").alias("doc_id"))


def cleaned(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned knowledge base: a JSON array of documents, with an id by address and text."""
    schema = "text string, title string, url string, doc_type string, category string, file_name string"
    df = json_records(spark, path, schema).where("coalesce(text, '') <> ''")
    return df.select("text", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), "category", F.coalesce("doc_type", F.lit("instruction")).alias("doc_type"), "file_name", F.sha1(F.concat_ws("|", "url", "text")).alias("doc_id"))
