"""Document filters, deduplication, chunk records and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X


def first_of_equal(df: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Of rows with equal content the first in order. A window limit before the exchange keeps large groups small."""
    by = Window.partitionBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def with_ids(chunks: DataFrame, collection: str) -> DataFrame:
    return chunks.withColumn("chunk_id", X.chunk_id(collection, "doc_id", "chunk_index", "text"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks, chunks with images and with tables, by category."""
    table = F.col("text").contains("|") & F.col("text").contains("---")
    return chunks.groupBy("category").agg(F.count("*").alias("chunks"), F.count_if(F.size("images") > 0).alias("with_images"), F.count_if(table).alias("with_tables"))


def profile(df: DataFrame, text: str, group: str) -> DataFrame:
    """Rows, empty, short and long texts and mean length by group."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < 50)).alias("short"), F.sum(n).cast("long").alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))


def issues(df: DataFrame, keys: list[str], title: str, text: str, raw: str, kinds: str, category: str, top: int = 10) -> DataFrame:
    """The data-quality report of articles: name, rows.

    ``articles``, ``valid`` and ``mean_chars`` (of the valid ones, rounded); ``issue:`` only_pdf_link, no_id,
    no_title, no_text, short_text; ``category:`` the ``top`` commonest, by name among equals; ``section:`` each
    section type (array). An article that only links to a PDF has that issue alone. ``keys``: the first
    that is filled is the id. Valid is what has an id, a title and a text, however short. One pass: an
    article is a few marks, counted where it stands.
    """
    filled = lambda c: F.coalesce(X.strip(c), F.lit("")) != ""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    pdf = F.coalesce(F.lower(raw).contains(".pdf"), F.lit(False)) & (n < 200)
    sound = {"no_id": X.first_filled(*keys) == "", "no_title": ~filled(title), "no_text": n == 0}
    valid = ~pdf & ~sound["no_id"] & ~sound["no_title"] & ~sound["no_text"]
    marks = {"issue:only_pdf_link": pdf, **{f"issue:{k}": ~pdf & c for k, c in sound.items()}, "issue:short_text": ~pdf & (n > 0) & (n < 50), "valid": valid, "articles": F.lit(True)}
    some = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in marks.items()]))
    each = F.concat(some, F.array(F.concat(F.lit("category:"), F.coalesce(F.col(category), F.lit("unknown_category")))), F.transform(F.coalesce(F.col(kinds), F.array().cast("array<string>")), lambda t: F.concat(F.lit("section:"), t)))
    counted = df.select(F.explode(each).alias("name"), F.when(valid, n).alias("n")).groupBy("name").agg(F.count("*").alias("rows"), F.round(F.avg("n")).cast("long").alias("mean"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(F.col("name").startswith("category:")).orderBy(F.desc("rows"), "name")))
    kept = ranked.where(~F.col("name").startswith("category:") | (F.col("r") <= top))
    both = F.when((F.col("name") == "valid") & F.col("mean").isNotNull(), F.array(F.struct("name", "rows"), F.struct(F.lit("mean_chars").alias("name"), F.col("mean").alias("rows")))).otherwise(F.array(F.struct("name", "rows")))
    return kept.select(F.explode(both).alias("x")).select("x.name", "x.rows")


def largest(df: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """The n longest texts, by key among equals."""
    return df.select(key, F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars")).orderBy(F.desc("chars"), key).limit(n)


def url_totals(df: DataFrame, url: str, status: str) -> DataFrame:
    """Distinct addresses, how many answered 200 and 404, and the share of 200 in percent."""
    one = df.where(F.coalesce(F.col(url), F.lit("")) != "").groupBy(url).agg(F.max(status).alias("s"))
    return one.agg(F.count("*").alias("urls"), F.count_if(F.col("s") == 200).alias("ok"), F.count_if(F.col("s") == 404).alias("lost"), F.round(100 * F.count_if(F.col("s") == 200) / F.greatest(F.count("*"), F.lit(1)), 2).alias("percent"))


def latency(df: DataFrame, value: str, group: str) -> DataFrame:
    """Exact mean, median, 95th percentile and minimum."""
    return df.groupBy(group).agg(
        F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.round(F.min(value), 6).alias("least"), F.count("*").alias("n")
    )


def first_preferred(names: DataFrame, column: str, preferences: list[str]) -> DataFrame:
    """The name that contains the earliest preference; none if no name does."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(preferences))):
        rank = F.when(F.col(column).contains(p), i).otherwise(rank)
    return names.withColumn("rank", rank).where("rank is not null").orderBy("rank", column).limit(1).select(column)


def checks(urls: DataFrame, portal: str, banned: str) -> DataFrame:
    """Per answer (answer_id, answer, urls, missing): passed when no banned name, no missing address and at least one address."""
    n = F.size(F.split(F.lower("answer"), banned)) - 1
    return urls.withColumn("mentions", n.cast("long")).withColumn("off_portal", F.size(F.filter("urls", lambda u: ~u.startswith(portal))).cast("long")).withColumn("passed", (n == 0) & (F.col("missing") == 0) & (F.size("urls") > 0))
