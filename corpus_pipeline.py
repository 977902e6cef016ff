"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, packing.

Every stage works on all that the one before it kept. Stages take (spark, docs, sf_dir); each result is
written as Parquet into the cluster's shared folder and reread as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import _bytes, decontaminate, language, ngram_join, packing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language go on; those without a letter (``und``) go."""
    _bytes.small_batches(spark)
    found = language.identify(docs, docs, keep=("text", "lang", "source", "n_chars"))
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id goes on; of rows that share that id, the first in order.

    Rows without doc_id have no links; of equal ones one goes on.
    """
    _bytes.small_batches(spark)
    found = ngram_join.similar_components(docs)
    gone = _bytes.cut_small(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct())
    kept = ngram_join.without(docs.select(*COLUMNS), gone)
    again = _bytes.cut_small(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    met = kept.join(again.withColumnRenamed("doc_id", "again"), same, "left_semi")
    others = F.struct(*[F.col(c) for c in COLUMNS if c != "doc_id"])
    own = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256))  # rows without id are told apart by their texts
    one = met.groupBy("doc_id", own.alias("own")).agg(F.min(others).alias("x")).select("doc_id", "x.*").select(*COLUMNS)
    return kept.join(again.withColumnRenamed("doc_id", "again"), same, "left_anti").unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in an earlier document are cut out; documents of which nothing is left go."""
    _bytes.small_batches(spark)
    found = substring_dedup.remove_repeats(docs, keep=("lang", "source", "n_chars"), with_text=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where("n_removed = 0 or n_removed < n_words").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    _bytes.small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.benchmark_hits(docs, items, keep=("text", "lang", "source", "n_chars")).where("not contaminated").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 token ids."""
    import public_tokenizers

    _bytes.small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]
#: Tokenizing cannot be expressed in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder is removed when the next one has been written from it; the last is read by the result and stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_bytes.shared_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
