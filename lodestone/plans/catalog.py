"""Every query of the engine by name. Each takes (spark, sf_dir); ``oracles`` has SQL that gives the same rows.

The carriers are the synthetic tables, so lexicons here are of their vocabulary; the rules are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import chunking, pages, text as X
from ..operators import answers, automaton, dialogue, documents, embedding, index, quantiles, retrieval, rules
from ..sources import folders, readers, writers
from ..streaming import cache, chat, replay
from . import derived, oracles

# The carriers' lexicons.
ROUTES = {"alpha": ["tion", "the and", "ing"], "beta": ["que", "les", "eau"], "gamma": ["sch", "keit", "der "], "delta": ["ción", "ara", "mente"]}
NODES = {"first": ["the", "and", "of the"], "second": ["der", "die", "in die"], "third": ["les", "que", "de la"], "fourth": ["que", "los", "de la"]}
BONUS = {"third": ["eau", "ette"]}
STEPS = {"first": 2, "second": 1, "third": 3}
OFFENSIVE = ["the|and|le", "und|der"]
AGREE, NEXT, STOP = ["the", "in", "et", "le"], ["tion", "eau", "ung"], ["ingly", "eux", "heit"]
WORDS, PHRASES = ["that it."], ["and the", "de la", "in der"]
PORTAL = "https://ththan.example.com"
CATEGORIES = {"x": ["thnt", "edou", "erst"], "y": ["aux", "onen"], "z": ["tzst", "ción"]}
TERMS = {"the": "definite article", "der": "männlicher Artikel", "les": "article défini pluriel", "of the": "genitive"}
TOP = 4  # hits that answer a question
ROLES = {"user": "Customer", "assistant": "Assistant", "system": "Service"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_quality_filter(spark, d):
    """Pages without stubs, with their document type."""
    from ..sources.readers import keep_content

    p = keep_content(read(spark, d, "pages").withColumn("clean", X.clean_html("html")), "html", "clean")
    return p.select("page_id", F.length("clean").cast("long").alias("n_chars"), X.document_type("url").alias("doc_type"))


def html_clean(spark, d):
    clean = X.clean_html("html")
    return read(spark, d, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("md5"))


def content_dedup_first(spark, d):
    return documents.first_of_equal(read(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "source")


def basic_normalize(spark, d):
    out = X.normalize_basic("text")
    return read(spark, d, "documents").select("doc_id", F.length(out).cast("long").alias("n_chars"), F.md5(out).alias("md5"))


def _split(spark, d):
    made = read(spark, d, "documents").select("doc_id", "lang", "source", chunking.split("text").alias("c"))
    return made.select("doc_id", "lang", "source", F.size("c").cast("long").alias("chunk_count"), F.posexplode("c").alias("i", "chunk")).withColumn("chunk_index", F.col("i").cast("long"))


def split_text_chunks(spark, d):
    return _split(spark, d).select("doc_id", "chunk_index", "chunk_count", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("md5"))


def _structured(spark, d):
    """Chunks of documents as instructions, or statutes where the language is German."""
    df = read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.lit("").alias("url"), F.col("lang").alias("category"), F.when(F.col("lang") == "de", "legislation").otherwise("instruction").alias("doc_type"), "text")
    return chunking.chunks(df)


def chunk_prefix_and_ids(spark, d):
    return documents.with_ids(_structured(spark, d), "docs").select("doc_id", "chunk_index", F.md5("text").alias("md5"), "chunk_id")


def chunk_category_stats(spark, d):
    """Chunks of the whole texts by source."""
    df = _split(spark, d).select(F.col("source").alias("category"), F.col("chunk").alias("text"), X.image_links("chunk").alias("images"))
    return documents.chunk_statistics(df)


def structured_chunks(spark, d):
    return _structured(spark, d).select("doc_id", "chunk_index", "chunk_count", "section", "step_number", F.size("images").cast("long").alias("images"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def keyword_route(spark, d):
    top = rules.best("text", ROUTES)
    return read(spark, d, "conversations").select("conv_id", "turn", top.getField("name").alias("category"), F.coalesce(top.getField("score"), F.lit(0)).cast("long").alias("score"))


def graph_node_match(spark, d):
    top = rules.graph_node("text", NODES, BONUS)
    return read(spark, d, "conversations").select("conv_id", "turn", top.getField("name").alias("node"), top.getField("score").alias("score"))


def guardrail_flags(spark, d):
    g = rules.guardrail("text", OFFENSIVE)
    return read(spark, d, "conversations").select("conv_id", "turn", g.getField("is_blocked").alias("is_blocked"), g.getField("reason").alias("reason"))


LEXICONS = {"offensive": ["zzz"], "words": WORDS, "phrases": PHRASES, "agree": AGREE, "next": NEXT, "stop": STOP, "nodes": NODES, "bonus": BONUS}


def _flags(spark, d):
    return dialogue.flags(read(spark, d, "conversations"), "text", LEXICONS)


def trigger_flags(spark, d):
    return _flags(spark, d).select("conv_id", "turn", "escalate", "agree", "next", "stop")


def term_expand(spark, d):
    out = X.expand_terms("text", TERMS)
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(X.present_terms("text", TERMS)).cast("long").alias("terms"), F.length(out).cast("long").alias("n_chars"), F.md5(out).alias("md5"))


def canonical_url(spark, d):
    return read(spark, d, "pages").select("page_id", X.canonical_url("url", PORTAL).alias("url"))


def extract_urls(spark, d):
    said = F.concat(F.lit("see ["), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") and "), "url", F.lit(". or http://x.example/"), F.col("page_id").cast("string"), F.lit(", too"))
    return read(spark, d, "pages").select("page_id", F.array_join(X.urls(said), " ").alias("urls"))


def image_links(spark, d):
    said = F.concat(F.lit("![a](img/"), F.col("page_id").cast("string"), F.lit(".png) <IMG alt='x' src='"), "url", F.lit("'> ![b](data:1) <img src=\"img/"), F.col("page_id").cast("string"), F.lit('.png">'))
    return read(spark, d, "pages").select("page_id", F.array_join(X.image_links(said), " ").alias("images"))


def _asked(spark, d):
    return read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark, d):
    return retrieval.dense(_asked(spark, d), read(spark, d, "embeddings"), "query_id", "vec_id", "embedding", 5).select("query_id", "vec_id", "score", "rank")


def dense_threshold_filter(spark, d):
    """A label is filtered before the search, scores below a threshold are dropped."""
    points = read(spark, d, "embeddings").where("label = 3")
    return retrieval.dense(_asked(spark, d), points, "query_id", "vec_id", "embedding", 24, threshold=0.1).select("query_id", "vec_id", "score", "rank")


def vector_norms(spark, d):
    v = read(spark, d, "embeddings")
    return v.select("vec_id", F.size("embedding").cast("long").alias("dimension"), F.round(X.norm("embedding"), 6).alias("norm"), F.round(X.l2_normalized("embedding")[0], 6).alias("first"))


def bm25_topk(spark, d):
    hits = retrieval.bm25(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "item_id", k=5)
    return hits.select("item_id", "doc_id", "score", "rank")


def _hybrid(spark, d):
    """Dense and sparse; each list and the fused one hold four times the hits that are kept in the end."""
    texts = tuple(read(spark, d, t).select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    docs, items = (embedding.embed(x, "text", "vector") for x in texts)
    return retrieval.hybrid(docs, items, "doc_id", "item_id", "text", "vector", TOP, texts)


def hybrid_rrf_topk(spark, d):
    """A dense and a sparse ranking, fused."""
    return _hybrid(spark, d).select("item_id", "doc_id", "score", "rank")


def _final(spark, d):
    """The hits that are kept, without texts; they are few, and stored once."""
    hits = folders.stored(_hybrid(spark, d).select("item_id", "doc_id", "score", "rank"), "hits")
    told = read(spark, d, "documents").select("doc_id", "lang", "source", F.lower("text").contains("tion").alias("boosted"))
    hits = retrieval.with_columns_of(hits, told, "doc_id")
    hits = hits.withColumn("wanted", F.when(F.col("item_id") % 3 == 0, "fr").when(F.col("item_id") % 3 == 1, "en"))
    boost = F.when(F.col("boosted"), 0.5).otherwise(0.0)
    return retrieval.boost_and_filter(hits, "item_id", boost, "lang", "wanted", TOP)


def hybrid_boost_postfilter_fallback(spark, d):
    return _final(spark, d).select("item_id", "doc_id", "score", "final_rank", "fell_back")


def context_listagg(spark, d):
    """The texts of the final hits alone are fetched."""
    hits = folders.stored(_final(spark, d).select("item_id", "doc_id", "final_rank"), "final-hits")
    hits = retrieval.with_columns_of(hits, read(spark, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    got = answers.context(hits, "item_id", "final_rank", "source", "lang", "text")
    return got.select("item_id", F.md5("context").alias("md5"))


def citation_dedup(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "example[.]([a-z]+)", 1).alias("query"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return answers.citations(p, "query", "host", "page_id").select("query", "host", "page_id")


def recent_history(spark, d):
    return answers.history(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "back")


def context_relevance(spark, d):
    """Do two longer words of a message occur in the one before it?"""
    c = read(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", rules.relevant("text", "before").alias("relevant"))


def least_loaded_agent(spark, d):
    """Who takes an escalated chat."""
    return answers.assigned(read(spark, d, "supplier"), read(spark, d, "lineitem"), "s_suppkey", "l_suppkey")


def agent_loads(spark, d):
    return answers.least_loaded(read(spark, d, "supplier"), read(spark, d, "lineitem"), "s_suppkey", "l_suppkey")


def workflow_replay(spark, d):
    return dialogue.replay(_flags(spark, d), "conv_id", "turn", STEPS)


def token_stream_assemble(spark, d):
    return dialogue.assembled(dialogue.token_events(read(spark, d, "conversations"), "conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", "n_tokens", F.md5("all_text").alias("md5"))


def cache_lookup_ttl(spark, d):
    """Events as requests: each type and user asks the same. The first and the last answer of each are cached for an hour; the last has replaced the first."""
    e = read(spark, d, "events").withColumn("message", F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")))
    both = e.groupBy("message").agg(F.array(F.min(F.struct("ts", "event_id")), F.max(F.struct("ts", "event_id"))).alias("x")).select("message", F.explode("x").alias("x"))
    cache = both.select(answers.cache_key("message").alias("cache_key"), F.col("x.event_id").cast("string").alias("answer"), F.expr("x.ts - interval 1 day").alias("written"), F.expr("x.ts - interval 23 hours").alias("expires_at"))
    return answers.cached(e, cache, "message", "ts", "written").select("event_id", "hit", "answer")


def dataset_profile(spark, d):
    return documents.profile(read(spark, d, "documents"), "text", "lang")


def latency_percentiles(spark, d):
    return documents.latency(read(spark, d, "events"), "value", "event_type")


def enum_display(spark, d):
    shown = F.create_map(*[F.lit(v) for p in ROLES.items() for v in p])
    return read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(shown[F.col("role")], F.col("role")).alias("role_display"))


def qa_pass_summary(spark, d):
    p = read(spark, d, "pages").select("page_id", F.col("html").alias("answer"), F.array("url").alias("urls"), (F.col("page_id") % 7 == 0).cast("int").alias("missing"))
    checked = documents.checks(p, "http://blog", "spam")
    return checked.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.countDistinct(F.col("urls")[0]).alias("distinct_urls"), F.sum("off_portal").alias("off_portal"), F.sum("mentions").alias("mentions"))


def text_category(spark, d):
    return read(spark, d, "documents").select("doc_id", rules.category("text", CATEGORIES).alias("category"))


def message_validation(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", rules.valid_message("text").alias("valid"))


def state_update(spark, d):
    """Chats (customers) after their orders as partial updates, by date: each sets the balance, urgent ones the segment."""
    old = read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    urgent = F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("urgent "), F.col("o_orderkey").cast("string")))
    new = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round("o_totalprice", 2).alias("c_acctbal"), urgent.alias("c_mktsegment"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return answers.updated(old, new, "c_custkey", "at")


def upsert_by_id(spark, d):
    """The table after an upsert of the French documents, each twice, with new sources; the later one counts."""
    from ..sources.writers import merged

    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    new = docs.where("lang = 'fr'").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("source", F.concat(F.lit("new "), F.col("at").cast("string")))
    return merged(docs, new, "doc_id", "at")


def answer_repair(spark, d):
    """Links to unknown addresses lose them; short answers get the first lines of the source."""
    p = read(spark, d, "pages")
    said = F.concat(F.lit("A ["), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") and [x](http://unknown.example/y).")) 
    fixed = answers.known_links(said, F.array("url"))
    short = F.when(F.col("page_id") % 2 == 0, F.lit("  no ")).otherwise(fixed)
    return p.select("page_id", F.when(answers.invalid_answer(short), answers.fallback_answer(F.concat(F.lit("\n \na\n"), "url", F.lit("\nb\nc\nd\ne\nf")))).otherwise(short).alias("answer"))


def model_output_clean(spark, d):
    """Messages as answers of a model, in five shapes."""
    kind, x = F.col("turn") % 5, F.col("text")
    said = (
        F.when(kind == 0, F.concat(F.lit("```text\nnoise\nSearch_Query:  "), x, F.lit(" \nmore\n```")))
        .when(kind == 1, F.concat(F.lit("\n \n"), x, F.lit("\nsecond line")))
        .when(kind == 2, F.concat(F.lit("```\n"), x, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("search_query: "), x))
        .otherwise(F.lit(" \n "))
    )
    out = X.clean_model_output(said)
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(out).alias("marked"), F.md5(X.strip_query_prefix(out)).alias("plain"))


def first_documents(spark, d):
    """The first ten documents in source order."""
    return read(spark, d, "documents").orderBy("doc_id").limit(10).select("doc_id", "source")


def preferred_model(spark, d):
    return documents.first_preferred(read(spark, d, "part").select("p_brand").distinct(), "p_brand", ["#9", "#55", "#4"])


def link_rewrite(spark, d):
    """Links of a page, of an article and of the main page, whose address is the beginning of the others."""
    own = F.col("page_id").cast("string")
    said = F.concat(F.lit("a [x]("), "url", F.lit(f") b {PORTAL}/knowledgebase/article/12?z c [y](http://{PORTAL[8:]}/q) [m]({PORTAL}/knowledgebase/article/"), own, F.lit(f") {PORTAL}/knowledgebase/ d {PORTAL}/knowledgebase/article/"), own)
    return read(spark, d, "pages").select("page_id", X.rewrite_links(said, PORTAL).alias("text"))


def prompt_assembly(spark, d):
    """Each message with the one before it as history and its own whole text as context."""
    c = read(spark, d, "conversations").withColumn("past", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.md5(answers.prompt("text", "past", "text")).alias("md5"))


def author_roles(spark, d):
    """Orders as messages with their customers' segments as roles."""
    met = answers.with_roles(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey", "c_mktsegment")
    return met.groupBy("c_mktsegment").agg(F.count("*").alias("messages"))


def hash_embeddings(spark, d):
    """Dimension, norm and a digest of the components, in millionths, of each whole text's vector."""
    v = embedding.embed(read(spark, d, "documents").select("doc_id", "text").where("text is not null"), "text", "v")
    digest = F.md5(F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("long").cast("string")), ","))
    return v.select("doc_id", F.size("v").cast("long").alias("dimension"), F.round(X.norm("v"), 6).alias("norm"), digest.alias("md5"))


def index_sparse_weights(spark, d):
    """What an index keeps of each chunk: the number of its vector, terms and the sum of their weights."""
    rows = retrieval.index_rows(read(spark, d, "documents").select("doc_id", "text").where("text is not null"), "doc_id")
    total = F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", F.size("vector").cast("long").alias("dimension"), F.size("sparse").cast("long").alias("terms"), F.round(total, 4).alias("weight"))


def term_idf(spark, d):
    return retrieval.idf(read(spark, d, "documents"))


def _index(spark, d, **options) -> str:
    """A new index of the whole documents with the vectors of ``embeddings`` beside it."""
    path = folders.new_folder(spark, "index")
    index.build_postings(read(spark, d, "documents"), path, "doc_id", **options)
    return path


def indexed_bm25_topk(spark, d):
    """As ``bm25_topk``, from a stored index: postings in blocks with their best weights."""
    hits = index.search_text(spark, _index(spark, d), read(spark, d, "benchmark"), "item_id", "doc_id", k=5)
    return hits.select("item_id", "doc_id", "score", "rank")


def index_terms(spark, d):
    """What the stored index tells of each term: documents, idf, and the best weight over its blocks."""
    path = _index(spark, d)
    best = spark.read.parquet(f"{path}/blocks").where("bucket >= 0").groupBy("term").agg(F.round(F.max(F.col("best")[0]), 6).alias("best"), F.sum("n").cast("long").alias("postings"))
    return spark.read.parquet(f"{path}/terms").select("term", "df", F.round("idf", 6).alias("idf")).join(best, "term")


def celled_dense_topk(spark, d):
    """As ``dense_topk``, from vectors stored by cell; cells that cannot hold a hit are not read."""
    path = folders.new_folder(spark, "cells")
    index.build_vectors(read(spark, d, "embeddings"), path, "vec_id", "embedding", ["label"], cells=32)
    return index.search_vectors(spark, path, _asked(spark, d), "query_id", "vec_id", "embedding", 5).select("query_id", "vec_id", "score", "rank")


def cache_replay_stream(spark, d):
    """Events as a stream of requests in four batches; an answer is cached for 30 hours of event time, and goes with its number of hits."""
    at = F.timestamp_millis(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)"))
    e = read(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("message"), at.alias("at"), F.unix_millis(at).alias("ms"))
    path = folders.new_folder(spark, "cache-stream")
    replay.deal(e, "ms", 4, f"{path}/in")
    with cache.keyed_state(spark):
        replay.run(cache.replayed(replay.arriving(spark, f"{path}/in", e.schema), "message", "event_id", "at", 30 * 3600), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("cache_key", "kind", "id", "at_ms", "hit", "answer", "hits")


def workflow_stream(spark, d):
    """As ``workflow_replay``, with the messages as a stream in three batches; a chat's state outlives them."""
    c = read(spark, d, "conversations").withColumn("seq", F.col("turn")).withColumn("chat_id", F.col("conv_id"))
    path = folders.new_folder(spark, "workflow-stream")
    replay.deal(c, "turn", 3, f"{path}/in")
    flagged = dialogue.flags(replay.arriving(spark, f"{path}/in", c.schema), "text", LEXICONS)
    replay.run(chat.workflow(flagged, STEPS), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").withColumnRenamed("chat_id", "conv_id").select("conv_id", "seq", "action", "active", "step")


def last_message_stream(spark, d):
    """Each chat's last message, merged from a stream in three batches, which then arrives once more."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("md5"))
    path = folders.new_folder(spark, "merge-stream")
    replay.deal(c, "turn", 3, f"{path}/in")
    for again in range(2):  # a second checkpoint: every epoch is repeated
        replay.merge(replay.arriving(spark, f"{path}/in", c.schema), f"{path}/out", "conv_id", "turn", f"{path}/checkpoint-{again}")
    return spark.read.parquet(f"{path}/out").select("conv_id", "turn", "role", "md5")


def upsert_touched_buckets(spark, d):
    """As ``upsert_by_id``, in a table in folders by a hash of the id; only those of changed ids are replaced."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    path = folders.new_folder(spark, "bucketed")
    writers.upsert_touched(spark, docs, path, "doc_id", buckets=8)
    new = docs.where("lang = 'fr'").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("source", F.concat(F.lit("new "), F.col("at").cast("string")))
    writers.upsert_touched(spark, new, path, "doc_id", "at", buckets=8)
    return spark.read.parquet(path).select("doc_id", "lang", "source")


SHARES = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]


def exact_quantiles(spark, d):
    """Quantiles of order totals by status, by selection in passes of range counts."""
    q = quantiles.exact(read(spark, d, "orders"), "o_totalprice", "o_orderstatus", SHARES)
    return q.select("o_orderstatus", "share", F.round("quantile", 4).alias("quantile"), "n")


def sketched_quantiles(spark, d):
    """Quantiles of merged sketches (one for each event type and user), and whether their rank is within 2 percent of the exact one."""
    e = read(spark, d, "events").withColumn("part", F.concat_ws("/", "event_type", "user_id"))
    whole = quantiles.sketches(e, "value", "part").groupBy(F.substring_index("part", "/", 1).alias("event_type")).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    q = quantiles.of_sketches(whole, "event_type", [0.05, 0.5, 0.95])
    met = read(spark, d, "events").join(F.broadcast(q.select("event_type", "share", "quantile")), "event_type").groupBy("event_type", "share")
    ranks = met.agg(F.count_if(F.col("value") < F.col("quantile")).alias("below"), F.count_if(F.col("value") <= F.col("quantile")).alias("upto"), F.count("*").alias("n"))
    return ranks.select("event_type", "share", "n", ((F.col("below") - F.col("share") * F.col("n") <= 0.02 * F.col("n")) & (F.col("share") * F.col("n") - F.col("upto") <= 0.02 * F.col("n"))).alias("within"))


def workflow_fold(spark, d):
    """As ``workflow_replay``, in one pass over sorted messages."""
    return dialogue.replay_sorted(_flags(spark, d), "conv_id", "turn", STEPS)


def container_images(spark, d):
    """Pages with images in and around a container of one kind or none, and tags left open."""
    i = F.col("page_id").cast("string")
    inner = F.concat(F.lit("<p>x<br><img src='in/"), i, F.lit(".png'><div><img data-src='/abs/"), i, F.lit(".png'></p><img src='logo.png'/><img src='in/"), i, F.lit(".png'>"))
    kind = F.col("page_id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("<article>"), inner, F.lit("</article>")))
        .when(kind == 1, F.concat(F.lit("<article><img src='art.png'></article><main>"), inner, F.lit("</main>")))
        .when(kind == 2, F.concat(F.lit("<div class='x content y'>"), inner, F.lit("</div></div>")))
        .when(kind == 3, F.concat(F.lit("<section class='region-content'><p>"), inner, F.lit("</section>")))
        .otherwise(inner)
    )
    html = F.concat(F.lit("<nav><img src='nav.png'><li>a</nav>"), body, F.lit("<footer><img src='foot.png'></footer>"))
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("https://s.example/p/"), i, F.lit("/q?x")).alias("base"), html.alias("html"))
    return pages.container_images(p, "html", "base").select("page_id", F.array_join("images", " ").alias("images"))


def automaton_route(spark, d):
    """As ``keyword_route``, by one automaton of all entries."""
    c = read(spark, d, "conversations")
    top = automaton.best_lists(c, ["conv_id", "turn"], "text", ROUTES)
    return c.select("conv_id", "turn").join(top, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("name").alias("category"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def automaton_nodes(spark, d):
    """As ``graph_node_match``, by one automaton of all entries."""
    c = read(spark, d, "conversations")
    top = automaton.best_lists(c, ["conv_id", "turn"], "text", NODES, lambda w: 3 if " " in w else 1, BONUS, least=2)
    return c.select("conv_id", "turn").join(top, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("name").alias("node"), "score")


def lexicon_hits(spark, d):
    """Documents' hits of a lexicon of all words of the benchmark: entries, as whole words, and how often they occur."""
    words = read(spark, d, "benchmark").select(F.explode(X.tokens("text")).alias("w")).distinct().orderBy("w")
    entries = [r.w for r in words.collect()]  # a stated lexicon, as large as the benchmark
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return automaton.occurrences(docs, "t", entries, whole_words=True).groupBy("doc_id").agg(F.count("*").alias("entries"), F.sum("times").alias("times"))


def variant_records(spark, d):
    """Chats as JSON: an array, an object to a line with noise between, or one object; read back as records."""
    c = read(spark, d, "conversations").withColumn("o", F.to_json(F.struct("conv_id", "turn", "role", F.struct(F.md5("text").alias("md5"), F.length("text").alias("n")).alias("x"))))
    chats = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "o"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["o"]).alias("s"))
    kind = F.col("conv_id") % 3
    value = F.when(kind == 0, F.concat(F.lit(" [5, "), F.array_join("s", ", "), F.lit(', "x", null]\n'))).when(kind == 1, F.concat(F.lit("noise\n"), F.array_join("s", "\r\n{bad\n"), F.lit("\n7\n"))).otherwise(F.col("s")[0])
    r = readers.records(chats.select(value.alias("value")), "value")
    get = lambda path, kind: F.try_variant_get("record", path, kind)
    return r.select(get("$.conv_id", "long").alias("conv_id"), get("$.turn", "long").alias("turn"), get("$.role", "string").alias("role"), get("$.x.md5", "string").alias("md5"), get("$.x.n", "long").alias("n_chars"))


def payload_merge(spark, d):
    """Payloads (maps) of documents after a partial update: its keys replace, empty values go."""
    old = F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("id"), F.col("doc_id").cast("string"))
    new = F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("new"), F.lit("n"), F.col("n_chars").cast("string"))
    kept = writers.merged_payload(old, new)
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("payload"))


_NAMES = [
    "doc_quality_filter", "html_clean", "content_dedup_first", "basic_normalize", "split_text_chunks", "chunk_prefix_and_ids", "chunk_category_stats", "structured_chunks", "keyword_route", "graph_node_match",
    "guardrail_flags", "trigger_flags", "term_expand", "canonical_url", "extract_urls", "image_links", "dense_topk", "dense_threshold_filter", "vector_norms", "bm25_topk", "hybrid_rrf_topk",
    "hybrid_boost_postfilter_fallback", "context_listagg", "citation_dedup", "recent_history", "context_relevance", "least_loaded_agent", "workflow_replay", "token_stream_assemble", "cache_lookup_ttl",
    "dataset_profile", "latency_percentiles", "enum_display", "qa_pass_summary", "text_category", "message_validation", "state_update", "upsert_by_id", "answer_repair", "model_output_clean", "first_documents", "preferred_model",
    "link_rewrite", "prompt_assembly", "author_roles", "hash_embeddings", "agent_loads", "index_sparse_weights", "term_idf", "indexed_bm25_topk", "index_terms", "celled_dense_topk",
    "cache_replay_stream", "workflow_stream", "last_message_stream", "upsert_touched_buckets",
    "exact_quantiles", "sketched_quantiles", "workflow_fold", "container_images", "automaton_route", "automaton_nodes", "lexicon_hits", "variant_records", "payload_merge",
]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top-5 chunks of the first benchmark item."""
    chunks = _split(spark, sf_dir).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk"), F.col("chunk").alias("text"))
    item = read(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    return retrieval.bm25(chunks, item, "chunk", "item_id", k=5).select("item_id", "chunk", "score", "rank")


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES} | derived.queries()


def oracle_sql() -> dict:
    return oracles.sql() | derived.oracle_sql()
