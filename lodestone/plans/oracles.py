"""DuckDB SQL that gives the same rows as the catalog's queries, written apart from their plans."""

from __future__ import annotations

SPACE = "[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}\\x{0b}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _values(lists: dict[str, list[str]], weight=lambda w: 1) -> str:
    return ", ".join(f"('{n}', {i}, '{w}', {weight(w)})" for i, (n, ws) in enumerate(lists.items()) for w in ws)


def _best(lists, weight=lambda w: 1, extra: str = "", least: int = 1, table: str = "conversations", keys: str = "conv_id, turn") -> str:
    """keys, name, score of the best list."""
    return f"""
kw(name, o, w, p) AS (VALUES {_values(lists, weight)}),
hits AS (SELECT {keys}, name, o, sum(p) AS s FROM {table}, kw WHERE contains(lower(text), w) GROUP BY ALL {extra}),
sums AS (SELECT {keys}, name, o, sum(s)::BIGINT AS score FROM hits GROUP BY ALL HAVING sum(s) >= {least}),
best AS (SELECT {keys}, arg_max(name, [score, -o]) AS name, max(score) AS score FROM sums GROUP BY ALL)"""


def _any(words: list[str], x: str = "lower(trim(text))", test: str = "contains") -> str:
    return "(" + " OR ".join(f"{test}({x}, '{w}')" for w in words) + ")"


def _whole(patterns: list[str], x: str = "text") -> str:
    return f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(patterns)})([^\\p{{L}}\\p{{N}}_]|$)')"


def _split() -> str:
    from ..functions.chunking import OVERLAP, SEPARATORS, SIZE

    quoted = lambda s: "'" + s.replace("\n", "'||chr(10)||'") + "'"
    cases = []
    for s in SEPARATORS:
        pos = f"(length(w) - strpos(rw, {quoted(s[::-1])}) + 1 - {len(s)})"
        cases.append(f"WHEN strpos(rw, {quoted(s[::-1])}) > 0 AND {pos} > {SIZE // 3} THEN a + {pos} + {len(s)}")
    blank = "(length(w) - strpos(rw, ' '))"
    cut = f"CASE WHEN a + {SIZE} >= n THEN n {' '.join(cases)} WHEN strpos(rw, ' ') > 0 AND {blank} > 0 THEN a + {blank} + 1 ELSE a + {SIZE} END"
    return f"""
d0 AS (SELECT doc_id, {strip("coalesce(text, '')")} AS t FROM documents), d1 AS (SELECT doc_id, t, length(t) AS n FROM d0 WHERE t <> ''),
r AS (SELECT doc_id, 0 AS i, 0::BIGINT AS a, (SELECT {cut} FROM (SELECT substr(t, 1, {SIZE}) AS w, reverse(substr(t, 1, {SIZE})) AS rw, 0 AS a)) AS z FROM d1
  UNION ALL
  SELECT doc_id, i + 1, a, {cut} FROM (SELECT r.doc_id, r.i, greatest(r.a + 1, r.z - {OVERLAP}) AS a, d1.n, substr(t, greatest(r.a + 1, r.z - {OVERLAP}) + 1, {SIZE}) AS w,
    reverse(substr(t, greatest(r.a + 1, r.z - {OVERLAP}) + 1, {SIZE})) AS rw FROM r JOIN d1 USING (doc_id) WHERE r.z < d1.n)),
c0 AS (SELECT doc_id, i, {strip("substr(t, a + 1, z - a)")} AS chunk FROM r JOIN d1 USING (doc_id)),
c AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_count FROM c0 WHERE chunk <> '')"""


def normalized(x: str) -> str:
    """``x`` normalised, but for statutes and compatibility forms."""
    out = f"translate(replace({x}, '…', '...'), '\u00a0\u2009\u2007\u202f–—−«»“”„ёЁ', '    ---\"\"\"\"\"еЕ')"
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, '!{{2,}}', '!', 'g'), '[?]{{2,}}', '?', 'g'), '[.]{{3,}}', '...', 'g')"
    return strip(f"regexp_replace({out}, '{SPACE}+', ' ', 'g')")


def expanded(table: str) -> str:
    """r: conv_id, turn, terms, t of a table's texts, with the carriers' terms expanded."""
    from . import catalog as C

    return f"""k(k, m) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in C.TERMS.items())}),
          p AS (SELECT conv_id, turn, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?i)of [\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS x FROM {table})),
          q AS (SELECT conv_id, turn, i, CASE WHEN k IS NOT NULL THEN m || ' (' || x || ')' WHEN k2.k2 IS NOT NULL THEN substr(x, 1, 3) || m2 || ' (' || substr(x, 4) || ')' ELSE x END AS x,
            coalesce(k, k2) AS hit FROM p LEFT JOIN k ON lower(x) = k LEFT JOIN (SELECT k AS k2, m AS m2 FROM k) k2 ON lower(x) = 'of ' || k2 AND lower(x) <> 'of the'),
          r AS (SELECT conv_id, turn, string_agg(x, '' ORDER BY i) AS t, count(DISTINCT hit) + CASE WHEN bool_or(hit = 'of the') AND NOT bool_or(hit = 'the') THEN 1 ELSE 0 END AS terms FROM q GROUP BY 1, 2)"""


def canonical(portal: str) -> str:
    """The canonical form of ``url``."""
    kb = f"{portal}/knowledgebase"
    u = "regexp_replace(regexp_replace(url, '^[''\"<>`]+|[''\"<>`]+$', '', 'g'), '[).,;:]+$', '')"
    number = f"regexp_extract({u}, 'knowledgebase/article/(?:details/(?:ais/)?)?(\\d+)(?:[/?#]|$)', 1)"
    return f"""CASE WHEN coalesce(url, '') = '' THEN '{kb}/main' WHEN contains({u}, 'knowledgebase/regulations') OR contains({u}, 'knowledgebase/article/regulation') THEN '{kb}/article/regulation/cms'
      WHEN {number} <> '' THEN '{kb}/article/details/ais/' || {number}
      WHEN regexp_matches({u}, '/knowledgebase/?$') OR {u} IN ('{portal}', '{portal}/') THEN '{kb}/main' WHEN starts_with({u}, 'http://{portal[8:]}') THEN 'https://' || substr({u}, 8) ELSE {u} END"""


def _bm25(k: int, b: float, name: str) -> str:
    return f"""
{name}_s AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * ({1 - b} + {b} * len / mean))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN dt USING (term), mean GROUP BY 1, 2),
{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_TERMS = """
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
dt AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dw) GROUP BY 1, 2),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY 1, 2),
mean AS (SELECT avg(len(t)) AS mean, count(*) AS n FROM dw),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM dt GROUP BY term), mean)"""

_BUCKET = "('0x' || substr(md5(term), 1, 8))::BIGINT % 256"
_SIGNED = "CASE WHEN ('0x' || substr(md5(term), 9, 2))::BIGINT < 128 THEN 1 ELSE -1 END"
_VECTORS = f"""
dv AS (SELECT doc_id, {_BUCKET} AS b, sum({_SIGNED} * tf)::DOUBLE AS v FROM dt GROUP BY 1, 2), dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM dv GROUP BY 1),
qv AS (SELECT item_id, {_BUCKET} AS b, sum({_SIGNED} * qtf)::DOUBLE AS v FROM qt GROUP BY 1, 2), qn AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1)"""

_HYBRID = (
    _TERMS + "," + _bm25(16, 0.75, "r1") + "," + _VECTORS + """,
dots AS (SELECT item_id, doc_id, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (b) GROUP BY 1, 2),
r2_s AS (SELECT qn.item_id, dn.doc_id, round(coalesce(s, 0) / (qn.n * dn.n), 6) AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id WHERE qn.n > 0 AND dn.n > 0),
r2 AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r2_s QUALIFY rank <= 16),
f0 AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2),
f AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f0 QUALIFY rank <= 16)"""
)
_FINAL = (
    _HYBRID + """,
w AS (SELECT f.*, d.text, d.lang, d.source, CASE item_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' END AS wanted FROM f JOIN documents d USING (doc_id)),
x AS (SELECT *, wanted IS NULL OR lang = wanted AS fits, bool_or(wanted IS NULL OR lang = wanted) OVER (PARTITION BY item_id) AS anyfit FROM w),
y AS (SELECT item_id, doc_id, score, text, lang, source, NOT anyfit AS fell_back,
  row_number() OVER (PARTITION BY item_id ORDER BY round(score + CASE WHEN contains(lower(text), 'tion') THEN 0.5 ELSE 0 END, 6) DESC, rank) AS final_rank FROM x WHERE fits OR NOT anyfit QUALIFY final_rank <= 4)"""
)

#: Chunks of documents without headings, tables and articles, as the structured chunkers make them.
_STRUCTURED = """
sp AS (SELECT d.doc_id, d.source, d.lang, c.chunk, c.chunk_index FROM c JOIN documents d USING (doc_id)),
st AS (SELECT doc_id, lang, chunk_index, source || ' | Часть ' || (chunk_index + 1) AS section, chunk FROM sp WHERE lang = 'de'
  UNION ALL SELECT sp.doc_id, sp.lang, chunk_index, sp.source || ' (Часть ' || (chunk_index + 1) || ')', chunk FROM sp JOIN documents d USING (doc_id) WHERE sp.lang IS DISTINCT FROM 'de' AND length(d.text) > 870
  UNION ALL SELECT doc_id, lang, 0, source, body FROM (SELECT doc_id, lang, source, text, %s AS body FROM documents) WHERE lang IS DISTINCT FROM 'de' AND length(text) <= 870 AND body <> ''),
sc AS (SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_count, section, '[Документ: ' || coalesce(d.source, '') || ' | Раздел: ' || section || ' | Категория: ' || coalesce(st.lang, '') || ']' || chr(10) || chr(10) || chunk AS text
  FROM st JOIN documents d USING (doc_id))""" % strip("coalesce(text, '')")


def sql() -> dict[str, str]:
    from . import catalog as C

    clean = strip("regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', chr(10), 'g'), chr(10) || '+', chr(10), 'g')")
    doc_type = "CASE WHEN regexp_matches(lower({}), 'закон|регламент|фз') THEN 'legislation' ELSE 'instruction' END"
    norm = normalized("text")
    ident = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('docs|' || doc_id || '|' || chunk_index || '|' || sha1(text)))"
    bare = strip(r"regexp_replace({0}, '^```(\w+)?\n?|\n?```$', '', 'g')".format(strip("said")))
    u = f"{canonical(C.PORTAL)} AS url FROM pages"
    cosine = "round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6)"
    asked = "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0)"
    ranked = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank"
    phrase = lambda w: 3 if " " in w else 1
    extra = " ".join(f"UNION ALL SELECT conv_id, turn, '{k}', {list(C.NODES).index(k)}, 10 FROM conversations WHERE {' AND '.join(f'''contains(lower(text), '{w}')''' for w in ws)}" for k, ws in C.BONUS.items())
    nodes = _best(C.NODES, phrase, extra, 2)
    low = "lower(trim(text))"
    flags = f"""fl AS (SELECT conv_id, turn, text, {low} IN ('{"', '".join(C.WORDS)}') OR {_any(C.PHRASES)} OR {_whole(["zzz"])} AS escalate,
      {_any(C.AGREE, test="starts_with")} AS agree, {_any(C.NEXT)} AS next, {_any(C.STOP)} AS stop FROM conversations)"""
    total = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.STEPS.items()) + " END"
    opens = "(NOT m.escalate AND m.agree AND s.active IS NULL AND s.suggested IS NOT NULL)"
    action = f"""CASE WHEN m.escalate THEN 'escalate' WHEN {opens} THEN CASE WHEN {total.format("s.suggested")} IS NULL THEN 'missing' WHEN {total.format("s.suggested")} <= 0 THEN 'finish' ELSE 'start' END
      WHEN s.active IS NOT NULL AND m.stop THEN 'stop' WHEN s.active IS NOT NULL AND (m.next OR m.agree) THEN CASE WHEN {total.format("s.active")} IS NULL THEN 'missing' WHEN s.step >= {total.format("s.active")} THEN 'finish' ELSE 'step' END
      ELSE 'answer' END"""
    said = "'see [' || page_id || '](' || url || ') and ' || url || '. or http://x.example/' || page_id || ', too'"
    images = "'![a](img/' || page_id || '.png) <IMG alt=''x'' src=''' || url || '''> ![b](data:1) <img src=\"img/' || page_id || '.png\">'"
    links = f"list_concat(regexp_extract_all(t, '\\[[^\\]]+\\]\\((https?://[^)\\s]+)\\)', 1), list_transform(regexp_extract_all(t, 'https?://[^\\s)\\]<>\"'']+'), lambda x: regexp_replace(x, '[).,;:]+$', '')))"
    tags = "list_filter(list_concat(regexp_extract_all(t, '!\\[.*?\\]\\(([^\\s)\"'']+)\\)', 1), regexp_extract_all(t, '(?i)<img[^>]+src=[\"'']([^\"''\\s>]+)[\"'']', 1)), lambda x: NOT starts_with(x, 'data:'))"
    found = {
        "doc_quality_filter": f"SELECT page_id, length(c)::BIGINT AS n_chars, {doc_type.format('url')} AS doc_type FROM (SELECT *, {clean} AS c FROM pages) WHERE NOT (contains(lower(html), '.pdf') AND length(c) < 200) AND length(c) >= 50",
        "html_clean": f"SELECT page_id, length(c)::BIGINT AS n_chars, md5(c) AS md5 FROM (SELECT page_id, {clean} AS c FROM pages)",
        "content_dedup_first": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1",
        "basic_normalize": f"SELECT doc_id, length(c)::BIGINT AS n_chars, md5(c) AS md5 FROM (SELECT doc_id, {norm} AS c FROM documents)",
        "split_text_chunks": f"WITH RECURSIVE {_split()} SELECT doc_id, chunk_index, chunk_count, length(chunk)::BIGINT AS n_chars, md5(chunk) AS md5 FROM c",
        "chunk_prefix_and_ids": f"""WITH RECURSIVE {_split()}, {_STRUCTURED}, h AS (SELECT doc_id, chunk_index, text, {ident} AS h FROM sc)
          SELECT doc_id, chunk_index, md5(text) AS md5, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h""",
        "structured_chunks": f"""WITH RECURSIVE {_split()}, {_STRUCTURED}
          SELECT doc_id, chunk_index, chunk_count, section, NULL::VARCHAR AS step_number, 0::BIGINT AS images, length(text)::BIGINT AS n_chars, md5(text) AS md5 FROM sc""",
        "chunk_category_stats": f"WITH RECURSIVE {_split()} SELECT source AS category, count(*) AS chunks, count(*) FILTER (regexp_matches(chunk, '!\\[.*?\\]\\([^\\s)\"'']+\\)|(?i)<img[^>]+src=')) AS with_images, count(*) FILTER (contains(chunk, '|') AND contains(chunk, '---')) AS with_tables FROM c JOIN documents USING (doc_id) GROUP BY source",
        "term_expand": f"WITH {expanded('conversations')} SELECT conv_id, turn, terms::BIGINT AS terms, length(t)::BIGINT AS n_chars, md5(t) AS md5 FROM r",
        "keyword_route": f"WITH {_best(C.ROUTES)} SELECT conv_id, turn, name AS category, coalesce(score, 0)::BIGINT AS score FROM conversations LEFT JOIN best USING (conv_id, turn)",
        "graph_node_match": f"WITH {nodes} SELECT conv_id, turn, name AS node, score::BIGINT AS score FROM conversations LEFT JOIN best USING (conv_id, turn)",
        "guardrail_flags": f"SELECT conv_id, turn, b AS is_blocked, CASE WHEN b THEN 'toxicity' END AS reason FROM (SELECT conv_id, turn, {_whole(C.OFFENSIVE)} AS b FROM conversations)",
        "trigger_flags": f"WITH {flags} SELECT conv_id, turn, escalate, agree, next, stop FROM fl",
        "canonical_url": f"SELECT page_id, {u}",
        "extract_urls": f"WITH s AS (SELECT page_id, {said} AS t FROM pages), l AS (SELECT page_id, {links} AS l FROM s), o AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), m AS (SELECT page_id, x, min(i) AS i FROM o GROUP BY 1, 2) SELECT page_id, string_agg(x, ' ' ORDER BY i) AS urls FROM m GROUP BY 1",
        "image_links": f"WITH s AS (SELECT page_id, {images} AS t FROM pages), l AS (SELECT page_id, {tags} AS l FROM s), o AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), m AS (SELECT page_id, x, min(i) AS i FROM o GROUP BY 1, 2) SELECT page_id, string_agg(x, ' ' ORDER BY i) AS images FROM m GROUP BY 1",
        "dense_topk": f"WITH {asked}, s AS (SELECT query_id, vec_id, {cosine} AS score FROM q, embeddings p) SELECT query_id, vec_id, score, {ranked} FROM s QUALIFY rank <= 5",
        "dense_threshold_filter": f"WITH {asked}, s AS (SELECT query_id, vec_id, {cosine} AS score FROM q, embeddings p WHERE label = 3) SELECT query_id, vec_id, score, {ranked} FROM s WHERE score >= 0.1 QUALIFY rank <= 24",
        "vector_norms": "SELECT vec_id, len(embedding)::BIGINT AS dimension, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, embedding, embedding::DOUBLE[] AS e FROM embeddings)",
        "bm25_topk": f"WITH {_TERMS}, {_bm25(5, 0.75, 'r')} SELECT item_id, doc_id, score, rank FROM r",
        "hybrid_rrf_topk": f"WITH {_HYBRID} SELECT item_id, doc_id, score, rank FROM f",
        "hybrid_boost_postfilter_fallback": f"WITH {_FINAL} SELECT item_id, doc_id, score, final_rank, fell_back FROM y",
        "context_listagg": f"WITH {_FINAL} SELECT item_id, md5(string_agg('### ' || source || ' (' || lang || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY final_rank)) AS md5 FROM y GROUP BY item_id",
        "citation_dedup": "SELECT query, host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, 'example[.]([a-z]+)', 1) AS query, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages) WHERE host <> '' GROUP BY 1, 2",
        "recent_history": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back BETWEEN 2 AND 5",
        "context_relevance": "WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, coalesce(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3 AND contains(lower(before), w))) >= 2, false) AS relevant FROM c",
        "least_loaded_agent": "SELECT s_suppkey, count(l_suppkey)::BIGINT AS active_chats, false AS created FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey ORDER BY active_chats, s_suppkey LIMIT 1",
        "agent_loads": "SELECT s_suppkey, count(l_suppkey)::BIGINT AS active_chats FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey",
        "workflow_replay": f"""WITH RECURSIVE {nodes}, {flags},
          m AS (SELECT conv_id, turn, escalate, agree, next, stop, coalesce(name, 'general_guide') AS node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM fl LEFT JOIN best USING (conv_id, turn)),
          s AS (SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, NULL::VARCHAR AS action, NULL::VARCHAR AS active, 0::BIGINT AS step, NULL::VARCHAR AS suggested FROM conversations GROUP BY conv_id
            UNION ALL
            SELECT conv_id, k, turn, a, CASE WHEN o THEN suggested WHEN a IN ('stop', 'finish', 'missing') THEN NULL ELSE active END,
              CASE WHEN a = 'start' THEN 1 WHEN a = 'step' THEN step + 1 WHEN a = 'stop' OR o THEN 0 WHEN a = 'finish' THEN {total.format("active")} ELSE step END, CASE WHEN a = 'answer' THEN node ELSE suggested END
            FROM (SELECT s.conv_id, m.k, m.turn, s.active, s.step, s.suggested, m.node, {opens} AS o, {action} AS a FROM s JOIN m ON m.conv_id = s.conv_id AND m.k = s.k + 1))
          SELECT conv_id, turn AS seq, action, active, step FROM s WHERE k > 0""",
        "token_stream_assemble": "SELECT conv_id, turn, len(regexp_extract_all(text, '\\s|[^\\s]+\\s?'))::BIGINT AS n_tokens, md5(text) AS md5 FROM conversations WHERE text <> ''",
        "cache_lookup_ttl": "WITH e AS (SELECT *, event_type || ' ' || user_id AS m FROM events), c AS (SELECT m, max(ts) - INTERVAL 23 HOUR AS until, arg_max(event_id, (ts, event_id))::VARCHAR AS answer FROM e GROUP BY m) SELECT event_id, until > ts AS hit, CASE WHEN until > ts THEN answer END AS answer FROM e JOIN c USING (m)",
        "dataset_profile": "SELECT lang, count(*) AS rows, count(*) FILTER (length(coalesce(text, '')) = 0) AS empty, count(*) FILTER (length(text) BETWEEN 1 AND 49) AS short, sum(length(text))::BIGINT AS chars, round(avg(length(coalesce(text, ''))), 6) AS mean_chars FROM documents GROUP BY lang",
        "latency_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS least, count(*) AS n FROM events GROUP BY event_type",
        "enum_display": "SELECT conv_id, turn, CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ROLES.items()) + " ELSE role END AS role_display FROM conversations",
        "qa_pass_summary": "WITH p AS (SELECT url, (length(lower(html)) - length(replace(lower(html), 'spam', ''))) // 4 AS n, page_id % 7 = 0 AS missing FROM pages) SELECT count(*) AS total, count(*) FILTER (n = 0 AND NOT missing) AS passed, count(DISTINCT url) AS distinct_urls, count(*) FILTER (NOT starts_with(url, 'http://blog')) AS off_portal, sum(n)::BIGINT AS mentions FROM p",
        "text_category": f"WITH {_best(C.CATEGORIES, table='documents', keys='doc_id')} SELECT doc_id, name AS category FROM documents LEFT JOIN best USING (doc_id)",
        "message_validation": "SELECT conv_id, turn, coalesce(length(text) BETWEEN 1 AND 1000, false) AS valid FROM conversations",
        "state_update": "WITH n AS (SELECT o_custkey, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS x, 'urgent ' || arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (starts_with(o_orderpriority, '1')) AS seg FROM orders GROUP BY 1) SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(x, round(c_acctbal, 2)) AS c_acctbal FROM customer FULL JOIN n ON o_custkey = c_custkey",
        "upsert_by_id": "SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN 'new 2' ELSE source END AS source FROM documents",
        "answer_repair": "WITH a AS (SELECT page_id, url, 'A [' || page_id || '](' || url || ') and x.' AS fixed FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 OR length(fixed) < 20 THEN 'a' || chr(10) || url || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'e' ELSE fixed END AS answer FROM a",
        "model_output_clean": f"""WITH s AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '```text' || chr(10) || 'noise' || chr(10) || 'Search_Query:  ' || text || ' ' || chr(10) || 'more' || chr(10) || '```' WHEN 1 THEN chr(10) || ' ' || chr(10) || text || chr(10) || 'second line'
            WHEN 2 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 3 THEN 'search_query: ' || text ELSE ' ' || chr(10) || ' ' END AS said FROM conversations),
          b AS (SELECT conv_id, turn, {bare} AS bare FROM s), m AS (SELECT *, {strip("regexp_extract(bare, '(?im)^[ \t]*search_query[ \t]*:[ \t]*(.+)$', 1)")} AS marked, {strip("list_filter(string_split(bare, chr(10)), lambda x: " + strip("x") + " <> '')[1]")} AS line FROM b),
          o AS (SELECT conv_id, turn, CASE WHEN marked <> '' THEN 'search_query: ' || marked WHEN starts_with(lower(line), 'search_query:') THEN line ELSE 'search_query: ' || coalesce(line, '') END AS x FROM m)
          SELECT conv_id, turn, md5(x) AS marked, md5(regexp_replace(x, '^search_query:\\s*', '')) AS plain FROM o""",
        "first_documents": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 10",
        "link_rewrite": f"SELECT page_id, 'a [x](' || {canonical(C.PORTAL)} || ') b {C.PORTAL}/knowledgebase/article/details/ais/12 c [y]({C.PORTAL}/q) [m]({C.PORTAL}/knowledgebase/article/details/ais/' || page_id || ') {C.PORTAL}/knowledgebase/main d {C.PORTAL}/knowledgebase/article/details/ais/' || page_id AS text FROM pages",
        "prompt_assembly": """WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS past FROM conversations)
          SELECT conv_id, turn, md5(CASE WHEN past <> '' THEN '### History' || chr(10) || past || chr(10) || chr(10) ELSE '' END || '### Context' || chr(10) || text || chr(10) || chr(10) || '### Question' || chr(10) || text) AS md5 FROM c""",
        "author_roles": "SELECT c_mktsegment, count(*) AS messages FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "hash_embeddings": f"""WITH {_TERMS}, {_VECTORS}, u AS (SELECT doc_id, b, v / n AS x FROM dv JOIN dn USING (doc_id) WHERE n > 0),
          g AS (SELECT d.doc_id, i, coalesce(x, 0) AS x FROM documents d, unnest(range(256)) AS r(i) LEFT JOIN u ON u.doc_id = d.doc_id AND u.b = i WHERE text IS NOT NULL)
          SELECT doc_id, 256::BIGINT AS dimension, round(sqrt(sum(x * x)), 6) AS norm, md5(string_agg(round(x * 1000000)::BIGINT, ',' ORDER BY i)) AS md5 FROM g GROUP BY doc_id""",
        "index_sparse_weights": f"WITH {_TERMS} SELECT d.doc_id, 256::BIGINT AS dimension, count(term) AS terms, round(coalesce(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 0), 4) AS weight FROM documents d LEFT JOIN dt USING (doc_id), mean WHERE text IS NOT NULL GROUP BY 1",
        "term_idf": f"WITH {_TERMS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM dt GROUP BY term), mean",
        "preferred_model": "SELECT p_brand FROM (SELECT DISTINCT p_brand, CASE WHEN contains(p_brand, '#9') THEN 0 WHEN contains(p_brand, '#55') THEN 1 WHEN contains(p_brand, '#4') THEN 2 END AS r FROM part) WHERE r IS NOT NULL ORDER BY r, p_brand LIMIT 1",
    }
    found["indexed_bm25_topk"], found["celled_dense_topk"] = found["bm25_topk"], found["dense_topk"]
    found["index_terms"] = f"WITH {_TERMS} SELECT term, count(*) AS df, round(any_value(idf), 6) AS idf, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS best, count(*)::BIGINT AS postings FROM dt JOIN idf USING (term), mean GROUP BY term"
    found["workflow_stream"], found["upsert_touched_buckets"] = found["workflow_replay"], found["upsert_by_id"]
    found["workflow_fold"], found["automaton_route"], found["automaton_nodes"] = found["workflow_replay"], found["keyword_route"], found["graph_node_match"]
    found["exact_quantiles"] = " UNION ALL ".join(f"SELECT o_orderstatus, {p}::DOUBLE AS share, round(quantile_cont(o_totalprice, {p}), 4) AS quantile, count(*) AS n FROM orders GROUP BY o_orderstatus" for p in C.SHARES)
    found["sketched_quantiles"] = "SELECT event_type, share, count(*) AS n, true AS within FROM events, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS p(share) GROUP BY event_type, share"
    inner = "'https://s.example/p/' || page_id || '/in/' || page_id || '.png https://s.example/abs/' || page_id || '.png'"
    found["container_images"] = f"SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'https://s.example/p/' || page_id || '/nav.png ' ELSE '' END || {inner} || CASE WHEN page_id % 5 = 4 THEN ' https://s.example/p/' || page_id || '/foot.png' ELSE '' END AS images FROM pages"
    found["lexicon_hits"] = "WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), t AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY ALL) SELECT doc_id, count(*) AS entries, sum(n)::BIGINT AS times FROM t JOIN l USING (w) GROUP BY doc_id"
    found["variant_records"] = "SELECT conv_id, turn, role, md5(text) AS md5, length(text)::BIGINT AS n_chars FROM conversations QUALIFY conv_id % 3 <> 2 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"
    found["payload_merge"] = "SELECT doc_id, 'id=' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',lang=new' END || CASE WHEN n_chars IS NULL THEN '' ELSE ',n=' || n_chars END || CASE WHEN coalesce(source, '') = '' THEN '' ELSE ',source=' || source END AS payload FROM documents"
    found["last_message_stream"] = "SELECT conv_id, turn, role, md5(text) AS md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
    found["cache_replay_stream"] = """WITH RECURSIVE e AS (SELECT event_type || ' ' || user_id AS m, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
      s AS (SELECT m, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS t, NULL::BOOLEAN AS hit, NULL::BIGINT AS answer, NULL::BIGINT AS until FROM e GROUP BY m
        UNION ALL SELECT s.m, e.k, e.event_id, e.t, h, CASE WHEN h THEN s.answer ELSE e.event_id END, CASE WHEN h THEN s.until ELSE e.t + 108000000 END
        FROM (SELECT *, k + 1 AS next FROM s) s JOIN e ON e.m = s.m AND e.k = s.next, LATERAL (SELECT coalesce(e.t < s.until, false) AS h)),
      r AS (SELECT * FROM s WHERE k > 0)
      SELECT m AS cache_key, 'request' AS kind, id, t AS at_ms, hit, CASE WHEN hit THEN answer END AS answer, NULL::BIGINT AS hits FROM r
      UNION ALL SELECT m, 'expired', answer, max(until), NULL, answer, count(*) FILTER (hit) FROM r GROUP BY m, answer HAVING max(until) < (SELECT max(t) FROM e)"""
    return found
