"""Text functions as Column expressions. Patterns carry (?U) or (?iU) where letters are not only ASCII."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import lexicon
from .chunking import nfkc


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def first_filled(*cs) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def clean_html(c) -> Column:
    """Tags become line breaks, runs of breaks one; null is empty."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", "\n"), "\n+", "\n")
    return strip(lines)


def squash_marks(c) -> Column:
    c = F.regexp_replace(col(c), "!{2,}", "!")
    return F.regexp_replace(F.regexp_replace(c, "[?]{2,}", "?"), "[.]{3,}", "...")


def canonical_statutes(c, numbers=lexicon.STATUTES) -> Column:
    """``44 фз``, ``44фз`` and the like become ``44-ФЗ``."""
    return F.regexp_replace(col(c), rf"(?iU)\b({'|'.join(numbers)})\s*[-–—]?\s*фз\b", "$1-ФЗ")


def normalize_basic(c) -> Column:
    """Compatibility forms composed, spaces, dashes, quotes and ё to their plain forms, marks squashed, white space single, statutes canonical."""
    c = F.replace(nfkc(col(c)), F.lit("…"), F.lit("..."))
    c = F.translate(c, "    –—−«»“”„ёЁ", "    ---\"\"\"\"\"еЕ")
    return canonical_statutes(strip(F.regexp_replace(squash_marks(c), r"(?U)\s+", " ")))


def present_terms(c, terms: dict[str, str] = lexicon.TERMS) -> Column:
    """Those keys, longest first, that occur as whole words in any case."""
    keys = sorted(terms, key=lambda k: (-len(k), k))
    found = [F.when(F.regexp_like(col(c), F.lit(rf"(?iU)(?<!\w){re.escape(k)}(?!\w)")), F.lit(k)) for k in keys]
    return F.array_compact(F.array(*found))


def expand_terms(c, terms: dict[str, str] = lexicon.TERMS) -> Column:
    """Each whole-word key becomes ``meaning (key as typed)``, in one pass: what is put in is not expanded again.

    Keys are first set between private characters that carry their number, where no shorter key is looked
    for; then all are put in.
    """
    out = col(c)
    keys = sorted(terms, key=lambda k: (-len(k), k))
    for i, k in enumerate(keys):
        outside = f"(?![^{chr(0xE000)}-{chr(0xF000)}]*{chr(0xF000)})"
        out = F.regexp_replace(out, rf"(?iU)(?<!\w)({re.escape(k)})(?!\w){outside}", f"{chr(0xE000 + i)}$1{chr(0xF000)}")
    for i, k in enumerate(keys):
        meaning = terms[k].replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, f"{chr(0xE000 + i)}([^{chr(0xF000)}]*){chr(0xF000)}", f"{meaning} ($1)")
    return out


def search_query(c, terms: dict[str, str] = lexicon.TERMS, model=None) -> Column:
    """The query as it goes to the search: normalised, expanded and marked.

    ``model`` (a function of Columns: the expanded query to a model's answer) may reword it; its answer is
    cleaned, and an empty or null one is passed over.
    """
    own = F.concat(F.lit("search_query: "), expand_terms(normalize_basic(c), terms))
    if model is None:
        return own
    said = strip(F.regexp_replace(clean_model_output(model(expand_terms(normalize_basic(c), terms))), r"(?U)\s+", " "))
    return F.when(F.coalesce(strip(F.lower(said)), F.lit("")).isin("", "search_query:", "search_query"), own).otherwise(said)


def strip_query_prefix(c) -> Column:
    return F.regexp_replace(col(c), r"^search_query:\s*", "")


def clean_model_output(c) -> Column:
    """The text after ``search_query:`` in a model's answer, else its first line with text; fences are dropped."""
    bare = F.regexp_replace(strip(c), r"^```(\w+)?\n?|\n?```$", "")
    marked = strip(F.regexp_extract(bare, r"(?im)^\s*search_query\s*:\s*(.+)$", 1))
    line = strip(F.regexp_extract(bare, r"(?U)([^\n]*\S[^\n]*)", 1))
    plain = F.when(F.lower(line).startswith("search_query:"), line).otherwise(F.concat(F.lit("search_query: "), line))
    return F.when(marked != "", F.concat(F.lit("search_query: "), marked)).otherwise(plain)


def plain_symbols(c) -> Column:
    """Letters of two alphabets, digits, spaces, commas and stops only."""
    c = F.regexp_replace(F.regexp_replace(col(c), "[-/:_\"'()]", " "), "[^0-9A-Za-zА-Яа-яЁё .,]+", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def step_number(c) -> Column:
    """``Шаг 2.1`` or ``Этап 3``, capitalised; null where there is none."""
    found = F.regexp_extract(col(c), r"(?iU)\b(Шаг\s+\d+(?:\.\d+)?|Этап\s+\d+)", 1)
    return F.when(found != "", F.concat(F.upper(F.substring(found, 1, 1)), F.lower(found.substr(F.lit(2), F.length(found)))))


def document_type(title) -> Column:
    return F.when(F.lower(col(title)).rlike("закон|регламент|фз"), "legislation").otherwise("instruction")


def image_links(c) -> Column:
    """Addresses of markdown images, then of img tags; no data: addresses, each once."""
    marked = F.regexp_extract_all(col(c), F.lit(r"!\[.*?\]\(([^\s)\"']+)\)"), 1)
    tagged = F.regexp_extract_all(col(c), F.lit(r"(?i)<img[^>]+src=[\"']([^\"'\s>]+)[\"']"), 1)
    return F.array_distinct(F.filter(F.concat(marked, tagged), lambda x: (x != "") & ~x.startswith("data:")))


def page_images(html, base) -> Column:
    """Images of a page (src, else data-src) that are no decoration, with absolute addresses, each once."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<img\b[^>]*>"), 0)
    src = lambda t: first_filled(F.regexp_extract(t, r"(?i)\ssrc=[\"']([^\"']*)[\"']", 1), F.regexp_extract(t, r"(?i)\sdata-src=[\"']([^\"']*)[\"']", 1))
    kept = F.filter(F.transform(tags, src), lambda s: (s != "") & ~F.lower(s).rlike("|".join(lexicon.DECORATION)))
    site = F.regexp_extract(col(base), "^https?://[^/?#]+", 0)
    folder = F.regexp_extract(col(base), "^https?://[^?#]*/", 0)
    whole = lambda s: (
        F.when(s.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), s).when(s.startswith("//"), F.concat(F.regexp_extract(col(base), "^https?:", 0), s)).when(s.startswith("/"), F.concat(site, s)).otherwise(F.concat(folder, s))
    )
    return F.array_distinct(F.transform(kept, whole))


def urls(c) -> Column:
    """Targets of markdown links, then bare addresses without closing punctuation, each once."""
    linked = F.regexp_extract_all(col(c), F.lit(r"\[[^\]]+\]\((https?://[^)\s]+)\)"), 1)
    bare = F.transform(F.regexp_extract_all(col(c), F.lit(r"https?://[^\s)\]<>\"']+"), 0), lambda x: F.regexp_replace(x, "[).,;:]+$", ""))
    return F.array_distinct(F.concat(linked, bare))


def quote(c) -> Column:
    """Percent-encoding that keeps the slash."""
    return F.replace(F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def canonical_url(c, portal: str, redirects: dict[str, str] | None = None) -> Column:
    """One working form of the addresses of a knowledge base at ``portal``; other addresses stay as they are.

    First rule that fits: nothing -> main page; redirects by substring; regulations page; numbered article;
    lettered article (20 characters or more); media document, its name with spaces for underscores; main
    page; http -> https.
    """
    kb, host = f"{portal}/knowledgebase", portal.split("://")[1]
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", ""), "^['\"<>`]+|['\"<>`]+$", ""), "[).,;:]+$", "")
    number = F.regexp_extract(u, r"knowledgebase/article/(?:details/(?:ais/)?)?(\d+)(?:[/?#]|$)", 1)
    letters = F.regexp_extract(u, r"(?i)knowledgebase/article/(?:details/(?:cms/)?)?([a-z0-9]{20,})(?:[/?#]|$)", 1)
    name = F.replace(strip(F.substring_index(F.try_url_decode(u), "docs/", -1)), F.lit("_"), F.lit(" "))
    out = F.when(F.coalesce(col(c), F.lit("")) == "", f"{kb}/main")
    for part, target in (redirects or {}).items():
        out = out.when(u.contains(part), target)
    return (
        out.when(u.contains("knowledgebase/regulations") | u.contains("knowledgebase/article/regulation"), f"{kb}/article/regulation/cms")
        .when(number != "", F.concat(F.lit(f"{kb}/article/details/ais/"), number))
        .when(letters != "", F.concat(F.lit(f"{kb}/article/details/cms/"), letters))
        .when(F.lower(u).contains("cms/media/docs/"), F.concat(F.lit(f"{portal}/cms/Media/docs/"), quote(name)))
        .when(u.rlike("/knowledgebase/?$") | u.isin(portal, portal + "/"), f"{kb}/main")
        .when(u.startswith("http://" + host), F.concat(F.lit("https://"), u.substr(F.lit(8), F.length(u))))
        .otherwise(u)
    )


def document_url(name, base: str, known: dict[str, str] | None = None) -> Column:
    """The address of a file by name: a known one, else base and the quoted name with spaces for underscores."""
    out = F.concat(F.lit(base), quote(F.replace(col(name), F.lit("_"), F.lit(" "))))
    for k, v in (known or {}).items():
        out = F.when(col(name) == k, v).otherwise(out)
    return out


def after_thinking(c, marker: str = "...done thinking.") -> Column:
    """What follows the marker, if it occurs."""
    at = F.locate(marker, col(c))
    return F.when(at > 0, strip(col(c).substr(at + len(marker), F.length(col(c))))).otherwise(col(c))


def deobfuscate(c) -> Column:
    """Look-alike Latin letters and digits to Cyrillic, separators inside words dropped (an extra, off by default)."""
    same = F.translate(F.lower(col(c)), "aeopcyxkmtbh0@3", "аеорсухкмтвноаз")
    return F.regexp_replace(same, r"(?U)(?<=\b\w)[\s.*_-]+(?=\w\b)", "")


def uuid5(namespace_hex: str, name) -> Column:
    """The name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), col(name).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


#: The DNS namespace of RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def chunk_id(collection: str, doc, index, chunk) -> Column:
    """A stable id of a chunk: the same chunk of the same document always has the same."""
    return uuid5(DNS, F.concat_ws("|", F.lit(collection), col(doc).cast("string"), col(index).cast("string"), F.sha1(col(chunk).cast("binary"))))


def cosine(a, b) -> Column:
    """Cosine in double precision; null where a vector has no length."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v) -> Column:
    """At unit length; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(col(v).cast("array<double>"), lambda x: x / size)).otherwise(col(v).cast("array<double>"))


def tokens(c) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"), 0)


def replaced(c, pattern: str, by) -> Column:
    """The text with each match of the pattern replaced by what ``by`` (a function of Columns) makes of it; nothing is looked at twice."""
    between, found = F.split(col(c), pattern, -1), F.regexp_extract_all(col(c), F.lit(pattern), 0)
    return F.array_join(F.zip_with(between, found, lambda x, m: F.when(m.isNull(), x).otherwise(F.concat(x, by(m)))), "")


def rewrite_links(c, portal: str) -> Column:
    """Markdown links, then bare knowledge-base addresses in a text, each in its canonical form; null is empty."""
    linked, host = r"\[([^\]]+)\]\((https?://[^)]+)\)", re.escape(portal.split("://")[1])
    link = lambda m: F.concat(F.lit("["), F.regexp_extract(m, linked, 1), F.lit("]("), canonical_url(F.regexp_extract(m, linked, 2), portal), F.lit(")"))
    return replaced(replaced(F.coalesce(col(c), F.lit("")), linked, link), rf"(?U)https?://{host}/knowledgebase[^\s)\]<>\"']+", lambda m: canonical_url(m, portal))


def snippet(c, n: int = 120) -> Column:
    """The first characters on one line."""
    return F.translate(F.substring(col(c), 1, n), "\n", " ")
