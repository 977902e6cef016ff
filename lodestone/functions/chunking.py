"""Structure-aware chunking: splitter, tables, articles with headings, statutes. Arrow functions over texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .batches import parts

SIZE, OVERLAP = 750, 120
# Where a text may be cut, best first.
SEPARATORS = ["\n\n", "\n- ", "\n* ", "\n1. ", "\n2. ", "\n3. ", "\n4. ", "\n5. ", "\n", ". ", ";\n", "; ", ", ", " "]
# Words in a heading that let a section without images borrow the document's.
INTERACTIVE = ["кнопк", "нажат", "вход", "окно", "шаг", "подать", "загруз", "интерфейс"]
# A markdown table of a head, its rule and at least one row.
TABLE = r"(\|[^\n]+\|\n\|[\s\-:|]+\|\n(?:\|[^\n]+\|\n?)+)"


def _cut(text: str, start: int, size: int, separators: list[str]) -> int:
    """Where the window that begins at start ends."""
    limit = start + size
    if limit >= len(text):
        return len(text)
    for sep in separators:
        at = text.rfind(sep, start, limit)
        if at > start + size // 3:
            return at + len(sep)
    blank = text.rfind(" ", start, limit)
    return blank + 1 if blank > start else limit


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Overlapping windows of at most ``size`` characters that end, if they can, after the best separator."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    out, start, end = [], 0, 0
    while end < len(text):
        end = _cut(text, start, size, separators)
        if piece := text[start:end].strip():
            out.append(piece)
        start = max(start + 1, end - overlap)
    return out


def split_recursive(text: str | None, size: int = 1200, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", "? ", "! ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, divided at the first separator that occurs, the next within what is still too long; neighbours share up to ``overlap`` characters of whole parts."""
    text = text or ""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep = next(s for s in separators if s in text)
    rest = separators[separators.index(sep) + 1 :]
    parts = text.split(sep) if sep else list(text)
    parts = [p + sep for p in parts[:-1]] + parts[-1:] if sep else parts
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if held and sum(map(len, held)) + len(part) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        if len(part) > size:
            out += split_recursive(part, size, overlap, rest or ("",))
            held = []
        else:
            held.append(part)
    out.append("".join(held))
    return [p for p in map(str.strip, out) if p]


def split_table(table: str, size: int = SIZE) -> list[str]:
    """A markdown table in pieces of whole rows that each repeat the two head lines; short ones as they are."""
    lines = [x for x in map(str.strip, table.splitlines()) if x]
    if len(lines) < 3 or len(table) <= size:
        return [table]
    head, rows = "\n".join(lines[:2]), lines[2:]
    room = size - len(lines[0]) - len(lines[1]) - 4
    groups: list[list[str]] = [[]]
    used = 0
    for row in rows:
        if groups[-1] and used + len(row) + 1 > room:
            groups.append([])
            used = 0
        groups[-1].append(row)
        used += len(row) + 1
    return ["\n".join([head, *g]) for g in groups]


_STEP = re.compile(r"\b(Шаг\s+\d+(?:\.\d+)?|Этап\s+\d+)", re.I)
_HEADING = re.compile(r"(?:^|\n)(#{1,4})\s+(.+)")
_TABLE = re.compile(TABLE)
_PART = re.compile(r"(?:^|\n)(\d+\.\s)")
_ARTICLE = re.compile(r"(?:^|\n)(Статья\s+\d+(?:\.\d+)*\.?[^\n]*)", re.I)
_IMAGE = re.compile(r"!\[.*?\]\(([^\s)\"']+)\)")
_TAG = re.compile(r"<img[^>]+src=[\"']([^\"'\s>]+)[\"']", re.I)


def step_number(text: str) -> str | None:
    found = _STEP.search(text)
    return found[1].capitalize() if found else None


def images_of(text: str) -> list[str]:
    return [x for x in dict.fromkeys(_IMAGE.findall(text) + _TAG.findall(text)) if x and not x.startswith("data:")]


def _chunk(doc: dict, where: str, body: str, images: list[str]) -> dict:
    body = body.strip()
    text = f"[Документ: {doc['title']} | Раздел: {where} | Категория: {doc['category']}]\n\n{body}"
    return {"section": where, "step_number": step_number(where) or step_number(body), "images": images, "text": text}


def _sections(text: str) -> Iterator[tuple[str, str]]:
    """(breadcrumb, body with its heading line) of a text with # headings."""
    marks = list(_HEADING.finditer(text))
    stack: list[tuple[int, str]] = []
    intro = text[: marks[0].start()].strip() if marks else ""
    if len(intro) > 20:
        stack.append((2, "Введение"))
        yield "Введение", intro
    for mark, stop in zip(marks, [*[m.start() for m in marks[1:]], len(text)], strict=False):
        level = len(mark[1])
        stack = [s for s in stack if s[0] < level] + [(level, mark[2].strip())]
        yield " > ".join(name for _, name in stack), text[mark.start() : stop].strip()


def chunk_article(doc: dict, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of an instruction: by headings; tables by rows; long sections in numbered parts."""
    text, out = doc.get("text") or "", []
    every = images_of(text)
    for where, body in list(_sections(text)) or [(doc["title"], text)]:
        own = images_of(body) or (every[:2] if any(w in where.split(" > ")[-1].lower() for w in INTERACTIVE) else [])
        table = _TABLE.search(body) if "|" in body and "---" in body else None
        if table:
            for piece in split_text(body[: table.start()], size, overlap):
                out.append(_chunk(doc, where, piece, own))
            for piece in split_table(table[0], size):
                out.append(_chunk(doc, f"{where} (Таблица)", piece, own))
            for piece in split_text(body[table.end() :], size, overlap):
                out.append(_chunk(doc, where, piece, own))
        elif len(body) <= size + overlap:
            if body.strip():
                out.append(_chunk(doc, where, body, own))
        else:
            for i, piece in enumerate(split_text(body, size, overlap), 1):
                out.append(_chunk(doc, f"{where} (Часть {i})", piece, images_of(piece) or own))
    return out


def _law(doc: dict, where: str, body: str, size: int, overlap: int, many: str) -> Iterator[dict]:
    if len(body) <= size + overlap:
        yield _chunk(doc, where, body, [])
        return
    for i, piece in enumerate(split_text(body, size, overlap), 1):
        yield _chunk(doc, many.format(where, i), piece, [])


def chunk_statute(doc: dict, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of a statute: by articles, long ones by numbered parts. What precedes the first article, and the first part of a long one, is left out."""
    text = (doc.get("text") or "").strip()
    marks = list(_ARTICLE.finditer(text))
    if not marks:
        return [_chunk(doc, f"{doc['title']} | Часть {i}", p, []) for i, p in enumerate(split_text(text, size, overlap), 1)]
    out: list[dict] = []
    for mark, stop in zip(marks, [m.start() for m in marks[1:]] + [len(text)], strict=True):
        head, body = mark[1].strip(), text[mark.start() : stop].strip()
        parts = [m.start(1) for m in _PART.finditer(body)] if len(body) > size + overlap else []
        if not parts:
            out += _law(doc, head, body, size, overlap, "{} (Часть {})")
            continue
        for a, b in pairwise([*parts, len(body)]):
            part = body[a:b].strip()
            label = part.split("\n")[0][:15].strip()
            out += _law(doc, f"{head} | Пункт {label}", part, size, overlap, "{} (п.{})")
    return out


_SHAPE = "array<struct<section:string,step_number:string,images:array<string>,text:string>>"
_ARROW = pa.list_(pa.struct([("section", pa.string()), ("step_number", pa.string()), ("images", pa.list_(pa.string())), ("text", pa.string())]))


def split(text, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """``split_text`` as a column of arrays."""

    @pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: split_text(t, size, overlap))

    return run(F.col(text) if isinstance(text, str) else text)


def chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, part_bytes: int = 1 << 20) -> DataFrame:
    """One row for each chunk of documents (doc_id, title, url, category, doc_type, text).

    Statutes (doc_type legislation) and instructions are divided each in their way; chunk_index counts
    from 0 in each document, chunk_count is the document's number of chunks. Documents without text have
    none. A task divides about ``part_bytes`` of texts at a time (or one document).
    """
    columns = ["doc_id", "title", "url", "category", "doc_type"]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns) + f", __c {_SHAPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", part_bytes):
                out = []
                for t, c, k, x in zip(*(part.column(n).to_pylist() for n in ("title", "category", "doc_type", "text")), strict=True):
                    doc = {"title": t or "", "category": c or "", "text": x or ""}
                    out.append(chunk_statute(doc, size, overlap) if k == "legislation" else chunk_article(doc, size, overlap))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(out, _ARROW)], [*columns, "__c"])

    made = documents.select(*columns, "text").mapInArrow(run, schema)
    made = made.select(*columns, F.size("__c").cast("long").alias("chunk_count"), F.posexplode("__c").alias("chunk_index", "c"))
    return made.select(*columns, F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_count", "c.section", "c.step_number", "c.images", "c.text")


@pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return x.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.found.append(data)


@pandas_udf(StringType())
def html_text(x: pd.Series) -> pd.Series:
    """Text nodes of HTML, one to a line, entities resolved."""

    def one(t):
        p = _Texts()
        p.feed(t or "")
        p.close()
        return re.sub("\n+", "\n", "\n".join(p.found)).strip()

    return x.map(one)


def register(spark) -> None:
    """split_text, nfkc and html_text as SQL functions."""

    @pandas_udf("array<string>")
    def split_sql(x: pd.Series) -> pd.Series:
        return x.map(split_text)

    spark.udf.register("split_text", split_sql)
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("html_text", html_text)
