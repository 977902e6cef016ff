"""Images of web pages by their tree: from the main container where there is one."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from . import lexicon

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Containers by name, then by class, in the order of preference.
CONTAINERS = [("main", None), ("article", None), (None, "content"), (None, "region-content")]


class _Images(HTMLParser):
    """Images with the containers that hold them, from one pass with a stack of open elements.

    Void elements close themselves. An end tag closes the last open element of its name and all within it;
    one without such an element is passed over. What is still open at the end is closed there. Of several
    containers of a kind the first to open counts.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset]] = []  # name, kinds of container that it or an element around it is
        self.first: dict[int, int] = {}  # kind -> number of the element that is this container
        self.n = 0
        self.found: list[tuple[str, frozenset]] = []

    def handle_starttag(self, tag, attrs):
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        around = self.open[-1][1] if self.open else frozenset()
        if tag == "img":
            self.found.append((given.get("src") or given.get("data-src") or "", around))
        self.n += 1
        if tag in VOID:
            return
        classes = given.get("class", "").split()
        for kind, (name, cls) in enumerate(CONTAINERS):
            if kind not in self.first and (tag == name or cls in classes):
                self.first[kind] = self.n
                around = around | {kind}
        self.open.append((tag, around))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break


def images(html: str | None, base: str | None, decoration=tuple(lexicon.DECORATION)) -> list[str]:
    """Absolute addresses of a page's images without decoration, each once: of its container, else of the whole page. An address that is no web address, or none, gives nothing."""
    if not html or not base or not base.startswith("http"):
        return []
    page = _Images()
    page.feed(html)
    page.close()
    kind = min(page.first, default=None)
    out = []
    for src, around in page.found:
        if src and (kind is None or kind in around) and not any(d in src.lower() for d in decoration):
            try:
                out.append(urljoin(base, src))
            except ValueError:  # an address with a broken host
                continue
    return list(dict.fromkeys(out))


def container_images(pages: DataFrame, html: str, base: str, out: str = "images") -> DataFrame:
    """pages with the images of each (array). Equal pages of a batch are parsed once."""
    columns = [c for c in pages.columns if c != out]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns) + f", `{out}` array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, list[str]] = {}
            rows = []
            for x in zip(batch.column(html).to_pylist(), batch.column(base).to_pylist(), strict=True):
                if x not in known:
                    known[x] = images(*x)
                rows.append(known[x])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(rows, pa.list_(pa.string()))], [*columns, out])

    return pages.select(*columns).mapInArrow(run, schema)
