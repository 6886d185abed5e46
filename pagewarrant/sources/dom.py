"""Pages as a table of DOM nodes.

One Arrow pass turns each page into rows in document order.  A start tag opens
an element unless it is void; an end tag closes the nearest open element of its
name or is ignored; nothing is closed implicitly; script and style hold raw
text; character references are decoded.  ``[node_id, subtree_end]`` is a node's
interval in pre-order, so "inside" is a range test or a look into ``ancestors``;
``path`` has the names of the elements that hold it, its own last, and
``suppressed`` whether one of them is hidden by attribute, type or style.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODES = (
    "page_id long, node_id int, parent_id int, depth int, ord int, tag string, attrs map<string,string>, classes array<string>, text string, kind string, ancestors array<int>, path array<string>, "
    "suppressed boolean, subtree_end int"
)
_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("classes", pa.list_(pa.string())), ("text", pa.string()), ("kind", pa.string()), ("ancestors", pa.list_(pa.int32())), ("path", pa.list_(pa.string())), ("suppressed", pa.bool_()), ("subtree_end", pa.int32()),
    ]
)
# Fixed value: styles that suppress an element.
SUPPRESSING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden|content-visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)
#: Characters of a page that are read where a cut-off is asked for.
MAX_CHARS = 120_000


class PageParser(HTMLParser):
    """Reads an unknown ``<![`` declaration as a comment and goes on, where its base class would give up the rest of the page."""

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


class _Tree(PageParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children = [0]

    def _add(self, tag, attrs, text, kind):
        depth = len(self.open)
        path, suppressed = self.rows[self.open[-1]][10:12] if self.open else ([], False)
        if tag is not None:
            path = [*path, tag]
            suppressed = suppressed or "hidden" in attrs or (tag == "input" and attrs.get("type", "").lower() == "hidden") or ("style" in attrs and SUPPRESSING_STYLE.search(attrs["style"]) is not None)
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, depth, self.children[-1], tag, attrs, (attrs.get("class") or "").split() if attrs is not None else [], text, kind, list(self.open), path, suppressed, len(self.rows)])
        self.children[-1] += 1

    def handle_starttag(self, tag, attrs):
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self._add(tag, first, None, "el")
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.children.append(0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, k):
        for i in self.open[k:]:
            self.rows[i][-1] = len(self.rows) - 1
        del self.open[k:], self.children[k + 1 :]

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][4] == tag:
                return self._close(k)

    def handle_data(self, data):
        self._add(None, None, data, "text")

    def handle_comment(self, data):
        self._add(None, None, data, "comment")


def parse(html: str | None) -> list[list]:
    """Node rows of one page, without its id."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._close(0)
    return tree.rows


def _explode(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            rows = [[i, *r] for i, h in zip(batch.column(0).slice(a, 64).to_pylist(), batch.column(1).slice(a, 64).to_pylist()) for r in parse(h)]
            if rows:
                columns = list(zip(*rows))
                columns[6] = [list(x.items()) if x is not None else None for x in columns[6]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def explode_dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_chars: int | None = None) -> DataFrame:
    """``nodes`` of all pages; with ``max_chars`` what lies past that many characters is not read."""
    html = F.col(html_col) if max_chars is None else F.substring(html_col, 1, max_chars)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html")).mapInArrow(_explode, NODES)


def read_pages(spark, path: str) -> DataFrame:
    """A page corpus: parquet with ``page_id, url, html``, or a folder of HTML files named by their path."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("url"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))


def inside(flagged: Column) -> Column:
    """Whether a node or one of its ancestors is among flagged node ids (an array column)."""
    return F.arrays_overlap(F.concat("ancestors", F.array("node_id")), flagged)
