"""HTML pages to title and text: boilerplate off, one content element chosen, blocks on lines, links by policy.

A page is read once into a flat row of tokens, in which each start tag knows where its element ends. What goes, what is chosen
and what is written are then ranges of that row. The parser is Python's own; pages are handled in Arrow batches, each by
itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Elements that go, elements on lines of their own, elements without an end tag, labels of language switches,
# words with which navigation begins, and content elements by preference.
DROPPED = {"script", "style", "nav", "footer", "header", "form", "aside", "noscript"}
BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
SWITCHES = {"english", "devanagari", "tamil", "telugu", "kannada", "malayalam", "sanskrit", "hindi", "word division"}
NAVIGATION = re.compile(r"(?:meaning\s+of\s+kriti|notation|click\s+here|back\s+to|home\s*page|pronunciation\s+guide|word\s+by\s+word\s+meaning)", re.I)
CONTENT = (("div", "post-body"), ("div", "post"), ("article", ""), ("div", "post-content"))
#: Pages that Spark hands to Python at once (a page is far larger than the usual row), and bytes of them read into objects at once.
BATCH_ROWS, PIECE_BYTES = 500, 1 << 20


@dataclass
class Token:
    """A start tag (with the place behind its element), or a piece of text (tag is empty)."""

    tag: str
    text: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    end: int = 0


class Tokens(HTMLParser):
    """An end tag closes up to its start, if there is one; what is left open ends with the page."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.row: list[Token] = []
        self.open: list[int] = []
        self.feed(page)
        self.close()
        self._shut(0)

    def _shut(self, depth: int) -> None:
        for at in self.open[depth:]:
            self.row[at].end = len(self.row)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.row.append(Token(tag, attrs={k: v or "" for k, v in attrs}, end=len(self.row) + 1))
        if tag not in VOID:
            self.open.append(len(self.row) - 1)

    def handle_endtag(self, tag: str) -> None:
        depth = next((k for k in range(len(self.open) - 1, -1, -1) if self.row[self.open[k]].tag == tag), None)
        if depth is not None:
            self._shut(depth)

    def handle_data(self, data: str) -> None:
        if piece := data.strip():
            self.row.append(Token("", piece))


def _texts(row: list[Token], start: int, end: int) -> list[str]:
    return [x.text for x in row[start:end] if not x.tag]


def _is_switch(row: list[Token], at: int) -> bool:
    """A table of language links: named like one, or with a language in half of its cells or more."""
    if row[at].attrs.get("id", "").strip().lower() in SWITCHES:
        return True
    cells = [k for k in range(at, row[at].end) if row[k].tag == "td"]
    return bool(cells) and 2 * sum("".join(_texts(row, k, row[k].end)).lower() in SWITCHES for k in cells) >= len(cells)


def _without(row: list[Token], gone) -> list[Token]:
    """The row without the elements at whose start gone(place) holds; ends are set anew."""
    keep, at = [], 0
    while at < len(row):
        if row[at].tag and gone(at):
            at = row[at].end
        else:
            keep.append(at)
            at += 1
    place = {old: new for new, old in enumerate(keep)}
    before = [0] * (len(row) + 1)
    for k in range(len(row)):
        before[k + 1] = before[k] + (k in place)
    return [Token(x.tag, x.text, x.attrs, before[x.end]) for x in (row[k] for k in keep)]


def _chosen(row: list[Token]) -> tuple[int, int]:
    """The range of the content element: the first of a kind, if it has text; else the body, else all."""
    for tag, name in CONTENT:
        first = next((k for k, x in enumerate(row) if x.tag == tag and (not name or name in x.attrs.get("class", "").split())), None)
        if first is not None and _texts(row, first, row[first].end):
            return first, row[first].end
    return next(((k, x.end) for k, x in enumerate(row) if x.tag == "body"), (0, len(row)))


def _link(label: str, href: str, base: str | None) -> str:
    """A link's words; its address behind them, unless it stays on the page."""
    stays = href.startswith("#") or (bool(base) and href.startswith(base))
    address = urljoin(base, href) if base and href else href
    return label if stays or not address else f"{label} ({address})"


def _lines(row: list[Token], start: int, end: int, base: str | None) -> str:
    """Pieces side by side; a new line where a block begins or ends, and at a line break."""
    lines: list[list[str]] = [[]]
    ends: set[int] = set()
    at = start
    while at < end:
        if at in ends:
            lines.append([])
        token = row[at]
        at += 1
        if not token.tag:
            lines[-1].append(token.text)
        elif token.tag == "br":
            lines.append([])
        elif token.tag == "a":
            label = " ".join(_texts(row, at, token.end))
            if label and not NAVIGATION.match(label):
                lines[-1].append(_link(label, token.attrs.get("href", "").strip(), base))
            if any(e in ends for e in range(at, token.end)):  # a block that ends within the link
                lines.append([])
            at = token.end
        elif token.tag in BLOCKS:
            lines.append([])
            ends.add(token.end)
    return "\n".join(" ".join(pieces) for pieces in lines if pieces)


def extract(html: str | None, base: str | None = None, most: int | None = None) -> tuple[str | None, str]:
    """(title, text) of a page; `most` cuts the text to so many characters."""
    row = Tokens(html or "").row
    row = _without(row, lambda at: row[at].tag in DROPPED)
    row = _without(row, lambda at: row[at].tag == "table" and _is_switch(row, at))
    title = next(("".join(_texts(row, k, x.end)) for k, x in enumerate(row) if x.tag == "title"), "") or None
    row = _without(row, lambda at: row[at].tag == "title")
    start, end = _chosen(row)
    text = re.sub(r" +", " ", re.sub(r"[\t\x0b\x0c\r]+", " ", _lines(row, start, end, base)))
    return title, re.sub(r"\n\s*\n+", "\n\n", text).strip()[:most]


def _pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose pages have at most `most` bytes, or one page."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, to - at)
        at = to


def _extracted(most: int | None, piece: int = PIECE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, piece):
                made = [extract(h.as_py(), u.as_py(), most) for h, u in zip(part.column("html"), part.column("url"), strict=True)]
                columns = [part.column("page_id").cast(pa.int64()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "title", "text"])
                del made, columns
            pa.default_memory_pool().release_unused()

    return run


def extract_pages(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, title and text of pages(page_id, url, html), whole unless `most` characters are asked for.

    A task's Python holds one batch of pages, of BATCH_ROWS at most, and the objects of PIECE_BYTES of them.
    """
    conf = pages.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(most), "page_id long, title string, text string")
