"""Main text of web pages by consensus host paths.

Each page scores all its containers by the text they hold outside links, less what they hold in
links and furniture, so an article cut into nested parts is found as a whole and a wrapper of the
page is not.  The best container is widened to the article it is part of: the article element
around it, or the nearest container that adds a heading or a paragraph of its own.

The page names the result by its generalised path: tags with their classes, digits taken out.
Spark sums the text by host and path, and by host, layout (the set of a page's container paths) and
path.  A layout of LAYOUT_PAGES pages or more follows its own strongest path, other pages that of
their host, and pages without a host their own.  Every page is extracted again from the containers
on its path; a page without text there is extracted from its own best container.

Inside the winning container everything that is no article text is left out: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments, told by tag, role or class.

Votes are summed by partial aggregation, so a host with a third of all pages is no hot key; the
winners (one row a host, and one a layout that differs from its host) are broadcast only below a
checked number of rows.

Defined cases: null or empty html has empty text; pages without a host vote alone; repeated
pages are extracted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import materialize

BROADCAST_ROWS = 1_000_000
LEAST_CHARS = 25  # shorter blocks count less for a container
SHORT_SHARE = 0.1
NOISE_COST = 2  # of a character in links or furniture, against one of text
LAYOUT_PAGES = 3  # fewer pages of a layout follow their host

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video select option textarea "
    "button form nav header footer aside menu dialog".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary center hr nav header footer aside form fieldset".split()
)
CONTAINERS = frozenset("body main article section div td".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADINGS = CLOSED_BY_BLOCK - {"p"}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notices?|alert|popup|modal"
    r"|overlay|comments?|replies|respond|disqus|side-?bar|menu|nav|navigation|navbar|breadcrumbs?|pagination|pager"
    r"|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|toolbar|widget)"
    r"(?:$|[\s_-])",
    re.I,
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# an attribute is a name and perhaps a value; a value without quotes ends at white space or the tag's end
_WHITE = r"[ \t\n\f\r]"
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_GIVEN = rf"{_WHITE}*+={_WHITE}*+"
_BARE = r"""(?!["'])[^ \t\n\f\r>]++"""
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:{_GIVEN}(?:"([^"]*+)"|'([^']*+)'|({_BARE}))?+)?+""")
_ATTRIBUTES = rf"""(?:[ \t\n\f\r/]++|{_NAME}(?:{_GIVEN}(?:"[^"]*+"|'[^']*+'|{_BARE})?+)?+)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)({_ATTRIBUTES})(?:>|\Z)",
    re.S,
)
_DIGITS = re.compile(r"\d+")


class Page:
    """Blocks of a page, each with its text, the characters of it in links, and its element."""

    def __init__(self, html: str) -> None:
        self.path = [""]  # of each element
        self.parent = [-1]
        self.left_out = [False]
        self.is_container = [False]
        self.tag = [""]
        self.furniture = [0]  # characters left out in each element
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [(0, "")]
        self._text: list[str] = []
        self._linked, self._in_link = 0, 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = _TOKEN.search(html, at)
            if not found:
                self._add(html[at:])
                break
            self._add(html[at : found.start()])
            at = found.end()
            closing, name, attributes = found.group(1, 2, 3)
            if not name:
                continue
            name = name.lower()
            if closing:
                self._close(name)
                continue
            if name == "br":
                self._text.append(" ")
            self._start(name, attributes)
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
                self._close(name)
        self._flush()

    def _add(self, text: str) -> None:
        if not text:
            return
        element = self._open[-1][0]
        if self.left_out[element]:
            self.furniture[element] += len(text.strip())
            return
        self._text.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html_module.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._open[-1][0], text, self._linked))
            self._text = []
        self._linked = 0

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            if self._open[-1][1] in CLOSED_BY_BLOCK or any(n in CLOSED_BY_BLOCK for _, n in self._open[-4:]):
                self._close_open_paragraph()
        if name in VOID:
            return
        given: dict[str, str] = {}
        for key, double, single, bare in _ATTRIBUTE.findall(attributes):
            given.setdefault(key.lower(), double or single or bare)  # the first of a name counts
        classes = given.get("class", "")
        up = self._open[-1][0]
        if name in BLOCKS or name in SKIPPED or classes:
            label = name + "".join(f".{c}" for c in sorted(_DIGITS.sub("#", classes.lower()).split()))
            self.path.append(self.path[up] if name == "html" else f"{self.path[up]}>{label}")  # a tag often left out
            self.parent.append(up)
            self.left_out.append(
                self.left_out[up]
                or name in SKIPPED
                or "hidden" in given
                or given.get("role", "").lower() in FURNITURE_ROLES
                or bool(name not in ("html", "body", "article", "main") and classes and FURNITURE.search(classes))
                or bool(name in CONTAINERS and name not in ("body", "main") and FURNITURE.search(given.get("id", "")))
            )
            self.is_container.append(name in CONTAINERS)
            self.tag.append(name)
            self.furniture.append(0)
            up = len(self.path) - 1
        self._open.append((up, name))
        self._in_link += name == "a"

    def _close_open_paragraph(self) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][1] in CLOSED_BY_BLOCK:
                self._drop(k)
                return
            if self._open[k][1] in BLOCKS:
                return

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][1] == name:
                self._drop(k)
                return
            if self._open[k][1] in BLOCKS and name not in BLOCKS and name not in SKIPPED:
                return  # an inline end tag closes nothing outside its block

    def _drop(self, k: int) -> None:
        self._in_link -= sum(n == "a" for _, n in self._open[k:])
        del self._open[k:]

    def best(self) -> tuple[str, float]:
        """Path of the container that holds the article, and the text outside links in it."""
        n = len(self.path)
        text, score = [0.0] * n, [-float(NOISE_COST * f) for f in self.furniture]
        adds = [False] * n  # a heading or a paragraph of its own
        for element, block, linked in self.blocks:
            plain = len(block) - linked
            gain = (plain - linked) * (1.0 if len(block) >= LEAST_CHARS else SHORT_SHARE)
            score[element] += plain - NOISE_COST * linked if gain <= 0 else gain
            if gain > 0:
                text[element] += gain
                adds[self._container(element)] |= len(block) >= LEAST_CHARS or self.tag[element] in HEADINGS
        for e in range(n - 1, 0, -1):
            text[self.parent[e]] += text[e]
            score[self.parent[e]] += score[e]
        able = [e for e in range(1, n) if self.is_container[e] and text[e] > 0]
        if not able:
            return "", 0.0
        top = self._widened(max(able, key=lambda e: (score[e], self.path[e].count(">"), -e)), adds)
        return self.path[top], text[top]

    def _container(self, element: int) -> int:
        while element > 0 and not self.is_container[element]:
            element = self.parent[element]
        return element

    def _widened(self, top: int, adds: list[bool]) -> int:
        """The article around the element, or else the nearest container below the body that adds text to it."""
        if self.tag[top] in ("article", "main", "body"):
            return top
        nearest, e = top, self._container(self.parent[top])
        while e > 0 and self.tag[e] not in ("main", "body"):
            if self.tag[e] == "article":
                return e
            if nearest == top and adds[e]:
                nearest = e
            e = self._container(self.parent[e])
        return nearest

    def layout(self) -> str:
        """Digest of the set of the containers' paths."""
        paths = {p for p, inside, out in zip(self.path, self.is_container, self.left_out, strict=True) if inside and not out}
        return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "replace"), digest_size=12).hexdigest()

    def text(self, path: str) -> str:
        """Blocks below the elements on the path (the empty path: of the page), joined by blank lines."""
        inside = [path == ""] * len(self.path)
        for e in range(1, len(self.path)):
            inside[e] = inside[self.parent[e]] or self.path[e] == path
        return "\n\n".join(text for element, text, _ in self.blocks if inside[element])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [Page(h or "") for h in batch["html"].to_pylist()]
        found = [page.best() for page in pages]
        columns = [[page.layout() for page in pages], [p for p, _ in found], [s for _, s in found]]
        types = (pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch["host"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            names=["host", "layout", "path", "score"],
        )


def _with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        layouts = pa.array([Page(h or "").layout() for h in batch["html"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, layouts], names=[*batch.schema.names, "layout"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, path in zip(batch["html"].to_pylist(), batch["path"].to_pylist(), strict=True):
            page = Page(html or "")
            texts.append((path and page.text(path)) or page.text(page.best()[0]))  # consensus first
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.regexp_extract(F.lower(pages[url_col]), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/:?#]*)", 1), F.lit(""))
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host.alias("host")
    )
    votes = rows.where("host != ''").select("host", "html").mapInArrow(_vote, "host string, layout string, path string, score double")
    sums = votes.groupBy("host", "layout", "path").agg(F.sum("score").alias("score"), F.count("*").alias("pages"))
    sums = materialize(sums, "votes")
    strongest = F.max(F.when(F.col("path") != "", F.struct("score", "path")))["path"]
    by_host = sums.groupBy("host", "path").agg(F.sum("score").alias("score")).groupBy("host").agg(strongest.alias("host_path"))
    winners = materialize(by_host.where("host_path is not null"), "winners")
    by_layout = sums.groupBy("host", "layout").agg(strongest.alias("layout_path"), F.sum("pages").alias("pages"))
    by_layout = by_layout.where(F.col("pages") >= LAYOUT_PAGES).drop("pages").join(winners, "host")
    layouts = materialize(by_layout.where("layout_path != host_path").drop("host_path"), "layouts")
    joined = rows.join(_small(winners), "host", "left")
    path = F.col("host_path")
    if not layouts.isEmpty():
        described = joined.mapInArrow(_with_layout, T.StructType([*joined.schema.fields, T.StructField("layout", T.StringType())]))
        joined = described.join(_small(layouts), ["host", "layout"], "left")
        path = F.coalesce("layout_path", "host_path")
    chosen = joined.select("page_id", "url", "html", path.alias("path"))
    return chosen.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
