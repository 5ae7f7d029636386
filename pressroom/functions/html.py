"""HTML pages: one Python pass per page, everything after it as Column expressions.

:func:`page_outline` is the only Python stage of article extraction. It reads a page once and returns its text, its
elements as (offsets into that text, attributes), its main text and its JSON-LD article object. An element's text is a
slice of the page text, so the outline grows with the page and not with the nesting.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonld import pick_article
from .text import col, let_sql, trim_sql

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody td th thead tr ul br".split()
)
# an open element of the value list ends when the key opens inside it
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("html body ul ol dl table tbody thead select article main section div td th".split())
UNREAD = frozenset("head script style noscript template svg nav footer aside form button select h1".split())
UNREAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|menu|nav\w*|popup|promo|related|share|"
    r"sidebar|social|sponsor\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
REGIONS = ("article", "main")
FIELD_TAGS = frozenset(("title", "meta", "link", "time", "html"))

# what the outlines of one slice of an Arrow batch are made of, at most
SLICE_BYTES = 1024 * 1024
SLICE_PAGES = 256

ELEMENT = "struct<ordinal:int,parent:int,depth:int,tag:string,attrs:map<string,string>,lo:int,hi:int>"
OUTLINE = f"struct<text:string,main_text:string,article_json:string,elements:array<{ELEMENT}>>"
_NUMBERS = ("ordinal", "parent", "depth", "lo", "hi")


class _Outline(HTMLParser):
    """Pre-order element list with text offsets, plus the text blocks that may be read."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.pieces: list[str] = []
        self.length = 0
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        self.open_blocks: list[int] = []
        self.ends: dict[int, int] = {}  # ordinal -> first ordinal after its subtree
        self.unread = 0  # open elements whose text is not read
        self.links = 0
        self.block: list[tuple[str, bool]] = []
        self.blocks: list[tuple[int, str, int]] = []  # (container ordinal, text, characters inside links)

    def _flush(self) -> None:
        text = " ".join("".join(piece for piece, _ in self.block).split())
        if text:
            linked = len(" ".join("".join(piece for piece, link in self.block if link).split()))
            container = self.open_blocks[-1] if self.open_blocks else 0
            if self.elements and self.elements[container]["tag"] == "p":
                container = max(self.elements[container]["parent"], 0)
            self.blocks.append((container, text, linked))
        self.block = []

    def _pop(self) -> str:
        ordinal = self.stack[-1]
        element = self.elements[ordinal]
        if element["tag"] in BLOCKS:
            self._flush()
            self.open_blocks.pop()
        self.stack.pop()
        self.open[element["tag"]] -= 1
        element["hi"] = self.length
        self.ends[ordinal] = len(self.elements)
        self.unread -= element.pop("unread")
        self.links -= element["tag"] == "a"
        return element["tag"]

    def _close(self, tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        """End the nearest open element with one of the tags, unless a scope lies in between."""
        if not any(self.open[tag] for tag in tags):
            return
        for ordinal in reversed(self.stack):
            tag = self.elements[ordinal]["tag"]
            if tag in tags:
                while self.stack and self.stack[-1] >= ordinal:
                    self._pop()
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and tag != "br":
            self._close(("p",), SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - set(CLOSES[tag]))
        if tag in BLOCKS:
            self._flush()
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        ordinal = len(self.elements)
        named = f"{values.get('class', '')} {values.get('id', '')}"
        unread = tag in UNREAD or (tag not in ("html", "body") and bool(UNREAD_NAMES.search(named)))
        self.elements.append(
            {
                "ordinal": ordinal,
                "parent": self.stack[-1] if self.stack else -1,
                "depth": len(self.stack),
                "tag": tag,
                "attrs": values,
                "lo": self.length,
                "hi": self.length,
            }
        )
        if tag in VOID:
            self.ends[ordinal] = ordinal + 1
            return
        self.elements[ordinal]["unread"] = int(unread)
        self.stack.append(ordinal)
        self.open[tag] += 1
        if tag in BLOCKS:
            self.open_blocks.append(ordinal)
        self.unread += unread
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the closing slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack and self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.length += len(data)
        if not self.unread:
            self.block.append((data, self.links > 0))

    def finish(self) -> None:
        self.close()
        while self.stack:
            self._pop()
        self._flush()

    def main_text(self) -> str:
        """The readable blocks of the best region.

        A block scores its characters outside links, in full for its container and by half for the container's parent.
        ``<article>`` and ``<main>`` are preferred; without one the best-scoring container is taken.
        """
        own = [0] * (len(self.elements) + 1)
        for container, text, linked in self.blocks:
            own[container] += len(text) - linked
        regions = [e["ordinal"] for e in self.elements if e["tag"] in REGIONS]
        if regions:
            total = list(itertools.accumulate(own, initial=0))
            best = max(regions, key=lambda r: (total[self.ends[r]] - total[r], -r))
        elif self.blocks:
            score = dict(enumerate(map(float, own)))
            for element in self.elements:
                if element["parent"] >= 0:
                    score[element["parent"]] += own[element["ordinal"]] / 2
            best = max(score, key=lambda o: (score[o], -o))
        else:
            return ""
        last = self.ends.get(best, best + 1)
        return "\n".join(text for container, text, _ in self.blocks if best <= container < last)


def _outline(html: str, fields_only: bool) -> tuple[str, str, str | None, list[dict]]:
    """(text, main text, JSON-LD article object, elements) of one page."""
    parser = _Outline()
    parser.feed(html)
    parser.finish()
    text = "".join(parser.pieces)
    elements = parser.elements
    scripts = [
        text[e["lo"] : e["hi"]]
        for e in elements
        if e["tag"] == "script" and e["attrs"].get("type", "").strip().lower() == "application/ld+json"
    ]
    if fields_only:
        elements = [e for e in elements if e["tag"] in FIELD_TAGS or "itemprop" in e["attrs"] or e["attrs"].get("rel") == "author"]
    return text, parser.main_text(), pick_article(scripts) if scripts else None, elements


def _offsets(lists: list) -> pa.Array:
    return pa.array(itertools.accumulate(map(len, lists), initial=0), pa.int32())


def _arrow(pages: list[tuple[str, str, str | None, list[dict]]], missing: list[bool]) -> pa.Array:
    """Outlines as one Arrow struct array, built by column."""
    lists = [page[3] for page in pages]
    flat = [element for elements in lists for element in elements]
    attrs = [element["attrs"] for element in flat]
    columns = {name: pa.array([element[name] for element in flat], pa.int32()) for name in _NUMBERS}
    columns["tag"] = pa.array([element["tag"] for element in flat], pa.string())
    columns["attrs"] = pa.MapArray.from_arrays(
        _offsets(attrs),
        pa.array([key for values in attrs for key in values], pa.string()),
        pa.array([value for values in attrs for value in values.values()], pa.string()),
    )
    names = ["ordinal", "parent", "depth", "tag", "attrs", "lo", "hi"]
    rows = pa.StructArray.from_arrays([columns[name] for name in names], names)
    texts = [pa.array([page[i] for page in pages], pa.string()) for i in range(3)]
    return pa.StructArray.from_arrays(
        [*texts, pa.ListArray.from_arrays(_offsets(lists), rows)],
        ["text", "main_text", "article_json", "elements"],
        mask=pa.array(missing, pa.bool_()),
    )


def _slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring pages, ``SLICE_BYTES`` of HTML and ``SLICE_PAGES`` at most; a longer page alone."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_pylist()
    start = taken = 0
    for i, size in enumerate(sizes):
        if i > start and (taken + size > SLICE_BYTES or i - start >= SLICE_PAGES):
            yield pages.slice(start, i - start)
            start, taken = i, 0
        taken += size
    yield pages.slice(start)


def _outline_udf(fields_only: bool):
    # a batch of Spark's may hold 10,000 pages, so outlines are made and sent in slices of it
    @F.arrow_udf(OUTLINE)
    def outline(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for pages in _slices(batch):
                texts = pages.to_pylist()
                rows = [("", "", None, []) if html is None else _outline(html, fields_only) for html in texts]
                yield _arrow(rows, [html is None for html in texts])

    # Spark repeats a deterministic call below filters that it derives from the result; this one is too costly for that
    return outline.asNondeterministic()


def page_outline(html: Column | str, fields_only: bool = True) -> Column:
    """Outline struct of a page; ``fields_only`` keeps just the elements that article fields are read from."""
    return _outline_udf(fields_only)(col(html))


def _attr(element: str, key: str) -> str:
    return f"coalesce({trim_sql(f'try_element_at({element}.attrs, {_quoted(key.lower())})')}, '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def attr(element: Column, key: str) -> Column:
    """Attribute value, trimmed; '' when the element or the attribute is missing. Names are stored in lower case."""
    return let_sql(element, "e", _attr("e", key))


def find_element(elements: Column, tag: str = "", key: str = "", value: str = "") -> Column:
    """First element in document order with the tag (if given) and the exact attribute value (if a key is given)."""
    tests = [f"e.tag = {_quoted(tag)}"] if tag else []
    tests += [f"{_attr('e', key)} = {_quoted(value)}"] if key else []
    found = F.call_function("filter", elements, F.expr(f"e -> {' and '.join(tests) or 'true'}"))
    return F.get(found, F.lit(0))


def meta(elements: Column, key: str, value: str) -> Column:
    """``content`` of the first matching ``<meta>``."""
    return attr(find_element(elements, "meta", key, value), "content")


def element_text(text: Column, element: Column) -> Column:
    """Text of an element and everything inside it, trimmed; '' when there is no element."""
    cut = trim_sql("substring(p.t, p.e.lo + 1, p.e.hi - p.e.lo)")
    return let_sql(F.struct(text.alias("t"), element.alias("e")), "p", f"coalesce({cut}, '')")
