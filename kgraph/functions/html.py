"""Elements of an HTML page as an array column.

Pages come with nested and unclosed tags, which patterns cannot follow, so one
Arrow-batched function walks the page. It only reports elements and the text
strings in them; what they mean is decided by column expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENT = "struct<tag:string,id:string,cls:string,href:string,pos:int,last:int,pieces:array<string>>"
DOCUMENT = "[document]"

# Tags that never hold content, and tags whose text is not prose.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN_TAGS = frozenset("script style template".split())


class _Walker(HTMLParser):
    """Collects wanted elements; an end tag closes the nearest open tag of its
    name and everything opened since."""

    def __init__(self, wanted: frozenset):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.found: list[dict] = []
        self.buffer: list[str] = []
        self.count = 0
        self.stack: list[tuple[str, dict | None]] = [(DOCUMENT, self._open(DOCUMENT, {}))]

    def _open(self, tag: str, attrs: dict) -> dict | None:
        self.count += 1
        if tag != DOCUMENT and tag not in self.wanted:
            return None
        element = {
            "tag": tag, "id": attrs.get("id"), "cls": attrs.get("class"), "href": attrs.get("href"),
            "pos": self.count, "last": None, "pieces": [],
        }
        self.found.append(element)
        return element

    def _flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer.clear()
        if not text or any(tag in HIDDEN_TAGS for tag, _ in self.stack):
            return
        for _, element in self.stack:
            if element is not None:
                element["pieces"].append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.stack.append((tag, self._open(tag, dict(attrs))))
        if tag in VOID_TAGS:
            self._close_top()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._flush()
            self._close_top()

    def _close_top(self) -> None:
        _, element = self.stack.pop()
        if element is not None:
            element["last"] = self.count

    def handle_endtag(self, tag):
        self._flush()
        if any(open_tag == tag for open_tag, _ in self.stack[1:]):
            while self.stack[-1][0] != tag:
                self._close_top()
            self._close_top()

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        while self.stack:
            self._close_top()
        return self.found


def elements(html: Column | str, tags: list[str]) -> Column:
    """Elements of `html` with one of `tags`, in document order.

    The first entry is the document itself. `pos` and `last` bound the elements
    inside one; `pieces` are its text strings, script and style left out.
    """
    wanted = frozenset(tags)

    @F.pandas_udf(f"array<{ELEMENT}>")
    def walk(pages: pd.Series) -> pd.Series:
        def one(page):
            walker = _Walker(wanted)
            walker.feed(page or "")
            return walker.finish()

        return pages.map(one)

    return walk(html)


class _BlockWalker(_Walker):
    """For every block (`tag` with class `name`) the text strings of the first element of each part inside it.

    Open blocks are kept on a stack, and a part that opens goes to each of them that has none of its kind yet. Text is collected for
    such parts only, so the walk is linear in the page and nothing is copied for other ancestors.
    """

    def __init__(self, block: tuple[str, str], parts: list[tuple[str, str]]):
        self.block, self.parts = block, parts
        self.blocks: list[dict] = []
        self.open_blocks: list[dict] = []
        super().__init__(frozenset())

    def _open(self, tag: str, attrs: dict) -> dict | None:
        classes = (attrs.get("class") or "").split()
        element = None
        for place, (part_tag, name) in enumerate(self.parts):
            waiting = [b for b in self.open_blocks if b["parts"][place] is None] if tag == part_tag and name in classes else []
            if waiting:
                element = element or {"pieces": []}
                for block in waiting:
                    block["parts"][place] = element["pieces"]
        if tag == self.block[0] and self.block[1] in classes:
            element = element or {"pieces": []}
            element["block"] = {"parts": [None] * len(self.parts)}
            self.blocks.append(element["block"])
            self.open_blocks.append(element["block"])
        return element

    def _flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer.clear()
        if text and not any(tag in HIDDEN_TAGS for tag, _ in self.stack):
            for _, element in self.stack:
                if element is not None and "block" not in element:
                    element["pieces"].append(text)

    def _close_top(self) -> None:
        _, element = self.stack.pop()
        if element is not None and "block" in element:
            self.open_blocks.remove(element["block"])


def blocks(html: Column | str, block: tuple[str, str], parts: list[tuple[str, str]]) -> Column:
    """Every block, a (tag, class), in document order: for each of `parts`, also (tag, class), the text strings of the first such
    element inside it, null where there is none."""

    @F.pandas_udf("array<array<array<string>>>")
    def walk(pages: pd.Series) -> pd.Series:
        def one(page):
            walker = _BlockWalker(block, parts)
            walker.feed(page or "")
            walker.finish()
            return [b["parts"] for b in walker.blocks]

        return pages.map(one)

    return walk(html)


BLANKS = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def strip(text: Column | str) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.regexp_replace(text, BLANKS, "")


def joined(pieces: Column, separator: str = " ") -> Column:
    """Stripped, non-empty text strings joined by `separator`."""
    return F.array_join(F.filter(F.transform(pieces, lambda p: strip(p)), lambda p: p != ""), separator)


def text_of(element: Column, separator: str = " ") -> Column:
    return joined(element["pieces"], separator)


def raw_length(element: Column) -> Column:
    return F.length(F.array_join(element["pieces"], ""))


def has_class(element: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(element["cls"], F.lit("")), r"\s+"), name)


def inside(element: Column, outer: Column) -> Column:
    return (element["pos"] > outer["pos"]) & (element["pos"] <= outer["last"])


def where(found: Column | str, test) -> Column:
    return F.filter(found, test)


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))
