"""Visible text of HTML, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = frozenset("canvas iframe noscript object script style svg template".split())
_CHROME = frozenset("aside footer form header nav".split())
_BLOCK = frozenset("address article blockquote br dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACE = re.compile(r"\s+")


class _Text(HTMLParser):
    def __init__(self, keep_chrome: bool):
        super().__init__(convert_charrefs=True)
        self.drop = _SKIP if keep_chrome else _SKIP | _CHROME
        self.parts: list[str] = []
        self.title: list[str] = []
        self.hidden: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.drop and tag not in _VOID:
            self.hidden.append(tag)
        elif tag == "title":
            self.in_title = True
        elif tag in _BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(_SPACE.sub(" ", data))


def extract(html: str | None, keep_chrome: bool = False) -> tuple[str, str]:
    """(title, text): scripts and the like dropped, page chrome too unless kept, a line for each block, white space collapsed."""
    p = _Text(keep_chrome)
    p.feed(html or "")
    p.close()
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(p.parts).split("\n"))
    return _SPACE.sub(" ", "".join(p.title)).strip(), "\n".join(x for x in lines if x)


def html_text(keep_chrome: bool = False):
    """`extract` as an Arrow function of an HTML column: struct (title, content)."""

    @F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
    def run(html: pa.Array) -> pa.Array:
        rows = [extract(h, keep_chrome) for h in html.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["title", "content"])

    return run
