"""Bodies of pages by what their host's pages don't have in common.

A page is a list of text blocks, each with the path of the elements that hold it. A block that stands at the same path on many pages
of its host belongs to the host's template, and so does whatever stands at a path that mostly holds such blocks
(menus with entries of their own). What is left is the body. Pages of hosts with few pages have no template to tell; all
their blocks outside dropped elements are left.

Blocks are compared by host, path and a hash of their text, which is all that meets: a block that stands on every page of a large host
is one row of an aggregate. Texts stay with their page until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .html import DROPPED_TAGS, MIN_SIGNAL, VOID, extract_body
from .tables import stored

#: A block is the template's if it stands on so many of its host's pages, and on this share of them; a path if that share of its blocks is.
LEAST_PAGES, PAGE_SHARE, PATH_SHARE = 3, 0.05, 0.6
#: Elements of a path, the innermost ones.
DEPTH = 6
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup time tt u var wbr".split())


class Blocks(HTMLParser):
    """(path, text) of a page's text blocks in order; text of dropped elements is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str]] = []
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.found: list[tuple[str, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text and not any(self.open.get(t) for t in DROPPED_TAGS):
            self.found.append(("/".join(mark for _, mark in self.path[-DEPTH:]), text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            return
        self.flush()
        if tag in VOID:
            return
        if self.path and self.path[-1][0] == tag and tag in ("p", "li", "td", "tr", "option"):
            self.open[self.path.pop()[0]] -= 1
        kind = (dict(attrs).get("class") or "").split()
        self.path.append((tag, f"{tag}.{kind[0]}" if kind else tag))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE or not self.open.get(tag):
            return
        self.flush()
        while True:
            gone = self.path.pop()[0]
            self.open[gone] -= 1
            if gone == tag:
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    read = Blocks()
    read.feed(html or "")
    read.close()
    read.flush()
    return read.found


def blocks(pages: DataFrame, row_id: str, host: str, html: str) -> DataFrame:
    """row_id, host, blocks: array<struct<path, text>>."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [[{"path": p, "text": t} for p, t in page_blocks(h.as_py())] for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], [row_id, "host", "blocks"])

    kind = pages.schema[row_id].dataType.simpleString()
    read = pages.select(F.col(row_id), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(html))
    return read.mapInArrow(rows, f"`{row_id}` {kind}, host string, blocks array<struct<path:string,text:string>>")


def template_bodies(pages: DataFrame, row_id: str = "page_id", host: str = "host", html: str = "html", least: int = MIN_SIGNAL) -> DataFrame:
    """row_id, body: the blocks that are not of the host's template, lines by line breaks; empty below ``least`` letters and digits.

    row_id tells pages apart.
    """
    held = stored(blocks(pages, row_id, host, html), "blocks")
    size = held.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = held.select(row_id, "host", F.posexplode("blocks").alias("at", "b")).select(row_id, "host", "at", "b.path", F.xxhash64("b.text").alias("h"))
    met = each.select(row_id, "host", "path", "h").distinct().groupBy("host", "path", "h").agg(F.count(F.lit(1)).alias("on"))
    many = met.join(size, "host").where((F.col("on") >= LEAST_PAGES) & (F.col("on") >= PAGE_SHARE * F.col("pages"))).select("host", "path", "h", F.lit(True).alias("__many"))
    told = stored(each.join(many, ["host", "path", "h"], "left").select(row_id, "host", "at", "path", F.coalesce("__many", F.lit(False)).alias("many")), "template")
    noisy = told.groupBy("host", "path").agg(F.avg(F.col("many").cast("int")).alias("share")).where(F.col("share") >= PATH_SHARE).select("host", "path", F.lit(True).alias("__noisy"))
    left = told.where("not many").join(noisy, ["host", "path"], "left_anti").groupBy(row_id).agg(F.collect_set("at").alias("left"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b, i: F.array_contains("left", i)), lambda b: b["text"]), "\n")
    out = held.join(left, row_id, "left").select(row_id, F.coalesce(text, F.lit("")).alias("body"))
    return out.select(row_id, F.when(T.signal_length(F.col("body")) >= least, F.col("body")).otherwise("").alias("body"))


def bodies(pages: DataFrame, row_id: str = "page_id", host: str = "host", html: str = "html", title: Column | None = None) -> DataFrame:
    """row_id, body, extractor: the article block of a page (html.extract_body); where there is none, what is not of the host's template."""
    first = pages.select(row_id, extract_body(F.col(html), title if title is not None else F.lit("")).alias("first"))
    second = template_bodies(pages, row_id, host, html)
    which = F.when(F.col("first") != "", "article").when(F.col("body") != "", "template")
    return first.join(second, row_id).select(row_id, F.when(F.col("first") != "", F.col("first")).otherwise(F.col("body")).alias("body"), which.alias("extractor"))
