"""Anchors and infobox rows of pages, by the standard library's HTML parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_wiki_path

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.href: str | None = None
        self.text: list[str] = []
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in VOID:
            self.open.append((tag, "navbox" in (a.get("class") or "").split()))
        if tag == "a" and not any(box for _, box in self.open):
            self.href, self.text = a.get("href") or "", []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append(("".join(self.text).strip(), self.href))
            self.href = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break


class _Infobox(HTMLParser):
    """Rows of cells of the first infobox table: ``(header, text, links)``; character references are dropped.

    A cell's links are the anchors known so far whose text it holds: the page's, overwritten by the table's as they come.
    """

    def __init__(self, known: dict[str, str] | None = None) -> None:
        super().__init__(convert_charrefs=False)
        self.depth, self.done = 0, False
        self.known = dict(known or {})
        self.path: str | None = None
        self.rows: list[list[tuple[bool, str, list[tuple[str, str]]]]] = []
        self.cell: list[str] | None = None
        self.head = False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table" and (self.depth or "infobox" in (dict(attrs).get("class") or "")):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("th", "td"):
            self.cell, self.head = [], tag == "th"
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")
        elif self.depth and tag == "a" and _is_wiki(href := dict(attrs).get("href")):
            self.path = href.replace("/wiki/", "")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        if self.path is not None:
            self.known[data] = self.path
            self.path = None

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if tag in ("th", "td") and self.cell is not None:
            text = " ".join(x.strip(" ") for x in self.cell).strip()
            text = re.sub(r" *\n *", ", ", text).replace("\xa0", " ")
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((self.head, text, [(t, p) for t, p in self.known.items() if t in text]))
            self.cell = None
        elif tag == "table":
            self.depth -= 1
            self.done = not self.depth


def _is_wiki(href: str | None) -> bool:
    """``is_wiki_path`` of a Python string."""
    return bool(href) and href.startswith("/wiki") and not (href.startswith("/wiki/File:") or "Category:" in href or "Special:" in href)


def anchors_of(html: str | None) -> list[tuple[str, str]]:
    """(text, href) of anchors outside navigation boxes; texts of 3 characters or more, the first of each."""
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    seen, out = set(), []
    for text, href in parser.found:
        if len(text) >= 3 and href and text not in seen:
            seen.add(text)
            out.append((text, href))
    return out


def infobox_of(html: str | None) -> list[list[tuple[bool, str, list[tuple[str, str]]]]]:
    parser = _Infobox({t: h.replace("/wiki/", "") for t, h in anchors_of(html) if _is_wiki(h)})
    parser.feed(html or "")
    parser.close()
    return [r for r in parser.rows if r] if parser.done else []


def _small(batches, limit: int = 1 << 22):
    """Slices of about ``limit`` bytes of pages, one page at least."""
    for batch in batches:
        start = size = 0
        for i, page in enumerate(batch.column(1)):
            size += page.as_buffer().size if page.is_valid else 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def page_anchors(pages: DataFrame, key: str, html: str = "html", wiki_only: bool = True) -> DataFrame:
    """``(key, pos, text, href)``; with ``wiki_only`` just links to wiki pages. Null pages have none."""

    def run(batches):
        for batch in _small(batches):
            rows = [(k, i, t, h) for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (t, h) in enumerate(anchors_of(page))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=[key, "pos", "text", "href"])

    found = pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, pos int, text string, href string")
    return found.where(is_wiki_path(F.col("href"))) if wiki_only else found


LINKS = "array<struct<text:string,path:string>>"


def infobox_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, row, heading, cells, links)``: heading is the text of a row that is one header cell; links to sections are left out."""
    link = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string())]))

    def run(batches):
        for batch in _small(batches):
            keys, number, heads, cells, links = [], [], [], [], []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, row in enumerate(infobox_of(page)):
                    keys.append(k)
                    number.append(i)
                    heads.append(row[0][1] if len(row) == 1 and row[0][0] else None)
                    cells.append([t for _, t, _ in row if t])
                    links.append([{"text": t, "path": p} for _, _, held in row for t, p in held if "#" not in p])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(number, pa.int32()), pa.array(heads, pa.string()), pa.array(cells, pa.list_(pa.string())), pa.array(links, link)], names=[key, "row", "heading", "cells", "links"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, row int, heading string, cells array<string>, links {LINKS}")


def infobox_evidence(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, row, evidence_text, links)``: each data row, after the heading above it; equal texts with equal links of a page once."""
    from ..operators.questions import carried_header

    rows = carried_header(infobox_rows(pages, key, html), key, ["row"], F.col("heading"))
    data = rows.where("heading is null").select(key, "row", F.concat_ws(", ", "header", F.array_join("cells", ", ")).alias("evidence_text"), "links")
    return data.groupBy(key, "evidence_text", "links").agg(F.min("row").alias("row")).select(key, "row", "evidence_text", "links")
