"""Rows of HTML tables.

``html_cells`` stays in the JVM: it suits machine-written pages whose rows and
cells are closed. ``html_cells_tolerant`` walks the page with the standard
library's event parser inside ``mapInPandas``, for pages that are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.text import (
    first_non_empty,
    lenient_double,
    lenient_int,
    pad_array,
    split_record,
    strip_space,
)

_CELL = "struct<sort:string,text:string>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def _unescape(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _first_table(body: Column, table_class: str | None) -> Column:
    """Text of the table carrying the class, else of the first table."""
    anywhere = F.regexp_extract(body, r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1)
    if table_class is None:
        return F.nullif(anywhere, F.lit(""))
    by_class = F.regexp_extract(
        body,
        rf"""(?is)<table\b[^>]*\bclass\s*=\s*["'][^"']*(?<![\w-]){table_class}(?![\w-])[^"']*["'][^>]*>(.*?)</table\s*>""",
        1,
    )
    return F.coalesce(F.nullif(by_class, F.lit("")), F.nullif(anywhere, F.lit("")))


def html_cells(
    pages: DataFrame,
    key: str,
    body: str,
    table_class: str | None = None,
    row_tag: str = "tr",
    cell_tag: str = "td",
    body_required: bool = True,
) -> DataFrame:
    """(key, row_pos, cells) with ``cells`` an array of (sort attribute, text).

    With ``body_required`` a table without a body yields nothing; without it the
    first row of such a table is taken for its header and skipped. ``row_tag``
    other than ``tr`` reads the rows from the whole page and makes each row one
    cell.
    """
    if row_tag != "tr":
        rows = F.regexp_extract_all(F.col(body), F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}\s*>"), 1)
        flat = pages.select(key, F.posexplode(rows).alias("row_pos", "_row"))
        text = strip_space(_unescape(F.regexp_replace("_row", r"(?s)<[^>]*>", "")))
        return flat.select(
            key,
            "row_pos",
            F.array(F.struct(F.lit("").alias("sort"), text.alias("text"))).alias("cells"),
        )
    table = _first_table(F.col(body), table_class)
    tbody = F.nullif(F.regexp_extract(table, r"(?is)<tbody\b[^>]*>(.*?)</tbody\s*>", 1), F.lit(""))
    row_pattern = F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>")
    in_body = F.regexp_extract_all(tbody, row_pattern, 1)
    if body_required:
        rows = in_body
    else:
        loose = F.regexp_extract_all(table, row_pattern, 1)
        rest = F.slice(loose, 2, F.greatest(F.size(loose), F.lit(1)))
        rows = F.coalesce(in_body, rest)
    flat = pages.select(key, F.posexplode(rows).alias("row_pos", "_row"))
    raw = F.regexp_extract_all(
        F.col("_row"), F.lit(rf"(?is)(<{cell_tag}\b[^>]*>.*?</{cell_tag}\s*>)"), 1
    )
    cells = F.transform(
        raw,
        lambda c: F.struct(
            _unescape(
                F.regexp_extract(c, r"""(?is)^<[^>]*\bdata-sort\s*=\s*["']([^"']*)["']""", 1)
            ).alias("sort"),
            strip_space(_unescape(F.regexp_replace(c, r"(?s)<[^>]*>", ""))).alias("text"),
        ),
    )
    return flat.select(key, "row_pos", cells.alias("cells"))


class _TableReader(HTMLParser):
    """Collects the rows of one table; unclosed rows and cells end at the next one."""

    def __init__(self, table_class: str | None):
        super().__init__(convert_charrefs=True)
        self.table_class = table_class
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if tag == "table":
            table = {
                "classes": (attributes.get("class") or "").split(),
                "body": False,
                "bodies": 0,
                "rows": [],
            }
            self.tables.append(table)
            self.open.append(table)
        elif not self.open:
            return
        elif tag == "tbody":
            self.open[-1]["body"] = True
            self.open[-1]["bodies"] += 1
        elif tag == "tr":
            self.open[-1]["rows"].append((self.open[-1]["bodies"], []))
        elif tag == "td" and self.open[-1]["rows"]:
            self.open[-1]["rows"][-1][1].append([attributes.get("data-sort") or "", ""])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["rows"] and self.open[-1]["rows"][-1][1]:
            self.open[-1]["rows"][-1][1][-1][1] += data

    def rows(self, body_required: bool) -> list[list[list[str]]]:
        if not self.tables:
            return []
        table = next(
            (t for t in self.tables if self.table_class and self.table_class in t["classes"]),
            self.tables[0],
        )
        if table["body"]:
            return [cells for body, cells in table["rows"] if body == 1]
        return [] if body_required else [cells for _, cells in table["rows"]][1:]


def html_cells_tolerant(
    pages: DataFrame, key: str, body: str, table_class: str | None = None, body_required: bool = True
) -> DataFrame:
    """Same result as ``html_cells``, for pages with unclosed tags."""
    key_type = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, positions, cells = [], [], []
            for page_key, text in zip(batch[key], batch[body]):
                reader = _TableReader(table_class)
                reader.feed(text or "")
                reader.close()
                for pos, row in enumerate(reader.rows(body_required)):
                    keys.append(page_key)
                    positions.append(pos)
                    cells.append([{"sort": s, "text": t.strip()} for s, t in row])
            if keys:
                yield pd.DataFrame({key: keys, "row_pos": positions, "cells": cells})

    return pages.select(key, body).mapInPandas(
        read, f"`{key}` {key_type}, row_pos int, cells array<{_CELL}>"
    )


def stat_rows(cells: DataFrame, key: str, variants: list[str], min_cells: int = 3) -> DataFrame:
    """Rank / name / value… rows → name and one number per variant.

    The sort attribute wins over the text; values that are no numbers and values
    beyond the row's end are NULL.
    """
    width = len(variants)
    valid = cells.filter(F.size("cells") >= min_cells)
    values = pad_array(
        F.transform(
            F.slice("cells", 3, width), lambda c: lenient_double(first_non_empty(c["sort"], c["text"]))
        ),
        width,
    )
    named = valid.select(
        key,
        "row_pos",
        first_non_empty(F.col("cells")[1]["sort"], F.col("cells")[1]["text"]).alias("name"),
        values.alias("_v"),
    )
    return named.select(
        key, "row_pos", "name", *[F.get("_v", F.lit(i)).alias(v) for i, v in enumerate(variants)]
    )


def record_rows(cells: DataFrame, key: str, header: str = "conference", min_cells: int = 4) -> DataFrame:
    """Name / rank / W-L / rate / leader / leader rank rows as typed columns.

    Rows that are short, unnamed or repeat the header are dropped.
    """

    def text(i: int) -> Column:
        return F.get("cells", F.lit(i))["text"]

    name = text(0)
    valid = cells.filter(
        (F.size("cells") >= min_cells) & (name != "") & (F.lower(name) != header)
    )
    wins, losses = split_record(text(2))
    return valid.select(
        key,
        "row_pos",
        name.alias("name"),
        lenient_int(text(1)).alias("rank"),
        wins.alias("wins"),
        losses.alias("losses"),
        lenient_double(text(3)).alias("win_rate"),
        text(4).alias("leader"),
        lenient_int(text(5)).alias("leader_rank"),
    )
