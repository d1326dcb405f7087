"""Texts into lines, sections and clauses: markdown headings natively, layout text by one pass.

Markdown sectioning needs no Python: lines are exploded with their place, a running count of
headings inside each document gives the section, and the body is put together again. Layout text
from converted pages carries state (table of contents, deep indents), so each document is walked
once in an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceloom.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, level, heading, body): a heading and what follows it, up to the next one.
    Lines before the first heading belong to none."""
    x = lines(docs, key, text).withColumn("level", T.heading_level(F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no")
    x = x.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(w)).filter("section_no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line")))), lambda s: s["line"]), "\n")
    g = x.groupBy(key, "section_no").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.regexp_replace("line", r"^#+\s*", ""))).alias("heading"), body.alias("body"))
    return g.select(key, F.col("section_no").cast("int").alias("section_no"), "level", "heading", F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))


def is_layout_text(text: Column) -> Column:
    """Whether a text is raw converted layout: no '#' headings, more than ten deep indents in the first 100 lines."""
    first = F.slice(F.split(text, "\n"), 1, 100)
    deep = F.filter(first, lambda l: (F.length(l) > 40) & (F.length(l) - F.length(F.ltrim(l)) > 30))
    return ~F.exists(first, lambda l: l.startswith("#")) & (F.size(deep) > 10)


# Headings of converted pages, and lines of a table of contents.
_HEAD = re.compile(r"^\s+(?:(?:Annex\s+([A-Z](?:\.\d+)*))|(\d+(?:\.\d+)*)|([A-Z](?:\.\d+)+))\s+([A-Z][A-Za-z].*?)\s*$")
_SHORT_HEAD = re.compile(r"^\s+(\d{1,2})\s{2,}([A-Z][A-Za-z].*?)(?:\s*\.+\s*\d+)?\s*$")
_CONTENTS = re.compile(r"\.{3,}\s*\d+\s*$")
_NOISE = [re.compile(p if not p.startswith("(?i)") else p[4:], re.I if p.startswith("(?i)") else 0) for p in (x.replace(r"\x{feff}", "﻿") for x in T.NOISE_LINES)]


def layout_sections_of(text: str) -> list[tuple[int, str, str]]:
    """(level, heading, body) of one layout text."""
    out: list[tuple[int, str, list[str]]] = []
    contents = False
    for line in text.split("\n"):
        bare = line.strip()
        if bare and any(p.search(bare) for p in _NOISE):
            continue
        if _CONTENTS.search(bare):
            contents = True
            continue
        if contents and (not bare or re.search(r"\.{3,}", bare)):
            continue
        contents = False
        m = _HEAD.match(line)
        ident, title = (m[1] or m[2] or m[3], m[4]) if m else (None, None)
        if not m and (s := _SHORT_HEAD.match(line)) and len(s[2]) > 3:
            ident, title = s[1], s[2]
        if ident and title:
            out.append((ident.count(".") + 2, f"{ident} {title.strip()}", []))
        elif out and bare:
            out[-1][2].append(bare)
    return [(level, heading, "\n".join(body)) for level, heading, body in out]


def layout_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, s in enumerate(layout_sections_of(t or ""), 1)]
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=[key, "section_no", "level", "heading", "body"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, section_no int, level int, heading string, body string")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections of each document by its own format."""
    raw = F.coalesce(is_layout_text(F.col(text)), F.lit(False))
    return markdown_sections(docs.filter(~raw), key, text).unionByName(layout_sections(docs.filter(raw), key, text))


def clauses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clause rows of standards' texts: number, title, class, tags, level, notes, references. Top
    headings and headings without a number make no clause."""
    s = sections(docs, key, text).withColumn("section", T.section_id(F.col("heading"))).filter((F.col("level") > 1) & (F.col("section") != ""))
    title = F.trim(F.regexp_extract(F.trim(F.regexp_replace("heading", r"[*_`]", "")), r"^\S+\s+(.*)$", 1))
    body = F.col("body")
    return s.select(key, "section_no", "section", title.alias("title"), T.clause_class(body).alias("type"), body.alias("text"), T.tags_in_text(body).alias("tags"), T.level_in_text(body).alias("asil_level"), T.notes_in_text(body).alias("notes"), T.references_in_text(body).alias("cross_references"))


def text_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, heading) of plain texts: '#', numbered or all-capital lines of 4 to 79 characters."""
    bare = F.trim("line")
    head = bare.startswith("#") | bare.rlike(r"^\d+\.[\d.]*\s+\w") | ((F.upper(bare) == bare) & bare.rlike("[A-Z]") & F.length(bare).between(4, 79))
    return lines(docs, key, text).filter(head).select(key, "line_no", F.trim(F.regexp_replace(bare, r"^#+", "")).alias("heading"))


def row_texts(rows: DataFrame, cells: str = "cells", key: str = "sheet", order: str = "row_no") -> DataFrame:
    """Spreadsheet rows as text: under a header row (two or more cells, all filled and short) each
    row reads 'Header: value | ...', else its cells joined by tabs."""
    first = F.min_by(cells, order)
    heads = rows.groupBy(key).agg(first.alias("head"))
    good = (F.size("head") >= 2) & ~F.exists("head", lambda c: c.isNull() | (F.trim(c) == "") | (F.length(c) >= 100))
    x = rows.join(heads, key).withColumn("good", good)
    named = F.array_join(F.filter(F.zip_with("head", cells, lambda h, c: F.when(F.trim(c) != "", F.concat(h, F.lit(": "), c))), lambda s: s.isNotNull()), " | ")
    firsts = F.min(order).over(Window.partitionBy(key))
    return x.withColumn("first", firsts).select(key, order, F.when(F.col("good") & (F.col(order) > F.col("first")), named).otherwise(F.array_join(cells, "\t", "")).alias("line"))
