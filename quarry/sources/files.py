"""File sources and sinks."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.library import SKIP_DIRS


def canonical(path: str) -> str:
    """An absolute path without dots; symbolic links are the store's business, not ours."""
    scheme, sep, rest = path.partition("://")
    return scheme + sep + posixpath.normpath(rest) if sep else posixpath.normpath(path)


def scan(spark: SparkSession, roots: list[str], content: bool = False) -> DataFrame:
    """path, file_name, size, mtime (epoch milliseconds) of all files below the roots; hidden and build folders skipped.

    Without ``content`` only listings are read: the column is pruned from the
    scan. Spark lists no empty files, which admission drops in any case.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1))
    f = f.filter(~hidden & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS))))
    cols = [F.col("path"), F.element_at(parts, -1).alias("file_name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]
    return f.select(*cols, *([F.col("content"), F.sha2("content", 256).alias("hash")] if content else []))


def read_text(files: DataFrame) -> DataFrame:
    """Plain-text files decoded as UTF-8 and cleaned; markup is kept as it is."""
    plain = T.extension(F.col("file_name")).isin("txt", "md", "csv", "tsv", "json", "xml", "html", "yaml", "log", "properties")
    return files.filter(plain).withColumn("text", T.clean_text(F.decode("content", "UTF-8"))).drop("content")


def needs_ocr(chars: Column, pages: Column, least: int = 100) -> Column:
    """Paged documents with fewer than ``least`` characters a page go to the OCR plug-in."""
    return (pages > 0) & (chars / pages < least)


_RULE = re.compile(r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$")


def markdown_tables(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of the pipe tables outside code fences; rows are padded and cut to the header."""

    def cells(line: str) -> list[str]:
        line = line.strip().removeprefix("|")
        line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
        return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]

    out, lines, fence, i = [], text.split("\n"), False, 0
    while i < len(lines):
        if lines[i].lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and "|" in lines[i] and i + 1 < len(lines) and "-" in lines[i + 1] and _RULE.match(lines[i + 1]):
            head, rows, i = cells(lines[i]), [], i + 2
            while i < len(lines) and "|" in lines[i] and not lines[i].lstrip().startswith("```"):
                row = cells(lines[i])[: len(head)]
                rows.append(row + [""] * (len(head) - len(row)))
                i += 1
            out.append((head, rows))
            continue
        i += 1
    return out


def extract_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table, row, cells) of all pipe tables; row -1 is the header."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, t, r, c) for i, text in zip(f[id_col], f[text_col]) for t, (head, body) in enumerate(markdown_tables(text or "")) for r, c in enumerate([head, *body], -1)]
            yield pd.DataFrame(rows, columns=[id_col, "table", "row", "cells"])

    return docs.select(id_col, text_col).filter(F.col(text_col).contains("|")).mapInPandas(run, f"{id_col} {kind}, `table` int, row int, cells array<string>")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with guarded formulas; quoting is Spark's own."""
    df.select(*(T.guard_formula(F.col(c).cast("string")).alias(c) for c in df.columns)).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_calendar(events: DataFrame, path: str) -> None:
    """One VCALENDAR text per event row (columns uid, vevent)."""
    events.select(F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//quarry//EN\r\n"), "vevent", F.lit("\r\nEND:VCALENDAR\r")).alias("value")).write.mode("overwrite").text(path)


def html_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A table row of markup for each row, all cells escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), T.html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    return rows.select(F.concat(F.lit("<tr>"), *map(cell, columns), F.lit("</tr>")).alias("html"))
