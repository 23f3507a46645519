"""CSV files of mixed encodings and delimiters, each read by what its own beginning shows."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings that are tried in this order where there is no byte order mark, delimiters, and letters of a sample.
ENCODINGS, DELIMITERS, SAMPLE = ("utf-8", "cp1253", "latin-1"), ",;\t|", 8192
#: Rows that are handed on at once.
ROWS = 5000
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def encoding_of(data: bytes) -> str:
    """By the byte order mark, else the first encoding in which all of the data can be read."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def delimiter_of(sample: str) -> str:
    """The delimiter that splits most of the first lines into the same number of cells, two at least; a comma, if
    none does. Quoted cells count as one."""
    best = (0, 0, ",")
    for k, delimiter in enumerate(DELIMITERS):
        widths = [len(r) for r in csv.reader(io.StringIO(sample), delimiter=delimiter) if r][:-1 if len(sample) >= SAMPLE else None]
        if widths and widths[0] > 1:
            same = sum(w == widths[0] for w in widths)
            best = max(best, (same * widths[0], -k, delimiter))
    return best[2]


def rows_of(data: bytes) -> Iterator[tuple[int, dict[str, str | None]]]:
    """Row numbers (from 1) and cells by header; cells beyond the header are dropped, missing ones are null."""
    text = io.TextIOWrapper(io.BytesIO(data), encoding=encoding_of(data), errors="replace", newline="")
    sample = text.read(SAMPLE)
    text.seek(0)
    reader = csv.reader(text, delimiter=delimiter_of(sample))
    header = [h.strip() for h in next(reader, [])]
    for k, cells in enumerate((c for c in reader if any(x.strip() for x in c)), 1):
        yield k, {h: cells[i] if i < len(cells) else None for i, h in enumerate(header) if h}


def read_sniffed(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """file, row, cells (map by header) of all files under a folder, whatever each is written in. A file is read
    by one task and goes through as a stream of rows; blank lines are left out, an empty file has no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                held: list[tuple[str, int, dict]] = []
                for k, cells in rows_of(bytes(data)):
                    held.append((file, k, cells))
                    if len(held) >= ROWS:
                        yield pd.DataFrame(held, columns=["file", "row", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "row", "cells"])

    return files.mapInPandas(parsed, "file string, row long, cells map<string,string>")


def cell(candidates: tuple[str, ...]) -> Column:
    """The cell under the first of several headers that has one, in any case; blanks count for nothing."""
    lower = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(lower, F.lit(c.lower()))), F.lit("")) for c in candidates))
