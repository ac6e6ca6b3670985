"""Readers: CSV as text, workbooks, archives and word tables. PDF bytes and legacy XLS have no reader; word tables stand in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("csv", "xlsx", "xls", "pdf")
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY = 300, 300 * 1024**2, 50 * 1024**2
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; types are settled by normalisation."""
    return spark.read.csv(path, header=True, inferSchema=False)


# What an archive's entry is refused for, in order; the first two go silently.
SYSTEM, HOSTILE, NESTED, OTHER = "system file", "unsafe path in archive", "nested archive (not expanded)", "not a supported file type"
PATHS = (
    (SYSTEM, r"[/\\]$|(^|/)__MACOSX(/|$)|(^|[/\\])(\.DS_Store$|\._[^/\\]*$)"),
    (HOSTILE, r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)"),
    (NESTED, r"(?i)\.(zip|gz|tgz|tar|7z|rar)$"),
    (OTHER, r"(?i)^(?!.*\.(" + "|".join(EXTENSIONS) + r")$)"),
)


def entry_plan(name: Column, size: Column) -> tuple[Column, Column]:
    """(take, why) of an archive's entry; first rule wins, folders and system files go silently."""
    why = F.when((size == 0) & ~name.rlike(r"\.[A-Za-z0-9]+$"), "")
    for reason, pattern in PATHS:
        why = why.when(name.rlike(pattern), "" if reason == SYSTEM else reason)
    why = why.when(size > MAX_ENTRY, f"larger than {MAX_ENTRY // 1024**2} MB")
    return why.isNull(), F.coalesce(why, F.lit(""))


def _plan(name: str, size: int) -> bool:
    """The same decision within a task."""
    return size <= MAX_ENTRY and not any(re.search(pattern, name) for _, pattern in PATHS)


def expand_zips(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the entries that the plan takes, of every archive under path. Archives over the caps are refused; an entry that inflates beyond its stated size goes."""
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    taken = [e for e in z.infolist() if not e.is_dir() and _plan(e.filename, e.file_size)][:MAX_ENTRIES]
                    if sum(e.file_size for e in taken) > MAX_TOTAL:
                        continue
                    for e in taken:
                        with z.open(e) as f:
                            data = f.read(int(e.file_size * 1.01) + 1025)
                        if len(data) <= e.file_size * 1.01 + 1024:
                            name = f"{archive.rpartition('/')[2]}: {re.split(r'[/\\\\]', e.filename)[-1]}"
                            yield pd.DataFrame({"name": [name], "content": [data]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "name string, content binary")


def sheet_cells(content: bytes, sheet: str | None = None) -> list[tuple[int, int, str]]:
    """(row, column, text) of a workbook's named or first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")] for s in book.find("m:sheets", _NS)}
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out = []
    for c in root.iter(f"{{{_NS['m']}}}c"):
        letters, digits = re.match(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
        column = 0
        for x in letters:
            column = column * 26 + ord(x) - 64
        v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
        if inline is not None:
            text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t"))
        elif v is None or v.text is None:
            continue
        else:
            text = shared[int(v.text)] if c.get("t") == "s" else v.text
        out.append((int(digits), column, text))
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, row, col, text of the cells of every workbook under path."""
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = [(p, *c) for c in sheet_cells(content, sheet)]
                yield pd.DataFrame(rows, columns=["path", "row", "col", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(of, "path string, row int, col int, text string")


def ocr_words(pixels: DataFrame, dpi: int = 300) -> DataFrame:
    """Pixel boxes to points; blank words go."""
    scaled = {c: F.col(c) * 72.0 / dpi for c in ("x", "y", "width", "height")}
    return pixels.filter(F.trim("text") != "").withColumns(scaled)


def blank_table(spark: SparkSession, rows: int = 8) -> DataFrame:
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    numbers = ("N", "MEAN", "SD", "SE", "ROUND_MEAN", "ROUND_DISPERSION", "ROUND_OBSERVATION", "CAT1", "CAT2", "CAT3")
    return spark.range(rows).select(null("string", "TRIAL"), null("string", "ROW"), *[null("double", c) for c in numbers])
