"""Typed numeric cells of a text line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import NUM, as_number, decimals

# Cell types in priority order, with their patterns.
TYPES = (
    ("meanSD", f"{NUM}\\s*(?:\u00b1|\\+/-|\\+-)\\s*{NUM}"),
    ("medianRng", f"{NUM}\\s*[\\[(]\\s*{NUM}\\s*(?:\u2013|\u2014|\u2212|-|to)\\s*{NUM}\\s*[\\])]"),
    ("nPct", f"{NUM}\\s*\\(\\s*{NUM}\\s*%\\s*\\)"),
    ("numParen", f"{NUM}\\s*\\(\\s*{NUM}\\s*\\)"),
    ("fraction", "\\d+(?:\\s*/\\s*\\d+)+"),
    ("pctOnly", f"{NUM}\\s*%"),
    ("plain", NUM),
)
TOKEN = "(?<![A-Za-z0-9_.])(?:" + "|".join(p for _, p in TYPES) + ")(?![A-Za-z0-9])"


def token_type(text: Column) -> Column:
    """The first type, in priority order, that is the whole token."""
    out = None
    for name, pattern in TYPES:
        out = F.when(text.rlike(f"^(?:{pattern})$"), name) if out is None else out.when(text.rlike(f"^(?:{pattern})$"), name)
    return out


def tokenize(line: Column) -> Column:
    """array<struct<type,text,num1,num2,dec1,dec2>> of a line's cells."""
    def cell(text: Column) -> Column:
        nums = F.regexp_extract_all(text, F.lit(NUM), F.lit(0))
        first, second = F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
        return F.struct(
            token_type(text).alias("type"), text.alias("text"), as_number(first).alias("num1"), as_number(second).alias("num2"), decimals(first).alias("dec1"), decimals(second).alias("dec2")
        )

    return F.transform(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), cell)


def offsets(line: Column, pattern: str) -> Column:
    """array<struct<text,start>> of a pattern's matches; start counts characters from 0."""
    hits, gaps = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern, -1)
    total = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(hits, lambda h, i: F.struct(h.alias("text"), (total(gaps, i + 1) + total(hits, i)).alias("start")))


def span(boxes: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Left of the first and right of the last box that holds characters from start to before end; boxes: array<struct<s,e,x0,x1>> in order."""
    touched = F.filter(boxes, lambda b: (b["e"] > start) & (b["s"] < end))
    return F.get(touched, F.lit(0))["x0"], F.get(touched, F.size(touched) - 1)["x1"]


def positioned(line: Column, boxes: Column) -> Column:
    """tokenize() with start, x0, x1 and mid: where each cell stands in its line and on its page."""
    def placed(cell: Column, start: Column) -> Column:
        x0, x1 = span(boxes, start, start + F.length(cell["text"]))
        return F.struct(*[cell[k].alias(k) for k in ("type", "text", "num1", "num2", "dec1", "dec2")], start.alias("start"), x0.alias("x0"), x1.alias("x1"), ((x0 + x1) / 2).alias("mid"))

    # the offsets are found once a line
    both = F.transform(F.array(offsets(line, TOKEN)), lambda o: F.transform(tokenize(line), lambda c, i: placed(c, F.get(o, i)["start"])))
    return F.get(both, F.lit(0))
