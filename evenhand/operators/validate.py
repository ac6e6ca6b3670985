"""Line validation: a ladder of rules that ends in issues, exclusions and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import NUMERIC

_ISSUE = "array<struct<col:string,code:string,note:string,soft:boolean>>"


def _issue(cond: Column, col: str, code: str, soft: bool = False, note: str = "") -> Column:
    return F.when(cond, F.struct(F.lit(col).alias("col"), F.lit(code).alias("code"), F.lit(note).alias("note"), F.lit(soft).alias("soft")))


def line_issues(lines: DataFrame) -> DataFrame:
    """lines (with <name>_raw texts and the categories map) plus kind and issues per line.

    Rungs, first match wins: label-only lines; category lines; quartile lines; continuous lines.
    Text in a numeric cell is `unreadable` and never also `missing`.
    """
    c = {x: F.col(x) for x in NUMERIC}
    blank = {x: F.col(f"{x}_raw").isNull() | (F.trim(f"{x}_raw") == "") for x in NUMERIC}
    unread = {x: ~blank[x] & c[x].isNull() for x in NUMERIC}
    has_cat = F.size("categories") > 0
    none = F.lit(True)
    for x in NUMERIC:
        none = none & c[x].isNull()
    label = F.col("row").isNotNull() & (F.trim("row") != "") & none & ~has_cat & ~(unread["n"] | unread["mean"] | unread["sd"])
    quart = c["q1"].isNotNull() | c["q3"].isNotNull()
    kind = F.when(label, "label").when(has_cat, "category").when(quart, "quartile").otherwise("continuous")
    is_ = lambda k: F.col("kind") == k
    lines = lines.withColumn("kind", kind)
    gone = lambda x: c[x].isNull() & ~unread[x]
    one = is_("quartile") & (c["q1"].isNull() != c["q3"].isNull())
    both = is_("quartile") & c["q1"].isNotNull() & c["q3"].isNotNull()
    outside = both & c["mean"].isNotNull() & ((c["mean"] < c["q1"]) | (c["mean"] > c["q3"]))
    found = [_issue(unread[x], x.upper(), "unreadable") for x in NUMERIC]
    found += [_issue(is_("label"), x, "missing", True) for x in ("N", "MEAN", "SD")]
    found += [_issue(is_("category") & c[x].isNotNull(), x.upper(), "incongruent") for x in ("n", "mean", "sd", "q1", "q3")]
    found += [_issue(one & gone(x), x.upper(), "missing") for x in ("q1", "q3")]
    found += [_issue(is_("quartile") & gone(x), x.upper(), "missing") for x in ("n", "mean")]
    found += [_issue(is_("quartile") & c[x].isNotNull(), x.upper(), "incongruent") for x in ("sd", "se")]
    found += [_issue(outside, x, "incongruent") for x in ("MEAN", "Q1", "Q3")]
    found += [_issue(is_("continuous") & gone(x), x.upper(), "missing") for x in ("n", "mean", "sd")]
    found += [_issue(is_("continuous") & gone("sd") & c["se"].isNotNull(), "SE", "incongruent")]
    alone = is_("category") & (F.count(F.when(is_("category"), 1)).over(W.partitionBy("trial", "row")) == 1)
    found.append(_issue(alone, "ROW", "missing", True, "a category variable needs two arms"))
    out = lines.withColumn("issues", F.array_compact(F.array(*found)).cast(_ISSUE))
    cats = is_("category")
    return out.withColumns({x: F.when(~cats, F.col(x)) for x in ("round_mean", "round_observation")})


def issue_table(checked: DataFrame) -> DataFrame:
    """line_no, col, code, note: unreadable cells first, then line order, single category lines last."""
    flat = checked.select("line_no", F.posexplode("issues").alias("i", "x")).select("line_no", "i", "x.*")
    stage = F.when(F.col("code") == "unreadable", 0).when(F.col("note") != "", 2).otherwise(1)
    return flat.select(stage.alias("stage"), "line_no", "i", "col", "code", "note", "soft")


def verdict(checked: DataFrame) -> DataFrame:
    """One row: lines, kept, hard issues, and fail: a hard issue or nothing left."""
    hard = F.size(F.filter("issues", lambda x: ~x["soft"]))
    kept = F.size("issues") == 0
    return checked.agg(F.count(F.lit(1)).alias("lines"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(hard), F.lit(0)).alias("hard")).withColumn(
        "fail", (F.col("hard") > 0) | (F.col("kept") == 0)
    )


def usable(checked: DataFrame) -> DataFrame:
    """Lines without soft issues, sorted by trial, row and line."""
    soft = F.exists("issues", lambda x: x["soft"])
    return checked.filter(~soft).orderBy(F.asc_nulls_last("trial"), F.asc_nulls_last("row"), "line_no")


def without_blank_rows(df: DataFrame) -> DataFrame:
    cells = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    return df.filter(F.coalesce(*cells).isNotNull())
