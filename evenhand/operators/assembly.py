"""Several files to one table, and the registries that mark its cells."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(files: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union by name of (stem, table). A file without trials takes its stem; a trial that an earlier file has makes
    all trials of the later file `stem: trial`. Files are few; their trial names are metadata."""
    seen: set = set()
    out = []
    for stem, df in files:
        if "TRIAL" not in df.columns:
            df = df.withColumn("TRIAL", F.lit(stem))
        own = F.nullif(F.trim(F.col("TRIAL").cast("string")), F.lit(""))
        if df.filter(own.isNotNull()).isEmpty():
            df = df.withColumn("TRIAL", F.lit(stem))
        names = {r[0] for r in df.select(F.col("TRIAL").cast("string")).distinct().collect()}
        if names & seen:
            df = df.withColumn("TRIAL", F.concat(F.lit(f"{stem}: "), F.col("TRIAL").cast("string")))
            names = {f"{stem}: {n}" for n in names}
        seen |= names
        out.append(df.withColumn("TRIAL", F.col("TRIAL").cast("string")))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def skip_lines(skipped: DataFrame) -> DataFrame:
    """Label-only lines of what a parser skipped (trial, row, reason)."""
    return skipped.select("trial", "row", *[F.lit(None).cast("double").alias(c) for c in ("n", "mean", "sd")])


def skip_marks(lines: DataFrame, skipped: DataFrame) -> DataFrame:
    """line_no, reason of lines without data that the registry names."""
    empty = F.coalesce(*[F.col(c) for c in ("n", "mean", "sd")]).isNull()
    return lines.filter(empty).join(skipped, ["trial", "row"]).select("line_no", F.col("reason").alias("note"), F.lit("unreadable").alias("code"))


def derived_marks(lines: DataFrame, registry: DataFrame, columns: list[str]) -> DataFrame:
    """line_no, col, note of filled cells that the registry (trial, row or '*', col, note) names."""
    cells = lines.select("line_no", "trial", "row", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).isNotNull().alias("filled")) for c in columns])).alias("cell"))
    cells = cells.filter("cell.filled").select("line_no", "trial", "row", "cell.col")
    whole = registry.filter("row = '*'").drop("row")
    return cells.join(registry, ["trial", "row", "col"]).select("line_no", "col", "note").unionByName(cells.join(whole, ["trial", "col"]).select("line_no", "col", "note"))
