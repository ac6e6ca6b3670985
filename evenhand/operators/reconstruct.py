"""Journal-style tables from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("trial", "row")


def fixed(x: Column, digits: Column, most: int = 10) -> Column:
    """x with so many decimals; null is empty and null digits are none. Ties of the binary value round half to even."""
    d = F.coalesce(digits, F.lit(0))
    out = F.format_string("%.0f", F.bround(x, 0))
    for k in range(1, most + 1):
        out = F.when(d == k, F.format_string(f"%.{k}f", x)).otherwise(out)
    return F.when(x.isNull(), "").otherwise(out)


def arm_index(lines: DataFrame) -> DataFrame:
    return lines.withColumn("arm", F.row_number().over(W.partitionBy(*KEYS).orderBy("line_no")))


def header_n(lines: DataFrame) -> DataFrame:
    """trial, arm, header_n: the most common N of continuous lines at the arm's place, the smallest on ties."""
    c = arm_index(lines).filter(F.col("mean").isNotNull() & F.col("n").isNotNull()).groupBy("trial", "arm", "n").agg(F.count(F.lit(1)).alias("times"))
    return c.groupBy("trial", "arm").agg(F.max_by("n", F.struct("times", (-F.col("n")).alias("least"))).alias("header_n"))


def cells(lines: DataFrame) -> DataFrame:
    """trial, row, arm, variable, sub, cell: one line's cell, or one per category under a heading."""
    lines = arm_index(lines).join(header_n(lines), ["trial", "arm"], "left")
    has_q = F.max((F.col("q1").isNotNull() | F.col("q3").isNotNull()).cast("int")).over(W.partitionBy(*KEYS)) == 1
    f = lambda c, d="round_mean": fixed(F.col(c), F.col(d) if isinstance(d, str) else d)
    mean_sd = F.concat(f("mean"), F.lit(" ("), f("sd", F.coalesce("round_dispersion", "round_mean")), F.lit(")"))
    median = F.concat(f("mean"), F.lit(" ["), f("q1"), F.lit(", "), f("q3"), F.lit("]"))
    odd_n = F.when(F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("header_n")), F.concat(F.lit("; n = "), F.col("n").cast("string"))).otherwise("")
    lines = lines.withColumn("cell", F.concat(F.when(has_q, median).otherwise(mean_sd), odd_n))
    plain = lines.filter("n is not null or mean is not null").select(*KEYS, "arm", F.col("row").alias("variable"), F.lit(0).alias("sub"), "cell", "line_no")
    cats = lines.filter(F.size("categories") > 0).select(*KEYS, "arm", "line_no", F.explode("categories").alias("category", "count"))
    cat_cells = cats.select(*KEYS, "arm", F.concat(F.lit("    "), "category").alias("variable"), F.lit(2).alias("sub"), F.col("count").cast("string").alias("cell"), "line_no")
    heads = cats.select(*KEYS, "arm", F.concat("row", F.lit(", n")).alias("variable"), F.lit(1).alias("sub"), F.lit("").alias("cell"), "line_no").distinct()
    return plain.unionByName(heads).unionByName(cat_cells)


def table(lines: DataFrame, arms: int | None = None) -> DataFrame:
    """Cells with arms as columns arm_1 to arm_<arms>, as many as any trial has by default (one number to the driver); missing cells are empty."""
    found = cells(lines)
    if arms is None:
        arms = found.agg(F.max("arm")).first()[0] or 0
    wide = found.groupBy(*KEYS, "variable", "sub").pivot("arm", list(range(1, arms + 1))).agg(F.first("cell")) if arms else found.select(*KEYS, "variable", "sub").distinct()
    return wide.select(*KEYS, "variable", "sub", *[F.coalesce(F.col(str(k)), F.lit("")).alias(f"arm_{k}") for k in range(1, arms + 1)])


def sheet_names(names: DataFrame) -> DataFrame:
    """trial, sheet: names safe for a workbook, at most 31 characters, repeated ones numbered from 2."""
    safe = F.trim(F.regexp_replace("trial", "[\\[\\]:*?/\\\\]", " "))
    safe = F.when(F.coalesce(safe, F.lit("")) == "", "Trial").otherwise(F.substring(safe, 1, 31))
    k = F.row_number().over(W.partitionBy(F.lower("base")).orderBy("trial_no"))
    return names.withColumn("base", safe).withColumn("k", k).select(
        "trial", "trial_no", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat(F.substring("base", 1, 28), F.lit(" "), F.col("k").cast("string"))).alias("sheet")
    )
