"""Data behind the distribution graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ecdf(rows: DataFrame, key: str = "trial") -> DataFrame:
    """key, p, step: the i-th of n p values against i / n."""
    w = W.partitionBy(key)
    return rows.filter("p is not null").withColumn("step", F.row_number().over(w.orderBy("p", "row")) / F.count(F.lit(1)).over(w))


def histogram(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, bin, count: Freedman-Diaconis bins from the least value."""
    x = F.col(value)
    facts = values.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("low"), (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias("iqr"))
    width = 2 * F.col("iqr") / F.cbrt(F.col("n").cast("double"))
    return values.join(facts.withColumn("bin_width", F.when(width > 0, width).otherwise(1.0)), keys).groupBy(*keys, F.floor((x - F.col("low")) / F.col("bin_width")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def slide_plan(rows: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """kind, trial, row: a title, an overall slide for two trials or more, a trial's for two rows or more, and alarming rows'."""
    tested = rows.filter("p is not null")
    per = tested.groupBy("trial").agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(None).cast("string")
    title = rows.sparkSession.range(1).select(F.lit("title").alias("kind"), null.alias("trial"), null.alias("row"))
    all_ = per.agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select(F.lit("overall").alias("kind"), null.alias("trial"), null.alias("row"))
    trial = per.filter("n >= 2").select(F.lit("trial").alias("kind"), "trial", null.alias("row"))
    alarming = tested.filter(F.col("p") <= cutoff).select(F.lit("row").alias("kind"), "trial", "row")
    return title.unionByName(all_).unionByName(trial).unionByName(alarming)
