"""Kinds, pooled moments and observed statistics of variables, from line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import unbiased_sd
from ..schema import METALOG_LIMIT, UNBIAS_BELOW

KEYS = ("trial", "row")


def kinds(lines: DataFrame) -> DataFrame:
    """trial, row, arms, kind: one_line, median, continuous or category."""
    g = lines.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("arms"), F.bool_and(F.col("n").isNotNull()).alias("all_n"), F.bool_or(F.col("q1").isNotNull() | F.col("q3").isNotNull()).alias("any_q"), F.min("line_no").alias("first_line")
    )
    kind = F.when(F.col("arms") <= 1, "one_line").when(F.col("any_q") & F.col("all_n"), "median").when(F.col("all_n"), "continuous").otherwise("category")
    return g.select(*KEYS, "arms", "first_line", kind.alias("kind"))


def _weighted(x: Column) -> Column:
    return F.sum(F.col("n") * x) / F.sum("n")


def continuous_moments(lines: DataFrame) -> DataFrame:
    """Pooled mean, SD, its small-sample correction, the mean's standard error and the observed statistic.

    Squares are unweighted, around the weighted mean. With scaled integer means the statistic's tie key is exact.
    """
    pooled = lines.groupBy(*KEYS).agg(
        F.sum("n").alias("total"), F.avg("n").alias("mean_n"), _weighted(F.col("mean")).alias("mu"), F.sqrt(_weighted(F.col("sd") * F.col("sd"))).alias("sd_pooled"), F.count(F.lit(1)).alias("arms"),
        F.var_pop("mean").alias("spread"), F.avg("mean").alias("plain_mean"), F.max("round_mean").alias("round_mean"), F.max("round_observation").alias("round_observation"),
    )
    pooled = pooled.withColumn("sigma", unbiased_sd(F.col("sd_pooled"), F.col("total"), UNBIAS_BELOW))
    pooled = pooled.withColumn("sem", F.col("sigma") / F.sqrt("mean_n"))
    # central moments don't cancel where means are large
    off = F.col("plain_mean") - F.col("mu")
    return pooled.withColumn("observed", F.col("arms") * (F.col("spread") + off * off)).drop("spread", "plain_mean")


def median_moments(lines: DataFrame) -> DataFrame:
    """Pooled quantiles, metalog coefficients and the refusal of skewed or missing quartiles."""
    ln3 = F.log(F.lit(3.0))
    g = lines.groupBy(*KEYS).agg(
        F.sum("n").alias("total"), F.avg("n").alias("mean_n"), _weighted(F.col("mean")).alias("m"), _weighted(F.col("q1")).alias("pq1"), _weighted(F.col("q3")).alias("pq3"),
        F.bool_or(F.col("q1").isNull() | F.col("q3").isNull()).alias("mixed"),
    )
    g = g.withColumns({"a1": F.col("m"), "a2": (F.col("pq3") - F.col("pq1")) / (2 * ln3), "a3": 2 * (F.col("pq1") + F.col("pq3") - 2 * F.col("m")) / ln3})
    skewed = (F.col("a2") <= 0) | (F.abs(F.col("a3")) / F.when(F.col("a2") > 0, F.col("a2")) > METALOG_LIMIT)
    status = F.when(F.col("mixed"), "MIXED_QUARTILES").when(skewed, "SKEWED_QUARTILES").otherwise("OK")
    return g.withColumns({"sd_shift": 2 * F.col("a2") / F.sqrt("mean_n"), "status": status})


def category_cells(lines: DataFrame) -> DataFrame:
    """trial, row, line_no, category, count in long form."""
    return lines.select(*KEYS, "line_no", F.explode("categories").alias("category", "count"))


def chi_square(cells: DataFrame) -> DataFrame:
    """trial, row, chi2, status of category variables; refusals are values.

    A category missing from one arm's map but present in another's is an incomplete count.
    """
    arms = cells.select(*KEYS, "line_no").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("arms"))
    by_cat = cells.groupBy(*KEYS, "category").agg(F.sum("count").alias("col_sum"), F.count("count").alias("filled"))
    by_arm = cells.groupBy(*KEYS, "line_no").agg(F.sum("count").alias("arm_sum"))
    facts = by_cat.join(arms, [*KEYS]).groupBy(*KEYS).agg(F.bool_or(F.col("filled") < F.col("arms")).alias("incomplete"), F.sum((F.col("col_sum") > 0).cast("int")).alias("live"), F.sum("col_sum").alias("total"))
    empty = by_arm.groupBy(*KEYS).agg(F.min("arm_sum").alias("least_arm"))
    live = cells.join(by_cat.filter("col_sum > 0").drop("filled"), [*KEYS, "category"]).join(by_arm, [*KEYS, "line_no"]).join(facts.select(*KEYS, "total"), [*KEYS])
    expected = F.col("arm_sum") * F.col("col_sum") / F.col("total")
    stat = live.groupBy(*KEYS).agg(F.sum(F.when(expected > 0, F.pow(F.col("count") - expected, 2) / expected)).alias("chi2"))
    status = F.when(F.col("incomplete"), "INCOMPLETE_CATEGORIES").when((F.col("live") < 2) | (F.col("least_arm") <= 0), "DEGENERATE_CATEGORIES").otherwise("OK")
    out = facts.join(empty, [*KEYS]).join(stat, [*KEYS], "left").withColumn("status", status)
    return out.select(*KEYS, "total", F.when(F.col("status") == "OK", F.col("chi2")).alias("chi2"), "status")
