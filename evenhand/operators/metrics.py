"""Agreement of two columns of p values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreement(pairs: DataFrame, ours: str = "ours", theirs: str = "theirs", alarm: float = 0.05) -> DataFrame:
    a, b = F.col(ours), F.col(theirs)
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.corr(F.when(b < 1, a), F.when(b < 1, b)).alias("r"), F.percentile(F.abs(a - b), F.lit(0.5)).alias("median_diff"),
        F.avg((F.abs(a - b) <= 0.05).cast("double")).alias("within_05"), F.avg(((a < alarm) == (b < alarm)).cast("double")).alias("concordance"),
    )


def log_agreement(pairs: DataFrame, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    a, b = F.log10(ours), F.log10(theirs)
    d = F.abs(a - b)
    share = lambda x: F.avg((d <= x).cast("double"))
    return pairs.agg(F.corr(a, b).alias("r_log"), F.percentile(d, F.lit(0.5)).alias("median_log"), share(0.25).alias("within_25"), share(0.5).alias("within_50"), share(1.0).alias("within_100"))


def alarm_table(pairs: DataFrame, ours: str = "ours", theirs: str = "theirs", alarm: float = 0.05) -> DataFrame:
    a, b = F.col(ours) < alarm, F.col(theirs) < alarm
    return pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_ours"), F.count_if(~a & b).alias("only_theirs"), F.count_if(~a & ~b).alias("neither"))


def worst_first(pairs: DataFrame, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    return pairs.withColumn("diff", F.abs(F.col(ours) - F.col(theirs))).orderBy(F.desc("diff"))
