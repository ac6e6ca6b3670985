"""Trial and overall summaries of variables' p values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import generator
from ..functions.special import signif, stouffer, tail_of, z_of

BOOTSTRAPS, INTERVAL_BELOW = 1_000, 0.001


def trial_summary(rows: DataFrame) -> DataFrame:
    """trial, k, p: Stouffer over numeric p's to four digits; one p is itself; none leaves null."""
    g = rows.withColumn("z", F.when(F.col("p").isNotNull(), z_of(F.coalesce("p", F.lit(0.5))))).groupBy("trial").agg(
        F.count("p").alias("k"), F.max("p").alias("only"), (F.sum("z") / F.sqrt(F.count("z").cast("double"))).alias("z")
    )
    combined = F.when(F.isnan("z"), F.lit(float("nan"))).otherwise(signif(tail_of(F.coalesce("z", F.lit(0.0))), 4))
    return g.select("trial", "k", F.when(F.col("k") > 1, combined).when(F.col("k") == 1, F.col("only")).alias("p"))


def overall(trials: DataFrame) -> DataFrame:
    """label, k, p over trials with a p; no row for fewer than two."""
    usable = trials.filter(F.col("p").isNotNull() & ~F.isnan("p"))
    g = usable.select(z_of("p").alias("z")).agg(F.count(F.lit(1)).alias("k"), (F.sum("z") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("z")).filter("k >= 2")
    label = F.concat(F.lit("ALL "), F.col("k").cast("string"), F.lit(" TRIALS (Stouffer combination)"))
    return g.select(label.alias("label"), "k", F.when(F.isnan("z"), F.lit(None)).otherwise(signif(tail_of("z"), 4)).alias("p"))


def bootstrap_interval(ps, ms, rng) -> tuple[float, float]:
    stats = [stouffer((rng.binomial(ms, ps) + 0.5) / (np.asarray(ms) + 1)) for _ in range(BOOTSTRAPS)]
    return tuple(np.quantile(stats, [0.025, 0.975]))


def trial_intervals(rows: DataFrame, seed: int = 42) -> DataFrame:
    """trial, low, high of trials whose combined p is under INTERVAL_BELOW; rows: trial, row, p, m. A trial's variables are few."""
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        p = pdf["p"].to_numpy(float)
        if len(p) < 2 or not stouffer(p) < INTERVAL_BELOW:
            return pd.DataFrame({"trial": [], "low": [], "high": []})
        low, high = bootstrap_interval(p, pdf["m"].to_numpy(), generator(seed, pdf["trial"].iloc[0], "interval"))
        return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "low": [low], "high": [high]})

    found = rows.filter("p is not null").select("trial", "row", "p", "m").groupBy("trial").applyInPandas(of, "trial string, low double, high double")
    return found.withColumn("interval", F.concat(signif(F.col("low"), 2).cast("string"), F.lit(" to "), signif(F.col("high"), 2).cast("string")))


def assembled(rows: DataFrame, trials: DataFrame) -> DataFrame:
    """Rows and a Summary line per trial, with order keys instead of blanks and spacers."""
    lines = rows.select("trial", F.lit(0).alias("part"), "first_line", "row", "display", "ci", "m")
    summary = trials.select(
        "trial", F.lit(1).alias("part"), F.lit(None).cast("long").alias("first_line"), F.lit("Summary").alias("row"),
        F.coalesce(F.col("p").cast("string"), F.lit("No values")).alias("display"), F.lit("").alias("ci"), F.lit(None).cast("long").alias("m"),
    )
    return lines.unionByName(summary)
