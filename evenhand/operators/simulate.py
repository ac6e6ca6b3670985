"""Staged Monte Carlo of variables under homogeneity.

The unit of work is (trial, row, chunk of replicates), so an alarming variable that needs a hundred times
the replicates spreads over tasks. Draws depend on (seed, trial, row, chunk) only. Ties are decided on
integers: means are scaled by their printed decimals, and the statistic is taken around N * mean.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import generator
from ..functions.special import clopper_pearson, signif, unbias_factor
from ..schema import CAP_P, LICENSE, M_MAX, M_STAGES, METALOG_LIMIT, STATUS, STOP_P, UNBIAS_BELOW
from .moments import KEYS

CHUNK = 1_000
#: Draws held at once at most.
DRAWS = 4_000_000


def tie_key(means: np.ndarray, n: np.ndarray, decimals: int) -> np.ndarray:
    """Exact integer form of the statistic, one per row of means (replicates x arms)."""
    scaled = np.rint(means * 10.0**decimals).astype(np.int64)
    total = int(n.sum())
    spread = total * scaled - (scaled * n).sum(axis=1, keepdims=True)
    if np.abs(spread).max(initial=0) < 2**30:
        return (spread * spread).sum(axis=1)
    return (spread.astype(object) ** 2).sum(axis=1)


def simulate_continuous(n, mean, sd, decimals, observed_decimals, replicates, rng) -> np.ndarray:
    n, mean, sd = np.asarray(n, np.int64), np.asarray(mean, float), np.asarray(sd, float)
    total = n.sum()
    mu = (n * mean).sum() / total
    sigma = np.sqrt((n * sd * sd).sum() / total)
    if 2 <= total < UNBIAS_BELOW:
        sigma *= unbias_factor(int(total))
    shift = rng.normal(mu, sigma / np.sqrt(n.mean()), replicates)
    out = np.empty((replicates, len(n)))
    for k, size in enumerate(n.tolist()):
        step = max(1, DRAWS // max(size, 1))
        for a in range(0, replicates, step):
            draws = rng.standard_normal((min(step, replicates - a), size))  # and worked on in place
            draws *= sigma
            draws += shift[a : a + step, None]
            np.round(draws, observed_decimals, out=draws)
            out[a : a + step, k] = np.round(draws.mean(axis=1), decimals)
    return tie_key(out, n, decimals)


def metalog(m: float, q1: float, q3: float) -> tuple[float, float, float]:
    return m, (q3 - q1) / (2 * np.log(3)), 2 * (q1 + q3 - 2 * m) / np.log(3)


def simulate_median(n, mean, q1, q3, decimals, observed_decimals, replicates, rng) -> np.ndarray:
    n = np.asarray(n, np.int64)
    w = n / n.sum()
    a1, a2, a3 = metalog(*(float((w * np.asarray(x, float)).sum()) for x in (mean, q1, q3)))
    shift = rng.normal(0.0, 2 * a2 / np.sqrt(n.mean()), replicates)
    out = np.empty((replicates, len(n)))
    for k, size in enumerate(n.tolist()):
        step = max(1, DRAWS // max(size, 1))
        for a in range(0, replicates, step):
            u = rng.random((min(step, replicates - a), size))
            logit = np.log(u / (1 - u))
            x = a1 + shift[a : a + step, None] + a2 * logit + a3 * (u - 0.5) * logit
            out[a : a + step, k] = np.round(np.median(np.round(x, observed_decimals), axis=1), decimals)
    return tie_key(out, n, decimals)


def chi2_of(tables: np.ndarray) -> np.ndarray:
    """Chi-square of each (arms x categories) table; margins are taken from each."""
    rows, cols = tables.sum(axis=-1, keepdims=True), tables.sum(axis=-2, keepdims=True)
    expected = rows * cols / tables.sum(axis=(-1, -2), keepdims=True)
    return ((tables - expected) ** 2 / expected).sum(axis=(-1, -2))


def simulate_category(table: np.ndarray, replicates: int, rng) -> np.ndarray:
    """Chi-squares of random tables with both margins fixed, arm by arm."""
    left = np.tile(table.sum(axis=0), (replicates, 1))
    out = np.empty((replicates, *table.shape), np.int64)
    for k, size in enumerate(table.sum(axis=1).tolist()[:-1]):
        for r in range(replicates):
            out[r, k] = rng.multivariate_hypergeometric(left[r], size, method="marginals")
        left = left - out[:, k]
    out[:, -1] = left
    return chi2_of(out)


def category_table(maps) -> tuple[np.ndarray | None, str]:
    """The live (arms x categories) table of a variable, or why there is none."""
    maps = [dict(m) if m is not None else {} for m in maps]
    names = sorted({c for m in maps for c, v in m.items() if v is not None})
    if any(m.get(c) is None for m in maps for c in names):
        return None, "INCOMPLETE_CATEGORIES"
    table = np.array([[m[c] for c in names] for m in maps], np.int64).reshape(len(maps), len(names))
    table = table[:, table.sum(axis=0) > 0]
    if table.shape[1] < 2 or (table.sum(axis=1) == 0).any():
        return None, "DEGENERATE_CATEGORIES"
    return table, "OK"


def run_unit(v, replicates: int, rng) -> tuple[int, int, str, np.ndarray | None]:
    """(below, equal, status, statistics) of one unit; v holds a variable's arms as arrays."""
    n = [None if pd.isna(x) else x for x in v["n"]]
    has_q = [not (pd.isna(a) and pd.isna(b)) for a, b in zip(v["q1"], v["q3"])]
    if len(n) <= 1:
        return 0, 0, "ONE_LINE", None
    rm = int(max((x for x in v["round_mean"] if not pd.isna(x)), default=0))
    ro = int(max((x for x in v["round_observation"] if not pd.isna(x)), default=0))
    if any(has_q) and all(x is not None for x in n):
        q1, q3 = np.asarray(v["q1"], float), np.asarray(v["q3"], float)
        if np.isnan(q1).any() or np.isnan(q3).any():
            return 0, 0, "MIXED_QUARTILES", None
        w = np.asarray(n, float) / sum(n)
        _, a2, a3 = metalog(*(float((w * np.asarray(x, float)).sum()) for x in (v["mean"], q1, q3)))
        if a2 <= 0 or abs(a3) / a2 > METALOG_LIMIT:
            return 0, 0, "SKEWED_QUARTILES", None
        own = tie_key(np.asarray([v["mean"]], float), np.asarray(n, np.int64), rm)[0]
        sim = simulate_median(n, v["mean"], q1, q3, rm, ro, replicates, rng)
    elif all(x is not None for x in n):
        own = tie_key(np.asarray([v["mean"]], float), np.asarray(n, np.int64), rm)[0]
        sim = simulate_continuous(n, v["mean"], v["sd"], rm, ro, replicates, rng)
    else:
        table, status = category_table(v["categories"])
        if table is None:
            return 0, 0, status, None
        own, sim = chi2_of(table[None])[0], simulate_category(table, replicates, rng)
        tie = np.abs(sim - own) <= 1e-9 * max(1.0, abs(own))
        return int(((sim < own) & ~tie).sum()), int(tie.sum()), "OK", sim
    return int((sim < own).sum()), int((sim == own).sum()), "OK", sim


_ARMS = ("n", "mean", "sd", "q1", "q3", "round_mean", "round_observation", "categories")


def variables(lines: DataFrame) -> DataFrame:
    """One row per variable with its arms as arrays in line order. A variable's arms are few by nature."""
    by_line = lambda a, b: F.when(a["line_no"] < b["line_no"], -1).when(a["line_no"] > b["line_no"], 1).otherwise(0)
    arms = F.array_sort(F.collect_list(F.struct("line_no", *_ARMS)), by_line)
    return lines.groupBy(*KEYS).agg(arms.alias("arms"), F.min("line_no").alias("first_line")).select(*KEYS, "first_line", *[F.col(f"arms.{c}").alias(c) for c in _ARMS])


def _tally(units: DataFrame, seed: int) -> DataFrame:
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for v in pdf.to_dict("records"):
                k = run_unit(v, int(v["replicates"]), generator(seed, v["trial"], v["row"], v["chunk"]))
                rows.append((v["trial"], v["row"], k[0], k[1], v["replicates"], k[2]))
            yield pd.DataFrame(rows, columns=["trial", "row", "below", "equal", "m", "status"])

    return units.mapInPandas(of, "trial string, row string, below long, equal long, m long, status string")


def staged_tail(lines: DataFrame, seed: int = 42, m_max: int = M_MAX, materialize=None) -> DataFrame:
    """trial, row, below, equal, m, status. Stages end at 1,000, 10,000 and m_max replicates; only
    variables whose running mid-p is under STOP_P go on. materialize(df, label) cuts lineage between stages; none is
    needed for small inputs."""
    keep = materialize or (lambda df, label: df)
    todo = keep(variables(lines), "variables")
    stages = sorted({min(s, m_max) for s in (*M_STAGES, m_max)})
    done, before, parts = None, 0, []
    for stage in stages:
        chunks = F.sequence(F.lit(before // CHUNK), F.lit((stage - 1) // CHUNK))
        units = todo.withColumn("chunk", F.explode(chunks)).withColumn("replicates", F.least(F.lit(CHUNK), F.lit(stage) - F.col("chunk") * CHUNK))
        # a unit's row is small and its work is not, so partitions are counted, not sized
        units = units.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism, "trial", "row", "chunk")
        tally = _tally(units, seed).groupBy(*KEYS).agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"), F.sum("m").alias("m"), F.max("status").alias("status"))
        if done is not None:
            tally = done.unionByName(tally).groupBy(*KEYS).agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"), F.sum("m").alias("m"), F.max("status").alias("status"))
        tally = keep(tally, f"stage-{stage}")
        alarming = (F.col("status") == "OK") & ((F.col("below") + F.col("equal") / 2) / F.col("m") < STOP_P)
        if stage == stages[-1]:
            parts.append(tally)
        else:
            parts.append(tally.filter(~alarming))
            done = tally.filter(alarming)
            todo = todo.join(done.select(*KEYS), list(KEYS), "left_semi")
        before = stage
    return functools.reduce(DataFrame.unionByName, parts)


def row_report(tally: DataFrame) -> DataFrame:
    """p, its display, the upper bound and its display, from counts below and equal of m replicates."""
    k, m = F.col("below") + F.col("equal"), F.col("m")
    p = F.greatest((F.col("below") + F.col("equal") / 2) / m, 1 / (m + 1))
    ok = F.col("status") == "OK"
    out = tally.withColumn("p", F.when(ok, F.when(p >= 1, CAP_P).otherwise(p))).withColumn("k_le", F.when(ok, k))
    out = out.withColumn("upper", F.when(ok, clopper_pearson(F.coalesce("k_le", F.lit(0)), m)))
    shown = F.when(F.col("upper") < LICENSE, "<0.0001").otherwise(signif(F.col("p"), 4).cast("string"))
    texts = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return out.withColumn("display", F.when(ok, shown).otherwise(F.try_element_at(texts, F.col("status")))).withColumn(
        "ci", F.when(ok & (F.col("p") < 0.001), F.concat(F.lit("<="), signif(F.col("upper"), 2).cast("string"))).otherwise("")
    )


def draws(lines: DataFrame, seed: int = 42) -> DataFrame:
    """trial, row, observed, draws array<double>: the first stage's statistics, in tie-key or chi-square units."""
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for v in pdf.to_dict("records"):
                sim = run_unit(v, CHUNK, generator(seed, v["trial"], v["row"], 0))[3]
                rows.append((v["trial"], v["row"], None if sim is None else np.asarray(sim, float)))
            yield pd.DataFrame(rows, columns=["trial", "row", "draws"])

    return variables(lines).mapInPandas(of, "trial string, row string, draws array<double>")
