"""Quality rules by weak supervision.

Rules vote junk, good or abstain. Expectation-maximisation over the counts of vote patterns of all
documents estimates how often each rule gives each vote for good and for junk documents, and a
document is kept by its posterior probability of being good. Patterns are few (three to the number
of rules at most), so what the driver sees has a bound that doesn't depend on the documents.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, texts_of, trim

MIN_WORDS = 20
REPEAT_PERCENT = 30
THRESHOLD = 0.5
#: Words of a stretch in which sameness is measured.
STRETCH = 100
#: rule -> (measure, junk from, good up to); between the two the rule abstains.
RULES = {
    "repeats": ("repeat_share", 0.30, 0.05),
    "symbols": ("symbol_share", 0.10, 0.02),
    "shouting": ("upper_share", 0.40, 0.15),
    "variety": ("sameness", 0.65, 0.45),
    "dup_lines": ("dup_line_share", 0.30, 0.01),
    "exclaims": ("exclaim_share", 0.15, 0.02),
    "word_length": ("odd_length", 0.50, 0.15),
    "letters": ("no_letter_share", 0.20, 0.06),
}
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[^\W\d_]")
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def split_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w]


def repeated_words(codes: np.ndarray, width: int = 8) -> int:
    """Words covered by windows of `width` words (a power of two) that occur twice or more.

    Exact: equal windows get equal names by pairing the names of their halves.
    """
    if len(codes) <= width:
        return 0
    names, span = codes.astype(np.int64), 1
    while span < width:
        pairs = names[:-span] * (int(names.max()) + 1) + names[span:]
        names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span *= 2
    often = np.bincount(names)[names] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@functools.cache
def _case() -> np.ndarray:
    """1 for every upper-case code point, 2 for every lower-case one."""
    return np.array([c.isupper() + 2 * c.islower() for c in map(chr, range(0x110000))], np.uint8)


def cased(text: str) -> tuple[int, int]:
    """Upper-case and lower-case letters."""
    found = np.bincount(_case()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=3)
    return int(found[1]), int(found[2])


def sameness(codes: np.ndarray, stretch: int = STRETCH) -> float:
    """Share of words that stood before in their stretch of the text, so that a text's length doesn't raise it."""
    if not len(codes):
        return 0.0
    at = np.arange(len(codes)) // stretch * (int(codes.max()) + 1)
    return 1 - len(np.unique(at + codes)) / len(codes)


def measures(text: str) -> dict:
    words = split_words(text)
    n = len(words)
    codes = pd.factorize(np.array(words, dtype=object))[0] if n else np.zeros(0, np.int64)
    seen, dup_lines, lines = set(), 0, 0
    for line in text.split("\n"):
        if not line or not _SPLIT.sub("", line):
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
        seen.add(line)
    word_chars = sum(map(len, words))
    n_symbols = len(_SYMBOL.findall(text))
    n_repeat = repeated_words(codes)
    upper, lower = cased(text)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "repeat_share": n_repeat / n if n else 0.0, "symbol_share": n_symbols / n if n else 0.0,
        "upper_share": upper / (upper + lower) if upper + lower else 0.0, "sameness": sameness(codes),
        "dup_line_share": dup_lines / lines if lines else 0.0, "exclaim_share": (text.count("!") + text.count("?")) / n if n else 0.0,
        "odd_length": sum(1 for w in words if len(w) > 18) / n if n else 1.0,
        "no_letter_share": sum(1 for w in words if not _UPPER.search(w)) / n if n else 1.0,
    }


def votes(m: dict) -> str:
    """One character per rule: '-' junk, '+' good, '0' abstains."""
    return "".join("-" if m[measure] >= junk else "+" if m[measure] <= good else "0" for measure, junk, good in RULES.values())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(text: pd.Series) -> pd.DataFrame:
    """Counts and votes of every text; null text is empty."""
    found = [measures(t) for t in texts_of(text)]
    trim()
    return pd.DataFrame({c: np.array([m[c] for m in found], np.int64) for c in COUNTS} | {"votes": pd.Series([votes(m) for m in found], dtype=object)})


def posteriors(patterns: list[tuple[str, int]], rounds: int = 200) -> dict[str, float]:
    """Pattern -> probability of good, by EM over a two-class model with independent votes.

    A pattern starts as junk in proportion to its junk votes; the class with the larger
    share of junk votes is called junk. Counts are smoothed by one vote of each kind.
    """
    if not patterns:
        return {}
    names = [p for p, _ in patterns]
    count = np.array([c for _, c in patterns], float)
    kinds = np.array([["-0+".index(v) for v in p] for p in names])
    onehot = (kinds[:, :, None] == np.arange(3)).astype(float)
    good = np.where((kinds == 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        prior = np.array([(count * (1 - good)).sum() + 1, (count * good).sum() + 1])
        prior /= prior.sum()
        logs = []
        for share in (1 - good, good):
            tally = np.einsum("p,prk->rk", count * share, onehot) + 1
            logs.append(np.log(tally / tally.sum(axis=1, keepdims=True)))
        scores = [np.log(prior[c]) + np.einsum("prk,rk->p", onehot, logs[c]) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    if logs[1][:, 0].sum() > logs[0][:, 0].sum():
        good = 1 - good
    return dict(zip(names, good.tolist()))


def judged(docs: DataFrame, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs: `row`, a struct of the columns `carry` (all, by default), counts, base_failed, quality (posterior of good) and kept.

    base_failed: under MIN_WORDS words, or over REPEAT_PERCENT % of words in repeated windows.
    Every row is judged by its own text, whatever its id. Null texts are empty and fail; null ids and repeated rows are
    judged as any other; an empty table gives no rows. Extra columns may have any names.
    """
    spark = docs.sparkSession
    measure = F.pandas_udf(counted, ", ".join(f"{c} long" for c in COUNTS) + ", votes string")
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = materialize(docs.select(row.alias("row"), measure("text").alias("m")).select("row", "m.*"), "quality")
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    patterns = rows.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    learned = posteriors(sorted((r[0], r[1]) for r in patterns))
    known = F.broadcast(spark.createDataFrame(list(learned.items()) or [("", 0.0)], "votes string, quality double"))
    return rows.join(known, "votes").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return judged(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that the rules reject go; the columns stay. Nulls, ties and empty tables as in judged()."""
    small_batches(spark)
    return judged(docs).filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
