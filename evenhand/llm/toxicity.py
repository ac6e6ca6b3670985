"""Toxicity by a weighted finite-state pattern grammar.

A tagging transducer rewrites a clause's words as symbols: insult (I), threat (T), target (U),
negation (N), reported speech (R) or nothing. Three pattern transducers rewrite those: a negation
reaches over a few words, a target reaches the insults and threats around it, reported speech holds for its
clause. They are composed into one machine that reads a clause forward and one that reads what it wrote backward; the
weights of the symbols that come out are a clause's matches, and clauses are scored, not isolated words. Insults are a seed list and what labelled rows teach: words and word beginnings that
labelled toxic texts hold far more often than others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remainder5, small_batches, table, texts_of

#: Labelled rows that the grammar learns from at most, taken by hash order.
SAMPLE = 20_000
#: Learned entries at most, and the least log-odds of one.
ENTRIES, LEAST_ODDS = 2_000, 3.5
PREFIXES = (4, 5, 6)
SEEDS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown dumb filth imbecile retard vermin scumbag".split()
THREATS = "kill hurt destroy beat stab shoot burn hang crush punch".split()
TARGETS = "you your yours yourself u they them their he him his she her hers everyone these those".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't nobody none hardly nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says claimed wrote quoted according called reported tweeted alleged sagte dit dijo".split()
#: Words over which a negation or a target reaches.
REACH = 3
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"[.!?;:,\n()«»“”\"]+")
FEATURES = ("insults", "targeted", "threats", "negated", "reported", "share")


class Transducer:
    """A finite-state machine: step[state, symbol] is the next state and the symbol written. The first state is 0."""

    def __init__(self, step: dict[tuple, tuple]):
        self.step = step

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes."""
        names, step, todo = {(0, 0): 0}, {}, [(0, 0)]
        for a, b in todo:
            for symbol in SYMBOLS:
                x, written = self.step[a, symbol]
                y, out = other.step[b, written]
                if (x, y) not in names:
                    names[x, y] = len(names)
                    todo.append((x, y))
                step[names[a, b], symbol] = names[x, y], out
        return Transducer(step)

    def read(self, symbols: list[str]) -> list[str]:
        state, out, step = 0, [], self.step
        for symbol in symbols:
            state, written = step[state, symbol]
            out.append(written)
        return out


#: J and K are an insult and a threat at a target, n a negated match, r a reported one, t a reported threat without a target yet.
SYMBOLS = "-ITUNRJKnrt"


def reaching(sign: str, rewrites: dict[str, str], reach: int | None) -> Transducer:
    """After `sign`, symbols are rewritten over `reach` words, or to the end."""
    step = {}
    for left in range((reach or 1) + 1):
        for symbol in SYMBOLS:
            after = (reach or 1) if symbol == sign else left if reach is None else max(0, left - 1)
            step[left, symbol] = after, rewrites.get(symbol, symbol) if left else symbol
    return Transducer(step)


NEGATION = reaching("N", {"I": "n", "T": "n"}, REACH)
TARGET = reaching("U", {"I": "J", "T": "K"}, REACH)
REPORT = reaching("R", {"I": "r", "J": "r", "K": "r", "T": "t"}, None)
FORWARD, BACKWARD = NEGATION.then(TARGET).then(REPORT), TARGET.then(REPORT)
#: symbol -> which of (insults, targeted, threats, negated, reported) its weight adds to.
COUNTED = {"I": (0,), "J": (0, 1), "K": (2,), "n": (3,), "r": (4,)}


def tagger(lexicon: dict[str, float]):
    """word -> (symbol, weight) by whole word, then by the longest learned beginning."""
    fixed = {w: (s, 1.0) for s, ws in (("T", THREATS), ("U", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}
    prefixes = {e[:-1]: w for e, w in lexicon.items() if e.endswith("*")}
    memo: dict[str, tuple[str, float]] = {}

    def tag(word: str) -> tuple[str, float]:
        out = memo.get(word)
        if out is None:
            if len(memo) > 200_000:
                memo.clear()
            out = fixed.get(word, ("-", 0.0))
            if word in lexicon:
                out = ("I", lexicon[word])
            elif out[0] == "-":
                for n in PREFIXES[::-1]:
                    if len(word) > n and word[:n] in prefixes:
                        out = ("I", prefixes[word[:n]])
                        break
            memo[word] = out
        return out

    return tag


def clause_matches(tagged: list[tuple[str, float]]) -> list[float]:
    """(insults, targeted, threats, negated, reported) weights of one clause. A threat needs a target."""
    out = [0.0] * 5
    written = BACKWARD.read(FORWARD.read([s for s, _ in tagged])[::-1])[::-1]
    for symbol, (_, weight) in zip(written, tagged):
        for k in COUNTED.get(symbol, ()):
            out[k] += weight
    return out


def features(text: str, tag) -> list[float]:
    total, clauses = np.zeros(5), 0
    for clause in _CLAUSE.split(text.lower()):
        tagged = [tag(w) for w in _WORD.findall(clause)]
        if tagged:
            clauses += 1
            if any(s in "IT" for s, _ in tagged if s != "-"):
                total += clause_matches(tagged)
    return [*np.log1p(total).tolist(), float(total[0] / clauses) if clauses else 0.0]


def entries(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) > 2:
            out.add(w)
            out.update(w[:n] + "*" for n in PREFIXES if len(w) > n)
    return out


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entry -> weight, from the sample's documents (text, toxic)."""
    def seen(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: dict[str, list[int]] = {}
            for text, toxic in zip(texts_of(pdf["text"]), pdf["toxic"]):
                for e in entries(text):
                    rows.setdefault(e, [0, 0])[0 if toxic else 1] += 1
            yield pd.DataFrame([(e, a, b) for e, (a, b) in rows.items()], columns=["entry", "toxic", "clean"])

    counts = sample.mapInPandas(seen, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = max(3, math.ceil(0.004 * n_toxic))
    found = counts.withColumn("odds", odds).filter((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("odds"), "entry").limit(ENTRIES).select("entry", "odds").collect()
    learned = {r[0]: min(1.0, r[1] / 6) for r in found}
    return {w: 1.0 for w in SEEDS} | learned


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic weights (the last is the constant) by gradient steps with signs held: matches never lower a score, negation and report never raise it."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.array([1.0, 0.5, 0.5, -0.1, -0.1, 0.5, -2.0])
    if len(y) == 0 or y.min() == y.max():
        return w
    low = np.array([0, 0, 0, -np.inf, -np.inf, 0, -np.inf])
    high = np.array([np.inf, np.inf, np.inf, 0, 0, np.inf, np.inf])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = p * (1 - p)
        hessian = (x * v[:, None]).T @ x / len(y) + 1e-3 * np.eye(len(w))
        move = np.linalg.solve(hessian, x.T @ (p - y) / len(y) + 1e-3 * w)
        w = np.clip(w - 0.5 * move, low, high)
        if np.abs(move).max() < 1e-7:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `most` labelled rows outside the held-out fifth, in order of a hash of the id; copies of a label count once."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder5(F.col("doc_id")) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that repeats with other texts is learned from once
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    Null texts are empty and match nothing; null ids are scored, never learned from; repeated rows
    score alike; without usable labels the seed list and fixed weights score; an empty table gives
    no rows. Extra columns are ignored.
    """
    sample = materialize(labelled_sample(docs, labels), "toxicity-sample")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    words = lexicon(sample, n.get(1, 0), n.get(0, 0))

    def learned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = tagger(words)
        for pdf in it:
            yield pd.DataFrame({"x": [features(t, tag) for t in texts_of(pdf["text"])], "y": pdf["toxic"].astype("int32")})

    rows = sample.mapInPandas(learned, "x array<double>, y int").collect()  # at most SAMPLE rows
    rows.sort()
    weights = fit(np.array([r[0] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = tagger(words)
        for pdf in it:
            x = np.array([features(t, tag) for t in texts_of(pdf["text"])]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder5(F.col("doc_id")) == 0).alias("held_out"))
    return kept.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
