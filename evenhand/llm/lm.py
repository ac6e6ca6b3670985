"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped files.

Counting deals pairs (context, word) by a hash of the context; very frequent contexts are spread by the
word as well. Each reducer sorts its pairs and writes a sorted array of 64-bit pair hashes with their
counts to the shared folder; contexts and words are summed by Spark and written the same way. A
scoring worker maps these files and looks pairs up by binary search, so a model may exceed memory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialize, mixed, release, remainder5, scratch_dir, sliced, small_batches, table, texts_of, word_hashes

#: The hashes of the text's begin and end.
BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
#: Contexts with more than 1 / HEAVY of all tokens are spread over SPREAD keys.
HEAVY, SPREAD = 4000, 256
#: Partitions hold about this many tokens.
TOKENS_PER_PART = 3_000_000


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by END, and the number of tokens of each."""
    words, sizes = word_hashes(texts, lower=True)
    out = np.empty(len(words) + len(sizes), np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = words, END
    return out, sizes + 1


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return before


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(context) * np.uint64(0x9E3779B97F4A7C15) + word)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((mixed(key ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def spread_part(h: np.ndarray, w: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """The part of a pair: its context's, or one of SPREAD parts of a heavy context."""
    at = np.searchsorted(heavy, h)
    at[at == len(heavy)] = 0
    with np.errstate(over="ignore"):
        return part_of(np.where(heavy[at] == h, h + mixed(w) % np.uint64(SPREAD), h), parts)


class Files:
    """Arrays in the shared folder. Files on a mounted folder are mapped in place; others are copied to a local file that is unlinked once mapped."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self, name: str):
        if self.uri.startswith("file:") or "://" not in self.uri:
            return None, self.uri.removeprefix("file://").removeprefix("file:") + "/" + name
        return fs.FileSystem.from_uri(self.uri + "/" + name)

    def write(self, name: str, array: np.ndarray) -> None:
        """Whole or not at all: a task that runs twice writes the same array twice."""
        system, path = self._open(name)
        spare = f"{path}.{uuid.uuid4().hex}"
        if system is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            array.tofile(spare)
            os.replace(spare, path)
        else:
            system.create_dir(os.path.dirname(path), recursive=True)
            with system.open_output_stream(spare) as out:
                out.write(np.ascontiguousarray(array))
            system.move(spare, path)

    def map(self, name: str, dtype) -> np.ndarray:
        system, path = self._open(name)
        if system is not None:
            with system.open_input_stream(path) as source, tempfile.NamedTemporaryFile(delete=False) as local:
                while block := source.read(1 << 22):
                    local.write(block)
            path = local.name
        out = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        if system is not None:
            os.unlink(path)
        return out


def _runs(*keys: np.ndarray):
    """Order of the keys and starts of equal runs."""
    order = np.lexsort(keys[::-1])
    if len(order) == 0:
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def packed(part: np.ndarray, h: np.ndarray, w: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """One row per part of pairs sorted by context: each context once, its number of followers, the followers, their counts.

    Hashes don't compress, so a shuffle of these rows is about half of one of a row per pair.
    """
    order = np.argsort(part, kind="stable")
    part, h, w, count = part[order], h[order], w[order], count[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
    heads = np.flatnonzero(first)
    followers = np.diff(np.append(heads, len(h)))
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    at = np.searchsorted(heads, cuts)
    least = lambda x: x.astype(np.min_scalar_type(x.max())).tobytes()
    rows = []
    for a, b, i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist()):
        rows.append((part[a], h[heads[i:j]].tobytes(), least(followers[i:j]), w[a:b].tobytes(), least(count[a:b])))
    return pd.DataFrame(rows, columns=["p", "h", "n", "w", "c"]).astype({"p": np.int32})


def unpacked(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and counts of packed rows; a number's width follows from its block's size."""
    h, n, w, c = [], [], [], []
    for heads, followers, words, counts in rows:
        h.append(np.frombuffer(heads, np.uint64))
        n.append(np.frombuffer(followers, f"u{len(followers) // len(h[-1])}"))
        w.append(np.frombuffer(words, np.uint64))
        c.append(np.frombuffer(counts, f"u{len(counts) // len(w[-1])}"))
    return np.repeat(np.concatenate(h), np.concatenate(n).astype(np.int64)), np.concatenate(w), np.concatenate(c).astype(np.int64)


def train(docs: DataFrame, folder: str) -> dict:
    """Count docs (column text) and write the model to folder. Returns its constants.

    Texts without words have their END. An empty table gives a model that knows nothing and scores
    every token as one of no known types.
    """
    spark = docs.sparkSession

    def unigrams(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = texts_of(pdf["text"])
            for a, b in sliced(texts):
                w, c = np.unique(tokens(texts[a:b])[0], return_counts=True)
                yield pd.DataFrame({"w": w.view(np.int64), "c": c})

    words = materialize(docs.select("text").mapInPandas(unigrams, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "lm-words")
    release(spark)
    n_tokens, n_types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = np.array(sorted(r[0] for r in words.filter(F.col("c") * HEAVY > n_tokens).select("w").collect()) + [BEGIN.view(np.int64)], np.int64).view(np.uint64)  # at most HEAVY words
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // TOKENS_PER_PART))
    heavy = np.sort(heavy)
    files = Files(folder)

    def pairs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = texts_of(pdf["text"])
            for a, b in sliced(texts):
                w, sizes = tokens(texts[a:b])
                h = contexts(w, sizes)
                order, starts = _runs(h, w)
                count = np.diff(np.append(starts, len(order)))
                h, w = h[order][starts], w[order][starts]
                yield packed(spread_part(h, w, heavy, parts), h, w, count)

    def reduce(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in it:
            for p, *row in pdf[["p", "h", "n", "w", "c"]].itertuples(index=False, name=None):
                held.setdefault(p, []).append(row)
        for p in sorted(held):
            h, w, c = unpacked(held.pop(p))
            order, starts = _runs(h, w)
            c = np.add.reduceat(c[order], starts)
            h, w = h[order][starts], w[order][starts]
            key = pair_hash(h, w)
            by = np.argsort(key, kind="stable")
            # counts beyond three take the same discount, but their size matters: 255 and more go to a list of their own
            often = by[c[by] >= 255]
            files.write(f"pair-{p}.key", key[by])
            files.write(f"pair-{p}.count", np.minimum(c[by], 255).astype(np.uint8))
            files.write(f"often-{p}.key", key[often])
            files.write(f"often-{p}.count", c[often].astype(np.uint64))
            histogram = np.array([(c == k).sum() for k in (1, 2, 3, 4)])
            # contexts: total and number of followers seen once, twice, more often
            order, starts = _runs(h)
            sums = [np.add.reduceat(x[order], starts) for x in (c, (c == 1) * 1, (c == 2) * 1, (c > 2) * 1)]
            yield _rows(0, h[order][starts], *sums)
            order, starts = _runs(w)
            n = np.diff(np.append(starts, len(order)))
            yield _rows(1, w[order][starts], n, n * 0, n * 0, n * 0)
            yield _rows(2, np.zeros(1, np.uint64), *[histogram[i : i + 1] for i in range(4)])

    def _rows(kind: int, key: np.ndarray, a, b, c, d) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(key), kind, np.int32), "key": key.view(np.int64), "a": a, "b": b, "c": c, "d": d})

    dealt = docs.select("text").mapInPandas(pairs, "p int, h binary, n binary, w binary, c binary").repartition(parts, "p")
    stats = materialize(dealt.mapInPandas(reduce, "kind int, key long, a long, b long, c long, d long"), "lm-stats")
    del dealt
    release(spark)
    summed = stats.groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in "abcd"])
    summed = materialize(summed, "lm-sums")
    for folder_of_stats in {f.rpartition("/")[0] for f in stats.inputFiles()}:
        delete(spark, folder_of_stats)
    release(spark)
    n1 = summed.filter("kind = 2").select("a", "b", "c", "d").first()
    u = summed.filter("kind = 1").agg(F.coalesce(F.sum("a"), F.lit(0)), *[F.coalesce(F.sum((F.col("a") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)], F.coalesce(F.sum((F.col("a") > 2).cast("long")), F.lit(0))).first()
    constants = {
        "parts": parts, "heavy": heavy.tolist(), "n_tokens": int(n_tokens), "n_types": int(n_types), "n_pairs": int(u[0]),
        "pair_discounts": discounts(list(n1) if n1 else [0] * 4), "word_discounts": discounts(list(u[1:5])), "word_kinds": [int(u[1]), int(u[2]), int(u[5])],
    }

    def store(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for pdf in it:
            rows = pdf[["key", "a", "b", "c", "d"]].to_numpy()
            kind, part = pdf["kind"].to_numpy(), pdf["p"].to_numpy()
            for k, p in sorted(set(zip(kind.tolist(), part.tolist()))):
                held.setdefault((k, p), []).append(rows[(kind == k) & (part == p)])
        for (kind, p), rows in sorted(held.items()):
            rows = np.concatenate(rows)
            key = rows[:, 0].copy().view(np.uint64)
            by = np.argsort(key)
            name = ("context", "word")[kind]
            files.write(f"{name}-{p}.key", key[by])
            counts = rows[by, 1:] if kind == 0 else rows[by, 1:3]
            files.write(f"{name}-{p}.count", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64))
            yield pd.DataFrame({"kind": [kind], "p": [p]})

    # words: how many contexts they follow (a) and how often they occur (b)
    seen = words.select(F.lit(1).alias("kind"), F.col("w").alias("key"), F.lit(0).cast("long").alias("a"), F.col("c").alias("b"))
    word_rows = summed.filter("kind = 1").select("kind", "key", "a", "b").unionByName(seen).groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumns({"c": F.lit(0).cast("long"), "d": F.lit(0).cast("long")})

    def with_part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(p=part_of(pdf["key"].to_numpy().copy().view(np.uint64), parts).astype(np.int32))

    both = summed.filter("kind = 0").unionByName(word_rows).mapInPandas(with_part, "kind int, key long, a long, b long, c long, d long, p int").repartition(parts, "p")
    both.mapInPandas(store, "kind int, p int").write.parquet(folder + "/stored")
    return constants


def discounts(n: list[int]) -> list[float]:
    """Discounts for counts of 1, 2 and more, from the numbers of counts of 1 to 4; plain halves where too few are known."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


#: Numbers stored with a key.
WIDTH = {"pair": 1, "often": 1, "context": 4, "word": 2}


class Model:
    """The mapped files of one model."""

    def __init__(self, folder: str, constants: dict):
        self.files, self.k, self.held = Files(folder), constants, {}

    def _arrays(self, kind: str, p: int):
        if (kind, p) not in self.held:
            try:
                key = self.files.map(f"{kind}-{p}.key", np.uint64)
                count = self.files.map(f"{kind}-{p}.count", np.uint8)
                # the width of a stored number follows from the file's size
                each = len(count) // max(1, len(key) * WIDTH[kind])
                count = count.view(f"u{each}") if each > 1 else count
            except FileNotFoundError:  # no key was dealt to this part
                key, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            width = WIDTH[kind]
            self.held[kind, p] = key, count.reshape(-1, width)
        return self.held[kind, p]

    def find(self, kind: str, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Stored rows of the keys, zeros where there is none."""
        out = np.zeros((len(keys), WIDTH[kind]))
        order = np.lexsort((keys, parts))
        cuts = np.searchsorted(parts[order], np.arange(self.k["parts"] + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[p] : cuts[p + 1]]
            key, count = self._arrays(kind, int(p))
            if len(key):
                at = np.searchsorted(key, keys[own])
                at[at == len(key)] = 0
                hit = key[at] == keys[own]
                out[own[hit]] = count[at[hit]]
        return out

    def probabilities(self, w: np.ndarray, h: np.ndarray, heavy_part) -> tuple[np.ndarray, np.ndarray]:
        """P(w | h) and how often w was seen, per token."""
        k = self.k
        words, back = np.unique(w, return_inverse=True)
        word = self.find("word", words, part_of(words, k["parts"]))[back]
        follows, seen = word[:, 0], word[:, 1]
        d = np.array([0.0, *k["word_discounts"]])
        total = max(k["n_pairs"], 1)
        left = float(np.dot(k["word_discounts"], k["word_kinds"])) if k["n_pairs"] else 1.0
        p1 = (np.maximum(follows - d[np.minimum(follows, 3).astype(int)], 0) + left / (k["n_types"] + 1)) / total
        hs, hback = np.unique(h, return_inverse=True)
        context = self.find("context", hs, part_of(hs, k["parts"]))[hback]
        key, part = pair_hash(h, w), heavy_part(h, w)
        pair = self.find("pair", key, part)[:, 0]
        many = pair == 255
        pair[many] = self.find("often", key[many], part[many])[:, 0]
        d = np.array([0.0, *k["pair_discounts"]])
        all_ = context[:, 0]
        known = all_ > 0
        safe = np.where(known, all_, 1)
        own = np.maximum(pair - d[np.minimum(pair, 3).astype(int)], 0) / safe
        rest = np.where(known, context[:, 1:] @ np.array(k["pair_discounts"]) / safe, 1)
        return own + rest * p1, seen


def perplexity(docs: DataFrame, train_on) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) per row of docs.

    train_on: condition of the rows to learn from. Null texts are empty and have one token, the end;
    null ids and repeated rows are learned and scored as any other; an empty table gives no rows.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "lm")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train_on.alias("train"))
    constants = train(kept.filter("train"), folder)
    return _scored(kept, folder, constants)


def _scored(docs: DataFrame, folder: str, constants: dict) -> DataFrame:
    heavy = np.array(constants["heavy"], np.uint64)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(folder, constants)
        n, v = constants["n_tokens"], constants["n_types"]
        for pdf in it:
            texts, out = texts_of(pdf["text"]), []
            for a, b in sliced(texts, 4_000_000):
                w, sizes = tokens(texts[a:b])
                p, seen = model.probabilities(w, contexts(w, sizes), lambda h, w: spread_part(h, w, heavy, constants["parts"]))
                starts = np.cumsum(sizes) - sizes
                base = np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))
                add = lambda x: np.add.reduceat(x, starts)
                out.append(pd.DataFrame({"n_tokens": sizes, "n_known": add((seen > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}))
            if out:
                rows = pd.concat(out, ignore_index=True)
                yield rows.assign(doc_id=pdf["doc_id"].astype("Int64"), held_out=~pdf["train"], train_tokens=n)

    return docs.mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return perplexity(table(spark, sf_dir, "documents"), remainder5(F.col("doc_id")) != 1)
