"""Substring dedup by hashing pieces of lines and runs of them.

Lines are cut into pieces where their words say so, so that two texts that share a passage share its
pieces wherever it stands in their lines. Runs of consecutive pieces that together reach a number of words are
normalised and hashed; digests are grouped over all documents; the occurrence that ranks first stays and the
others are removed, with their original offsets retained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, Words, keyed, mixed, sliced, small_batches, stretch_hashes, table, texts_of, trim

#: Runs of fewer words are left alone: short ones recur by chance.
MIN_WORDS = 25
#: A piece ends with its line, or with a word whose hash is the least among so many words before and after it.
NEAR = 6
_BASE2 = 0xD1342543DE82EF95
SPANS = "array<struct<start:long,end:long>>"


def piece_ends(words: Words, owner: np.ndarray, near: int = NEAR) -> np.ndarray:
    """The last words of the pieces; owner: each word's text. Only a text's own words decide."""
    h = words.hashes
    ends = np.ones(len(h), bool)
    for k in range(1, near + 1):
        other = owner[:-k] != owner[k:]
        ends[:-k] &= other | (h[:-k] <= h[k:])
        ends[k:] &= other | (h[k:] < h[:-k])
    breaks = np.concatenate(([0], np.cumsum(words.data == 10)))
    ends[:-1] |= breaks[words.starts[1:]] > breaks[words.ends[:-1]]  # a line break stands between texts too
    ends[-1:] = True
    return np.flatnonzero(ends)


def runs(before: np.ndarray, owner: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) pieces of the shortest runs of min_words words or more from every piece on and up to every piece.

    before: words before each piece, and all words; owner: the text of each piece, which a run doesn't leave. Together
    the runs cover every piece of any stretch that has as many words.
    """
    n = len(owner)
    at = np.arange(n)
    last = np.searchsorted(before, before[:-1] + min_words, side="left") - 1
    first = np.searchsorted(before, before[1:] - min_words, side="right") - 1
    codes = np.unique(np.concatenate([(at * n + last)[last < n], (first * n + at)[first >= 0]]))
    first, last = np.divmod(codes, max(n, 1))
    own = owner[first] == owner[last]
    return first[own], last[own]


def runs_of(texts: list[str], min_words: int) -> tuple[np.ndarray, ...]:
    """text, start, end (code points) and two hashes (together 96 bits) of every run of pieces of min_words words or more."""
    words = Words(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), words.sizes)
    ends = piece_ends(words, owner)
    before = np.concatenate(([0], ends + 1))
    first, last = runs(before, owner[ends], min_words)
    a, b = before[first], before[last + 1]
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    start_of_text = points[np.concatenate(([0], words.text_ends[:-1]))] if len(texts) else points[:0]
    of = owner[a]
    h1 = stretch_hashes(words.hashes, a, b).astype(np.int64)
    h2 = stretch_hashes(mixed(words.hashes ^ np.uint64(_BASE2)), a, b, _BASE2).astype(np.int32)
    return of, points[words.starts[a]] - start_of_text[of], points[words.ends[b - 1]] - start_of_text[of], h1, h2


def occurrences(ids: np.ndarray, hashes: np.ndarray, texts: list[str], min_words: int) -> pd.DataFrame:
    """__id, __text, start, end, h1, h2, again of every run of some rows.

    again: the run stands in these rows before, in order of (id, text hash, start). So a run adds one
    occurrence a batch at most to its group, however often it stands in one. Of a run that overlaps the first
    one in its text only what lies behind that counts.
    """
    one = np.unique(np.stack([ids, hashes], 1), axis=0, return_index=True)[1] if len(ids) else np.zeros(0, np.int64)
    parts = []
    for a, b in sliced([texts[i] for i in one]):
        of, *rest = runs_of([texts[i] for i in one[a:b]], min_words)
        row = one[a:b][of]
        parts.append((ids[row], hashes[row], *rest))
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
    order = np.lexsort([columns[k] for k in (2, 1, 0, 5, 4)])
    i, t, start, end, h1, h2 = (x[order] for x in columns)
    new = np.ones(len(i), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(i) else np.zeros(0, np.int64)
    overlaps = ~new & (i == i[first]) & (t == t[first]) & (start < end[first])
    start = np.where(overlaps, end[first], start)
    h1 = np.where(new, h1, mixed((t ^ start ^ (end << 32)).astype(np.uint64)).astype(np.int64))  # those that are settled spread over all tasks
    return pd.DataFrame({"__id": i, "__text": t, "start": start, "end": end, "h1": h1, "h2": h2, "again": ~new})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_GAP = " \t\n\v\f\r"


def widened(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, merged over the white space between them, with the white space that would be left over.

    A span that begins a line takes what follows it up to the line break and the break too; another one takes
    the white space before it.
    """
    joined: list[tuple[int, int]] = []
    for a, b in merged(spans):
        if joined and not text[joined[-1][1] : a].strip(_GAP):
            joined[-1] = joined[-1][0], b
        else:
            joined.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in joined:
        left, right = a, b
        while left and text[left - 1] in " \t\v\f\r":
            left -= 1
        if left == 0 or text[left - 1] == "\n":
            while right < len(text) and text[right] in " \t\v\f\r":
                right += 1
            if right < len(text) and text[right] == "\n":
                right += 1
            elif right == len(text) and left:
                left -= 1  # the last line goes with the break before it
        out.append((left, right))
    return merged(out)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given stretches."""
    kept, at = [], 0
    for a, b in merged(spans):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept)


def cleaned(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """A text without its spans, and the stretches removed; nothing where there is no text or span."""
    texts, removed = [], []
    for t, a, b in zip(text, starts, ends):
        cut = widened(t, list(zip(a.tolist(), b.tolist()))) if isinstance(t, str) and a is not None and len(a) else []
        texts.append(without(t, cut) if cut else t if isinstance(t, str) else None)
        removed.append([{"start": x, "end": y} for x, y in cut])
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "spans": pd.Series(removed, dtype=object)})


def spans_of(rows: DataFrame, min_words: int) -> DataFrame:
    """A row's key, `starts` and `ends` of the runs that stood elsewhere before; rows as of keyed()."""
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield occurrences(pdf["__id"].to_numpy(), pdf["__text"].to_numpy(), texts_of(pdf["text"]), min_words)
        trim()

    found = rows.select(*KEY, F.col("row.text").alias("text")).mapInPandas(of, "__id long, __text long, start long, `end` long, h1 long, h2 int, again boolean")
    place = F.struct(*KEY, "start")
    first = F.first(place).over(W.partitionBy("h1", "h2").orderBy(*KEY, "start").rowsBetween(W.unboundedPreceding, 0))
    again = found.withColumn("first", first).filter(F.col("again") | (place != F.col("first")))
    gathered = again.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return gathered.select(*KEY, F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`row`, a struct of all columns of docs, `text`, its text cleaned, and `removed_spans`, offsets (code points) in the original text.

    Stretches of text are equal if their words are, whatever the white space between them and ASCII case. The first
    of equal ones by (doc_id, hash of the text, offset) stays, also within a text, where a run that overlaps the first one
    loses only what lies behind it. Rows that repeat an id and text are one document and keep the same
    text; rows that repeat an id with another text are documents of their own, also with null ids, which rank first. Null text stays
    null. Texts of any length and ties have no other rule. An empty table gives no rows. Extra columns may have any names.
    """
    rows = keyed(docs)
    spans = spans_of(rows, min_words)
    joined = rows.join(spans, KEY, "left")
    again = F.col("starts").isNotNull()
    clean = F.pandas_udf(cleaned, f"struct<text:string,spans:{SPANS}>")
    done = clean(F.when(again, F.col("row.text")), F.col("starts"), F.col("ends"))
    joined = joined.select("row", "starts", done.alias("done"))
    text = F.when(again, F.col("done.text")).otherwise(F.col("row.text"))
    return joined.select("row", text.alias("text"), F.coalesce("done.spans", F.expr(f"cast(array() as {SPANS})")).alias("removed_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("removed_spans")
    size = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "text", spans, F.size(spans).cast("long").alias("n_removed"), size.alias("removed_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: texts without the passages that an earlier document holds; n_chars follows where there is one.

    A document that loses all its words stays, with an empty text. Nulls, ties and empty tables as in deduplicated().
    """
    small_batches(spark)
    found = deduplicated(docs)
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
