"""N-gram Jaccard join by MinHash banding.

Bands and rows are chosen for a target recall at the threshold. Texts with equal n-gram sets are
one class member; members meet on band hashes, where each is linked to the bucket's least member.
The components of these links are candidate groups: supersets of the true ones, since two texts
that share a band are both linked to its bucket's least member. Within a group, members are dealt
into blocks of bounded size, every pair of blocks is one unit of work, and each pair of texts whose
sizes allow a link is verified there on its full n-gram sets. Units return counts and spanning links,
never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, id_of, keyed, materialize, mixed, sliced, small_batches, table, texts_of, trim, word_hashes
from .components import components

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Members of a group meet in blocks of this size, larger ones in large groups: copies of a text stay under SPREAD until blocks are full.
BLOCK, FULL_BLOCK, SPREAD = 64, 1024, 48


def bands_for(similarity: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose recall at the similarity reaches the target within the hash budget."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best or (most_hashes, 1)


_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of word hashes; 1 to n - 1 words are one shingle, none are none."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mixed(out * _FOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def all_shingles(texts: list[str]) -> list[np.ndarray]:
    out = []
    for a, b in sliced(texts):
        hashes, sizes = word_hashes(texts[a:b])
        at = 0
        for size in sizes.tolist():
            out.append(shingles(hashes[at : at + size]))
            at += size
    return out


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    odd = seeds | np.uint64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), 1024):
            part = grams[a : a + 1024]
            # one multiplicative permutation of the mixed hashes per row
            np.minimum(least, ((part[None, :] ^ seeds[:, None]) * odd[:, None]).min(axis=1), out=least)
        grid = mixed(least).reshape(bands, rows)
        out = np.zeros(bands, np.uint64)
        for r in range(rows):
            out = mixed(out * _FOLD + grid[:, r])
    return out.astype(np.int64)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row's key, digest of the n-gram set (null for no words), number of n-grams, band hashes."""
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for grams in all_shingles(texts_of(pdf["text"])):
                if len(grams):
                    out.append((hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), signature(grams, bands, rows)))
                else:
                    out.append((None, 0, None))
            yield pd.DataFrame(out, columns=["digest", "n_grams", "bands"]).assign(**{k: pdf[k].to_numpy() for k in KEY})
        trim()

    return docs.select(*KEY, F.col("row.text").alias("text")).mapInPandas(of, "digest binary, n_grams long, bands array<long>, __id long, __text long")


def _verify(rows: list[tuple], left: int, right: int, similarity: float) -> tuple[dict, list]:
    """Links and spanning links of one unit. rows: (id, block, copies, text)."""
    seen, ids, block, copies, texts = set(), [], [], [], []
    for i, b, c, text in rows:
        if i not in seen:  # a repeated row fetched its text twice
            seen.add(i)
            ids.append(i), block.append(b), copies.append(c), texts.append(text)
    grams = all_shingles(texts)
    # in order of block and size, so that those a text can link to are neighbours
    order = np.lexsort(([len(g) for g in grams], block)).tolist()
    ids, block, copies, grams = [[x[k] for k in order] for x in (ids, block, copies, grams)]
    sizes = np.array([len(g) for g in grams])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    codes = pd.factorize(np.concatenate(grams))[0]
    del grams
    links, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))
    copies, marked = np.array(copies), np.zeros(codes.max(initial=-1) + 1, bool)
    begin = 0 if left == right else int(np.searchsorted(block, right))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(len(ids) if left == right else begin):
        # an exact bound: a link's smaller set has at least `similarity` of the larger one's size
        low = x + 1 if left == right else begin + int(np.searchsorted(sizes[begin:], similarity * sizes[x] - 1e-6))
        high = begin + int(np.searchsorted(sizes[begin:], sizes[x] / similarity + 1e-6, side="right"))
        if low >= high:
            continue
        own = codes[starts[x] : starts[x + 1]]
        marked[own] = True
        both = np.add.reduceat(marked[codes[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        marked[own] = False
        ys = low + np.flatnonzero(both >= similarity * (sizes[x] + sizes[low:high] - both) - 1e-9)
        links[x] += copies[ys].sum()
        links[ys] += copies[x]
        for y in ys.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
    spans = [(ids[x], ids[root(x)]) for x in range(len(ids))]
    return dict(zip(ids, links.tolist())), spans


def grouped(rows: DataFrame, similarity: float, recall: float, block: int) -> DataFrame:
    """A row's key, `class`, the least key of its group, n_links and n_grams; rows as of keyed()."""
    bands, per_band = bands_for(similarity, recall)
    marked = materialize(signed(rows, bands, per_band), "neardup-signed")
    # a member stands for all rows of equal n-grams, by the least key among them
    members = materialize(
        marked.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(*KEY)).alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "neardup-members"
    )
    exploded = members.select("id", F.posexplode("bands").alias("band", "hash"))
    # written tables on both sides let Spark split hot buckets and groups
    buckets = materialize(exploded.groupBy("band", "hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "neardup-buckets", few=True)
    stars = exploded.join(buckets, ["band", "hash"]).filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    groups = materialize(components(stars), "neardup-groups", few=True)
    each = F.least(F.lit(max(block, FULL_BLOCK)), F.greatest(F.lit(block), F.ceil(F.col("n") / SPREAD)))
    sizes = materialize(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / each).cast("int")), "neardup-sizes", few=True)
    placed = groups.join(sizes, "root").select(F.col("node").alias("id"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = placed.join(members.select("id", "copies"), "id")
    parts = lambda c, names: [F.col(f"{c}.{k}").alias(n) for k, n in zip(KEY, names)]
    placed = placed.select(*parts("id", KEY), *parts("root", ["r0", "r1"]), "blocks", "block", "copies")
    fetched = rows.select(*KEY, F.col("row.text").alias("text")).join(placed, KEY)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = fetched.withColumn("other", other).select("r0", "r1", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), *KEY, "block", "copies", "text")
    keys = ["r0", "r1", "left", "right"]
    units = units.repartition(*keys).sortWithinPartitions(*keys)

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None

        def done() -> pd.DataFrame:
            links, spans = _verify(held, key[2], key[3], similarity)
            return pd.DataFrame([(*i, links[i], *r) for i, r in spans], columns=["i0", "i1", "links", "t0", "t1"])

        for pdf in it:
            texts = texts_of(pdf["text"])
            for n, (*unit, i, t, b, c) in enumerate(zip(*(pdf[k] for k in (*keys, *KEY, "block", "copies")))):
                if key != unit:
                    if held:
                        yield done()
                    held, key = [], unit
                held.append(((i, t), b, c, texts[n]))
        if held:
            yield done()
        trim()

    node = lambda a, b: F.struct(F.col(a).alias(KEY[0]), F.col(b).alias(KEY[1]))
    verified = materialize(units.mapInPandas(verify, "i0 long, i1 long, links long, t0 long, t1 long").select(node("i0", "i1").alias("id"), "links", node("t0", "t1").alias("to")), "neardup-verified")
    linked = verified.groupBy("id").agg(F.sum("links").alias("links"))
    classes = materialize(components(verified.select(F.col("id").alias("a"), F.col("to").alias("b"))), "neardup-classes", few=True)
    known = (
        members.select("digest", "id", "copies")
        .join(linked, "id", "left")
        .join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
        .select("digest", F.coalesce("root", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = marked.select(*KEY, "digest", "n_grams").join(known, "digest", "left")
    return out.select(*KEY, F.coalesce("class", F.struct(*KEY)).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_grams")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_grams per row of docs (doc_id, text).

    class_id is the least doc_id of the row's group: rows joined by chains of links, a link being a
    word n-gram Jaccard similarity of `similarity` or more (equal sets: 1). n_links counts the other
    rows the row links to, copies included. Texts without words link to nothing; null text is empty.
    Null ids act as the least possible id and come back null. Repeated rows are copies of each
    other; rows that repeat an id with another text are texts of their own. An empty table gives no rows. Extra columns are ignored.
    """
    found = grouped(keyed(docs), similarity, recall, block)
    return found.select(id_of(F.col(KEY[0])).alias("doc_id"), id_of(F.col(f"class.{KEY[0]}")).alias("class_id"), "n_links", "n_grams")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the least document of each group stays, by (doc_id, hash of the text). Rows that repeat an id and text are one
    document and stay together; rows of one id with other texts are told apart. Texts without words stay. Null ids rank
    first, null text is empty, an empty table gives no rows, and extra columns may have any names."""
    small_batches(spark)
    rows = keyed(docs)
    gone = grouped(rows, SIMILARITY, RECALL, BLOCK).filter(F.struct(*KEY) != F.col("class")).select(*KEY).distinct()
    return rows.join(gone, KEY, "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
