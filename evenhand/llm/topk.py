"""Exact top-k inner products by no-random-access aggregation (NRA).

A block of vectors keeps, for every dimension, its members in order of that component. A query
reads every list from the end its own component favours, in growing sequential steps. A vector's
lower bound is its seen partial score plus the least that unseen components can add; its upper
bound adds the most: what the list's frontier still allows. Reading stops when no outsider's upper
bound reaches the k-th lower bound; the remaining candidates' scores are then resolved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

K = 5
QUERY_BLOCK = 512
VECTOR_BLOCK = 4096
#: Sums that may pass this are taken in integers of any size.
SAFE = 2.0**62


def nra_block(queries: np.ndarray, owns: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """[(query, row, score)] of the k best rows of a block for each integer query, ties to smaller id.

    All queries read their lists in the same steps. What a depth has shown is a mask of the
    components, one for each direction of reading, so the bounds of all queries and rows are
    products of matrices. A query reads on until no row beyond k can qualify.
    """
    n, dims = vecs.shape
    place = np.argsort(np.argsort(vecs, axis=0, kind="stable"), axis=0, kind="stable")
    ranked, values = np.sort(vecs, axis=0), vecs.astype(float)
    alive = [np.flatnonzero(ids != own) for own in owns]
    active = np.array([i for i, rows in enumerate(alive) if len(rows) > k], np.int64)
    depth, step = 0, max(64, n // 8)
    while depth < n and len(active):
        depth, step = min(n, depth + step), step * 2
        q = queries[active]
        rising, falling = np.maximum(q, 0).astype(float).T, np.minimum(q, 0).astype(float).T
        top, bottom = (place >= n - depth).astype(float), (place < depth).astype(float)
        seen = (values * top) @ rising + (values * bottom) @ falling
        # the most and the least that a component not yet seen can add
        spans = []
        for up, down in ((ranked[n - depth], ranked[depth - 1]), (ranked[0], ranked[-1])):
            up, down = rising * up[:, None], falling * down[:, None]
            spans.append(seen + (up + down).sum(axis=0) - top @ up - bottom @ down)
        high, low = (x.T for x in spans)
        own = ids[None, :] == owns[active][:, None]
        low[own], high[own] = -np.inf, -np.inf
        least = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
        # sums beyond 2 ** 53 are rounded: leave room for that
        room = np.abs(spans[0]).max(initial=0, where=np.isfinite(spans[0])) * dims * 2.0**-48
        stays = (high >= (least - room)[:, None]) & ~own
        for i, rows in zip(active, stays):
            alive[i] = np.flatnonzero(rows)
        active = active[stays.sum(axis=1) > k]
    out = []
    for i, rows in enumerate(alive):
        own, asked = vecs[rows], queries[i]
        if (np.abs(own.astype(float)).max(initial=0) + 1) * (np.abs(asked.astype(float)).max(initial=0) + 1) * dims >= SAFE:
            own, asked = own.astype(object), asked.astype(object)
        score = own @ asked
        best = sorted(range(len(rows)), key=lambda j: (-score[j], ids[rows[j]]))[:k] if score.dtype == object else np.lexsort((ids[rows], -score))[:k]
        out += [(i, int(rows[j]), min(max(int(score[j]), -(2**63)), 2**63 - 1)) for j in best]
    return out


def _pair_blocks(key, left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = []
    if len(left) and len(right):
        vecs, ids = np.stack(right["v"].to_numpy()).astype(np.int64), right["vec_id"].to_numpy()
        owns = left["vec_id"].to_numpy()
        asked = np.stack(left["v"].to_numpy()).astype(np.int64)
        # the largest block that hashing may deal keeps to bounded matrices
        for at in range(0, len(owns), QUERY_BLOCK):
            found = nra_block(asked[at : at + QUERY_BLOCK], owns[at : at + QUERY_BLOCK], ids, vecs, k)
            rows += [(owns[at + i], ids[row], score) for i, row, score in found]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def topk(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row where is_query holds.

    vectors: vec_id and `embedding`. Components become floor(256 * x), within the range of a long. Vectors that are null, empty
    or hold null or non-finite components, and rows without id, take no part. Vectors meet those of their own length only.
    Rows that repeat an id are candidates of their own, but not for queries of that id, whose answers
    are pooled. Ties go to the smaller id. A score beyond a long is its nearest long. An empty table gives no rows. Extra columns are ignored. Queries and vectors meet in
    blocks of bounded size; blocks are dealt by row, so equal ids or vectors don't gather.
    """
    x = F.col("embedding")
    # an ANSI cast of a non-finite double would raise, so such vectors go first
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.when(e.isNotNull() & ~F.isnan(e), e.cast("double")).otherwise(0.0) * 256))
    good = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    good = materialize(good.withColumn("dims", F.size("v")).withColumn("at", F.monotonically_increasing_id()), "topk-vectors")  # written, so that places stay
    asked = good.filter(is_query)
    # sizes of the two sides: counts only
    n, nq = good.count(), asked.count()
    bv, bq = max(1, -(-n // vector_block)), max(1, -(-nq // query_block))
    slot = lambda m: F.pmod(F.xxhash64("at"), F.lit(m)).cast("int")
    left = asked.withColumn("qb", slot(bq)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(bv - 1))))
    right = good.withColumn("vb", slot(bv)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    keys = ["dims", "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda key, a, b: _pair_blocks(key, a, b, k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
