"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight; within a source, keys are
sorted and sizes prefix-summed to the source's budget. Complete epochs precede the fractional
selection: a source with budget b and size s gives every document floor(b / s) times, and the first
documents in key order once more until b is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 1024


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: the share of a text that is letters, marks or white space."""
    length = F.length(text)
    other = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\s]+", ""))
    return F.when(length > 0, 1.0 - 0.75 * other / length).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> target per source.

    Sources in code-point order, null last, take the weights in turn and share all words. A target
    stops at max_epochs times its source's size and the excess is shared again by weight. Sorted by
    cap / weight, the capped sources are a prefix, so prefix sums give the fixed point. One row per
    source: the windows below never see documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    before = W.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    listed = (
        listed.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("all_size", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("share", (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
        .withColumn("capped", F.col("cap") <= F.col("share") * F.col("w"))
    )
    listed = listed.withColumn("level", F.min(F.when(~F.col("capped"), F.struct("cap_before", "share"))).over(whole)["share"])
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return listed.select("source", "source_size", target.alias("target"))


def draw(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, weight: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """row, size, source_size, target, copies for every row of docs; row is a struct of the columns `carry` (all, by default).

    Null text counts 0 words; null sources are one source, last in order; null ids draw the key of
    the text 'null'. Rows of equal key (repeated rows) are interchangeable and each counts. An empty table gives an
    empty result. Keys depend on id and seed only, so reruns agree whatever the partitioning.
    A source may hold any share of the rows: its keys are cut into ranges, and only sums of ranges
    meet in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    base = docs.select(
        row.alias("row"), "doc_id", "source", word_count(text).alias("size"), (-F.log(u) / (weight if weight is not None else quality_weight(text))).alias("key")
    )
    base = base.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    # written, so that places stay; whole rows are met once, by place, after all sums
    whole_rows = materialize(base.withColumn("place", F.monotonically_increasing_id()), "mix")
    base = whole_rows.drop("row")
    ranges = materialize(base.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    targets = targets.withColumn("epochs", F.least(whole, F.lit(max_epochs)).cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    plan = (
        ranges.alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("of"), F.col("r.range").alias("at"), "ahead", "source_size", "target", "epochs", "rest")
    )
    joined = base.join(plan, base["source"].eqNullSafe(plan["of"]) & (base["range"] == plan["at"]))
    within = W.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("ahead") + F.sum("size").over(within)
    joined = joined.withColumn("upto", upto)
    extra = (F.col("upto") - F.col("size") / 2 <= F.col("rest")) & (F.col("epochs") < max_epochs) & (F.col("size") > 0)
    drawn = joined.select("place", "size", "source_size", "target", (F.col("epochs") + extra.cast("int")).alias("copies"))
    return drawn.join(whole_rows.select("place", "row"), "place").drop("place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = draw(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: every document as often as the mix takes it, with the columns it came with.

    Rows are drawn one by one, also those that share an id. Nulls, ties and empty tables as in draw().
    """
    picked = draw(docs).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return picked.select(*[F.col(f"row.`{c}`") for c in docs.columns])
