"""Line tables from subject-level tables: the test data's orders and items act as subjects.

Sums are of whole cents and rounding is floor(x * 10 + 0.5) / 10, so that other engines give the same lines.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VARIABLES = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, label: str = "") -> DataFrame:
    """df written as Parquet to the shared folder that spark.checkpoint.dir names, and read back; to a temporary one only where that is unset, on a local master.

    Lineage ends here, and readers load the columns they ask for.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not base:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="evenhand-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def continuous_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial: a part; arms: return flags; variables: quantity, discount and tax of its items (in hundredths but for quantity)."""
    # an arm's sums of all variables are one row until they are whole, and a trial's lines lie together from there on
    whole = lambda k, c: F.floor(F.col(c) * (1 if k == "quantity" else 100) + 0.5)
    sums = [f(whole(k, c)).cast("double").alias(f"{a}_{k}") for k, c in VARIABLES.items() for a, f in (("s", F.sum), ("ss", lambda v: F.sum(v * v)))]
    arms = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("arm")).agg(F.count(F.lit(1)).alias("c"), *sums).filter("c > 1")
    arms = arms.withColumn("trial", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "trial")
    each = F.array(*[F.struct(F.lit(k).alias("row"), F.col(f"s_{k}").alias("s"), F.col(f"ss_{k}").alias("ss")) for k in VARIABLES])
    g = arms.select("trial", "arm", "c", F.explode(each).alias("x")).select("trial", "arm", "c", "x.*")
    n = F.col("c").cast("double")
    var = (F.col("ss") - F.col("s") * F.col("s") / n) / F.when(n > 1, n - 1)
    return g.select(
        F.ascii("arm").cast("long").alias("line_no"), "trial", "row", F.col("c").cast("int").alias("n"), half_up(F.col("s") / n, 1).alias("mean"),
        half_up(F.sqrt(F.greatest(var, F.lit(0.0))), 1).alias("sd"), *[F.lit(None).cast("double").alias(c) for c in ("se", "q1", "q3")],
        F.lit(1).alias("round_mean"), F.lit(None).cast("int").alias("round_dispersion"), F.lit(0).alias("round_observation"), F.expr("cast(null as map<string,bigint>)").alias("categories"),
    )


def median_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial: a nation; arms: market segments; variable: account balance in whole units, by exact percentiles."""
    c = table(spark, sf_dir, "customer").withColumn("v", F.floor("c_acctbal").cast("double"))
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("c"), *[F.percentile("v", F.lit(p)).alias(k) for k, p in (("q1", 0.25), ("mean", 0.5), ("q3", 0.75))])
    return g.filter("c > 1").select(
        F.xxhash64("c_mktsegment").alias("line_no"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("trial"), F.lit("balance").alias("row"), F.col("c").cast("int").alias("n"), "mean",
        *[F.lit(None).cast("double").alias(x) for x in ("sd", "se")], "q1", "q3", F.lit(0).alias("round_mean"), F.lit(None).cast("int").alias("round_dispersion"), F.lit(0).alias("round_observation"),
        F.expr("cast(null as map<string,bigint>)").alias("categories"),
    )


def category_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial: a customer's nation; arms: order priorities; categories: order statuses."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("c_nationkey", "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    m = g.groupBy("c_nationkey", "o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "c"))).alias("categories"))
    null = lambda t, *cs: [F.lit(None).cast(t).alias(c) for c in cs]
    return m.select(
        F.ascii("o_orderpriority").cast("long").alias("line_no"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("trial"), F.lit("status").alias("row"),
        *null("int", "n"), *null("double", "mean", "sd", "se", "q1", "q3"), *null("int", "round_mean", "round_dispersion", "round_observation"), "categories",
    )


LINES_SQL = """
long AS (SELECT 'P' || l_partkey AS trial, l_returnflag AS arm, 'quantity' AS "row", CAST(floor(l_quantity + 0.5) AS BIGINT) AS v FROM lineitem
  UNION ALL SELECT 'P' || l_partkey, l_returnflag, 'discount', CAST(floor(l_discount * 100 + 0.5) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'P' || l_partkey, l_returnflag, 'tax', CAST(floor(l_tax * 100 + 0.5) AS BIGINT) FROM lineitem),
agg AS (SELECT trial, "row", arm, count(*) AS c, CAST(sum(v) AS DOUBLE) AS s, CAST(sum(v * v) AS DOUBLE) AS ss FROM long GROUP BY ALL HAVING count(*) > 1),
lines AS (SELECT trial, "row", ascii(arm) AS line_no, CAST(c AS INTEGER) AS n, floor(s / c * 10 + 0.5) / 10 AS mean,
  floor(sqrt(greatest((ss - s * s / c) / (c - 1), 0)) * 10 + 0.5) / 10 AS sd FROM agg)
"""
MEDIAN_SQL = """
mlines AS (SELECT 'N' || c_nationkey AS trial, 'balance' AS "row", c_mktsegment AS arm, CAST(count(*) AS INTEGER) AS n, quantile_cont(CAST(floor(c_acctbal) AS DOUBLE), 0.5) AS mean,
  quantile_cont(CAST(floor(c_acctbal) AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(floor(c_acctbal) AS DOUBLE), 0.75) AS q3 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)
"""
CELLS_SQL = """
cells AS (SELECT 'N' || c_nationkey AS trial, 'status' AS "row", o_orderpriority AS arm, o_orderstatus AS category, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def printed(cells: DataFrame, keys: list[str], char: float = 5.0) -> DataFrame:
    """Words as boxes from cells (keys, line_no, x, text) that begin at x, every character being `char` wide."""
    words = cells.select(*keys, "line_no", "x", "text", F.posexplode(F.split("text", " ")).alias("i", "w"))
    before = F.when(F.col("i") > 0, F.length(F.call_function("substring_index", F.col("text"), F.lit(" "), F.col("i"))) + 1).otherwise(0)
    return words.filter("w <> ''").select(
        *keys, "line_no", (F.col("x") * 1000 + F.col("i")).cast("long").alias("word_no"), F.col("w").alias("text"), (F.col("x") + before * char).alias("x"), (F.length("w") * char).alias("width")
    )


def by_document(df: DataFrame, doc: str) -> DataFrame:
    """df with a document's rows in one partition, and `leads`, true for one of them. As many partitions as shuffles have, since few bytes print many words."""
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)
    return spread.withColumn("leads", F.row_number().over(W.partitionBy(doc).orderBy("flag")) == 1)
