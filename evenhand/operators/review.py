"""What a parsed table needs a person to look at, and what a second engine may add to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squish
from .blocks import KEYS


def review_flags(tables: DataFrame, arms: DataFrame, variables: DataFrame, skipped: DataFrame, derived: DataFrame) -> DataFrame:
    """doc, block, flags: the reasons in order, none for a table that was read cleanly.

    tables: doc, block, dispersion. A block without variables has its row too.
    """
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    from_text = F.col("source").startswith("document text")
    in_order = lambda by, c: F.concat_ws(", ", F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c])))
    a = arms.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("arms"), F.bool_or(F.col("n").isNull()).alias("open"), F.count_if(F.col("source").isNotNull() & ~from_text).alias("from_cells"), F.count_if(from_text).alias("from_text"),
        F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.when(from_text, F.struct("arm_no", "source")))), lambda x: x["source"])).alias("sources"),
    )
    has = F.col("sd").isNotNull() | F.col("se").isNotNull()
    part = (F.col("mean").isNotNull() | has) & (F.col("mean").isNull() | ~has)
    v = variables.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("lines"), F.bool_or(part).alias("part"), F.count("se").alias("se"))
    s = skipped.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("skips"), in_order("line_no", "label").alias("skip_labels"))
    d = derived.groupBy(*KEYS, "kind").agg(F.count_distinct("label").alias("n"), in_order("line_no", "label").alias("labels"))
    unique, rough = (d.filter(F.col("kind") == k).select(*KEYS, F.col("n").alias(f"{k}_n"), F.col("labels").alias(f"{k}_labels")) for k in ("unique", "approximate"))
    t = tables
    for other in (a, v, s, unique, rough):
        t = t.join(other, KEYS, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    flags = F.array(
        F.when(n("lines") == 0, "no rows were parsed at all"),
        F.when(n("skips") > 0, text("%d table line(s) could not be used: %s", n("skips"), F.col("skip_labels"))),
        F.when(n("arms") < 2, text("only %d treatment arm(s) were found", n("arms"))),
        F.when(F.col("open"), "arm N is missing for at least one arm"),
        F.when(n("from_cells") > 0, text("%d arm size(s) derived from the table's own printed n (%%) cells", n("from_cells"))),
        F.when(n("from_text") > 0, text("%d arm size(s) recovered from the document text - verify against the CONSORT flow diagram: %s", n("from_text"), F.col("sources"))),
        F.when(n("unique_n") > 0, text("%d category row(s) converted from printed percentages via the arm N (unique-count bracket): %s", n("unique_n"), F.col("unique_labels"))),
        F.when(n("approximate_n") > 0, text("%d category row(s) use APPROXIMATE counts - round(arm N x percent) where the printed rounding could not pin a unique integer: %s. Check these against the paper before analyzing.", n("approximate_n"), F.col("approximate_labels"))),
        F.when(F.col("part"), "a continuous row is missing its mean or its SD/SE"),
        F.when(n("se") > 0, text("%d row(s) report a standard error, not an SD - converting needs N and is the analysis's decision", n("se"))),
        F.when(F.col("dispersion").contains("assumed"), "the table does not say whether its dispersion is an SD or an SE; recorded as SD"),
    )
    return t.select(*KEYS, F.array_compact(flags).alias("flags"))


def merged(own: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """All rows of `own`, and those of `other` whose variable, white space and case aside, `own` doesn't have; own columns come first.

    Both have `row` and `engine`. Everything own rows carry, such as sizes' sources and derived cells, stays.
    """
    name = F.lower(squish(F.col("row"))).alias("__name")
    have = own.select(*key, name).distinct()
    new = other.withColumn("__name", F.lower(squish(F.col("row")))).join(have, [*key, "__name"], "left_anti").drop("__name")
    return own.unionByName(new, allowMissingColumns=True)


def needs_fallback(flags: DataFrame, policy: str = "fallback") -> DataFrame:
    """doc, block of the tables that a second engine is asked about: none for `never`, all for `always`, flagged ones for `fallback`."""
    if policy not in ("never", "always", "fallback"):
        raise ValueError(f"unknown policy {policy}")
    asked = {"never": F.lit(False), "always": F.lit(True), "fallback": F.size("flags") > 0}[policy]
    return flags.filter(asked).select(*KEYS)


def first_route(routes: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """Rows of the first route that has any for a document, with `route`: table readings come before prose."""
    out = None
    for name, rows in routes:
        rows = rows.withColumn("route", F.lit(name))
        out = rows if out is None else out.unionByName(rows.join(out.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out
