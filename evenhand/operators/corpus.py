"""Joins, dedup, title matches, suffix keys, batches and agreement of values over bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Two phases, so that a frequent key never sorts in one task."""
    least = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"))
    cond = F.struct(*order) == F.col("__first")
    return df.join(least, key).filter(cond).drop("__first")


def first_match_join(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return left.join(keep_first(right, key, order).drop(*order), key, "left")


def uncontested(df: DataFrame, key: list[str], claimant: str) -> DataFrame:
    """Rows of keys that one claimant holds."""
    single = df.groupBy(*key).agg(F.count_distinct(claimant).alias("__n")).filter("__n = 1").drop("__n")
    return df.join(single, key, "left_semi")


def todo(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return items.join(done, key, "left_anti")


def bag_overlap(left: Column, right: Column) -> Column:
    """Share of the left bag that the right one holds."""
    return F.size(F.array_intersect(left, right)) / F.when(F.size(left) > 0, F.size(left))


def title_matches(pages: DataFrame, titles: DataFrame, near: float = 0.6, accept: float = 0.75, margin: float = 0.15) -> DataFrame:
    """page, title, score, runner_up, accepted: the title whose bag a page holds best.

    pages: page, bag; titles: title, bag. A pair of score `near` shares a word among any
    size - ceil(near * size) + 1 of its title, so an inverted index of the words that the fewest titles hold finds all pairs, and common
    words bring none together. The index goes down to accept - margin, so that every runner-up that matters is met; one below
    that counts as 0. Pages are read once: only their words that some title holds go on, and scores come from these.
    """
    low = min(near, accept - margin)
    known = titles.select("title", F.array_distinct("bag").alias("bag")).withColumn("size", F.size("bag")).filter("size > 0")
    words = known.select("title", "size", F.explode("bag").alias("word"))
    frequent = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("title").orderBy("df", "word"))
    rare = words.join(frequent, "word").withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.ceil(F.lit(low) * F.col("size") - 1e-9) + 1).select("title", "word")
    # rows that repeat a page are told apart
    numbered = pages.select("page", "bag", F.monotonically_increasing_id().alias("copy"))
    hits = numbered.select("page", "copy", F.explode(F.array_distinct("bag")).alias("word")).join(frequent.select("word"), "word")
    held = hits.groupBy("page", "copy").agg(F.collect_list("word").alias("held"))
    met = held.select("page", "copy", "held", F.explode("held").alias("word")).join(rare, "word").join(known, "title")
    scored = met.select("page", "copy", "title", (F.size(F.array_intersect("bag", "held")) / F.col("size")).alias("score")).distinct().drop("copy")
    w = W.partitionBy("page").orderBy(F.desc("score"), "title")
    ranked = scored.filter(F.col("score") >= low - 1e-9).withColumns({"k": F.row_number().over(w), "runner_up": F.lead("score").over(w)})
    accepted = (F.col("score") >= accept) & (F.col("score") - F.coalesce("runner_up", F.lit(0.0)) >= margin)
    return ranked.filter((F.col("k") == 1) & (F.col("score") >= near)).select("page", "title", "score", F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"), accepted.alias("accepted"))


def unique_suffix(keys: DataFrame, names: DataFrame) -> DataFrame:
    """key, name where exactly one name ends with '/' + key. The last path part is an equi-join key."""
    last = lambda c: F.element_at(F.split(c, "/"), -1).alias("last")
    hit = keys.withColumn("last", last("key")).join(names.select("name", last("name")), "last").filter(F.endswith("name", F.concat(F.lit("/"), F.col("key"))))
    return hit.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter("n = 1").drop("n")


def by_doi(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc, item: the item whose DOI a text prints, or the one item whose DOI begins so.

    texts: doc, doi; known: item, doi. Prefixes of known DOIs from the registrant on are the join key. A key that several items
    share, as all do the registrant, is one row with its least and greatest item, so no key outgrows a task.
    """
    ends = lambda lo, hi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"))

    def only(texts: DataFrame, keys: DataFrame) -> DataFrame:
        hit = texts.join(keys.groupBy("doi").agg(*ends("item", "item")), "doi").groupBy("doc").agg(*ends("lo", "hi"))
        return hit.filter("lo = hi").select("doc", F.col("lo").alias("item"))

    exact = only(texts, known)
    rest = texts.join(exact, "doc", "left_anti")
    starts = known.select("item", F.explode(F.transform(F.sequence(F.lit(9), F.length("doi")), lambda n: F.substring(F.col("doi"), F.lit(1), n))).alias("doi"))
    return exact.unionByName(only(rest, starts))


def by_one_id(found: DataFrame, known: DataFrame) -> DataFrame:
    """doc, item of documents that print exactly one known id. found: doc, id; known: item, id."""
    return found.join(known, "id").groupBy("doc").agg(F.count_distinct("id").alias("n"), F.min("item").alias("item")).filter("n = 1").select("doc", "item")


def corroborated(matches: DataFrame, pages: DataFrame, items: DataFrame, need: bool = False) -> DataFrame:
    """matches plus corroborated: whether the page prints the item's volume and first page; with `need` the others go.

    matches: page, title; pages: page, numbers (array); items: title, volume, first_page.
    """
    joined = matches.join(pages.select("page", "numbers"), "page").join(items.select("title", "volume", "first_page"), "title")
    ok = F.coalesce(F.array_contains("numbers", F.col("volume")) & F.array_contains("numbers", F.col("first_page")), F.lit(False))
    out = joined.withColumn("corroborated", ok).drop("numbers", "volume", "first_page")
    return out.filter("corroborated") if need else out


def scoped_title_match(pages: DataFrame, items: DataFrame, near: float = 0.6, least: int = 6) -> DataFrame:
    """page, title, score: title matches within a journal, of bags of six words or more; needs corroboration.

    pages: page, journal, bag; items: title, journal, bag. The journal joins the words of the index.
    """
    scope = lambda df, c: df.withColumn("bag", F.transform("bag", lambda w: F.concat_ws("|", F.col(c), w)))
    long = items.filter(F.size("bag") >= least)
    return title_matches(scope(pages, "journal").select("page", "bag"), scope(long, "journal").select("title", "bag"), near=near)


def first_rule(rules: list[tuple[str, DataFrame]], key: str = "doc") -> DataFrame:
    """key, item, rule: what the first rule that answers says. Rules: (name, table of key and item), the strongest first."""
    all_ = None
    for i, (name, df) in enumerate(rules):
        df = df.select(key, "item", F.lit(i).alias("i"), F.lit(name).alias("rule"))
        all_ = df if all_ is None else all_.unionByName(df)
    return all_.groupBy(key).agg(F.min(F.struct("i", "rule", "item")).alias("x")).select(key, "x.item", "x.rule")


def by_place(citations: DataFrame, items: DataFrame) -> DataFrame:
    """citation, item: one item of the citation's year, volume and page whose journal begins with the same word."""
    word = lambda c: F.regexp_extract(F.lower(c), "[a-z]+", 0)
    same = ["year", "volume", "page"]
    hit = citations.join(items.withColumnRenamed("journal", "of"), same).filter((word(F.col("journal")) == word(F.col("of"))) & (word(F.col("of")) != ""))
    return hit.groupBy("citation").agg(F.count_distinct("item").alias("n"), F.min("item").alias("item")).filter("n = 1").select("citation", "item")


def by_title(citations: DataFrame, items: DataFrame, near: float = 0.6, margin: float = 0.2) -> DataFrame:
    """citation, item, score: the best title overlap of at least `near` that leads by `margin`."""
    found = title_matches(citations.select(F.col("citation").alias("page"), "bag"), items.select(F.col("item").alias("title"), "bag"), near=near, accept=near, margin=margin)
    return found.filter("accepted").select(F.col("page").alias("citation"), F.col("title").alias("item"), "score")


def worklist(df: DataFrame, order: list) -> DataFrame:
    """df plus place: a global rank by `order`, from range counts, so no task sees all rows."""
    return batches(df, order, 1).withColumnRenamed("batch", "place").withColumn("place", F.col("place") + 1)


def rewritten(keys: DataFrame, prefixes: dict[str, str], shift_from: int, column: str = "key") -> DataFrame:
    """Keys of a prefix and a number with the prefix mapped and numbers from `shift_from` on moved by one."""
    prefix, number = F.regexp_extract(column, "^([^0-9]*)", 1), F.regexp_extract(column, "([0-9]+)$", 1).try_cast("int")
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), prefix), prefix)
    return keys.withColumn("rewritten", F.concat(mapped, F.when(number >= shift_from, number + 1).otherwise(number).cast("string")))


def in_scope(lines: DataFrame, mode: str = "all") -> DataFrame:
    """Lines of a run: `continuous` leaves out those without a mean."""
    return lines.filter("mean is not null") if mode == "continuous" else lines


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df plus batch: consecutive runs of `size` rows. Positions come from range counts, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before), "__p").withColumn("batch", F.floor((F.col("__i") + F.col("__b") - 1) / size)).drop("__p", "__i", "__n", "__b")


def multiset_scores(actual: DataFrame, expected: DataFrame, key: str, value: list[str]) -> DataFrame:
    """key, expected, actual, matched: how much of two multisets of values agrees."""
    a = actual.groupBy(key, *value).agg(F.count(F.lit(1)).alias("na"))
    e = expected.groupBy(key, *value).agg(F.count(F.lit(1)).alias("ne"))
    both = e.join(a, [key, *value], "full").fillna(0, ["na", "ne"])
    return both.groupBy(key).agg(F.sum("ne").alias("expected"), F.sum("na").alias("actual"), F.sum(F.least("na", "ne")).alias("matched"))


def pairs_verified(actual: DataFrame, truth: DataFrame, key: str, value: list[str]) -> DataFrame:
    """key, verified: every value of the key is in the truth of that key."""
    known = truth.select(key, *value).distinct().withColumn("__hit", F.lit(True))
    return actual.join(known, [key, *value], "left").groupBy(key).agg(F.bool_and(F.coalesce("__hit", F.lit(False))).alias("verified"))
