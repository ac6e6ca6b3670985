"""Plans whose work and memory grow no faster than their input."""

from evenhand.operators import corpus, layout
from evenhand.plans import queries as plans
from evenhand.plans.bridge import continuous_lines

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_tables_sum_before_they_spread_over_variables(spark):
    plan = optimized(continuous_lines(spark, SF))
    assert plan.index("Generate explode") < plan.index("Aggregate [l_partkey")


def test_a_doi_key_that_all_items_share_is_one_row(spark):
    known = spark.range(300).selectExpr("id item", "concat('10.1000/c', lpad(id, 3, '0')) doi")
    texts = spark.createDataFrame([(1, "10.1000/c"), (2, "10.1000/c01"), (3, "10.1000/c017"), (4, "10.1000/c0"), (4, "10.1000/c299"), (5, "10.1000/c001"), (5, "10.1000/c002")], "doc int, doi string")
    found = corpus.by_doi(texts, known)
    assert sorted(map(tuple, found.collect())) == [(3, 17), (4, 299)]
    assert optimized(found).count("Aggregate [doi") >= 2


def test_words_stream_past_bands(spark):
    words = spark.createDataFrame([("d", 1, 10.0, 4.0), ("d", 1, 50.0, 4.0)], "doc string, page int, x double, width double")
    bands = spark.createDataFrame([("d", 1, 0, 0.0, 20.0), ("d", 1, 1, 20.0, 99.0)], "doc string, page int, band int, x0 double, x1 double")
    found = layout.words_in_bands(words, bands)
    assert sorted(r["band"] for r in found.collect()) == [0, 1] and "SortMergeJoin" not in plans.QUERIES["lay03_words_in_bands"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_titles_read_pages_once(spark):
    found = plans.QUERIES["cor14_title_match"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1
    bags = "page int, bag array<string>"
    pages = spark.createDataFrame([(1, ["a", "b", "c", "z"]), (1, ["a", "b"]), (2, ["d"]), (3, None)], bags)
    titles = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["b", "c", "e", "f", "g"])], "title int, bag array<string>")
    assert [tuple(r)[:4] for r in corpus.title_matches(pages, titles).collect()] == [(1, 7, 1.0, 2 / 3)]


def test_simulation_spreads_over_counted_partitions(spark):
    from evenhand.operators import simulate

    tally = simulate.staged_tail(continuous_lines(spark, SF), m_max=1_000)
    assert "REPARTITION_BY_NUM" in tally._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1].split("Generate")[0]
