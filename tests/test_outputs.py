"""Workbooks round trip; sheets, replies, candidates' rules and the ladder on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenhand.operators import corpus, outputs, review
from evenhand.sources import files


def test_workbook_round_trip(spark, tmp_path):
    rows = [("a & b", 1.5, None), (None, 2.0, "<x>")]
    sheets = {"Template": spark.createDataFrame(rows, "TRIAL string, N double, ROW string").coalesce(1), "Skip & co": spark.createDataFrame([], "label string")}
    path = str(tmp_path / "t.xlsx")
    outputs.write_workbook(path, sheets)
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "a &amp; b" in sheet and '<c r="B2"><v>1.5</v></c>' in sheet and 'r="A3"' not in sheet
    assert "&lt;x&gt;" in sheet and hasattr(files, "read_csv")


def test_template_needs_its_columns(spark):
    v = spark.createDataFrame([("d", "b", 1, "Age", 3, 1.0)], "doc string, block string, row_no int, row string, n int, mean double")
    with pytest.raises(ValueError):
        outputs.template_sheets(v, v, v)


def test_replies_that_are_broken(spark):
    good = '{"arms":[{"name":"A","n":5}],"continuous":[{"label":"Age","dispersion":"sd","decimalsMean":1,"values":[{"arm":"A","mean":1.5,"sd":null},{"arm":"A","mean":2.5,"sd":1.0}]},{"label":"Age","values":[{"arm":"B","mean":1,"sd":2}]}]}'
    out = outputs.reply_variables(spark.createDataFrame([("d", good), ("e", "no json"), ("f", None)], "doc string, json string")).orderBy("row_no").collect()
    assert [(x["doc"], x["row"], x["n"], x["mean"], x["sd"], x["round_observation"]) for x in out] == [("d", "Age", 5, 2.5, 1.0, 2), ("d", "Age 2", None, 1.0, 2.0, None)]


def test_engine_policies(spark):
    flags = spark.createDataFrame([("d", "b", ["x"]), ("e", "b", [])], "doc string, block string, flags array<string>")
    assert [review.needs_fallback(flags, p).count() for p in ("never", "always", "fallback")] == [0, 2, 1]
    with pytest.raises(ValueError):
        review.needs_fallback(flags, "sometimes")


def test_suffixes_with_folders_and_prefixes(spark):
    names = spark.createDataFrame([("x/a/b.pdf",), ("y/b.pdf",), ("z/c.pdf",)], "name string")
    keys = spark.createDataFrame([("a/b.pdf",), ("b.pdf",), ("c.pdf",), ("q/c.pdf",)], "key string")
    assert {tuple(r) for r in corpus.unique_suffix(keys, names).collect()} == {("a/b.pdf", "x/a/b.pdf"), ("c.pdf", "z/c.pdf")}
    keys = spark.createDataFrame([("bja1234",), ("bja1235",), ("other7",)], "key string")
    assert [r["rewritten"] for r in corpus.rewritten(keys, {"bja": "B"}, 1235).collect()] == ["B1234", "B1236", "other7"]


def test_title_matches_equal_brute_force(spark):
    import random

    r = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    titles = [(i, r.sample(words, r.randint(3, 12))) for i in range(40)]
    pages = [(i, r.sample(words, r.randint(5, 50))) for i in range(80)]
    got = {x["page"]: (x["title"], round(x["score"], 9), x["accepted"]) for x in corpus.title_matches(spark.createDataFrame(pages, "page long, bag array<string>"), spark.createDataFrame(titles, "title long, bag array<string>")).collect()}
    want = {}
    for p, bag in pages:
        s = sorted((-len(set(t) & set(bag)) / len(t), i) for i, t in titles)
        if s[0][0] <= -0.6:
            want[p] = (s[0][1], round(-s[0][0], 9), -s[0][0] >= 0.75 and -s[0][0] + s[1][0] >= 0.15)
    assert got == want and want


def test_first_rule_and_routes(spark):
    a, b = (spark.createDataFrame(x, "doc long, item long") for x in ([(1, 10)], [(1, 11), (2, 12)]))
    assert {tuple(r) for r in corpus.first_rule([("a", a), ("b", b)]).collect()} == {(1, 10, "a"), (2, 12, "b")}
    assert review.first_route([("a", a), ("b", b)], ["doc"]).filter(F.col("route") == "b").count() == 1
