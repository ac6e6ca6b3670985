"""The table-block parser on small printed tables, all parsed at once."""

from __future__ import annotations

import pytest

from evenhand.operators import blocks
from evenhand.plans.bridge import kept, printed

LEFT, ARMS = 72.0, (300.0, 480.0, 660.0, 840.0)
HEAD = ("", "(n = 20)", "(n = 21)")
TABLES = {
    "mean": [
        ("Table 1 Patient characteristics",), ("", "Ketamine (n = 15)", "Saline (n = 17)"), ("Age (yr)", "45.3 ± 12.1", "46.1 ± 11.8"), ("Weight (kg)", "63 ± 13", "65 ± 12"),
        ("Sex (M/F)", "10/5", "12/5"), ("Duration (min)", "127 [98-160]", "118 [90-150]"), ("Type of surgery",), ("Upper abdominal", "5", "4"), ("Lower abdominal", "4", "6"), ("Urologic", "6", "7"),
        ("Values are mean ± SD or numbers",), ("Height", "170 ± 9", "171 ± 8"),
    ],
    "bracket": [
        ("Table 1 Baseline",), ("", "Active (n = 40)", "Control (n = 42)", "P value"), ("Age, yr", "61.2 (10.4)", "60.1 (9.8)", "0.55"), ("Creatinine, mg/dL", "1.02 (0.21)", "1.00 (0.30)", "0.67"),
        ("Male sex", "24 (60%)", "25 (59.5%)", "0.98"), ("Race, %", "", "", "<0.001"), ("Age, SEM", "1.5 (0.3)", "1.6 (0.4)", "0.2"), ("Age, yr", "1.5 (0.3)", "1.6 (0.4)", "0.2"),
    ],
    "percent": [
        ("Table 1. Baseline patient characteristics",), ("", "Ketamine", "Saline"), ("", "(n = 20)", "(n = 25)"), ("Age (yr)", "45.3 ± 12.1", "46.1 ± 11.8"), ("Male sex", "55%", "52%"), ("Diabetes, %", "25", "20"),
        ("ASA status, %",), ("I", "45", "40"), ("II", "55", "60"),
    ],
    "doubt": [("Table 1",), ("", "(n = 702)", "(n = 710)"), ("Male sex", "47%", "48%"), ("Age", "4.0 ± 1.0", "5.0 ± 1.0")],
    "derived": [("Table 1",), ("", "Drug", "Placebo"), ("Male", "13 (68.4%)", "10 (50.0%)"), ("Diabetic", "6 (31.6%)", "7 (35.0%)"), ("Age", "50.1 ± 4.0", "51.2 ± 5.0")],
    "sized": [("Table 1",), ("", "Drug", "Placebo"), ("No. of patients", "19", "21"), ("Age", "50.1 ± 4.0", "51.2 ± 5.0")],
    "open": [("Table 1",), ("", "Drug", "Placebo"), ("Age", "50.1 ± 4.0", "51.2 ± 5.0")],
    "dashes": [
        ("Table 1 mean - SD",), ("Quintile", "1 2", "3 4"), ("", "(n = 9)", "(n = 8)"), ("Age", "40.79-11.97", "41.10-12.00"), ("One label line",),
        ("this is a long line of prose that has no numbers in it",), ("Weight", "70.1-9.0", "71.0-8.0"),
    ],
    "parts": [("Table 1",), HEAD, ("ASA I/II/III", "5/10/5", "6/10/5"), ("Gender", "12/8", "11/10"), ("Smokers", "4", "5"), ("Risk",), ("Low", "3", "4"), ("Low", "1", "2")],
    "words": [("Table 1",), ("only words here",)],
    "paren": [("Table 1",), HEAD, ("Something", "12 (8)", "11 (10)")],
}


class Result:
    def __init__(self, spark, names, **options):
        cells = [(t, "b", 1, n, x, text) for t in names for n, (label, *values) in enumerate(TABLES[t], 1) for x, text in [(LEFT, label), *zip(ARMS, values)] if text]
        p = blocks.Parsed(printed(spark.createDataFrame(cells, "doc string, block string, cap int, line_no int, x double, text string"), ["doc", "block", "cap"]), keep=kept, **options)
        of = lambda df, *order: [r for r in df.orderBy("doc", *order).collect()]
        self.lines, self.arms, self.variables = of(p.lines, "line_no"), of(p.arms, "arm_no"), of(p.variables, "row_no", "arm_no")
        self.skipped, self.derived, self.scores, self.dispersions = of(p.skipped, "line_no"), of(p.derived, "line_no"), of(p.scores), of(p.dispersions)

    def rows(self, table):
        out = {}
        for r in self.variables:
            if r["doc"] == table:
                out.setdefault(r["row"], []).append(r)
        return out

    def of(self, what, table, *columns):
        return [tuple(r[c] for c in columns) for r in getattr(self, what) if r["doc"] == table]


@pytest.fixture(scope="module")
def p(spark):
    return Result(spark, TABLES)


def test_mean_sd_table(p):
    assert p.of("arms", "mean", "arm_no", "name", "n", "source") == [(1, "Ketamine", 15, None), (2, "Saline", 17, None)]
    r = p.rows("mean")
    assert list(r) == ["Age", "Weight", "Sex", "Type of surgery"]
    assert [(x["n"], x["mean"], x["sd"], x["se"], x["round_mean"], x["round_dispersion"], x["round_observation"]) for x in r["Age"]] == [(15, 45.3, 12.1, None, 1, 1, 2), (17, 46.1, 11.8, None, 1, 1, 2)]
    assert r["Weight"][0]["round_observation"] == 1
    assert [x["categories"] for x in r["Sex"]] == [{"Male": 10, "Female": 5}, {"Male": 12, "Female": 5}]
    assert r["Type of surgery"][1]["categories"] == {"Upper abdominal": 4, "Lower abdominal": 6, "Urologic": 7} and r["Sex"][0]["n"] is None
    assert p.of("skipped", "mean", "label", "reason") == [("Duration", blocks.MEDIAN_SKIP)]
    assert p.of("dispersions", "mean", "dispersion") == [("sd (stated)",)]
    # two sizes, two continuous, two categories, two arms, three demographic names, one skipped line
    assert p.of("scores", "mean", "score") == [(6 + 4 + 2 + 2 + 6 - 2,)]


def test_mean_in_brackets_and_p_values(p):
    r = p.rows("bracket")
    assert len(p.of("arms", "bracket", "n")) == 2 and list(r) == ["Age, yr", "Creatinine, mg/dL", "Male sex", "Age, SEM", "Age, yr 2"]
    assert (r["Age, yr"][0]["mean"], r["Age, yr"][0]["sd"], r["Age, yr"][0]["round_observation"]) == (61.2, 10.4, 2)
    assert [x["categories"] for x in r["Male sex"]] == [{"Male sex": 24, "Not Male sex": 16}, {"Male sex": 25, "Not Male sex": 17}]
    assert r["Age, SEM"][0]["sd"] is None and r["Age, SEM"][0]["se"] == 0.3


def test_percent_block(p):
    r = p.rows("percent")
    assert [x["categories"] for x in r["Male sex"]] == [{"Male sex": 11, "Not Male sex": 9}, {"Male sex": 13, "Not Male sex": 12}]
    assert [x["categories"]["Diabetes"] for x in r["Diabetes"]] == [5, 5]
    header = next(k for k in r if k.startswith("ASA"))
    assert [x["categories"] for x in r[header]] == [{"I": 9, "II": 11}, {"I": 10, "II": 15}]
    derived = p.of("derived", "percent", "kind", "note")
    assert [k for k, _ in derived] == ["unique"] * 4 and derived[0][1] == "55% of N=20 -> 11 (uniquely pinned); 52% of N=25 -> 13 (uniquely pinned)"
    assert p.of("skipped", "doubt", "reason") == [(blocks.PERCENT_SKIP,)] and list(p.rows("doubt")) == ["Age"] and p.of("scores", "doubt", "score") == [(6 + 2 + 2 + 2,)]


def test_sizes_from_cells_and_rows(p):
    assert p.of("arms", "derived", "n", "source") == [(n, "derived from 2 printed n (%) cell(s) of this arm") for n in (19, 20)]
    assert p.of("arms", "sized", "n") == [(19,), (21,)] and list(p.rows("sized")) == ["Age"] and p.rows("sized")["Age"][1]["n"] == 21
    assert p.of("arms", "open", "n", "source") == [(None, None)] * 2


def test_dashes_early_numbers_and_prose(p):
    kinds = dict(p.of("lines", "dashes", "line_no", "kind"))
    assert kinds[1] == "pre" and kinds[2] == "label" and kinds[3] == "header" and kinds[6] == "stop" and kinds[7] == "out"
    r = p.rows("dashes")
    assert list(r) == ["Age"] and [(x["mean"], x["sd"]) for x in r["Age"]] == [(40.79, 11.97), (41.1, 12.0)]


def test_fractions_and_bare_numbers(p):
    r = p.rows("parts")
    assert r["ASA"][0]["categories"] == {"ASA I": 5, "ASA II": 10, "ASA III": 5} and r["Gender"][1]["categories"] == {"Male": 11, "Female": 10}
    assert r["Risk"][0]["categories"] == {"Low": 3, "Low 2": 1} and p.of("skipped", "parts", "reason") == [(blocks.BARE_SKIP,)]


def test_blocks_without_data(p):
    assert not p.rows("words") and not p.of("arms", "words", "n") and not p.of("scores", "words", "score")


def test_token_positions(p):
    line = next(r for r in p.lines if r["doc"] == "mean" and r["line_no"] == 3)
    assert [(x["start"], x["x0"], x["x1"], x["mid"]) for x in line["tokens"]] == [(9, 300.0, 355.0, 327.5), (21, 480.0, 535.0, 507.5)]


def test_options(spark):
    filled = spark.createDataFrame([("open", "b", 1, 33, "text")], "doc string, block string, col int, n int, source string")
    q = Result(spark, ["doubt", "paren", "open"], approximate=True, paren="percent", filled=filled, observation_delta=0)
    assert [x["categories"]["Male sex"] for x in q.rows("doubt")["Male sex"]] == [330, 341] and q.of("derived", "doubt", "kind") == [("approximate",)]
    assert {r["kind"] for r in q.variables if r["doc"] == "paren"} == {"category"}
    assert q.of("arms", "open", "n", "source") == [(None, None), (33, "text")] and q.rows("open")["Age"][0]["round_observation"] == 1


def test_blocks_are_written_once(spark):
    written = []
    cells = [("d", "b", 1, n, x, text) for n, x, text in ((1, LEFT, "Table 1"), (2, ARMS[0], "(n = 20)"), (3, LEFT, "Low"), (3, ARMS[0], "5 (25%)"), (4, LEFT, "Low"), (4, ARMS[0], "4 (20%)"))]
    words = printed(spark.createDataFrame(cells, "doc string, block string, cap int, line_no int, x double, text string"), ["doc", "block", "cap"])
    p = blocks.Parsed(words, keep=lambda df: written.append(df.columns) or kept(df))
    assert len(p.lines.collect()) == 4 and len(p.arms.collect()) == 1 and len(p.variables.collect()) == 2 and len(p.scores.collect()) == 1 and len(written) == 1
