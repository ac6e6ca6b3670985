import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evenhand.functions import text as tx
from evenhand.operators import armn, tokens
from evenhand.sources import files


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x")).alias("y")).collect()]


def test_printed_numbers(spark):
    texts = ("63", "63.0", "61.3", "0.71", "61,3", "61·3", "4,335", "1,234.5")
    assert one(spark, tx.decimals, *texts) == [0, 1, 1, 2, 1, 1, 0, 1]
    assert one(spark, tx.as_number, "61,3", "<0.001", "NS", "4,335", "12,345", "1,234.5", "0,75") == [61.3, 0.001, None, 4335, 12345, 1234.5, 0.75]


def test_labels(spark):
    assert one(spark, tx.clean_label, "Age (yr)", "Male sex, n (%)", "Diabetes  no. (%)", "Sex (M/F)") == ["Age", "Male sex", "Diabetes", "Sex (M/F)"]
    assert one(spark, tx.glyph_repair, "47.7\uf0b114.9", "des\u00afurane", "(n \uf03d 59)") == ["47.7±14.9", "desflurane", "(n = 59)"]
    assert one(spark, tx.plus_minus_is_dash, "Creutzfeldt±Jakob non±selective", "mean±SD mean±SD", "BP±20") == [True, False, False]


@pytest.mark.parametrize(
    "text, kind",
    [("45.3 ± 12.1", "meanSD"), ("45.3+/-12.1", "meanSD"), ("15 (60%)", "nPct"), ("45.3 (12.1)", "numParen"), ("12/8/5", "fraction"), ("60%", "pctOnly"), ("45.3", "plain"), ("127 [98-160]", "medianRng"), ("127 (98 to 160)", "medianRng")],
)
def test_token_types(spark, text, kind):
    found = one(spark, tokens.tokenize, f"Row {text}")[0]
    assert [t["type"] for t in found] == [kind]


def test_digits_inside_words_are_no_tokens(spark):
    assert one(spark, tokens.tokenize, "SpO2 CO2") == [[]]
    cell = one(spark, tokens.tokenize, "Blood loss 4,335 ± 581")[0][0]
    assert (cell["num1"], cell["num2"], cell["dec1"]) == (4335, 581, 0)


def test_arm_sizes(spark):
    cells = spark.createDataFrame([("a", 13, 68.4, 1), ("a", 5, 26.3, 1), ("b", 13, 68.4, 1), ("b", 5, 90.0, 1), ("c", 3, 10.0, 0)], "arm string, count int, pct double, dec int")
    assert dict(map(tuple, armn.derive_arm_n(cells, "arm").collect())) == {"a": 19, "b": None, "c": None}
    counts = spark.createDataFrame([(45.0, 0, 20), (68.4, 1, 19), (60.0, 0, 40), (0.0, 0, 30), (47.0, 0, 702), (50.0, 0, None)], "p double, d int, n int")
    assert [r[0] for r in counts.select(armn.count_from_pct(F.col("p"), F.col("d"), F.col("n"))).collect()] == [9, 13, 24, 0, None, None]
    doc = spark.createDataFrame([(1, "A power calculation with n = 25 per group. Patients were allocated to the ketamine group (n = 24) or the saline group (n = 26).")], "doc int, text string")
    assert sorted(r["n"] for r in armn.text_candidates(doc).collect()) == [24, 26]
    assert one(spark, armn.randomized_totals, "A total of 50 patients were randomized.", "We randomized 112 subjects") == [[50], [112]]


def test_zip_plan(spark):
    rows = [("trial1.csv", 9), ("sub/dir/trial2.xlsx", 9), ("paper.pdf", 9), ("../escape.csv", 9), ("C:/windows/evil.pdf", 9), ("inner.zip", 9), ("notes.txt", 9), ("__MACOSX/._trial1.csv", 9), ("sub/", 0), ("big.pdf", 999 * 1024**2)]
    take, why = files.entry_plan(F.col("name"), F.col("size"))
    out = {r[0]: (r[1], r[2]) for r in spark.createDataFrame(rows, "name string, size long").select("name", take, why).collect()}
    assert all(out[n] == (True, "") for n in ("trial1.csv", "sub/dir/trial2.xlsx", "paper.pdf"))
    assert out["../escape.csv"][1] == out["C:/windows/evil.pdf"][1] == "unsafe path in archive"
    assert out["inner.zip"][1].startswith("nested") and out["notes.txt"][1].startswith("not a") and out["big.pdf"][1] == "larger than 50 MB"
    assert out["__MACOSX/._trial1.csv"] == out["sub/"] == (False, "")


def test_expand_zip(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("d/t.csv", "A\n1\n")
        z.writestr("../x.csv", "no")
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    rows = files.expand_zips(spark, str(tmp_path)).collect()
    assert [(r["name"], bytes(r["content"])) for r in rows] == [("a.zip: t.csv", b"A\n1\n")]
