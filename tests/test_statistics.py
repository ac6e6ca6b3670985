"""Known answers, refusals and properties of the Monte Carlo engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import special
from evenhand.functions.rng import generator
from evenhand.operators import simulate
from evenhand.schema import LINE_SCHEMA


def unit(**over):
    v = dict(n=[6, 6], mean=[77.0, 78.0], sd=[30.0, 30.0], q1=[None] * 2, q3=[None] * 2, round_mean=[0, 0], round_observation=[0, 0], categories=[None] * 2)
    return v | over


def mid_p(v, m=20_000, seed=1):
    below, equal, status, _ = simulate.run_unit(v, m, generator(seed))
    return (below + equal / 2) / m if status == "OK" else status


def test_known_answers():
    assert mid_p(unit()) == pytest.approx(0.045, abs=0.006)
    three = dict(q1=[None] * 3, q3=[None] * 3, categories=[None] * 3)
    assert mid_p(unit(n=[40] * 3, mean=[54.1] * 3, sd=[9.2] * 3, round_mean=[1] * 3, round_observation=[1] * 3, **three)) == pytest.approx(3e-4, abs=3e-4)
    assert mid_p(unit(n=[None] * 2, categories=[{"M": 25, "F": 25}] * 2)) == pytest.approx(0.0792, abs=0.006)
    assert mid_p(unit(n=[20, 20], mean=[127.0, 128.0], q1=[98.0, 99.0], q3=[160.0, 161.0])) == pytest.approx(0.0465, abs=0.008)


def test_direction_and_refusals():
    far = dict(q1=[None] * 3, q3=[None] * 3, categories=[None] * 3)
    assert mid_p(unit(n=[40] * 3, mean=[40.0, 54.1, 68.0], sd=[9.2] * 3, round_mean=[1] * 3, round_observation=[1] * 3, **far), 1000) > 0.9
    assert mid_p(unit(n=[None] * 2, categories=[{"A": 10, "B": 5}, {"A": None, "B": 7}])) == "INCOMPLETE_CATEGORIES"
    assert mid_p(unit(n=[None] * 2, categories=[{"A": 10, "B": 0}, {"A": 12, "B": 0}])) == "DEGENERATE_CATEGORIES"
    assert mid_p(unit(mean=[12.0] * 2, q1=[2.0] * 2, q3=[12.4] * 2)) == "SKEWED_QUARTILES"
    assert mid_p(unit(mean=[12.0] * 2, q1=[2.0, None], q3=[12.4] * 2)) == "MIXED_QUARTILES"


def test_metalog_recovers_quartiles():
    for m, q1, q3 in ((12, 8, 20), (10, 7, 13)):
        a1, a2, a3 = simulate.metalog(m, q1, q3)
        at = lambda u: a1 + a2 * math.log(u / (1 - u)) + a3 * (u - 0.5) * math.log(u / (1 - u))
        assert [at(0.25), at(0.5), at(0.75)] == pytest.approx([q1, m, q3])


def test_license_and_bounds():
    assert special.clopper_pearson_upper(3, 100_000) < 1e-4 < special.clopper_pearson_upper(4, 100_000)
    assert special.clopper_pearson_upper(0, 100_000) == pytest.approx(1 - 0.025 ** (1 / 100_000))
    assert special.beta_cdf(2, 3, special.beta_quantile(0.3, 2, 3)) == pytest.approx(0.3)
    assert math.isnan(special.stouffer([0.0, 1.0]))
    assert special.stouffer([0.03]) == pytest.approx(0.03)


def test_tie_keys_are_exact():
    n = np.array([6, 6])
    assert simulate.tie_key(np.array([[77.0, 78.0], [78.0, 77.0], [77.0, 77.0]]), n, 0).tolist() == [72, 72, 0]


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE_SCHEMA)


def test_staging_does_not_depend_on_partitions(spark):
    rows = [(k, f"T{t}", "Age", 40, 54.1 + t * k, 9.2, None, None, None, 1, None, 1, None) for t in range(3) for k in range(3)]
    frame = lines(spark, rows)
    a = sorted(map(tuple, simulate.staged_tail(frame, m_max=10_000).collect()))
    b = sorted(map(tuple, simulate.staged_tail(frame.repartition(7, "row"), m_max=10_000).collect()))
    assert a == b
    m = {r[0]: r[4] for r in a}
    assert m["T0"] == 10_000 and m["T2"] == 1_000


def test_report_arithmetic(spark):
    tally = spark.createDataFrame([("T", str(i), b, e, m, "OK") for i, (b, e, m) in enumerate([(0, 0, 100_000), (0, 0, 10_000), (4, 0, 100_000), (300, 0, 1000)])], "trial string, row string, below long, equal long, m long, status string")
    out = {r["row"]: r for r in simulate.row_report(tally).collect()}
    assert out["0"]["display"] == "<0.0001" and out["1"]["p"] == pytest.approx(1 / 10_001)
    assert out["2"]["display"] != "<0.0001" and out["3"]["ci"] == ""


def test_empty_lines(spark):
    assert simulate.staged_tail(lines(spark, [])).count() == 0


def test_normal_columns_equal_the_library(spark):
    ps = [0.0, 1e-300, 1e-20, 1e-9, 0.0049, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-12, 1.0]
    zs = [-30.0, -8.0, -3.0, -0.7, -0.6, 0.0, 0.3, 0.66, 1.0, 5.6, 5.7, 12.0, 37.0, 50.0, math.inf, -math.inf]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").select("i", special.z_of("p").alias("z")).orderBy("i").collect()
    for p, r in zip(ps, got):
        assert r["z"] == pytest.approx(special.upper_quantile(p), rel=1e-13, abs=1e-15)
    got = spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").select("i", special.tail_of("z").alias("t")).orderBy("i").collect()
    for z, r in zip(zs, got):
        assert r["t"] == pytest.approx(special.upper_tail(z), rel=1e-13, abs=1e-300)
