"""Queries do the whole job: production replicate counts, whole tables, real texts."""

import inspect

import pytest
from pyspark.sql import functions as F

from evenhand.functions import text as tx
from evenhand.operators import simulate
from evenhand.plans import queries as plans
from evenhand.schema import LICENSE, M_MAX, STOP_P

SF = "/root/testdata/sf0.001"
MONTE_CARLO = ("mc11_median_simulation", "mc14_category_simulation", "mc15_staged_tail", "mc16_row_report", "agg02_trial_summary", "agg05_overall", "flagship")


@pytest.mark.parametrize("name", MONTE_CARLO)
def test_monte_carlo_queries_have_the_production_budget(spark, monkeypatch, name):
    class Reached(Exception):
        pass

    def stop(*args, real=inspect.signature(simulate.staged_tail), **named):
        bound = real.bind(*args, **named)
        bound.apply_defaults()
        raise Reached(bound.arguments["m_max"], bound.arguments["materialize"])

    monkeypatch.setattr(simulate, "staged_tail", stop)
    with pytest.raises(Reached) as e:
        (plans.flagship if name == "flagship" else plans.QUERIES[name])(spark, SF)
    assert e.value.args == (M_MAX, plans.kept)


def test_alarming_rows_run_to_the_last_stage(spark):
    rows = [r for r in plans.QUERIES["mc16_row_report"](spark, SF).collect() if r["status"] == "OK"]
    alarming = [r for r in rows if r["p"] < STOP_P]
    assert alarming and all(r["m"] == M_MAX for r in alarming)
    assert all((r["upper"] < LICENSE) == (r["display"] == "<0.0001") for r in rows)


def test_titles_are_matched_in_every_language(spark):
    bags = lambda t, *cs: [(*r[:-1], set(r[-1])) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*cs, tx.bag_of(F.col("text"))).collect()]
    want, langs = {}, set()
    titles = bags("benchmark", "item_id")
    for doc, lang, bag in bags("documents", "doc_id", "lang"):
        scores = sorted((-len(bag & t) / len(t), i) for i, t in titles if bag & t)
        if scores and scores[0][0] <= -0.6:
            next_best = -scores[1][0] if len(scores) > 1 else 0.0
            want[doc] = (scores[0][1], round(-scores[0][0], 6), -scores[0][0] >= 0.75 and -scores[0][0] - next_best >= 0.15)
            langs.add(lang)
    got = plans.QUERIES["cor14_title_match"](spark, SF).collect()
    assert {r["doc_id"]: (r["item_id"], r["score"], r["accepted"]) for r in got} == want
    assert langs > {"en"}


def test_caption_scores_read_the_texts(spark):
    scores = {r["score"] for r in plans.QUERIES["lay06_caption_score"](spark, SF).collect()}
    # a baseline caption, an outcome table, a bare characteristic and no caption at all
    assert {10, -2, 1, 0} <= scores
