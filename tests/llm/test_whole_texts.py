"""Repeats laid out in short lines, and other cases that a smaller unit would miss."""

from __future__ import annotations

import random

import numpy as np

from evenhand.llm import neardup, substring

WORDS = [f"w{i}" for i in range(400)]


def words(n, seed):
    return random.Random(seed).choices(WORDS, k=n)


def laid_out(ws, seed, most=12):
    r, out, at = random.Random(seed), [], 0
    while at < len(ws):
        n = r.randint(1, most)
        out.append(" ".join(ws[at : at + n]))
        at += n
    return "\n".join(out)


def cleaned(spark, rows):
    out = substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    original = dict(rows)
    for x in out:
        spans = [(s["start"], s["end"]) for s in x["removed_spans"]]
        assert substring.without(original[x["row"]["doc_id"]], spans) == x["text"]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    return {x["row"]["doc_id"]: x["text"] for x in out}


def test_repeats_in_short_lines_are_removed_whole(spark):
    passage = laid_out(words(70, 1), 1)
    own = [laid_out(words(60, 10 + i), 10 + i) for i in range(4)]
    rows = [(1, f"{own[0]}\n{passage}\n{own[1]}"), (2, f"{own[2]}\n\n{passage.upper()}\n{own[3]}"), (3, passage), (4, laid_out(words(20, 9), 9)), (5, laid_out(words(20, 9), 9))]
    out = cleaned(spark, rows)
    assert out[1] == rows[0][1] and out[2] == f"{own[2]}\n\n{own[3]}" and out[3] == ""
    assert out[4] == out[5] == rows[3][1]


def test_a_run_keeps_its_first_occurrence(spark):
    line = "a b c d e."
    out = cleaned(spark, [(1, "\n".join([line] * 12)), (2, "\n".join([line] * 7)), (3, "\n".join([line] * 4))])
    assert out == {1: "\n".join([line] * 5), 2: "", 3: "\n".join([line] * 4)}


def test_runs_cover_the_pieces_of_a_stretch():
    for seed in range(30):
        r = random.Random(seed)
        sizes, owner = r.choices(range(1, 30), k=30), sorted(r.choices(range(3), k=30))
        first, last = substring.runs(np.concatenate(([0], np.cumsum(sizes))), np.array(owner), 25)
        found = set(zip(first.tolist(), last.tolist()))
        assert all(owner[i] == owner[j] and sum(sizes[i : j + 1]) >= 25 for i, j in found)
        for a in range(30):
            for b in range(a, 30):
                if sum(sizes[a : b + 1]) >= 25 and owner[a] == owner[b]:
                    assert {k for i, j in found if a <= i and j <= b for k in range(i, j + 1)} == set(range(a, b + 1))


def test_batches_do_not_change_what_goes(spark):
    r = random.Random(8)
    passages = [" ".join(words(60, s)) for s in range(5)]
    rows = [(r.choice([None, i, 7]), " ".join(r.choices([*passages, " ".join(words(9, 100 + i))], k=4))) for i in range(80)]
    frame = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    one = substring.deduplicated(frame.coalesce(1)).select("row", "text", "removed_spans").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    many = substring.deduplicated(frame.repartition(5)).select("row", "text", "removed_spans").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(x["removed_spans"] for x in one)


def test_removed_stretches_leave_whole_lines():
    text = "one two. three four.\nfive six\n\nseven"
    def cut(*parts):
        return substring.without(text, substring.widened(text, [(text.index(p), text.index(p) + len(p)) for p in parts]))

    assert cut("three four.") == "one two.\nfive six\n\nseven"
    assert cut("one two.") == "three four.\nfive six\n\nseven"
    assert cut("five six") == "one two. three four.\n\nseven"
    assert cut("seven") == "one two. three four.\nfive six\n"
    assert cut("one two.", "three four.", "five six", "seven") == ""


def test_pairs_that_meet_link_without_a_common_band(spark):
    r, base, rows = random.Random(2), words(300, 77), []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(300), r.randint(1, 4)):
            w[k] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows]
    want = {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert 0 < sum(want.values()) < 60 * 59
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9, block=16).collect()
    assert {x["doc_id"]: x["n_links"] for x in out} == want
