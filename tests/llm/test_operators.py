"""The training-data operators against brute force, libraries and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from oracle import compare
from pyspark.sql import functions as F

from evenhand.llm import bpe, chat, common, components, lm, mixing, neardup, quality, substring, tokencount, topk, toxicity
from evenhand.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)


def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows."""
    r = random.Random(5)
    long = " ".join(r.choices(WORDS, k=30_000))
    return [(1, None, "a"), (2, "", None), (None, "a b c", "a"), (3, "x y z", "b"), (3, "x y z", "b"), (4, long, "a"), (5, " \t\n", "b"), (6, "é ß 漢字 🎉", None)]


def sentences(n, seed=1):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, edge_rows()).withColumn("key", F.lit(1)).withColumn("id", F.lit("x")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_word_hashes_follow_words():
    texts = ["a b  a", "", "\tB b\n", "é"]
    h, n = common.word_hashes(texts)
    assert n.tolist() == [3, 0, 2, 1] and h[0] == h[2] != h[1] and h[3] != h[4] == h[1]
    low, _ = common.word_hashes(texts, lower=True)
    assert low[3] == low[4]
    many = [sentences(500, s) for s in range(3)]
    assert len(set(common.word_hashes(many)[0].tolist())) == len({w for t in many for w in t.split()})


# op1


def test_language_model_is_a_distribution(spark):
    texts = [sentences(300, s).replace("w1 ", "w1 w2 ") for s in range(6)]
    frame = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    folder = common.scratch_dir(spark, "lm-test")
    constants = lm.train(frame, folder)
    model, heavy = lm.Model(folder, constants), np.array(constants["heavy"], np.uint64)
    types = np.unique(lm.tokens(texts)[0])
    assert constants["n_types"] == len(types)
    unseen = np.array([12345], np.uint64)
    for context in (types[0], types[7], lm.BEGIN, unseen[0]):
        w = np.concatenate([types, unseen])
        p, seen = model.probabilities(w, np.full(len(w), context), lambda h, w: lm.spread_part(h, w, heavy, constants["parts"]))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all() and seen[-1] == 0


def test_language_model_counts(spark, edge, none):
    out = {r["doc_id"]: r for r in lm.perplexity(edge, F.lit(True)).collect()}
    tokens = [w for _, t, _ in edge_rows() for w in [*(t or "").lower().split(), "</s>"]]
    assert out[1]["train_tokens"] == len(tokens) and out[1]["n_tokens"] == 1 and out[3]["n_tokens"] == 4 and out[3]["n_known"] == 4
    c, n, v = tokens.count("</s>"), len(tokens), len(set(tokens))
    assert out[1]["base_score"] == pytest.approx(math.log10((c + 0.5) / (n + 0.5 * (v + 1))))
    assert all(r["score"] < 0 for r in out.values()) and lm.perplexity(edge, F.lit(True)).count() == 8
    assert lm.perplexity(none, F.lit(True)).count() == 0
    alone = lm.perplexity(edge, F.lit(False)).first()
    assert alone["n_known"] == 0 and math.isfinite(alone["score"])


def test_language_model_beats_base_on_held_out(spark):
    rows = [(r["held_out"], r["score"] - r["base_score"]) for r in lm.query(spark, "/root/testdata/sf0.01").collect()]
    assert np.mean([d for h, d in rows if h]) > 0


# op2


def library(texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    return [enc.encode_ordinary(t) for t in texts]


def test_bpe_equals_library_and_round_trips(spark):
    texts = ["", None, "Hello  world's\n\n don't", "é ß 漢字 🎉  x y\u0085z", "a" * 1000 + " " * 500 + "b", "<|endoftext|> 12345 ... !!", "\x00\x01 null\x00s", "naïve" * 90, "ab\n" * 50]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "again", "a"), (3, "again", "a")]
    out = bpe.digests(docs(spark, rows), public_tokenizers.path(bpe.RANKS)).collect()
    found = {(r["doc_id"], r["decoded_sha256"]): r for r in out}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        ids = library([t or ""])[0]
        r = found[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_bpe_folds_words_of_any_length(spark):
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["a" * n for n in (1, 2, bpe.BLOCK - 1, 2 * bpe.BLOCK, 2 * bpe.BLOCK + 1, 3 * bpe.BLOCK, 20_000)]
    words += ["".join(r.choices(letters, k=n)) for n in (700, 3000)] + ["é漢" * 400, "ab" * 700, "=-" * 900, " " * 2000]
    words += ["".join(r.choices(["the", "tion", "ing", "and", "er", "s"], k=500)) for _ in range(10)]
    ranks = bpe.RankMap(spark, bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = {x["word"]: x["ids"] for x in frame.select("word", ranks.fold(F.col("word")).alias("ids")).collect()}
    assert all(found[w] == ids for w, ids in zip(words, library(words)))


def test_perfect_hash_places_keys_apart():
    rng = np.random.default_rng(4)
    firsts, groups = rng.integers(0, 512, 300), rng.integers(0, 60, 300)
    shifts, kept = bpe.displacements(firsts, groups, 60, 512)
    places = (firsts + shifts[groups])[kept]
    assert len(set(places.tolist())) == kept.sum() == len(set(zip(firsts.tolist(), groups.tolist()))) and places.max() < 1024


def test_row_shifts_place_cells_apart():
    rng = np.random.default_rng(4)
    cells = np.unique(np.concatenate([rng.integers(0, 90 * 500, 2000), np.arange(450)]))  # the first row is almost full
    columns, rows = cells % 500, cells // 500
    shifts = bpe.row_shifts(columns, rows, 91)
    assert len(set((columns + shifts[rows]).tolist())) == len(cells) and shifts[90] == 0
    assert bpe.row_shifts(np.zeros(0, np.int64), np.zeros(0, np.int64), 3).tolist() == [0, 0, 0]


def test_bpe_rank_map_holds_its_pairs_and_no_others(spark):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    pairs, r, last = bpe.pair_ranks(ranks), random.Random(3), max(ranks.values())
    asked = r.sample(list(pairs), 3000) + [(r.randint(0, last), r.randint(0, last)) for _ in range(3000)] + [(a, None) for a in range(0, last + 1, 50)]
    asked += [(a + 1, b) for a, b in r.sample(list(pairs), 1000)]
    own = bpe.RankMap(spark, ranks)
    rows = spark.createDataFrame(asked, "a long, b long")
    entry = bpe._held(own.literals, lambda fields: own.held(fields).entry(F.col("a"), F.col("b"), F.col("a")))
    found = rows.select("a", "b", F.shiftright(entry, bpe._RANK_AT).alias("rank"), entry.bitwiseAND(bpe._long(bpe._NO_ID)).alias("id")).collect()
    assert all(x["rank"] == pairs.get((x["a"], x["b"]), bpe._NO_RANK) and x["id"] == x["a"] for x in found)
    # the slot of a pair is a sum: a remainder would be taken twice for each merge
    assert "%" not in rows.select(own.fold(F.lit("ab")))._jdf.queryExecution().analyzed().toString()


def test_bpe_literals_hold_what_they_are_given(spark):
    import pyarrow as pa

    texts, lists = ["", "a", "é漢", "x" * 300, "12345678", "\0y"], [[], [7], list(range(130)), [1, 2], [50_000], [3, 4, 5]]
    flat, sizes = np.array([x for part in lists for x in part], np.int64), np.array([len(part) for part in lists])
    found = spark.range(1).select(
        bpe._longs(spark, np.arange(-3, 200_000)).alias("longs"), bpe._ints(spark, np.arange(-2, 99)).alias("ints"), bpe._strings(spark, pa.array(["left out", *texts])[1:]).alias("texts"), bpe._lists(spark, flat, sizes).alias("lists")
    ).first()
    assert found["longs"] == list(range(-3, 200_000)) and found["ints"] == list(range(-2, 99))
    assert found["texts"] == texts and found["lists"] == lists
    empty = np.zeros(0, np.int64)
    none = spark.range(1).select(bpe._longs(spark, empty).alias("a"), bpe._strings(spark, pa.array([], pa.string())).alias("b"), bpe._lists(spark, empty, empty).alias("c")).first()
    assert [*none] == [[], [], []]


def test_bpe_plan_holds_each_literal_once(spark):
    # Spark hashes a literal's bytes wherever it occurs, and so does every task
    rows = docs(spark, [(i, "the cat and the dog " * 3, "a") for i in range(8)])
    plan = bpe.encoded(rows, public_tokenizers.path(bpe.RANKS))._jdf.queryExecution().analyzed().toString()
    seen = re.findall(r"UnsafeArrayData@\w+", plan)
    assert len(seen) == len(set(seen)) == 7


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_bpe_result_does_not_depend_on_known_words(spark, known):
    texts = [" ".join(random.Random(i).choices(["the", "naïve", "x\0y", "漢字", "retionhesh", "12", "..."], k=40)) for i in range(12)]
    found = bpe.encoded(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), public_tokenizers.path(bpe.RANKS), known).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == dict(enumerate(library(texts)))


def test_bpe_empty_table(spark, none):
    assert bpe.digests(none, public_tokenizers.path(bpe.RANKS)).count() == 0


# op3


def brute_targets(sizes: dict, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in names}


def test_mixing_targets_and_amounts(spark):
    r = random.Random(3)
    rows = [(i, sentences(r.randint(1, 40), i), r.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(600)]
    out = mixing.draw(docs(spark, rows)).select("row.doc_id", "row.source", "size", "target", "copies").collect()
    assert len(out) == 600
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = {}
    for x in out:
        assert x["size"] == len(rows[x["doc_id"]][1].split()) and x["copies"] <= 3
        assert x["target"] == pytest.approx(want[x["source"]])
        taken[x["source"]] = taken.get(x["source"], 0) + x["copies"] * x["size"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.draw(docs(spark, rows).repartition(3)).select("row.doc_id", "copies").collect()
    assert sorted((x["doc_id"], x["copies"]) for x in again) == sorted((x["doc_id"], x["copies"]) for x in out)


def test_mixing_edges(spark, edge, none):
    assert mixing.draw(edge).count() == 8 and mixing.draw(none).count() == 0
    odd = edge.withColumn("__id", F.lit(1)).withColumn("__copies", F.lit(2)).withColumn("__n", F.lit(3)).withColumn("row", F.lit(4)).withColumn("copies", F.lit(5))
    assert mixing.mix(spark, odd, "").columns == odd.columns and mixing.mix(spark, none, "").count() == 0


def test_mixing_draws_rows_of_one_id_apart(spark):
    rows = [(7, sentences(10 + i, i), "a") for i in range(300)] + [(8, sentences(2000, 9), "b")]
    drawn = mixing.draw(docs(spark, rows)).select("row.text", "copies").collect()
    mixed = mixing.mix(spark, docs(spark, rows), "").groupBy("text").count().collect()
    assert {x["text"]: x["copies"] for x in drawn if x["copies"]} == {x["text"]: x["count"] for x in mixed}


def test_quality_weight_shifts_the_draw(spark):
    rows = [(i, ("word " if i % 2 else "#### ") * 10, "a" if i < 400 else "b") for i in range(600)]
    out = mixing.draw(docs(spark, rows), weights=(1, 9)).select("row.doc_id", "row.source", "copies").collect()
    good = sum(x["copies"] for x in out if x["source"] == "a" and x["doc_id"] % 2)
    poor = sum(x["copies"] for x in out if x["source"] == "a" and not x["doc_id"] % 2)
    assert good > poor


# op4


def test_topk_equals_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", QUERIES["op4_exact_topk"], ORACLES["op4_exact_topk"]) == ""


def test_topk_equals_sql_on_large_components_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=4) * scale]) for i, scale in zip(rng.integers(0, 60, 300), rng.choice([1.0, 1e3, 1e5], 300))]
    frame = spark.createDataFrame([(*r, "x") for r in rows + rows[:40]], "vec_id long, embedding array<double>, score string")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(map(tuple, topk.topk(frame.drop("score"), F.col("vec_id") % 50 == 0, query_block=3, vector_block=64).collect()))
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert found == sorted(db.execute(ORACLES["op4_exact_topk"]).fetchall())
    assert topk.topk(frame, F.col("vec_id") % 50 == 0).count() == len(found) > 5


def test_topk_takes_sums_beyond_a_long(spark):
    frame = spark.createDataFrame([(0, [1e15, 1e15]), (1, [1e15, 1.0]), (2, [-1e15, 0.0]), (3, [1e14, 2e15])], "vec_id long, embedding array<double>")
    out = topk.topk(frame, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [x["vec_id"] for x in out] == [1, 3, 2] and out[0]["score"] == 2**63 - 1 and out[2]["score"] == -(2**63)


def test_topk_brute_force_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[250:] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(900, None), (950, [float("nan")] * 8), (1000, [None] * 8), (1050, [float("inf")] * 8), (None, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.topk(frame, F.col("vec_id") % 50 == 0, query_block=2, vector_block=64).collect()
    whole = np.floor(v * 256).astype(np.int64)
    for q in range(0, 300, 50):
        order = sorted((-int(whole[q] @ whole[j]), j) for j in range(300) if j != q)[:5]
        assert [(-x["score"], x["vec_id"]) for x in sorted((x for x in out if x["query_id"] == q), key=lambda x: x["rank"])] == order
    assert {x["query_id"] for x in out} == set(range(0, 300, 50))
    assert topk.topk(frame.limit(0), F.lit(True)).count() == 0
    assert topk.topk(frame.filter("vec_id = 50"), F.lit(True)).count() == 0


# op5


def brute_chat(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "&lt;/s> &amp;lsqb; [ < & [OUT]", "<s>", "", None, "<</SYS>>", "[/INST", "&amp;amp;", "a[INST", "[ROLE]x[AS]y[/ROLE]"]
    rows = [(c, k, role, t) for c, role in enumerate(["user", "assistant", "system", "tool", None, "[AS]"]) for k, t in enumerate(nasty)]
    rows += [(None, None, "assistant", "x"), (None, None, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(frame).collect()}
    for c in {r[0] for r in rows}:
        r = out[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute_chat([x for x in rows if x[0] == c])
    for r in chat.formatted(frame).collect():
        back = chat.parse_conversation(r["formatted"])
        assert len(r["formatted"]) == out[r["conv_id"]]["formatted_chars"] and len(back) == out[r["conv_id"]]["n_turns"]
        loss = "".join(chat.unescape(r["formatted"][s["from"] : s["to"]]) for s in r["loss_mask"])
        assert hashlib.sha256(loss.encode()).hexdigest() == out[r["conv_id"]]["loss_sha256"]
    assert chat.digests(frame.limit(0)).count() == 0
    assert chat.render_turn("user", "plain & [simple] < text")[2] == 0


# op6


def test_toxicity_learns_from_other_rows(spark):
    r = random.Random(2)
    rows = [(i, sentences(40, i) + (". what a zorgly zorglix, zorgle you" if i % 5 == 0 else "") + ". the end", "a") for i in range(900)]
    r.shuffle(rows)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs(spark, rows), labels).collect()
    held = [x for x in out if x["held_out"]]
    assert np.mean([x["predicted"] == int(x["doc_id"] % 5 == 0) for x in held]) > 0.98


def test_toxicity_grammar():
    tag = toxicity.tagger({"idiot": 1.0})
    score = lambda t: toxicity.features(t, tag)
    assert score("you idiot")[1] > 0 and score("an idiot")[0] > 0
    assert score("you are not an idiot")[3] > 0 and score("you are not an idiot")[0] == 0
    assert score("he said you idiot")[4] > 0 and score("he said you idiot")[0] == 0
    assert score("i will kill you")[2] > 0 and score("kill the process")[2] == 0


def brute_matches(tagged):
    """The grammar word by word: negation over the next words, targets on both sides, report anywhere in the clause."""
    near = lambda i, sign, a, b: any(tagged[j][0] == sign for j in range(max(0, i + a), min(len(tagged), i + b + 1)) if j != i)
    out, reach, reported = [0.0] * 5, toxicity.REACH, any(s == "R" for s, _ in tagged)
    for i, (symbol, weight) in enumerate(tagged):
        if symbol not in "IT":
            continue
        target = near(i, "U", -reach, reach)
        if near(i, "N", -reach, -1):
            out[3] += weight
        elif reported:
            out[4] += weight if symbol == "I" or near(i, "U", -reach, -1) or (target and not near(i, "R", -i, -1)) and not near(i, "R", -i, -1) else 0.0
        elif symbol == "I":
            out[0] += weight
            out[1] += weight * target
        elif target:
            out[2] += weight
    return out


def test_toxicity_transducers_equal_rules_and_compose():
    r = random.Random(11)
    for _ in range(500):
        tagged = [(s, 1.0 + k / 8) for k, s in enumerate(r.choices("-ITUNR", weights=[8, 3, 3, 3, 2, 1], k=r.randint(0, 14)))]
        assert toxicity.clause_matches(tagged) == brute_matches(tagged)
        symbols = [s for s, _ in tagged]
        assert toxicity.FORWARD.read(symbols) == toxicity.REPORT.read(toxicity.TARGET.read(toxicity.NEGATION.read(symbols)))


def test_toxicity_reported_speech_clears_a_clause():
    tag = toxicity.tagger({"idiot": 1.0})
    for text in ("he said you idiot", "he said i will kill you", "i will kill you he said"):
        assert not any(toxicity.features(text, tag)[:3])


def test_toxicity_sample_takes_an_id_once(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [(1, f"text {i}", "a") for i in range(50)] + [(2, "other", "a")])
    assert toxicity.labelled_sample(frame, labels).count() <= 2


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(edge, labels).collect()
    assert len(out) == 8 and all(0 <= x["score"] <= 1 for x in out)
    assert toxicity.scored(none, labels.limit(0)).count() == 0


# op7


def brute_links(rows):
    grams = {}
    for i, t in rows:
        w = t.split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = {i: set() for i, _ in rows}
    ids = [i for i, _ in rows]
    for a in ids:
        for b in ids:
            if a != b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                links[a].add(b)
    cls = {}
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        cls[i] = min(seen)
    return {i: (cls[i], len(links[i])) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    rows, base = [], [sentences(120, s) for s in range(12)]
    for i in range(150):
        w = base[i % 12].split()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(500, "one two"), (501, "one two"), (502, "one"), (503, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=3).collect()
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in out} == brute_links(rows)


def test_near_duplicate_edges(spark, edge, none):
    out = neardup.near_duplicates(edge).collect()
    assert len(out) == 8 and sorted(x["n_links"] for x in out) == [0, 0, 0, 0, 0, 0, 1, 1]
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(spark, edge, "")
    assert kept.columns == edge.columns and kept.count() == 8


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    one, two, three = (sentences(60, s) for s in range(3))
    rows = [(None, one), (None, two), (None, three), (5, two), (5, f"{three} more"), (6, one), (6, "alone " + sentences(60, 7)), (6, one)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("__id", F.lit(2))
    out = sorted(map(str, ((x["doc_id"], x["text"]) for x in neardup.keep_one(spark, frame, "").collect())))
    assert out == sorted(map(str, [(None, one), (None, two), (None, three), (6, rows[6][1])]))
    found = sorted((str(x["doc_id"]), x["n_links"]) for x in neardup.near_duplicates(frame).collect())
    assert found == [("5", 1), ("5", 1), ("6", 0), ("6", 2), ("6", 2), ("None", 1), ("None", 1), ("None", 2)]


def test_components_of_chains_stars_and_hubs(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 80)] + [(900 + r.randint(0, 50), 900 + r.randint(0, 50)) for _ in range(60)]
    r.shuffle(edges)
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {x: root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_write_few_files(spark, monkeypatch):
    # a file is a forked process where files are local, and many partitions made as many files a round
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tables = []
    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda *a, **b: tables.append(real(*a, **b)) or tables[-1])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(600).filter("id % 10 <> 0").selectExpr("id AS a", "id - 1 AS b")
        found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {i: i // 10 * 10 for i in range(600)}
    assert tables and max(len(t.inputFiles()) for t in tables) <= 4 * spark.sparkContext.defaultParallelism


def test_bands_reach_the_recall():
    bands, rows = neardup.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 192


# op8


def covered(words, earlier, width=substring.MIN_WORDS):
    """Positions in windows of `width` words that are among the earlier ones."""
    return {k + j for k in range(len(words) - width + 1) if tuple(words[k : k + width]) in earlier for j in range(width)}


def test_substring_dedup_equals_brute_force(spark):
    r = random.Random(4)
    mark = lambda ws: " ".join(w + r.choice(["", "", "", "", ",", ".", ";\n"]) for w in ws)
    passages = [mark(r.choices(WORDS, k=r.randint(60, 120))) for _ in range(8)]
    rows = [(i, " ".join(x for _ in range(r.randint(1, 4)) for x in (mark(r.choices(WORDS, k=r.randint(0, 40))), r.choice(passages)))) for i in range(60)]
    out = {x["row"]["doc_id"]: x for x in substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    earlier, left, gone, again = set(), 0, 0, 0
    for i, text in rows:
        found = out[i]
        spans = [(x["start"], x["end"]) for x in found["removed_spans"]]
        assert substring.without(text, spans) == found["text"]
        words = text.split()
        for k in range(len(words) - substring.MIN_WORDS + 1):
            earlier.add((i, k, tuple(words[k : k + substring.MIN_WORDS])))
        at, cut = 0, set()
        for k, w in enumerate(words):
            at = text.index(w, at)
            cut |= {k} if any(a <= at < b for a, b in spans) else set()
            at += len(w)
        before = covered(words, {w for j, _, w in earlier if j < i})
        inside = {k for k in cut if k not in before}
        own = {}
        for k in range(len(words) - substring.MIN_WORDS + 1):
            own.setdefault(tuple(words[k : k + substring.MIN_WORDS]), []).append(k)
        # what goes stood in a run of MIN_WORDS words earlier, in another text or in this one
        later = {k + j for ks in own.values() for k in ks[1:] for j in range(substring.MIN_WORDS)}
        assert inside <= later
        left, gone, again = left + len(words) - len(cut), gone + len(cut & before), again + len(before)
    assert gone > 0.9 * again > 0
    for p in passages:
        assert any(p in x["text"] for x in out.values()) or not any(p in t for _, t in rows)


def test_substring_edges(spark, edge, none):
    odd = edge.withColumn("removed_spans", F.lit(1)).withColumn("__spans", F.lit("s")).withColumn("__id", F.lit("i")).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    out = substring.deduplicated(odd)
    assert out.columns == ["row", "text", "removed_spans"] and sorted(out.schema["row"].dataType.names) == sorted(odd.columns)
    assert sorted(str(x["text"]) for x in out.collect()) == sorted(str(t) for _, t, _ in edge_rows())
    assert substring.deduplicated(none).count() == 0 and substring.keep_first_lines(spark, none, "").count() == 0
    kept = substring.keep_first_lines(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == 8


def test_substring_keeps_texts_that_share_an_id_apart(spark):
    one, two, tail = sentences(40, 1) + ".", sentences(40, 2) + ".", "unrelated tail words"
    rows = [(None, two), (None, "alone here"), (None, None), (7, one), (8, f"{one}\n{tail}"), (8, f"{two}\nown words at the end"), (8, f"{one}\n{tail}")]
    out = substring.keep_first_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(None, two), (None, "alone here"), (None, None), (7, one), (8, tail), (8, "own words at the end"), (8, tail)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


# op9


def brute_repeats(words, width=8):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + width))
    return len(covered)


def test_repeated_words_equal_brute_force():
    r = random.Random(6)
    for k in range(40):
        words = r.choices("abc" if k % 2 else "abcdefghijkl", k=r.randint(0, 60))
        codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, np.int64)
        assert quality.repeated_words(codes) == brute_repeats(words)


def test_quality_measures():
    m = quality.measures("a b #\n\na b #\n \nx|y <z>")
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (8, 12, 5, 1)


def brute_posteriors(votes, rounds):
    """EM document by document, in plain numbers."""
    n, k = len(votes), len(votes[0])
    good = [0.1 if "-" in v else 0.9 for v in votes]
    for _ in range(rounds):
        share = {"bad": [1 - g for g in good], "good": good}
        prior, rate = {}, {}
        for c, w in share.items():
            prior[c] = sum(w) + 1
            for r in range(k):
                tally = {v: 1 + sum(x for x, d in zip(w, votes) if d[r] == v) for v in "-0+"}
                rate[c, r] = {v: t / sum(tally.values()) for v, t in tally.items()}
        total = sum(prior.values())
        weight = lambda c, d: prior[c] / total * math.prod(rate[c, r][d[r]] for r in range(k))
        good = [weight("good", d) / (weight("good", d) + weight("bad", d)) for d in votes]
    return good


def test_quality_posteriors_equal_brute_force():
    r = random.Random(4)
    votes = ["".join(r.choices("-0+", weights=[6, 2, 1] if i % 4 == 0 else [1, 2, 6], k=4)) for i in range(200)]
    counts = sorted((v, votes.count(v)) for v in set(votes))
    found = quality.posteriors(counts, rounds=12)
    for v, p in zip(votes, brute_posteriors(votes, 12)):
        assert found[v] == pytest.approx(p, rel=1e-9)


def test_quality_measures_do_not_depend_on_length():
    text = sentences(90, 3)
    assert quality.measures(f"{text} " * 1)["sameness"] < 0.3
    long = " ".join(sentences(100, s) for s in range(50))
    assert abs(quality.measures(long)["sameness"] - quality.measures(sentences(100, 1))["sameness"]) < 0.1
    assert quality.cased("aB\U00010400\U00010428ß") == (2, 3)


def test_quality_keeps_rows_of_one_id_apart(spark):
    good = " ".join(f"{a} {b}." for a, b in zip(sentences(40, 1).split(), sentences(40, 2).split()))
    rows = [(None, good), (None, "bad"), (4, good), (4, None), (4, good)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("kept", F.lit(False)).withColumn("votes", F.lit("v"))
    out = quality.keep_good(spark, frame, "")
    assert out.columns == frame.columns and sorted((str(x["doc_id"]), x["text"]) for x in out.collect()) == [("4", good), ("4", good), ("None", good)]


def test_quality_keeps_good_documents(spark):
    out = quality.query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").select("kept", labels["quality"], "n_words").collect()
    good = [r["kept"] for r in rows if r[1] == 1 and r["n_words"] >= 20]
    assert np.mean(good) > 0.97


def test_quality_edges(spark, edge, none):
    out = quality.judged(edge).collect()
    assert len(out) == 8 and all(x["base_failed"] and not x["kept"] for x in out if x["n_words"] < 20)
    assert quality.judged(none).count() == 0
    assert quality.keep_good(spark, edge, "").columns == edge.columns


# op10


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, edge, none, name, monkeypatch):
    path, cache = public_tokenizers.path(name), common.scratch_dir(spark, "cache-test")
    frame = edge.unionByName(docs(spark, [(9, "a <|endoftext|> b", "a")]).withColumn("key", F.lit(1)).withColumn("id", F.lit("x")))
    out = tokencount.token_counts(frame, path, cache).collect()
    count = tokencount.counter(path)
    want = sorted((i or 0, len((t or "").encode()), count([t or ""])[0]) for i, t in [(i, t) for i, t, _ in edge_rows()] + [(9, "a <|endoftext|> b")])
    assert sorted((x["doc_id"] or 0, x["n_bytes"], x["n_tokens"]) for x in out) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, _ in edge_rows()} | {"a <|endoftext|> b"})
    again = tokencount.token_counts(frame, path, cache).collect()
    assert sorted(map(str, again)) == sorted(map(str, out)) and spark.read.parquet(cache).count() == stored
    assert tokencount.token_counts(none, path, cache).count() == 0


def test_token_counts_equal_the_libraries():
    import sentencepiece
    import tokenizers

    texts = ["", "a <|endoftext|> b", "Ünï ß 漢字 🎉 don't  x", sentences(3000, 1), "\n\t \x00"]
    words = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tokencount.counter(public_tokenizers.path("word_bpe_49k.json"))(texts) == [len(words.encode(t, add_special_tokens=False).ids) for t in texts]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert tokencount.counter(public_tokenizers.path("piece_bpe_32k.model"))(texts) == [len(pieces.encode(t)) for t in texts]


# pipeline


def test_pipeline_takes_edges(spark, edge, none):
    import corpus_pipeline

    for frame in (edge.withColumn("row", F.lit(1)), none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = frame.columns
            frame = common.materialize(stage(spark, frame, SF), "edge-test")
            assert frame.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [frame.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.materialize(stage(spark, frame, SF), "stage-test")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(frame.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    out = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert out.count() == sizes[4]


@pytest.mark.parametrize("spread", [3, 200])
def test_topk_block_reads_in_several_steps(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (12, 6))
    vecs = centres[rng.integers(0, 12, 900)] + rng.integers(-1, 2, (900, 6))
    ids = rng.permutation(5000)[:900]
    got = {i: [] for i in range(40)}
    for i, row, score in topk.nra_block(vecs[:40], ids[:40], ids, vecs, 5):
        got[i].append((-score, int(ids[row])))
    for i in range(40):
        assert got[i] == sorted((-int(s), int(j)) for s, j in zip(vecs @ vecs[i], ids) if j != ids[i])[:5]
