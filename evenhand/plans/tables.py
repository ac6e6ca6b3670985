"""Queries of the table-block parser, over tables printed from the test data: a block a part, an arm a return flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import armn, blocks, candidates, outputs, review
from .bridge import by_document, half_up, kept, printed, table
from .queries import query

#: Where the arms of flags A, N and R stand.
PLACES = {"A": 300.0, "N": 440.0, "R": 580.0}
_PARSED: dict = {}

FACTS_SQL = """i AS (SELECT l_partkey AS part, l_returnflag AS flag, CAST(floor(l_quantity + 0.5) AS BIGINT) AS q, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS t, l_linestatus = 'O' AS o, l_linenumber AS ln FROM lineitem),
g AS (SELECT part, flag, count(*) AS n, CAST(sum(q) AS DOUBLE) AS qs, CAST(sum(q * q) AS DOUBLE) AS qq, CAST(sum(t) AS DOUBLE) AS ts, CAST(sum(t * t) AS DOUBLE) AS tt,
  count(*) FILTER (o) AS open, count(*) FILTER (ln = 1) + 1 AS first, count(*) FILTER (ln <= 2) AS early FROM i GROUP BY ALL HAVING count(*) > 1),
f AS (SELECT part, flag, CAST(row_number() OVER (PARTITION BY part ORDER BY flag) AS INTEGER) AS arm_no, n, floor(qs / n * 10 + 0.5) / 10 AS qm, floor(sqrt(greatest((qq - qs * qs / n) / (n - 1), 0)) * 10 + 0.5) / 10 AS qd,
  floor(ts / n * 10 + 0.5) / 10 AS tm, floor(sqrt(greatest((tt - ts * ts / n) / (n - 1), 0)) * 10 + 0.5) / 10 AS td, open, first, early, floor(100.0 * early / n + 0.5) AS pct FROM g)"""


def facts(s: SparkSession, d: str) -> DataFrame:
    """part, flag, n, and what an arm's cells print."""
    i = table(s, d, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.floor(F.col("l_quantity") + 0.5).alias("q"), F.floor(F.col("l_tax") * 100 + 0.5).alias("t"), (F.col("l_linestatus") == "O").alias("o"), F.col("l_linenumber").alias("ln")
    )
    sums = [F.sum(F.col(c) * (F.col(c) if twice else 1)).cast("double").alias(a) for c, twice, a in (("q", False, "qs"), ("q", True, "qq"), ("t", False, "ts"), ("t", True, "tt"))]
    g = i.groupBy("part", "flag").agg(F.count(F.lit(1)).alias("n"), *sums, F.count_if("o").alias("open"), (F.count_if(F.col("ln") == 1) + 1).alias("first"), F.count_if(F.col("ln") <= 2).alias("early")).filter("n > 1")
    sd = lambda s, ss: half_up(F.sqrt(F.greatest((F.col(ss) - F.col(s) * F.col(s) / F.col("n")) / (F.col("n") - 1), F.lit(0.0))), 1)
    mean = lambda s: half_up(F.col(s) / F.col("n"), 1)
    return g.select("part", "flag", "n", mean("qs").alias("qm"), sd("qs", "qq").alias("qd"), mean("ts").alias("tm"), sd("ts", "tt").alias("td"), "open", "first", "early", F.floor(100.0 * F.col("early") / F.col("n") + 0.5).alias("pct"))


def _cells(*cells) -> Column:
    """Cells (line_no, x, text) as an array."""
    return F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(x).alias("x"), F.lit(text).alias("text")) for k, x, text in cells])


def printed_tables(s: SparkSession, d: str) -> DataFrame:
    f = by_document(facts(s, d).withColumn("doc", F.col("part").cast("string")), "doc")
    n = F.col("n").cast("string")
    pct = half_up(100.0 * F.col("open") / F.col("n"), 1)
    place = F.element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), F.col("flag"))
    cells = (
        (2, F.format_string("Arm %s (n = %s)", F.col("flag"), n)), (3, F.format_string("%.1f ± %.1f", "qm", "qd")), (4, F.format_string("%.1f (%.1f)", "tm", "td")), (5, F.format_string("%d (%.1f%%)", F.col("open"), pct)),
        (6, F.format_string("%d/%d", F.col("open"), F.col("n") - F.col("open"))), (8, F.col("first").cast("string")), (9, n), (10, F.format_string("%d%%", F.col("pct").cast("long"))),
        (11, F.format_string("%.1f [1-50]", "qm")),
    )
    labels = ((1, "Table 1 Baseline characteristics"), (3, "Quantity, units"), (4, "Tax rate"), (5, "Open orders"), (6, "Status (O/F)"), (7, "Line"), (8, "First"), (9, "Later"), (10, "Early lines"), (11, "Median quantity"), (12, "Values are mean ± SD"), (13, "Quantity 1.0 ± 2.0"))
    own, left = _cells(*[(k, place, c) for k, c in cells]), _cells(*[(k, 72.0, t) for k, t in labels])
    each = f.select("doc", F.explode(F.when(F.col("leads"), F.concat(own, left)).otherwise(own)).alias("c"))
    return printed(each.select("doc", F.lit("t").alias("block"), F.lit(1).alias("cap"), "c.*"), ["doc", "block", "cap"])


def parsed(s: SparkSession, d: str) -> blocks.Parsed:
    """The parsed tables, once a session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _PARSED:
        _PARSED[key] = blocks.Parsed(printed_tables(s, d), keep=kept)
    return _PARSED[key]


def _part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.col("doc").cast("long"))


@query("blk01_line_kinds", f"WITH {FACTS_SQL} SELECT part, k.line_no, k.kind FROM (SELECT DISTINCT part FROM f), (VALUES (1, 'pre'), (2, 'header'), (3, 'data'), (4, 'data'), (5, 'data'), (6, 'data'), (7, 'label'), (8, 'data'), (9, 'data'), (10, 'data'), (11, 'data'), (12, 'stop'), (13, 'out')) k(line_no, kind)")
def blk01(s, d):
    return _part(parsed(s, d).lines).select("part", "line_no", "kind")


@query("tok08_positions", f"""WITH {FACTS_SQL}, p AS (SELECT part, CASE flag WHEN 'A' THEN 300.0 WHEN 'N' THEN 440.0 ELSE 580.0 END AS x0, printf('%.1f ± %.1f', qm, qd) AS c, qm AS num1, qd AS num2 FROM f)
SELECT part, x0, x0 + 5.0 * length(c) AS x1, x0 + 2.5 * length(c) AS mid, num1, num2, CAST(1 AS INTEGER) AS dec2 FROM p""")
def tok08(s, d):
    t = _part(parsed(s, d).lines).filter("line_no = 3").select("part", F.explode("tokens").alias("t"))
    return t.select("part", *[F.col(f"t.{c}").alias(c) for c in ("x0", "x1", "mid", "num1", "num2", "dec2")])


@query("blk07_arms", f"WITH {FACTS_SQL} SELECT part, arm_no, 'Arm ' || flag AS name, CAST(n AS INTEGER) AS n FROM f")
def blk07(s, d):
    return _part(parsed(s, d).arms).select("part", "arm_no", "name", "n")


@query("blk13_main_types", "WITH " + FACTS_SQL + " SELECT part, k.line_no, k.main, k.label FROM (SELECT DISTINCT part FROM f), (VALUES (3, 'meanSD', 'Quantity, units'), (4, 'numParen', 'Tax rate'), (5, 'nPct', 'Open orders'), (6, 'fraction', 'Status (O/F)'), (8, 'plain', 'First'), (9, 'plain', 'Later'), (10, 'pctOnly', 'Early lines'), (11, 'medianRng', 'Median quantity')) k(line_no, main, label)")
def blk13(s, d):
    return _part(parsed(s, d).lines.filter("main is not null")).select("part", "line_no", "main", "label")


@query("blk15_continuous_rows", f"""WITH {FACTS_SQL} SELECT part, 'Quantity, units' AS variable, arm_no, CAST(n AS INTEGER) AS n, qm AS mean, qd AS sd, CAST(1 AS INTEGER) AS round_mean, CAST(2 AS INTEGER) AS round_observation FROM f
UNION ALL SELECT part, 'Tax rate', arm_no, CAST(n AS INTEGER), tm, td, 1, 2 FROM f""")
def blk15(s, d):
    v = _part(parsed(s, d).variables).filter("kind = 'continuous'")
    return v.select("part", F.col("row").alias("variable"), "arm_no", "n", "mean", "sd", "round_mean", "round_observation")


_UNIQUE = "u AS (SELECT *, greatest(ceil(n * (pct - 0.5) / 100 - 1e-9), 0) AS lo, least(floor(n * (pct + 0.5) / 100 + 1e-9), n) AS hi FROM f), ok AS (SELECT part, bool_and(lo = hi) AS ok FROM u GROUP BY part)"


def _counts(s, d, *names):
    v = _part(parsed(s, d).variables).filter(F.col("kind") == "category").select("part", F.col("row").alias("variable"), "arm_no", F.explode("categories").alias("category", "n"))
    return v.filter(F.col("variable").isin(*names))


@query("blk16_fraction_rows", f"WITH {FACTS_SQL} SELECT part, 'Status' AS variable, arm_no, 'Status O' AS category, CAST(open AS BIGINT) AS n FROM f UNION ALL SELECT part, 'Status', arm_no, 'Status F', CAST(n - open AS BIGINT) FROM f")
def blk16(s, d):
    return _counts(s, d, "Status")


@query("blk17_count_rows", f"WITH {FACTS_SQL} SELECT part, 'Open orders' AS variable, arm_no, 'Open orders' AS category, CAST(open AS BIGINT) AS n FROM f UNION ALL SELECT part, 'Open orders', arm_no, 'Not Open orders', CAST(n - open AS BIGINT) FROM f")
def blk17(s, d):
    return _counts(s, d, "Open orders")


@query("blk18_category_rows", f"""WITH {FACTS_SQL}, {_UNIQUE} SELECT part, 'Line' AS variable, arm_no, 'First' AS category, CAST(first AS BIGINT) AS n FROM f UNION ALL SELECT part, 'Line', arm_no, 'Later', CAST(n AS BIGINT) FROM f
UNION ALL SELECT part, 'Line', arm_no, 'Early lines', CAST(lo AS BIGINT) FROM u JOIN ok USING (part) WHERE ok""")
def blk18(s, d):
    return _counts(s, d, "Line")


@query("blk19_percent_conversion", f"""WITH {FACTS_SQL}, {_UNIQUE} SELECT part, 'Early lines' AS label, 'unique' AS kind, string_agg(CAST(pct AS BIGINT) || '% of N=' || n || ' -> ' || CAST(lo AS BIGINT) || ' (uniquely pinned)', '; ' ORDER BY arm_no) AS note FROM u JOIN ok USING (part) WHERE ok GROUP BY part""")
def blk19(s, d):
    return _part(parsed(s, d).derived).select("part", "label", "kind", "note")


@query("blk14_skipped_rows", f"""WITH {FACTS_SQL}, {_UNIQUE} SELECT DISTINCT part, 'Median quantity' AS label, '{blocks.MEDIAN_SKIP}' AS reason FROM f UNION ALL SELECT part, 'Early lines', '{blocks.PERCENT_SKIP}' FROM ok WHERE NOT ok""")
def blk14(s, d):
    return _part(parsed(s, d).skipped).select("part", "label", "reason")


@query("blk24_parse_score", f"WITH {FACTS_SQL} SELECT part, CAST(3 * count(*) + 2 * 2 + 3 + CASE WHEN count(*) >= 2 THEN 2 ELSE 0 END - 2 AS BIGINT) AS score FROM f GROUP BY part")
def blk24(s, d):
    return _part(parsed(s, d).scores).select("part", "score")


@query("rev01_review_flags", f"""WITH {FACTS_SQL}, {_UNIQUE}, a AS (SELECT part, count(*) AS arms FROM f GROUP BY part)
SELECT part, concat_ws(' / ', (1 + CASE WHEN ok THEN 0 ELSE 1 END) || ' table line(s) could not be used: ' || CASE WHEN ok THEN '' ELSE 'Early lines, ' END || 'Median quantity',
 CASE WHEN arms < 2 THEN 'only ' || arms || ' treatment arm(s) were found' END,
 CASE WHEN ok THEN '1 category row(s) converted from printed percentages via the arm N (unique-count bracket): Early lines' END) AS flags FROM ok JOIN a USING (part)""")
def rev01(s, d):
    p = parsed(s, d)
    return _part(review.review_flags(p.dispersions, p.arms, p.variables, p.skipped, p.derived)).select("part", F.concat_ws(" / ", "flags").alias("flags"))


@query("hyb02_merge", """SELECT l_partkey AS part, 'line ' || l_linenumber AS variable, 'heuristic' AS engine FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL
UNION ALL SELECT l_partkey, 'line ' || l_linenumber, 'ai' FROM lineitem GROUP BY ALL HAVING NOT bool_or(l_returnflag = 'A')""")
def hyb02(s, d):
    i = table(s, d, "lineitem").withColumn("row", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    own = i.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("part"), "row").distinct().withColumn("engine", F.lit("heuristic"))
    other = i.select(F.col("l_partkey").alias("part"), F.upper(F.concat(F.lit(" "), F.col("row"))).alias("row")).distinct().withColumn("engine", F.lit("ai"))
    return review.merged(own, other, ["part"]).select("part", F.trim(F.lower("row")).alias("variable"), "engine")


@query("hyb01_engine_policy", f"WITH {FACTS_SQL}, a AS (SELECT part, count(*) AS arms FROM f GROUP BY part) SELECT part FROM a WHERE arms < 2")
def hyb01(s, d):
    p = parsed(s, d)
    flags = review.review_flags(p.dispersions, p.arms, p.variables, p.skipped, p.derived)
    flags = flags.withColumn("flags", F.filter("flags", lambda f: f.startswith("only")))  # the other flags hold for most tables here
    return _part(review.needs_fallback(flags)).select("part")


@query("hyb03_first_route", "SELECT l_orderkey AS doc, CASE WHEN bool_or(l_returnflag = 'A') THEN 'table' ELSE 'prose' END AS route FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A') OR bool_or(l_returnflag = 'N')")
def hyb03(s, d):
    i = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_returnflag")
    route = lambda flag: i.filter(F.col("l_returnflag") == flag).select("doc").distinct()
    return review.first_route([("table", route("A")), ("prose", route("N"))], ["doc"]).select("doc", "route")


_TEXT = "doc AS (SELECT o_orderkey AS doc, 20 + o_custkey % 30 AS a, 20 + o_orderkey % 30 AS b FROM orders)"


@query("arm06_fill_from_text", f"""WITH {_TEXT} SELECT doc, 0 AS col, CAST(a AS INTEGER) AS n, 'name' AS how FROM doc WHERE doc % 2 = 0 UNION ALL SELECT doc, 1, CAST(b AS INTEGER), 'name' FROM doc WHERE doc % 2 = 0
UNION ALL SELECT doc, 0, CAST(a AS INTEGER), 'position' FROM doc WHERE doc % 2 = 1 UNION ALL SELECT doc, 1, CAST(b AS INTEGER), 'position' FROM doc WHERE doc % 2 = 1""")
def arm06(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 30 + 20).alias("a"), (F.col("o_orderkey") % 30 + 20).alias("b"))
    text = F.format_string("A total of %d patients were randomized. They were allocated to the ketamine group (n = %d) or were assigned to receive the plain fluid of the saline group (n = %d).", F.col("a") + F.col("b"), F.col("a"), F.col("b"))
    docs = kept(o.select("doc", text.alias("text")))
    names = F.when(F.col("doc") % 2 == 0, F.array(F.lit("Ketamine"), F.lit("Saline group"))).otherwise(F.array(F.lit("Drug X"), F.lit("Control")))
    arms = o.select("doc", F.lit("t").alias("block"), F.posexplode(names).alias("col", "name")).withColumn("n", F.lit(None).cast("int"))
    totals = docs.select("doc", F.explode(armn.randomized_totals(F.col("text"))).alias("total"))
    filled = armn.filled_from_text(arms, kept(armn.text_candidates(docs)), totals)
    return filled.select("doc", "col", "n", F.when(F.col("source").contains("name matched"), "name").when(F.col("source").contains("by position"), "position").otherwise("other").alias("how"))


# Candidates: documents of three pages, with a caption and its table, a foreign table, and a page that carries the first one on

def printed_documents(s: SparkSession, d: str) -> DataFrame:
    """Pages from parts: page 1 holds the baseline table's first variable, page 2 its second one, without caption (odd parts: prose), page 3 a results table."""
    f = facts(s, d)
    place = F.element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), F.col("flag"))
    value = {1: ((2, F.format_string("Arm %s (n = %d)", "flag", "n")), (3, F.format_string("%.1f ± %.1f", "qm", "qd"))), 2: ((1, F.format_string("%.1f ± %.1f", "tm", "td")), (2, F.format_string("%.1f ± %.1f", "qm", "td"))), 3: ((2, F.format_string("%.1f ± %.1f", "qm", "qd")), (3, F.format_string("%.1f ± %.1f", "tm", "td")))}
    label = {1: ((1, "Table 1 Baseline characteristics of all the patients in each group"), (3, "Age, years")), 2: ((1, "Weight, kg of each of them"), (2, "Height, cm of each of them")), 3: ((1, "Table 2 Pain score and recovery after the operation in each group"), (2, "Pain score"), (3, "Recovery time"))}
    prose = ((1, "No number stands in any line here"), (2, "and so the page does not go on"))
    cells = None
    for page in value:
        own = f.select("part", place.alias("x"), F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), c.alias("text")) for k, c in value[page]])).alias("c"))
        words = F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(t).alias("text")) for k, t in label[page]])
        if page == 2:
            own = own.filter("part % 2 = 0")
            words = F.when(F.col("part") % 2 == 0, words).otherwise(F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(t).alias("text")) for k, t in prose]))
        left = f.select("part").distinct().select("part", F.lit(20.0).alias("x"), F.explode(words).alias("c"))
        both = own.unionByName(left).select(F.col("part").cast("string").alias("doc"), F.lit(page).alias("page"), "c.line_no", "x", "c.text")
        cells = both if cells is None else cells.unionByName(both)
    return printed(cells, ["doc", "page"]).withColumns({"y": F.col("line_no") * 12.0, "height": F.lit(9.0), "word_no": F.col("line_no") * 1_000_000 + F.col("word_no")}).drop("line_no")


class Chosen:
    """The winners among the candidates of the printed documents, and their longer readings."""

    def __init__(self, s: SparkSession, d: str):
        self.words = kept(printed_documents(s, d))
        self.lined = kept(candidates.bands_of(self.words))
        self.found = kept(candidates.captions(self.lined))
        self.listed = kept(candidates.enumerated(self.words, self.lined, self.found))
        own = kept(candidates.block_words(self.lined, self.listed))
        self.best = kept(candidates.chosen(self.listed, blocks.Parsed(own, keep=kept).scores))
        base = own.join(self.best.select("doc", "block"), ["doc", "block"], "left_semi")
        more = blocks.Parsed(candidates.continued(self.words, self.lined, self.best, base), keep=kept)
        self.final = candidates.extended(self.best, more.scores)


def chosen(s: SparkSession, d: str) -> Chosen:
    key = (s.sparkContext.applicationId, d, "documents")
    if key not in _PARSED:
        _PARSED[key] = Chosen(s, d)
    return _PARSED[key]


@query("lay07_best_caption_page", f"WITH {FACTS_SQL} SELECT DISTINCT part, 1 AS page, 8 AS score FROM f")
def lay07(s, d):
    return _part(candidates.best_caption_page(chosen(s, d).found)).select("part", "page", "score")


@query("cnd01_candidates", f"WITH {FACTS_SQL} SELECT DISTINCT part, k.page, k.cap_score, k.strong, k.place FROM f, (VALUES (1, 8, true, 1), (3, -2, false, 2)) k(page, cap_score, strong, place)")
def cnd01(s, d):
    return _part(chosen(s, d).listed).select("part", "page", "cap_score", "strong", "place")


@query("cnd05_chosen", f"WITH {FACTS_SQL} SELECT part, 1 AS page, CAST(3 * count(*) + 2 + 2 + CASE WHEN count(*) >= 2 THEN 2 ELSE 0 END AS BIGINT) AS score FROM f GROUP BY part")
def cnd05(s, d):
    return _part(chosen(s, d).best).select("part", "page", "score")


@query("cnd06_continuation", f"WITH {FACTS_SQL} SELECT DISTINCT part, CAST(CASE WHEN part % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS pages FROM f")
def cnd06(s, d):
    return _part(chosen(s, d).final).select("part", "pages")


@query("bat02_parse_outcomes", f"""WITH {FACTS_SQL}, {_UNIQUE} SELECT part, 'ok' AS status, count(*) AS arms, count(*) AS arms_with_n, 5 * count(*) AS lines, 5 AS variables, 2 AS continuous, 1 + CASE WHEN any_value(ok) THEN 0 ELSE 1 END AS skipped FROM f JOIN ok USING (part) GROUP BY part""")
def bat02(s, d):
    p = parsed(s, d)
    return _part(outputs.parse_outcomes(p.dispersions, p.arms, p.variables, p.skipped)).select("part", "status", "arms", "arms_with_n", "lines", "variables", "continuous", "skipped")


@query("ai01_reply_variables", f"""WITH {FACTS_SQL} SELECT part, 1 AS row_no, 'Quantity' AS variable, flag AS arm, CAST(n AS INTEGER) AS n, qm AS mean, CASE WHEN part % 2 = 0 THEN qd END AS sd, CASE WHEN part % 2 = 1 THEN qd END AS se, NULL::BIGINT AS open FROM f
UNION ALL SELECT part, 2, 'Status', flag, NULL, NULL, NULL, NULL, CAST(open AS BIGINT) FROM f""")
def ai01(s, d):
    f = facts(s, d).groupBy("part").agg(F.collect_list(F.struct("flag", "n", "qm", "qd", "open")).alias("a"))
    arms = F.transform("a", lambda x: F.struct(x["flag"].alias("name"), x["n"].alias("n")))
    values = F.transform("a", lambda x: F.struct(x["flag"].alias("arm"), x["qm"].alias("mean"), x["qd"].alias("sd")))
    counts = F.transform("a", lambda x: F.struct(x["flag"].alias("arm"), F.array(x["open"], x["n"] - x["open"]).alias("counts")))
    broken = F.transform("a", lambda x: F.struct(x["flag"].alias("arm"), F.array(x["open"]).alias("counts")))
    level = F.array(F.lit("Open"), F.lit("Filled"))
    reply = F.struct(
        arms.alias("arms"), F.array(F.struct(F.lit(" Quantity ").alias("label"), F.when(F.col("part") % 2 == 1, "se").otherwise("sd").alias("dispersion"), F.lit(1).alias("decimalsMean"), F.lit(1).alias("decimalsDispersion"), values.alias("values"))).alias("continuous"),
        F.array(F.struct(F.lit("Status").alias("label"), level.alias("categories"), counts.alias("values")), F.struct(F.lit("Broken").alias("label"), level.alias("categories"), broken.alias("values"))).alias("categorical"),
    )
    out = _part(outputs.reply_variables(f.select(F.col("part").cast("string").alias("doc"), F.to_json(reply).alias("json"))))
    return out.select("part", "row_no", F.col("row").alias("variable"), "arm", "n", "mean", "sd", "se", F.element_at("categories", F.lit("Open")).alias("open"))


@query("snk03_summary_sheet", """WITH t AS (SELECT 'T' || n_nationkey AS trial, n_nationkey AS line, CAST(NULL AS VARCHAR) AS p FROM nation)
SELECT line, trial, CASE WHEN line % 5 = 0 THEN NULL ELSE '0.5' END AS p, '' AS ci FROM t UNION ALL SELECT 4611686018427387904, 'ALL ' || count(*) || ' TRIALS (Stouffer combination)', '0.5', '' FROM t WHERE line % 5 <> 0""")
def snk03(s, d):
    from ..operators import report

    t = table(s, d, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("trial"), F.col("n_nationkey").alias("trial_no"), F.when(F.col("n_nationkey") % 5 != 0, 0.5).alias("p"), F.lit(None).cast("string").alias("ci"))
    return outputs.summary_sheet(t, report.overall(t))
