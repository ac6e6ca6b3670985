"""Queries of operators over whole test tables, with the SQL that another engine can run beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rng import normal
from ..functions.special import signif, tail_of, tail_sql, z_of, z_sql
from ..operators import armn, assembly, corpus, graphs, layout, metrics, moments, normalize, reconstruct, report, simulate, tokens, validate
from ..sources import files
from .bridge import CELLS_SQL, LINES_SQL, MEDIAN_SQL, category_lines, continuous_lines, kept, median_lines, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c, alias: str | None = None, digits: int = 6):
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x, digits).alias(alias or c)


# Monte Carlo engine: kinds, moments, statistics

@query("mc01_dispatch", f"""WITH {LINES_SQL}, {CELLS_SQL},
k AS (SELECT trial, "row", count(*) AS arms, 'continuous' AS k FROM lines GROUP BY ALL UNION ALL SELECT trial, "row", count(DISTINCT arm), 'category' FROM cells GROUP BY ALL)
SELECT trial, "row" AS variable, arms, CASE WHEN arms <= 1 THEN 'one_line' ELSE k END AS kind FROM k""")
def mc01(s: SparkSession, d: str) -> DataFrame:
    both = moments.kinds(continuous_lines(s, d).unionByName(category_lines(s, d)))
    return both.select("trial", F.col("row").alias("variable"), "arms", "kind")


@query("mc02_pooled_moments", f"""WITH {LINES_SQL} SELECT trial, "row" AS variable, sum(n) AS total, round(sum(n * mean) / sum(n), 6) AS mu, round(sqrt(sum(n * sd * sd) / sum(n)), 6) AS sd_pooled FROM lines GROUP BY ALL""")
def mc02(s, d):
    return moments.continuous_moments(continuous_lines(s, d)).select("trial", F.col("row").alias("variable"), "total", r6("mu"), r6("sd_pooled"))


@query("mc03_small_sample_sd", f"""WITH {LINES_SQL}, p AS (SELECT trial, "row" AS variable, sum(n) AS t, sqrt(sum(n * sd * sd) / sum(n)) AS s FROM lines GROUP BY ALL)
SELECT trial, variable, round(CASE WHEN t < 30 THEN s * sqrt((t - 1) / 2) * gamma((t - 1) / 2) / gamma(t / 2) ELSE s END, 5) AS sigma FROM p""")
def mc03(s, d):
    return moments.continuous_moments(continuous_lines(s, d)).select("trial", F.col("row").alias("variable"), r6("sigma", digits=5))


@query("mc04_location_uncertainty", f"""WITH {LINES_SQL}, p AS (SELECT trial, "row" AS variable, sum(n) AS t, avg(n) AS m, sqrt(sum(n * sd * sd) / sum(n)) AS s FROM lines GROUP BY ALL)
SELECT trial, variable, round(CASE WHEN t < 30 THEN s * sqrt((t - 1) / 2) * gamma((t - 1) / 2) / gamma(t / 2) ELSE s END / sqrt(m), 5) AS sem FROM p""")
def mc04(s, d):
    return moments.continuous_moments(continuous_lines(s, d)).select("trial", F.col("row").alias("variable"), r6("sem", digits=5))


@query("mc05_observed_statistic", f"""WITH {LINES_SQL}, c AS (SELECT *, sum(n * mean) OVER w / sum(n) OVER w AS mu FROM lines WINDOW w AS (PARTITION BY trial, "row"))
SELECT trial, "row" AS variable, round(sum((mean - mu) * (mean - mu)), 4) AS observed FROM c GROUP BY ALL""")
def mc05(s, d):
    return moments.continuous_moments(continuous_lines(s, d)).select("trial", F.col("row").alias("variable"), r6("observed", digits=4))


_MEDIANS = f"""WITH {MEDIAN_SQL}, p AS (SELECT trial, sum(n) AS total, avg(n) AS mean_n, sum(n * mean) / sum(n) AS m, sum(n * q1) / sum(n) AS pq1, sum(n * q3) / sum(n) AS pq3 FROM mlines GROUP BY trial),
f AS (SELECT *, (pq3 - pq1) / (2 * ln(3)) AS a2, 2 * (pq1 + pq3 - 2 * m) / ln(3) AS a3 FROM p)"""


@query("mc07_pooled_quantiles", _MEDIANS + " SELECT trial, total, round(m, 5) AS m, round(pq1, 5) AS pq1, round(pq3, 5) AS pq3 FROM f")
def mc07(s, d):
    return moments.median_moments(median_lines(s, d)).select("trial", "total", r6("m", digits=5), r6("pq1", digits=5), r6("pq3", digits=5))


@query("mc08_metalog", _MEDIANS + " SELECT trial, round(m, 5) AS a1, round(a2, 5) AS a2, round(a3, 5) AS a3 FROM f")
def mc08(s, d):
    return moments.median_moments(median_lines(s, d)).select("trial", r6("a1", digits=5), r6("a2", digits=5), r6("a3", digits=5))


@query("mc09_metalog_refusal", _MEDIANS + " SELECT trial, CASE WHEN a2 <= 0 OR abs(a3) / a2 > 1.667 THEN 'SKEWED_QUARTILES' ELSE 'OK' END AS status FROM f")
def mc09(s, d):
    return moments.median_moments(median_lines(s, d)).select("trial", "status")


@query("mc10_median_uncertainty", _MEDIANS + " SELECT trial, round(2 * a2 / sqrt(mean_n), 5) AS sd_shift FROM f")
def mc10(s, d):
    return moments.median_moments(median_lines(s, d)).select("trial", r6("sd_shift", digits=5))


_CHI = f"""WITH {CELLS_SQL}, a AS (SELECT trial, arm, sum(n) AS arm_sum FROM cells GROUP BY ALL), c AS (SELECT trial, category, sum(n) AS col_sum, count(*) AS filled FROM cells GROUP BY ALL),
t AS (SELECT trial, sum(n) AS total, count(DISTINCT arm) AS arms, count(DISTINCT category) AS live FROM cells GROUP BY trial),
st AS (SELECT t.trial, CASE WHEN min(filled) < any_value(arms) THEN 'INCOMPLETE_CATEGORIES' WHEN any_value(live) < 2 THEN 'DEGENERATE_CATEGORIES' ELSE 'OK' END AS status FROM t JOIN c USING (trial) GROUP BY t.trial),
x AS (SELECT trial, sum(power(cells.n - CAST(arm_sum AS DOUBLE) * col_sum / total, 2) / (CAST(arm_sum AS DOUBLE) * col_sum / total)) AS chi2 FROM cells JOIN a USING (trial, arm) JOIN c USING (trial, category) JOIN t USING (trial) GROUP BY trial)"""


@query("mc12_category_prep", _CHI + " SELECT trial, CAST(total AS BIGINT) AS total, status FROM t JOIN st USING (trial)")
def mc12(s, d):
    return moments.chi_square(moments.category_cells(category_lines(s, d))).select("trial", "total", "status")


@query("mc13_chi_square", _CHI + " SELECT trial, CASE WHEN status = 'OK' THEN round(chi2, 6) END AS chi2 FROM x JOIN st USING (trial)")
def mc13(s, d):
    return moments.chi_square(moments.category_cells(category_lines(s, d))).select("trial", r6("chi2"))


@query("mc06_counter_normals", """WITH r AS (SELECT s_suppkey, s_nationkey, r.r FROM supplier, range(20) r(r)),
u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', 42, s_nationkey, r, s_suppkey, 'a')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS a,
 (CAST('0x' || substr(md5(concat_ws('|', 42, s_nationkey, r, s_suppkey, 'b')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS b FROM r)
SELECT s_nationkey AS arm, r AS replicate, count(*) AS n, sum(CAST(floor(sqrt(-2 * ln(a)) * cos(2 * pi() * b) * 10 + 0.5) AS BIGINT))::BIGINT AS sum_tenths FROM u GROUP BY ALL""")
def mc06(s, d):
    draws = table(s, d, "supplier").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    z = normal(F.lit(42), F.col("s_nationkey"), F.col("r"), F.col("s_suppkey"))
    return draws.groupBy(F.col("s_nationkey").alias("arm"), F.col("r").alias("replicate")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(z * 10 + 0.5)).alias("sum_tenths"))


@query("mc15_staged_tail")
def mc15(s, d):
    return simulate.staged_tail(continuous_lines(s, d), materialize=kept)


def _reported(s: SparkSession, d: str) -> DataFrame:
    lines = continuous_lines(s, d).unionByName(median_lines(s, d)).unionByName(category_lines(s, d))
    return simulate.row_report(simulate.staged_tail(lines, materialize=kept))


@query("mc16_row_report")
def mc16(s, d):
    return _reported(s, d).select("trial", F.col("row").alias("variable"), "p", "k_le", "upper", "display", "ci", "m", "status")


@query("mc11_median_simulation")
def mc11(s, d):
    return simulate.row_report(simulate.staged_tail(median_lines(s, d), materialize=kept)).select("trial", "p", "m", "status")


@query("mc14_category_simulation")
def mc14(s, d):
    return simulate.row_report(simulate.staged_tail(category_lines(s, d), materialize=kept)).select("trial", "p", "m", "status")


@query("mc20_draws")
def mc20(s, d):
    return simulate.draws(median_lines(s, d)).select("trial", F.size("draws").alias("n_draws"))


@query("agg02_trial_summary")
def agg02(s, d):
    return report.trial_summary(_reported(s, d).select("trial", "row", "p"))


@query("agg05_overall")
def agg05(s, d):
    return report.overall(report.trial_summary(_reported(s, d).select("trial", "row", "p")))


# Exact p values stand for simulated ones where an oracle is wanted.
_PSQL = "ps AS (SELECT 'T' || l_suppkey AS trial, l_linenumber AS \"row\", (count(*) FILTER (l_returnflag = 'A') + 0.5) / (count(*) + 1) AS p FROM lineitem GROUP BY ALL)"


def _ps(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("trial"), F.col("l_linenumber").cast("string").alias("row"))
    return g.agg(((F.count_if(F.col("l_returnflag") == "A") + 0.5) / (F.count(F.lit(1)) + 1)).alias("p"))


@query("agg01_stouffer_z", f"""WITH {_PSQL}, g AS (SELECT trial, count(*) AS k, max(p) AS lone, sum({z_sql('p')}) / sqrt(count(*)) AS z FROM ps GROUP BY trial), t AS (SELECT *, {tail_sql('z')} AS t FROM g)
SELECT trial, k, CASE WHEN k > 1 THEN round(floor(t * pow(10, 3 - floor(log10(t))) + 0.5) / pow(10, 3 - floor(log10(t))), 9) ELSE round(lone, 9) END AS p FROM t""")
def agg01(s, d):
    return report.trial_summary(_ps(s, d)).select("trial", "k", r6("p", digits=9))


@query("mc17_normal_tails", f"""WITH {_PSQL}, z AS (SELECT trial, "row", {z_sql('p')} AS z FROM ps) SELECT trial, "row"::VARCHAR AS variable, round(z, 8) AS z, round({tail_sql('z * 2')}, 10) AS tail FROM z""")
def mc17(s, d):
    z = _ps(s, d).withColumn("z", z_of("p"))
    return z.select("trial", F.col("row").alias("variable"), r6("z", digits=8), r6(tail_of(F.col("z") * 2), "tail", digits=10))


@query("gra01_ecdf", f"WITH {_PSQL} SELECT trial, \"row\"::VARCHAR AS variable, round(p, 8) AS p, round(row_number() OVER (PARTITION BY trial ORDER BY p, \"row\"::VARCHAR) / count(*) OVER (PARTITION BY trial), 8) AS step FROM ps")
def gra01(s, d):
    return graphs.ecdf(_ps(s, d)).select("trial", F.col("row").alias("variable"), r6("p", digits=8), r6("step", digits=8))


@query("gra02_histogram", """WITH v AS (SELECT event_type AS k, CAST(value AS DOUBLE) AS x FROM events), f AS (SELECT k, count(*) AS n, min(x) AS low, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v GROUP BY k)
SELECT k AS event_type, CAST(floor((x - low) / CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) ELSE 1 END) AS BIGINT) AS bin, count(*) AS count FROM v JOIN f USING (k) GROUP BY ALL""")
def gra02(s, d):
    return graphs.histogram(table(s, d, "events").select("event_type", F.col("value").cast("double").alias("value")), ["event_type"])


@query("gra03_slide_plan", f"""WITH {_PSQL}, per AS (SELECT trial, count(*) AS n FROM ps GROUP BY trial)
SELECT 'title' AS kind, NULL AS trial, NULL AS variable UNION ALL SELECT 'overall', NULL, NULL WHERE (SELECT count(*) FROM per) >= 2
UNION ALL SELECT 'trial', trial, NULL FROM per WHERE n >= 2 UNION ALL SELECT 'row', trial, "row"::VARCHAR FROM ps WHERE p <= 0.2""")
def gra03(s, d):
    return graphs.slide_plan(_ps(s, d), cutoff=0.2).withColumnRenamed("row", "variable")


# Validation: the same lines with faults planted by arithmetic on the part number

def _faulty(s: SparkSession, d: str) -> DataFrame:
    lines = continuous_lines(s, d)
    k = F.regexp_extract("trial", "[0-9]+", 0).cast("long") % 11
    t = lambda c: F.col(c).cast("string")
    faults = lines.select(
        "line_no", "trial", "row",
        F.when(k == 5, None).when(k == 7, None).otherwise(t("n")).alias("n_raw"), F.when(k == 5, None).otherwise(t("mean")).alias("mean_raw"),
        F.when(k == 1, None).when(k == 2, "n/a").when(k.isin(3, 4, 5, 6), None).otherwise(t("sd")).alias("sd_raw"),
        F.when(k == 6, "1.4").alias("se_raw"), F.when(k == 3, (F.col("mean") - 1).cast("string")).when(k == 4, (F.col("mean") + 1).cast("string")).alias("q1_raw"),
        F.when(k == 4, (F.col("mean") + 2).cast("string")).alias("q3_raw"), "round_mean", "round_observation",
        F.expr("cast(map() as map<string,bigint>)").alias("categories"),
    )
    return faults.withColumns({c: F.trim(f"{c}_raw").try_cast("double") for c in ("n", "mean", "sd", "se", "q1", "q3")})


_FAULTS = f"""WITH {LINES_SQL}, f AS (SELECT *, CAST(substr(trial, 2) AS BIGINT) % 11 AS k FROM lines),
i AS (SELECT trial, "row", line_no, 'SD' AS col, 'unreadable' AS code FROM f WHERE k = 2
UNION ALL SELECT trial, "row", line_no, 'SD', 'missing' FROM f WHERE k = 1
UNION ALL SELECT trial, "row", line_no, 'Q3', 'missing' FROM f WHERE k = 3
UNION ALL SELECT trial, "row", line_no, x, 'incongruent' FROM f, (VALUES ('MEAN'), ('Q1'), ('Q3')) v(x) WHERE k = 4
UNION ALL SELECT trial, "row", line_no, x, 'missing' FROM f, (VALUES ('N'), ('MEAN'), ('SD')) v(x) WHERE k = 5
UNION ALL SELECT trial, "row", line_no, 'SD', 'missing' FROM f WHERE k = 6 UNION ALL SELECT trial, "row", line_no, 'SE', 'incongruent' FROM f WHERE k = 6
UNION ALL SELECT trial, "row", line_no, 'N', 'missing' FROM f WHERE k = 7)"""


@query("val01_line_issues", _FAULTS + ' SELECT trial, "row" AS variable, CAST(line_no AS BIGINT) AS line_no, col, code FROM i')
def val01(s, d):
    checked = validate.line_issues(_faulty(s, d))
    return checked.select("trial", F.col("row").alias("variable"), "line_no", F.explode("issues").alias("x")).select("trial", "variable", "line_no", "x.col", "x.code")


@query("val11_usable_lines", f'WITH {LINES_SQL} SELECT trial, "row" AS variable, count(*) AS arms FROM lines WHERE CAST(substr(trial, 2) AS BIGINT) % 11 <> 5 GROUP BY ALL')
def val11(s, d):
    return validate.usable(validate.line_issues(_faulty(s, d))).groupBy("trial", F.col("row").alias("variable")).agg(F.count(F.lit(1)).alias("arms"))


@query("val11_verdict", _FAULTS + """ SELECT (SELECT count(*) FROM f) AS "lines", (SELECT count(*) FROM f WHERE k NOT BETWEEN 1 AND 7) AS kept,
 CAST((SELECT count(*) FROM i) - 3 * (SELECT count(*) FROM f WHERE k = 5) AS BIGINT) AS hard, (SELECT count(*) FROM i) - 3 * (SELECT count(*) FROM f WHERE k = 5) > 0 AS fail""")
def val11v(s, d):
    return validate.verdict(validate.line_issues(_faulty(s, d)))


@query("val10_single_category_line", """WITH g AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), c AS (SELECT o_custkey, count(*) AS n FROM g GROUP BY ALL)
SELECT 'C' || o_custkey AS trial, o_orderpriority AS arm FROM g JOIN c USING (o_custkey) WHERE n = 1""")
def val10(s, d):
    g = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    lines = g.select(
        F.ascii("o_orderpriority").cast("long").alias("line_no"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("trial"), F.lit("priority").alias("row"), F.col("o_orderpriority").alias("arm"),
        F.create_map(F.lit("orders"), "c").alias("categories"), F.lit(0).alias("round_mean"), F.lit(0).alias("round_observation"),
        *[F.lit(None).cast("string").alias(f"{c}_raw") for c in ("n", "mean", "sd", "se", "q1", "q3")], *[F.lit(None).cast("double").alias(c) for c in ("n", "mean", "sd", "se", "q1", "q3")],
    )
    return validate.line_issues(lines).filter(F.exists("issues", lambda x: x["col"] == "ROW")).select("trial", "arm")


@query("nrm09_normalized_names", "SELECT 'N' || c_nationkey AS trial, c_mktsegment AS variable, count(*) AS lines, round(sum(floor(c_acctbal)), 1) AS mean_sum, CAST(max(0) AS INTEGER) AS round_mean FROM customer GROUP BY ALL")
def nrm09(s, d):
    c = table(s, d, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("My Trial ID"), F.col("c_mktsegment").alias(" measure "), F.lit("5").alias("Number"), F.floor("c_acctbal").cast("string").alias("mean"),
        F.lit("1").alias("sd"), F.lit("0").alias("DecM"), F.lit("x").alias("Group"),
    )
    n = normalize.normalized(c)
    return n.groupBy("trial", F.col("row").alias("variable")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("mean"), 1).alias("mean_sum"), F.max("round_mean").alias("round_mean"))


@query("nrm13_decimal_bump", f'WITH {LINES_SQL} SELECT trial, "row" AS variable, CAST(line_no AS BIGINT) AS line_no, CAST(CASE WHEN mean <> floor(mean) THEN 1 ELSE 0 END AS INTEGER) AS round_mean FROM lines')
def nrm13(s, d):
    lines = continuous_lines(s, d).select(F.col("line_no").alias("no"), F.col("trial").alias("TRIAL"), F.col("row").alias("ROW"), F.col("n").cast("string").alias("N"), F.col("mean").cast("string").alias("MEAN"), F.col("sd").cast("string").alias("SD"))
    return normalize.normalized(lines, "no").select("trial", F.col("row").alias("variable"), "line_no", "round_mean")


@query("nrm14_column_roles", "SELECT * FROM (VALUES ('balance', 'misc'), ('gaps', 'category'), ('name', 'misc')) t(name, role)")
def nrm14(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")).alias("gaps"), F.col("c_acctbal").cast("string").alias("balance"))
    return s.createDataFrame(sorted(normalize.column_roles(c, c.columns).items()), "name string, role string")


# Reconstruction

@query("rec02_header_n", f"""WITH {LINES_SQL}, a AS (SELECT trial, n, row_number() OVER (PARTITION BY trial, "row" ORDER BY line_no) AS arm FROM lines), c AS (SELECT trial, arm, n, count(*) AS t FROM a GROUP BY ALL)
SELECT trial, CAST(arm AS INTEGER) AS arm, n AS header_n FROM c QUALIFY row_number() OVER (PARTITION BY trial, arm ORDER BY t DESC, n) = 1""")
def rec02(s, d):
    return reconstruct.header_n(continuous_lines(s, d)).select("trial", F.col("arm").cast("int").alias("arm"), "header_n")


@query("rec04_mean_sd_cells", f"""WITH {LINES_SQL} SELECT trial, "row" AS variable, CAST(row_number() OVER (PARTITION BY trial, "row" ORDER BY line_no) AS INTEGER) AS arm, format('{{:.1f}} ({{:.1f}})', mean, sd) AS cell FROM lines""")
def rec04(s, d):
    return reconstruct.cells(continuous_lines(s, d)).select("trial", "variable", F.col("arm").cast("int").alias("arm"), "cell")


@query("rec08_pivoted_arms", f"""WITH {LINES_SQL}, a AS (SELECT trial, "row" AS variable, row_number() OVER (PARTITION BY trial, "row" ORDER BY line_no) AS arm, format('{{:.1f}} ({{:.1f}})', mean, sd) AS cell FROM lines)
SELECT trial, variable, coalesce(max(cell) FILTER (arm = 1), '') AS arm_1, coalesce(max(cell) FILTER (arm = 2), '') AS arm_2, coalesce(max(cell) FILTER (arm = 3), '') AS arm_3 FROM a GROUP BY ALL""")
def rec08(s, d):
    return reconstruct.table(continuous_lines(s, d)).drop("row", "sub")


@query("rec07_category_block", f"""WITH {CELLS_SQL} SELECT trial, '    ' || category AS variable, n::VARCHAR AS cell, count(*) AS times FROM cells GROUP BY ALL
UNION ALL SELECT trial, 'status, n', '', count(DISTINCT arm) FROM cells GROUP BY ALL""")
def rec07(s, d):
    return reconstruct.cells(category_lines(s, d)).groupBy("trial", "variable", "cell").agg(F.count(F.lit(1)).alias("times"))


@query("snk04_sheet_names", """WITH b AS (SELECT p_partkey AS trial_no, p_name || ': ' || p_type || '/' || p_brand AS trial FROM part),
s AS (SELECT *, substr(trim(regexp_replace(trial, '[\\[\\]:*?/\\\\]', ' ', 'g')), 1, 31) AS base FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY trial_no) AS k FROM s)
SELECT trial_no, CASE WHEN k = 1 THEN base ELSE substr(base, 1, 28) || ' ' || k END AS sheet FROM k""")
def snk04(s, d):
    names = table(s, d, "part").select(F.col("p_partkey").alias("trial_no"), F.concat("p_name", F.lit(": "), "p_type", F.lit("/"), "p_brand").alias("trial"))
    return reconstruct.sheet_names(names).select("trial_no", "sheet")


# Text

@query("txt03_printed_numbers", """WITH n AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) WHEN 1 THEN '<' || replace(format('{:.2f}', l_tax), '.', ',') WHEN 2 THEN replace(format('{:.1f}', l_quantity), '.', '·') ELSE 'NS' END AS t, * FROM lineitem)
SELECT l_orderkey, l_linenumber, t AS printed, CASE l_linenumber % 4 WHEN 0 THEN floor(l_extendedprice) WHEN 1 THEN round(l_tax, 2) WHEN 2 THEN round(l_quantity, 1) END AS number, CAST(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS decimals FROM n""")
def txt03(s, d):
    k = F.col("l_linenumber") % 4
    t = (
        F.when(k == 0, F.format_number(F.floor("l_extendedprice"), 0)).when(k == 1, F.concat(F.lit("<"), F.replace(F.format_string("%.2f", "l_tax"), F.lit("."), F.lit(","))))
        .when(k == 2, F.replace(F.format_string("%.1f", "l_quantity"), F.lit("."), F.lit("·"))).otherwise("NS")
    )
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("printed")).select("*", tx.as_number(F.col("printed")).alias("number"), tx.decimals(F.col("printed")).alias("decimals"))


@query("txt06_squish", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squished FROM documents")
def txt06(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.squish(F.col("text")).cast("binary")).alias("squished"))


@query("txt07_clean_label", "SELECT p_partkey, p_name AS label FROM part")
def txt07(s, d):
    ends = F.element_at(F.array(*map(F.lit, (", n (%)", " (kg)", "  no. (%)", ":"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", tx.clean_label(F.concat("p_name", ends)).alias("label"))


@query("txt10_html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def txt10(s, d):
    return table(s, d, "pages").select("page_id", F.md5(tx.html_escape(F.col("html")).cast("binary")).alias("escaped"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_BAG = f"list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(TEXT), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ')), lambda w: length(w) > 3 AND w NOT IN ({_STOP}))"


@query("txt11_bags", f"SELECT item_id, len({_BAG.replace('TEXT', 'text')}) AS words, array_to_string(list_sort({_BAG.replace('TEXT', 'text')}), ' ') AS bag FROM benchmark")
def txt11(s, d):
    bag = tx.bag_of(F.col("text"))
    return table(s, d, "benchmark").select("item_id", F.size(bag).cast("long").alias("words"), F.array_join(F.array_sort(bag), " ").alias("bag"))


@query("txt12_citations", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey % 90 + 1 AS INTEGER) AS volume, CAST(o_orderkey % 700 AS INTEGER) AS page FROM orders")
def txt12(s, d):
    cite = F.concat(F.lit("A Title. J. "), F.year("o_orderdate").cast("string"), F.lit(";"), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit(": "), (F.col("o_orderkey") % 700).cast("string"), F.lit("-9."))
    return table(s, d, "orders").select("o_orderkey", tx.parse_loc(cite).alias("x")).select("o_orderkey", "x.*")


@query("txt14_dois", "SELECT o_orderkey, '10.' || (1000 + o_custkey % 9000) || '/j.' || o_orderkey AS doi FROM orders")
def txt14(s, d):
    t = F.concat(F.lit("see doi: 10."), (F.col("o_custkey") % 9000 + 1000).cast("string"), F.lit("/J."), F.col("o_orderkey").cast("string"), F.lit("., and more"))
    return table(s, d, "orders").select("o_orderkey", F.explode(tx.dois(t)).alias("doi"))


@query("tok01_cell_types", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'meanSD' WHEN 1 THEN 'nPct' WHEN 2 THEN 'numParen' WHEN 3 THEN 'medianRng' WHEN 4 THEN 'fraction' ELSE 'pctOnly' END AS type, round(l_quantity, 1) AS num1 FROM lineitem""")
def tok01(s, d):
    q = F.format_string("%.0f", "l_quantity")
    k = F.col("l_linenumber") % 6
    line = F.concat(F.lit("Row CO2 "), F.when(k == 0, F.concat(q, F.lit(" ± 12.1"))).when(k == 1, F.concat(q, F.lit(" (60%)"))).when(k == 2, F.concat(q, F.lit(" (12.1)"))).when(k == 3, F.concat(q, F.lit(" [98-160]"))).when(k == 4, F.concat(q, F.lit("/12/8"))).otherwise(F.concat(q, F.lit("%"))))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(tokens.tokenize(line)).alias("t")).select("l_orderkey", "l_linenumber", "t.type", "t.num1")


_CAPTIONS = ("table 1 Baseline patient characteristics of ", "Table 2 Postoperative complication by group: ", "Characteristics: ", "Tab. I Demographic and clinical characteristics. ", "Adverse outcome, patient data ", "")
def _ladder() -> str:
    one = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    has = lambda p, i="i": "regexp_matches(t, '{}', '{}')".format(p.replace("'", "''"), i)
    q = has(tx.QUALIFIED)
    return " + ".join([
        one(has("baseline"), 4), one(has("demographic|anthropometric"), 4), one(q, 3), one(f"{has('characteristic')} AND NOT {q}", 1), one(has(r"patient(s)?\s+(data|profile|detail)"), 2),
        one(has(r"preoperative|pre-operative|on\s+admission"), 1), one(has(r"\bpatients?\b|\bsubjects?\b|\bgroups?\b"), 1), one(has(r"^\s*(table|tab\.?)\s+(1|I)\b", "c"), 2),
        one(f"NOT ({has('baseline|demographic')} OR {q}) AND " + has("outcome|complication|adverse|side.?effect|intra-?operative|post-?operative|pain score|recovery|haemodynamic|hemodynamic"), -3),
    ])


@query("lay06_caption_score", "WITH x AS (SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CAPTIONS)) + f" END || text AS t FROM documents) SELECT doc_id, CAST({_ladder()} AS INTEGER) AS score FROM x")
def lay06(s, d):
    start = F.element_at(F.array(*map(F.lit, _CAPTIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", tx.caption_score(F.concat(start, F.col("text"))).alias("score"))


# Layout: words of documents as boxes, x from the place in the line, y from the line

def _boxes(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc", "line", F.posexplode(F.split("t", " ")).alias("k", "text")).filter(F.trim("text") != "")
    return words.select("doc", F.lit(1).alias("page"), (F.col("line") * 100_000 + F.col("k")).cast("long").alias("word_no"), "text", (F.col("k") * 40.0).alias("x"), (F.col("line") * 10.0 + (F.col("k") % 3)).alias("y"), (F.length("text") * 5.0).alias("width"), F.lit(9.0).alias("height"))


_BOXES = """b AS (SELECT doc_id AS doc, line, k, w AS text FROM (SELECT doc_id, line, unnest(string_split(t, ' ')) AS w, unnest(range(len(string_split(t, ' ')))) AS k FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)) WHERE trim(w) <> '')"""


@query("lay08_visual_lines", f"WITH {_BOXES} SELECT doc, count(DISTINCT line) AS lines, count(*) AS words FROM b GROUP BY doc")
def lay08(s, d):
    return layout.visual_lines(_boxes(s, d)).groupBy("doc").agg(F.count_distinct("line_no").alias("lines"), F.count(F.lit(1)).alias("words"))


@query("lay10_columns", "SELECT CAST(l_orderkey AS BIGINT) AS doc, count(*) AS cols FROM (SELECT *, l_quantity * 4 - lag(l_quantity * 4) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS g FROM lineitem) WHERE g IS NULL OR g > 25 GROUP BY ALL")
def lay10(s, d):
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (F.col("l_quantity") * 4).alias("mid"))
    return layout.cluster_columns(t).groupBy("doc").agg(F.count(F.lit(1)).alias("cols"))


@query("lay03_words_in_bands", f"WITH {_BOXES} SELECT doc, CAST(CASE WHEN k * 40.0 + length(text) * 2.5 <= 300 THEN 0 ELSE 1 END AS INTEGER) AS band, count(*) AS words FROM b GROUP BY ALL")
def lay03(s, d):
    boxes = _boxes(s, d)
    bands = boxes.select("doc", "page").distinct().select("doc", "page", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for i, a, b in ((0, -1.0, 300.0), (1, 300.0, 1e12))])).alias("z")).select("doc", "page", "z.*")
    return layout.words_in_bands(boxes, bands).groupBy("doc", "band").agg(F.count(F.lit(1)).alias("words"))


@query("src07_ocr_scaling", f"WITH {_BOXES} SELECT doc, count(*) AS words, round(sum(k * 40.0 * 72 / 300), 3) AS x_sum FROM b GROUP BY doc")
def src07(s, d):
    return files.ocr_words(_boxes(s, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("words"), F.round(F.sum("x"), 3).alias("x_sum"))


# Arm sizes

_CELLS = "c AS (SELECT l_partkey AS arm, CAST(l_quantity AS INTEGER) AS cnt, 60 + l_partkey % 40 AS n, floor(100.0 * CAST(l_quantity AS INTEGER) / (60 + l_partkey % 40) * 10 + 0.5) / 10 AS pct FROM lineitem)"


def _pct_cells(s, d):
    n = F.col("l_partkey") % 40 + 60
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("arm"), F.col("l_quantity").cast("int").alias("count"), n.alias("n"), (F.floor(100.0 * F.col("l_quantity").cast("int") / n * 10 + 0.5) / 10).alias("pct"), F.lit(1).alias("dec"))


@query("arm01_feasible_sizes", f"WITH {_CELLS} SELECT arm, cnt, CAST(greatest(ceil(cnt / ((pct + 0.05) / 100) - 1e-9), cnt) AS BIGINT) AS lo, CAST(floor(cnt / ((pct - 0.05) / 100) + 1e-9) AS BIGINT) AS hi FROM c")
def arm01(s, d):
    return _pct_cells(s, d).select("arm", F.col("count").alias("cnt"), armn.feasible_sizes(F.col("count"), F.col("pct"), F.col("dec")).alias("x")).select("arm", "cnt", "x.*")


@query("arm02_derived_n", f"""WITH {_CELLS}, s AS (SELECT arm, CAST(greatest(ceil(cnt / ((pct + 0.05) / 100) - 1e-9), cnt) AS BIGINT) AS lo, CAST(floor(cnt / ((pct - 0.05) / 100) + 1e-9) AS BIGINT) AS hi FROM c)
SELECT arm, CASE WHEN NOT bool_or(hi < lo) AND max(lo) FILTER (hi - lo < 400) = min(hi) FILTER (hi - lo < 400) THEN max(lo) FILTER (hi - lo < 400) END AS arm_n FROM s GROUP BY arm""")
def arm02(s, d):
    return armn.derive_arm_n(_pct_cells(s, d), "arm")


@query("arm03_count_from_pct", f"""WITH {_CELLS}, x AS (SELECT arm, cnt, n, greatest(ceil(n * (pct - 0.05) / 100 - 1e-9), 0) AS lo, least(floor(n * (pct + 0.05) / 100 + 1e-9), n) AS hi FROM c) SELECT arm, cnt, CASE WHEN lo = hi THEN CAST(lo AS BIGINT) END AS found FROM x""")
def arm03(s, d):
    return _pct_cells(s, d).select("arm", F.col("count").alias("cnt"), armn.count_from_pct(F.col("pct"), F.col("dec"), F.col("n")).alias("found"))


@query("arm05_randomized_totals", "SELECT o_orderkey, CAST(o_custkey + 10 AS INTEGER) AS total FROM orders")
def arm05(s, d):
    t = F.concat(F.lit("A total of "), (F.col("o_custkey") + 10).cast("string"), F.lit(" patients were randomized."))
    return table(s, d, "orders").select("o_orderkey", F.explode(armn.randomized_totals(t)).alias("total"))


# Sources and assembly

@query("src09_zip_plan", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS take, CASE page_id % 6 WHEN 2 THEN 'unsafe path in archive' WHEN 3 THEN 'nested archive (not expanded)' WHEN 4 THEN 'not a supported file type' ELSE '' END AS why FROM pages""")
def src09(s, d):
    k = F.col("page_id") % 6
    name = F.when(k == 0, "t.csv").when(k == 1, "sub/dir/t.XLSX").when(k == 2, "../escape.csv").when(k == 3, "inner.zip").when(k == 4, "notes.txt").otherwise("__MACOSX/._t.csv")
    take, why = files.entry_plan(name, F.lit(100))
    return table(s, d, "pages").select("page_id", take.alias("take"), why.alias("why"))


@query("src12_blank_table", "SELECT count(*) AS rows, 0::BIGINT AS filled FROM range(8)")
def src12(s, d):
    t = files.blank_table(s)
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count("N").alias("filled"))


@query("asm02_collision_prefix", """SELECT trial, count(*) AS lines FROM (SELECT o_orderstatus AS trial FROM orders UNION ALL SELECT 'second: ' || o_orderstatus FROM orders UNION ALL SELECT 'third' FROM customer) GROUP BY trial""")
def asm02(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("TRIAL"), F.col("o_orderpriority").alias("ROW"))
    c = table(s, d, "customer").select(F.col("c_mktsegment").alias("ROW"), F.col("c_acctbal").alias("MEAN"))
    return assembly.assemble([("first", o), ("second", o), ("third", c)]).groupBy(F.col("TRIAL").alias("trial")).agg(F.count(F.lit(1)).alias("lines"))


@query("asm06_derived_marks", f"""WITH {LINES_SQL}, m AS (SELECT trial, "row", line_no, unnest(['n', 'mean']) AS col FROM lines)
SELECT trial, "row" AS variable, CAST(line_no AS BIGINT) AS line_no, col FROM m WHERE col = 'mean' AND "row" = 'tax' UNION ALL SELECT trial, "row", CAST(line_no AS BIGINT), col FROM m WHERE col = 'n'""")
def asm06(s, d):
    lines = continuous_lines(s, d).withColumn("line_no", F.struct("trial", "row", "line_no"))
    parts = lines.select("trial").distinct()
    registry = parts.select("trial", F.lit("tax").alias("row"), F.lit("mean").alias("col"), F.lit("x").alias("note")).unionByName(parts.select("trial", F.lit("*").alias("row"), F.lit("n").alias("col"), F.lit("y").alias("note")))
    return assembly.derived_marks(lines, registry, ["n", "mean", "sd"]).select("line_no.trial", F.col("line_no.row").alias("variable"), F.col("line_no.line_no").alias("line_no"), "col")


# Corpus: joins, dedup, identification, worklists

@query("cor01_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def cor01(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("cor02_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def cor02(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("cor03_first_match", "SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def cor03(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), F.col("o_orderkey").alias("k"))
    return corpus.first_match_join(table(s, d, "customer").select("c_custkey"), o, ["c_custkey"], ["k"]).select("c_custkey", "first_order")


@query("cor04_fallback_key", "SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS name FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND o_custkey % 2 = 0 LEFT JOIN customer b ON b.c_custkey = o_orderkey % 100")
def cor04(s, d):
    c = table(s, d, "customer")
    o = table(s, d, "orders").withColumns({"k1": F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")), "k2": F.col("o_orderkey") % 100})
    a, b = c.select(F.col("c_custkey").alias("k1"), F.col("c_name").alias("n1")), c.select(F.col("c_custkey").alias("k2"), F.col("c_name").alias("n2"))
    return o.join(a, "k1", "left").join(b, "k2", "left").select("o_orderkey", F.coalesce("n1", "n2").alias("name"))


@query("cor05_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def cor05(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("cor06_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def cor06(s, d):
    return corpus.todo(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("cor07_keep_first", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def cor07(s, d):
    return corpus.keep_first(table(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("cor08_contested", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) = 1)")
def cor08(s, d):
    return corpus.uncontested(table(s, d, "lineitem"), ["l_orderkey"], "l_suppkey").select("l_orderkey", "l_linenumber")


@query("cor09_pairs_verified", "SELECT l_partkey, bool_and(l_quantity IN (1, 2, 3, 4, 5) OR l_returnflag = 'A') AS verified FROM lineitem GROUP BY ALL")
def cor09(s, d):
    li = table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return corpus.pairs_verified(li, li.filter("l_quantity in (1,2,3,4,5) or l_returnflag = 'A'"), "l_partkey", ["l_quantity", "l_returnflag"])


@query("cor10_multiset", """WITH a AS (SELECT l_partkey, l_quantity, count(*) AS na FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), e AS (SELECT l_partkey, l_quantity, count(*) AS ne FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
SELECT l_partkey, CAST(sum(coalesce(ne, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(na, 0)) AS BIGINT) AS actual, CAST(sum(least(coalesce(ne, 0), coalesce(na, 0))) AS BIGINT) AS matched FROM a FULL JOIN e USING (l_partkey, l_quantity) GROUP BY ALL""")
def cor10(s, d):
    li = table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return corpus.multiset_scores(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag <> 'A'"), "l_partkey", ["l_quantity"])


@query("cor13_unique_suffix", "SELECT split_part(url, '/', -1) AS key, min(url) AS name FROM pages GROUP BY ALL HAVING count(*) = 1")
def cor13(s, d):
    p = table(s, d, "pages").select(F.col("url").alias("name"))
    return corpus.unique_suffix(p.select(F.element_at(F.split("name", "/"), -1).alias("key")).distinct(), p)


@query("cor14_title_match", f"""WITH t AS (SELECT item_id, {_BAG.replace('TEXT', 'text')} AS bag FROM benchmark), p AS (SELECT doc_id, {_BAG.replace('TEXT', 'text')} AS bag FROM documents),
x AS (SELECT doc_id, item_id, CAST(len(list_intersect(p.bag, t.bag)) AS DOUBLE) / len(t.bag) AS score FROM p, t WHERE len(list_intersect(p.bag, t.bag)) > 0),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS runner_up FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, item_id))
SELECT doc_id, item_id, round(score, 6) AS score, score >= 0.75 AND score - coalesce(runner_up, 0) >= 0.15 AS accepted FROM r WHERE k = 1 AND score >= 0.6""")
def cor14(s, d):
    return _titles(table(s, d, "documents"), table(s, d, "benchmark"))


def _titles(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    pages = documents.select(F.col("doc_id").alias("page"), tx.bag_of(F.col("text")).alias("bag"))
    titles = benchmark.select(F.col("item_id").alias("title"), tx.bag_of(F.col("text")).alias("bag"))
    return corpus.title_matches(pages, titles).select(F.col("page").alias("doc_id"), F.col("title").alias("item_id"), r6("score"), "accepted")


@query("cor19_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'have' WHEN o_totalprice > 100000 THEN 'download' WHEN o_orderpriority LIKE '1%' THEN 'request' ELSE 'closed' END AS status FROM orders")
def cor19(s, d):
    st = F.when(F.col("o_orderstatus") == "F", "have").when(F.col("o_totalprice") > 100000, "download").when(F.col("o_orderpriority").startswith("1"), "request").otherwise("closed")
    return table(s, d, "orders").select("o_orderkey", st.alias("status"))


@query("cor21_group_counts", "SELECT o_orderpriority AS status, count(*) AS n FROM orders GROUP BY ALL")
def cor21(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("cor22_batches", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS BIGINT) AS batch FROM orders")
def cor22(s, d):
    return corpus.batches(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 50).select("o_orderkey", "batch")


# Agreement

_PAIRS = "p AS (SELECT (c_custkey % 997 + 1) / 1000.0 AS ours, ((c_custkey * 7 + c_nationkey) % 991 + 1) / 1000.0 AS theirs FROM customer)"


def _pairs(s, d):
    return table(s, d, "customer").select(((F.col("c_custkey") % 997 + 1) / 1000.0).alias("ours"), (((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 991 + 1) / 1000.0).alias("theirs"))


@query("met01_agreement", f"WITH {_PAIRS} SELECT count(*) AS n, round(corr(ours, theirs), 6) AS r, round(median(abs(ours - theirs)), 6) AS median_diff, round(avg(CASE WHEN abs(round(ours - theirs, 9)) <= 0.05 THEN 1.0 ELSE 0 END), 6) AS within_05, round(avg(CASE WHEN (ours < 0.05) = (theirs < 0.05) THEN 1.0 ELSE 0 END), 6) AS concordance FROM p")
def met01(s, d):
    return metrics.agreement(_pairs(s, d)).select("n", r6("r"), r6("median_diff"), r6("within_05"), r6("concordance"))


@query("met05_log_agreement", f"WITH {_PAIRS}, l AS (SELECT log10(ours) AS a, log10(theirs) AS b FROM p) SELECT round(corr(a, b), 6) AS r_log, round(median(abs(a - b)), 6) AS median_log FROM l")
def met05(s, d):
    return metrics.log_agreement(_pairs(s, d)).select(r6("r_log"), r6("median_log"))


@query("met06_alarms", f"WITH {_PAIRS} SELECT count(*) FILTER (ours < 0.05 AND theirs < 0.05) AS both, count(*) FILTER (ours < 0.05 AND theirs >= 0.05) AS only_ours, count(*) FILTER (ours >= 0.05 AND theirs < 0.05) AS only_theirs, count(*) FILTER (ours >= 0.05 AND theirs >= 0.05) AS neither FROM p")
def met06(s, d):
    return metrics.alarm_table(_pairs(s, d))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Validated bridge lines, staged Monte Carlo, row report and trial summary."""
    return report.trial_summary(_reported(s, d).select("trial", "row", "p"))


# Identification ladder

@query("cor11_by_doi", """WITH k AS (SELECT c_custkey AS item, '10.1000/c' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS doi FROM customer),
t AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN '10.1000/c' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE left('10.1000/c' || lpad(CAST(o_custkey AS VARCHAR), 6, '0'), 14) END AS doi FROM orders),
x AS (SELECT doc, min(item) AS item FROM t JOIN k USING (doi) GROUP BY doc HAVING count(DISTINCT item) = 1), p AS (SELECT left(doi, 14) AS doi, min(item) AS item, count(*) AS n FROM k GROUP BY 1)
SELECT doc, item FROM x UNION ALL SELECT doc, p.item FROM t JOIN p USING (doi) WHERE n = 1 AND doc NOT IN (SELECT doc FROM x)""")
def cor11(s, d):
    doi = lambda c: F.concat(F.lit("10.1000/c"), F.lpad(F.col(c).cast("string"), 6, "0"))
    texts = table(s, d, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 2 == 0, doi("o_custkey")).otherwise(F.substring(doi("o_custkey"), 1, 14)).alias("doi"))
    return corpus.by_doi(texts, table(s, d, "customer").select(F.col("c_custkey").alias("item"), doi("c_custkey").alias("doi")))


@query("cor12_by_one_id", """WITH f AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS id FROM lineitem), k AS (SELECT s_suppkey AS id, s_nationkey AS item FROM supplier WHERE s_suppkey % 3 = 0)
SELECT doc, min(item) AS item FROM f JOIN k USING (id) GROUP BY doc HAVING count(DISTINCT id) = 1""")
def cor12(s, d):
    found = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("id"))
    return corpus.by_one_id(found, table(s, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("item")))


@query("cor14_corroborated", f"""WITH t AS (SELECT item_id, {_BAG.replace('TEXT', 'text')} AS bag FROM benchmark), p AS (SELECT doc_id, {_BAG.replace('TEXT', 'text')} AS bag FROM documents),
x AS (SELECT doc_id, item_id, CAST(len(list_intersect(p.bag, t.bag)) AS DOUBLE) / len(t.bag) AS score FROM p, t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM x)
SELECT doc_id, item_id, item_id % 3 IN (doc_id % 3, doc_id % 2) AND item_id % 2 IN (doc_id % 3, doc_id % 2) AS corroborated FROM r WHERE k = 1 AND score >= 0.6""")
def cor14_corroborated(s, d):
    docs, items = table(s, d, "documents"), table(s, d, "benchmark")
    matches = _titles(docs, items).select(F.col("doc_id").alias("page"), F.col("item_id").alias("title"))
    pages = docs.select(F.col("doc_id").alias("page"), F.array(F.col("doc_id") % 3, F.col("doc_id") % 2).alias("numbers"))
    known = items.select(F.col("item_id").alias("title"), (F.col("item_id") % 3).alias("volume"), (F.col("item_id") % 2).alias("first_page"))
    return corpus.corroborated(matches, pages, known).select(F.col("page").alias("doc_id"), F.col("title").alias("item_id"), "corroborated")


@query("cor15_scoped_titles", f"""WITH t AS (SELECT item_id, ['en', 'de', 'fr', 'es'][1 + item_id % 4] AS journal, {_BAG.replace('TEXT', 'text')} AS bag FROM benchmark), p AS (SELECT doc_id, lang AS journal, {_BAG.replace('TEXT', 'text')} AS bag FROM documents),
x AS (SELECT doc_id, item_id, CAST(len(list_intersect(p.bag, t.bag)) AS DOUBLE) / len(t.bag) AS score FROM p JOIN t USING (journal) WHERE len(t.bag) >= 6), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM x)
SELECT doc_id, item_id, round(score, 6) AS score FROM r WHERE k = 1 AND score >= 0.6""")
def cor15(s, d):
    journal = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    pages = table(s, d, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("journal"), tx.bag_of(F.col("text")).alias("bag"))
    items = table(s, d, "benchmark").select(F.col("item_id").alias("title"), journal.alias("journal"), tx.bag_of(F.col("text")).alias("bag"))
    return corpus.scoped_title_match(pages, items).select(F.col("page").alias("doc_id"), F.col("title").alias("item_id"), r6("score"))


@query("cor16_first_rule", """SELECT o_orderkey AS doc, CASE WHEN o_orderstatus = 'F' THEN o_custkey WHEN o_totalprice > 100000 THEN o_custkey + 1 ELSE o_custkey + 2 END AS item,
CASE WHEN o_orderstatus = 'F' THEN 'doi' WHEN o_totalprice > 100000 THEN 'pmid' ELSE 'title' END AS rule FROM orders""")
def cor16(s, d):
    o = table(s, d, "orders").withColumn("doc", F.col("o_orderkey"))
    item = lambda df, n: df.select("doc", (F.col("o_custkey") + n).alias("item"))
    return corpus.first_rule([("doi", item(o.filter("o_orderstatus = 'F'"), 0)), ("pmid", item(o.filter("o_totalprice > 100000"), 1)), ("title", item(o, 2))])


_PLACES = """i AS (SELECT s_suppkey AS item, 1992 + s_suppkey % 7 AS year, s_nationkey AS volume, s_suppkey % 10 AS page, ['Lancet oncology', 'BMJ open', 'Anaesthesia'][1 + s_suppkey % 3] AS journal FROM supplier),
c AS (SELECT o_orderkey AS citation, year(o_orderdate) AS year, o_custkey % 25 AS volume, o_orderkey % 10 AS page, ['Lancet', 'bmj', 'Anaesthesia news'][1 + o_orderkey % 3] AS journal FROM orders)"""


@query("cor17_by_place", f"""WITH {_PLACES} SELECT citation, min(item) AS item FROM c JOIN i USING (year, volume, page) WHERE regexp_extract(lower(c.journal), '[a-z]+') = regexp_extract(lower(i.journal), '[a-z]+') GROUP BY citation HAVING count(DISTINCT item) = 1""")
def cor17(s, d):
    of = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 3 + 1).cast("int")).alias("journal")
    items = table(s, d, "supplier").select(F.col("s_suppkey").alias("item"), (1992 + F.col("s_suppkey") % 7).alias("year"), F.col("s_nationkey").alias("volume"), (F.col("s_suppkey") % 10).alias("page"), of("s_suppkey", "Lancet oncology", "BMJ open", "Anaesthesia"))
    cited = table(s, d, "orders").select(F.col("o_orderkey").alias("citation"), F.year("o_orderdate").cast("long").alias("year"), (F.col("o_custkey") % 25).alias("volume"), (F.col("o_orderkey") % 10).alias("page"), of("o_orderkey", "Lancet", "bmj", "Anaesthesia news"))
    return corpus.by_place(cited, items)


@query("cor18_by_title", f"""WITH t AS (SELECT item_id, {_BAG.replace('TEXT', 'text')} AS bag FROM benchmark), p AS (SELECT doc_id, {_BAG.replace('TEXT', 'text')} AS bag FROM documents),
x AS (SELECT doc_id, item_id, CAST(len(list_intersect(p.bag, t.bag)) AS DOUBLE) / len(t.bag) AS score FROM p, t), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS runner_up FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, item_id))
SELECT doc_id AS citation, item_id AS item, round(score, 6) AS score FROM r WHERE k = 1 AND score >= 0.6 AND score - coalesce(runner_up, 0) >= 0.2""")
def cor18(s, d):
    bag = tx.bag_of(F.col("text")).alias("bag")
    return corpus.by_title(table(s, d, "documents").select(F.col("doc_id").alias("citation"), bag), table(s, d, "benchmark").select(F.col("item_id").alias("item"), bag)).select("citation", "item", r6("score"))


@query("cor20_worklist", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def cor20(s, d):
    return corpus.worklist(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "place")


@query("cor23_rewritten_keys", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BJA' WHEN 1 THEN 'AA' ELSE 'ccm' END || CAST(CASE WHEN o_orderkey >= 1235 THEN o_orderkey + 1 ELSE o_orderkey END AS VARCHAR) AS rewritten FROM orders""")
def cor23(s, d):
    k = F.col("o_orderkey") % 3
    keys = table(s, d, "orders").select("o_orderkey", F.concat(F.when(k == 0, "bja").when(k == 1, "anesth analg").otherwise("ccm"), F.col("o_orderkey").cast("string")).alias("key"))
    return corpus.rewritten(keys, {"bja": "BJA", "anesth analg": "AA"}, 1235).select("o_orderkey", "rewritten")


@query("cor24_scope", f"""WITH {LINES_SQL} SELECT trial, count(*) AS lines FROM lines GROUP BY trial""")
def cor24(s, d):
    both = continuous_lines(s, d).unionByName(category_lines(s, d))
    return corpus.in_scope(both, "continuous").groupBy("trial").agg(F.count(F.lit(1)).alias("lines"))


# Text functions over whole texts

@query("txt01_glyph_repair", "SELECT doc_id, replace(translate(text || chr(10942) || chr(61617), chr(10942) || chr(61617) || chr(188), chr(177) || chr(177) || '='), chr(175), 'fl') AS fixed FROM documents")
def txt01(s, d):
    return table(s, d, "documents").select("doc_id", tx.glyph_repair(F.concat("text", F.lit("\u2afe\uf0b1"))).alias("fixed"))


@query("txt13_names_and_journals", """SELECT o_orderkey, split_part('Smith, J. ' || o_orderkey, ',', 1) AS surname, ['JAMA', 'bja', 'NEJM', 'other'][1 + o_orderkey % 4] AS code FROM orders""")
def txt13(s, d):
    journal = F.element_at(F.array(*map(F.lit, ("JAMA Surgery", "British Journal of Anaesthesia", "N. New England J", "The Lancet"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", tx.surname_of(F.concat(F.lit("Smith, J. "), F.col("o_orderkey").cast("string"))).alias("surname"), tx.journal_code(journal).alias("code"))


@query("txt15_licenses", "SELECT o_orderkey, ['cc-by', 'cc-by-nc', 'elsevier-tdm', 'cc0'][1 + o_orderkey % 4] AS license, o_orderkey % 4 <> 2 AS open FROM orders")
def txt15(s, d):
    x = F.element_at(F.array(*map(F.lit, (" CC-BY-4.0", "cc-by-nc-3.0", "elsevier-tdm-1.0", "CC0"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", tx.license_of(x).alias("license"), tx.is_open_license(x).alias("open"))


@query("txt16_html_unescape", "SELECT page_id, replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM pages")
def txt16(s, d):
    return table(s, d, "pages").select("page_id", tx.html_unescape(F.col("html")).alias("t"))


@query("txt02_plus_minus_is_dash", "SELECT doc_id, doc_id % 3 = 0 AS dash FROM documents")
def txt02(s, d):
    tail = F.when(F.col("doc_id") % 3 == 0, " double\u00b1blind post\u00b1operative").when(F.col("doc_id") % 3 == 1, " mean\u00b1SD and median \u00b1 SE one\u00b1two").otherwise(" 4\u00b12")
    plain = F.translate(F.col("text"), "\u00b1", " ")
    return table(s, d, "documents").select("doc_id", tx.plus_minus_is_dash(F.concat(plain, tail)).alias("dash"))


@query("lay01_page_score", r"""SELECT doc_id, CAST(CASE WHEN regexp_matches(t, 'baseline\s+(patient\s+|demographic\s+)?characteristics', 'i') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, 'patient\s+characteristics', 'i') THEN 3 ELSE 0 END
 + CASE WHEN regexp_matches(t, 'demographic', 'i') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\bbaseline\b', 'i') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, 'table\s+1\b', 'i') THEN 2 ELSE 0 END + least(4, (doc_id % 15) / 3.0)
 + CASE WHEN regexp_matches(t, '\bn\s*=\s*\d+', 'i') THEN 1 ELSE 0 END AS DOUBLE) AS score FROM (SELECT doc_id, ['Table 1 Baseline patient characteristics (n = 4) ', 'demographic ', ''][1 + doc_id % 3] || text AS t FROM documents)""")
def lay01(s, d):
    start = F.element_at(F.array(*map(F.lit, ("Table 1 Baseline patient characteristics (n = 4) ", "demographic ", ""))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", tx.page_score(F.concat(start, F.col("text")), F.col("doc_id") % 15).cast("double").alias("score"))
