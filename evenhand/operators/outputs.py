"""What a run hands out, as tables: result sheets, parse outcomes, and a second engine's reply as variables; and tables as a workbook."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import KEYS

#: The line of what all trials say: after every trial.
LAST_LINE = 2**62
# Headers that readers of the results know, and the note of an overall p that has no value.
RESULT_HEADERS = ("TRIAL", "ROW", "P (one-sided toward homogeneity)", "95% Monte Carlo bound", "Replicates")
NOT_COMPUTABLE = "not computable (trial p of exactly 0 and 1 both present)"

REPLY = """struct<arms:array<struct<name:string,n:int>>,
continuous:array<struct<label:string,dispersion:string,decimalsMean:int,decimalsDispersion:int,values:array<struct<arm:string,n:int,mean:double,sd:double>>>>,
categorical:array<struct<label:string,categories:array<string>,values:array<struct<arm:string,counts:array<long>>>>>>"""


def results_sheet(rows: DataFrame) -> DataFrame:
    """trial, row, display, ci, m under the headers of the results."""
    return rows.select(*[F.col(c).alias(h) for c, h in zip(("trial", "row", "display", "ci", "m"), RESULT_HEADERS)])


def summary_sheet(trials: DataFrame, overall: DataFrame) -> DataFrame:
    """line, trial, p, ci: a line a trial, in order of trial_no, and one for all where two trials or more have a p.

    trials: trial, trial_no, p, ci; overall: k, p (null if it isn't computable).
    """
    own = trials.select(F.col("trial_no").cast("long").alias("line"), "trial", F.col("p").cast("string").alias("p"), F.coalesce("ci", F.lit("")).alias("ci"))
    whole = overall.filter("k >= 2").select(
        F.lit(LAST_LINE).alias("line"), F.format_string("ALL %d TRIALS (Stouffer combination)", F.col("k")).alias("trial"),
        F.when(F.col("p").isNull() | F.isnan("p"), NOT_COMPUTABLE).otherwise(F.col("p").cast("string")).alias("p"), F.lit("").alias("ci"),
    )
    return own.unionByName(whole)


def template_sheets(variables: DataFrame, skipped: DataFrame, dispersions: DataFrame, engine: str = "heuristic") -> dict[str, DataFrame]:
    """Template, Provenance and Skipped of parsed blocks."""
    needed = {"row", "n", "mean", "sd"}
    if missing := needed - set(variables.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    provenance = variables.select(*KEYS, "row_no", "row").distinct().withColumn("engine", F.lit(engine)).join(dispersions, KEYS, "left")
    return {"Template": variables, "Provenance": provenance, "Skipped": skipped}


def parse_outcomes(blocks: DataFrame, arms: DataFrame, variables: DataFrame, skipped: DataFrame) -> DataFrame:
    """doc, block, status, arms, arms_with_n, lines, variables, continuous, skipped of every block tried; those that gave nothing stay, as `no table`."""
    a = arms.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("arms"), F.count("n").alias("arms_with_n"))
    v = variables.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("row").alias("variables"), F.count_distinct(F.when(F.col("mean").isNotNull(), F.col("row"))).alias("continuous"))
    s = skipped.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("skipped"))
    out = blocks.select(*KEYS).distinct().join(a, KEYS, "left").join(v, KEYS, "left").join(s, KEYS, "left")
    counts = ("arms", "arms_with_n", "lines", "variables", "continuous", "skipped")
    return out.select(*KEYS, F.when(F.col("lines") > 0, "ok").otherwise("no table").alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def reply_variables(replies: DataFrame, observation_delta: int = 1) -> DataFrame:
    """doc, row_no, row, arm, n, mean, sd, se, round_mean, round_dispersion, round_observation, categories, engine from replies (doc, json).

    A value without mean or dispersion goes, and so does one whose counts are not as many as its categories. A value of unstated kind
    is an SD. Sizes that a value lacks are its arm's. Names and categories that repeat in a reply are numbered. Text that isn't JSON gives nothing.
    """
    r = replies.select("doc", F.from_json("json", REPLY).alias("r")).filter("r is not null")
    sizes = r.select("doc", F.explode("r.arms").alias("a")).select("doc", F.col("a.name").alias("arm"), F.col("a.n").alias("arm_n")).groupBy("doc", "arm").agg(F.first("arm_n").alias("arm_n"))
    cont = r.select("doc", F.posexplode("r.continuous").alias("i", "v")).select("doc", F.lit(0).alias("part"), "i", "v.label", F.col("v").alias("c"))
    cat = r.select("doc", F.posexplode("r.categorical").alias("i", "v")).filter(F.size("v.categories") > 0).select("doc", F.lit(1).alias("part"), "i", "v.label", F.col("v").alias("k"))
    both = cont.unionByName(cat, allowMissingColumns=True).withColumn("label", F.trim(F.regexp_replace("label", "\\s+", " ")))
    nth = F.row_number().over(W.partitionBy("doc", "label").orderBy("part", "i"))
    both = both.withColumn("row_no", F.row_number().over(W.partitionBy("doc").orderBy("part", "i"))).withColumn("nth", nth)
    both = both.withColumn("row", F.when(F.col("nth") == 1, F.col("label")).otherwise(F.concat_ws(" ", "label", F.col("nth").cast("string"))))
    values = both.filter("part = 0").select("doc", "row_no", "row", "c", F.explode("c.values").alias("x")).filter("x.mean is not null and x.sd is not null")
    values = values.withColumn("arm", F.col("x.arm")).join(sizes, ["doc", "arm"], "left")
    se = F.coalesce(F.col("c.dispersion") == "se", F.lit(False))
    lines = values.select(
        "doc", "row_no", "row", "arm", F.coalesce("x.n", "arm_n").alias("n"), "x.mean", F.when(~se, F.col("x.sd")).alias("sd"), F.when(se, F.col("x.sd")).alias("se"), F.col("c.decimalsMean").alias("round_mean"),
        F.col("c.decimalsDispersion").alias("round_dispersion"), (F.col("c.decimalsMean") + observation_delta).alias("round_observation"),
    )
    names = both.filter("part = 1").select("doc", "row_no", "row", "k", F.posexplode("k.categories").alias("j", "level"))
    names = names.withColumn("nth", F.row_number().over(W.partitionBy("doc", "level").orderBy("row_no", "j")))
    names = names.withColumn("level", F.when(F.col("nth") == 1, F.col("level")).otherwise(F.concat_ws(" ", "level", F.col("nth").cast("string"))))
    levels = names.groupBy("doc", "row_no", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "level"))), lambda x: x["level"]).alias("levels"))
    counted = both.filter("part = 1").select("doc", "row_no", F.explode("k.values").alias("x")).join(levels, ["doc", "row_no"]).filter(F.size("x.counts") == F.size("levels"))
    cats = counted.select("doc", "row_no", "row", "x.arm", F.map_from_arrays("levels", "x.counts").alias("categories"))
    return lines.unionByName(cats, allowMissingColumns=True).withColumn("engine", F.lit("ai"))


def prose_request(text, most: int = 60_000):
    """What of a document's text a second engine is shown."""
    return F.substring(text, 1, most)


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """An .xlsx of ordered tables, a sheet each, streamed row by row: numbers as numbers, the rest as text, null blank. path is local to the driver."""
    types = '<Override PartName="/xl/worksheets/sheet{0}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    numbers = range(1, len(sheets) + 1)

    def row_xml(r: int, values) -> str:
        cells = []
        for i, v in enumerate(values):
            at = f"{_column(i)}{r}"
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
            elif v is not None and v == v:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        return f'<row r="{r}">{"".join(cells)}</row>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(types.format(k) for k in numbers) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
        for k, df in zip(numbers, sheets.values()):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{row_xml(1, df.columns)}'.encode())
                for r, row in enumerate(df.toLocalIterator(), 2):
                    f.write(row_xml(r, row).encode("utf-8", "replace"))
                f.write(b"</sheetData></worksheet>")
