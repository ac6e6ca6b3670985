"""Names and types of an uploaded table. Names are metadata and are settled on the driver; cells stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NUMERIC


class MissingColumns(ValueError):
    """The table lacks columns that validation needs."""


def _first(names: list[str], part: str) -> str | None:
    return next((n for n in names if part in n), None)


def resolve_names(columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """(new name of each old one, names to drop); names are matched by what they contain, earlier rules first."""
    upper = [c.strip().upper() for c in columns]
    now, drop = dict(zip(columns, upper)), []

    def rename(part: str, to: str) -> bool:
        hit = _first([v for v in now.values() if v not in drop], part)
        if hit is None:
            return False
        if hit != to and to in now.values():
            return True
        key = next(k for k, v in now.items() if v == hit)
        now[key] = to
        return True

    rename("TRIAL", "TRIAL")
    if rename("MEASURE", "ROW"):
        drop += [v for v in now.values() if v in ("GROUP", "DECSD")]
    rename("DECM", "ROUND_MEAN")
    rename("NUMBER", "N")
    if not any("ROW" in v for v in now.values()):
        rename("GROUP", "ROW")
    if not rename("ROW", "ROW"):
        raise MissingColumns("no ROW column")
    missing = [c for c in ("N", "MEAN", "SD") if c not in now.values()]
    if missing:
        raise MissingColumns("missing " + ", ".join(missing))
    fixed = {"TRIAL", "ROW", "N", "MEAN", "SD", "SE", "Q1", "Q3", "ROUND_MEAN", "ROUND_DISPERSION", "ROUND_OBSERVATION"}
    rest = [v for v in now.values() if v not in fixed and v not in drop]
    if "ROUND_MEAN" not in now.values():
        hit = _first(rest, "MEAN") or ("ROUND" if "ROUND" in rest else None)
        if hit:
            now[next(k for k, v in now.items() if v == hit)] = "ROUND_MEAN"
            rest.remove(hit)
    if "ROUND_OBSERVATION" not in now.values() and (hit := _first(rest, "OBS")):
        now[next(k for k, v in now.items() if v == hit)] = "ROUND_OBSERVATION"
    return now, drop


def normalized(df: DataFrame, line_no: str | None = None) -> DataFrame:
    """Renamed, typed lines with `<name>_raw` texts of the numeric columns and a line number; other columns stay strings.

    A missing TRIAL is '1'. ROUND_MEAN falls back to the observations' decimals, these to ROUND_MEAN as it stands then; both to
    0. A mean typed with more decimals than ROUND_MEAN raises it.
    """
    names, drop = resolve_names([c for c in df.columns if c != line_no])
    kept = {new: F.col(f"`{old}`") for old, new in names.items() if new not in drop}
    cols = [(F.col(line_no) if line_no else F.monotonically_increasing_id()).alias("line_no")]
    cols.append((F.when(F.trim(kept["TRIAL"].cast("string")) == "", None).otherwise(kept["TRIAL"].cast("string")) if "TRIAL" in kept else F.lit("1")).alias("trial"))
    cols.append(kept["ROW"].cast("string").alias("row"))
    for c in NUMERIC:
        raw = kept[c.upper()].cast("string") if c.upper() in kept else F.lit(None).cast("string")
        cols += [raw.alias(f"{c}_raw"), F.trim(raw).try_cast("double").alias(c)]
    whole = lambda c: F.trim(kept[c].cast("string")).try_cast("double").cast("int")
    mean = whole("ROUND_MEAN") if "ROUND_MEAN" in kept else whole("ROUND_OBSERVATION") if "ROUND_OBSERVATION" in kept else F.lit(0)
    obs = whole("ROUND_OBSERVATION") if "ROUND_OBSERVATION" in kept else mean
    cols += [F.coalesce(mean, F.lit(0)).alias("round_mean"), F.coalesce(obs, F.lit(0)).alias("round_observation")]
    cols.append((whole("ROUND_DISPERSION") if "ROUND_DISPERSION" in kept else F.lit(None).cast("int")).alias("round_dispersion"))
    used = {"TRIAL", "ROW", *(c.upper() for c in NUMERIC), "ROUND_MEAN", "ROUND_OBSERVATION", "ROUND_DISPERSION"}
    cols += [v.cast("string").alias(k) for k, v in kept.items() if k not in used]
    out = df.select(*cols)
    typed = F.length(F.regexp_extract(F.trim("mean_raw"), "\\.([0-9]*)$", 1))
    return out.withColumn("round_mean", F.when((F.col("mean") % 1) != 0, F.greatest("round_mean", typed)).otherwise(F.col("round_mean")))


def column_roles(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """column -> category or misc, by one aggregate pass: a category is numeric with gaps and whole-numbered."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        blank = F.col(f"`{c}`").isNull() | (F.trim(f"`{c}`") == "")
        value = F.trim(f"`{c}`").try_cast("double")
        aggs += [
            F.bool_and(blank | value.isNotNull()).alias(f"numeric{i}"), F.bool_or(blank).alias(f"gaps{i}"), F.bool_or(~blank).alias(f"some{i}"),
            F.bool_and(blank | (value % 1 == 0)).alias(f"whole{i}"),
        ]
    facts = df.agg(*aggs).first()
    return {c: "category" if all(facts[f"{k}{i}"] for k in ("numeric", "gaps", "some", "whole")) else "misc" for i, c in enumerate(columns)}


def with_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """The category columns as one map of counts; empty cells have no entry."""
    if not columns:
        return df.withColumn("categories", F.expr("cast(map() as map<string,bigint>)"))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.trim(f"`{c}`").try_cast("double").cast("long").alias("value")) for c in columns])
    return df.withColumn("categories", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))).drop(*columns)
