"""Table blocks: from positioned words below a caption to variables by arm.

A block (doc, block) holds lines of words; `cap` is its caption's line, 0 if it is read from the top. Its words are brought
together once and parse.py reads it whole, so that a block costs one pass however many tables are asked of it.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import parse
from .parse import BARE_SKIP, CAPTION, COUNT_SKIP, MEDIAN_SKIP, PERCENT_SKIP  # noqa: F401

KEYS = ["doc", "block"]

TOKENS = {"type": "string", "text": "string", "num1": "double", "num2": "double", "dec1": "int", "dec2": "int", "start": "int", "x0": "double", "x1": "double", "mid": "double"}
LINES = {"line_no": "int", "text": "string", "kind": "string", "main": "string", "label": "string"}
ARMS = {"col": "int", "arm_no": "int", "name": "string", "n": "int", "source": "string", "clusters": "int", "live": "boolean"}
VARIABLES = {
    "row_no": "int", "row": "string", "kind": "string", "arm_no": "int", "n": "int", "mean": "double", "sd": "double", "se": "double", "round_mean": "int", "round_dispersion": "int", "round_observation": "int",
    "categories": "map<string,bigint>",
}
SKIPPED = {"line_no": "int", "label": "string", "reason": "string"}
DERIVED = {"line_no": "int", "label": "string", "kind": "string", "note": "string"}
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "map<string,bigint>": pa.map_(pa.string(), pa.int64())}
#: Blocks that a worker reads at once.
HELD = 500


def _ddl(fields: dict[str, str]) -> str:
    return f"array<struct<{','.join(f'{k}:{v}' for k, v in fields.items())}>>"


SCHEMA = f"cap int, foot string, dispersion string, score bigint, lines {_ddl(LINES | {'tokens': _ddl(TOKENS)})}, arms {_ddl(ARMS)}, variables {_ddl(VARIABLES)}, skipped {_ddl(SKIPPED)}, derived {_ddl(DERIVED)}"


def _nested(lists: list[list[tuple]], fields: dict[str, str], *more: tuple[str, pa.Array]) -> pa.Array:
    """Lists of tuples as lists of structs; `more` are further fields, flat."""
    offsets = [0]
    for x in lists:
        offsets.append(offsets[-1] + len(x))
    columns = list(zip(*[row for x in lists for row in x])) or [()] * len(fields)
    arrays = [pa.array(c, _ARROW[kind]) for c, kind in zip(columns, fields.values())]
    names = [*fields, *[name for name, _ in more]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([*arrays, *[a for _, a in more]], names=names))


def _read(words: pa.Table, options: dict) -> pa.RecordBatch:
    """Whole blocks of sorted words, `first` at each block's first one, as rows of SCHEMA."""
    line_no, x, text, width = (words.column(c).to_pylist() for c in ("line_no", "x", "text", "width"))
    starts = pc.indices_nonzero(words.column("first")).to_pylist()
    heads = words.take(pa.array(starts, pa.int64())).combine_chunks()
    filled = heads.column("filled").to_pylist() if "filled" in heads.column_names else repeat(None)
    blocks, at = [], []
    for i, (a, b, cap, f) in enumerate(zip(starts, [*starts[1:], len(x)], heads.column("cap").to_pylist(), filled)):
        block = parse.Block(cap, line_no[a:b], x[a:b], text[a:b], width[a:b], {r["col"]: (r["n"], r["source"]) for r in f or ()}, **options)
        if block.lines:
            blocks.append(block)
            at.append(i)
    tokens = _nested([x.tokens for b in blocks for x in b.lines], TOKENS)
    arms = [[(a.col, a.arm_no, a.name, a.n, a.source, len(b.arms), a.live or a.n is not None) for a in b.arms] for b in blocks]
    out = {
        **{k: heads.column(k).take(pa.array(at, pa.int32())).combine_chunks() for k in (*KEYS, "cap")}, "foot": pa.array([b.foot for b in blocks], pa.string()), "dispersion": pa.array([b.dispersion for b in blocks], pa.string()),
        "score": pa.array([b.score for b in blocks], pa.int64()), "lines": _nested([[(x.line_no, x.text, x.kind, x.main, x.label) for x in b.lines] for b in blocks], LINES, ("tokens", tokens)), "arms": _nested(arms, ARMS),
        "variables": _nested([b.variables for b in blocks], VARIABLES), "skipped": _nested([b.skipped for b in blocks], SKIPPED), "derived": _nested([b.derived for b in blocks], DERIVED),
    }
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.values()], names=list(out))


def parsed_blocks(words: DataFrame, filled: DataFrame | None = None, paren: str = "auto", approximate: bool = False, observation_delta: int = 1) -> DataFrame:
    """A row for each block that has data, with all that parse.py reads from it, from words (doc, block, cap, line_no, word_no, text, x, width).

    Words without a text or a place are left out. filled: doc, block, col, n, source. A window brings a block's words together, in
    order, and shuffles only words that don't lie so already.
    """
    options = {"paren": paren, "approximate": approximate, "delta": observation_delta}
    typed = words.select(*KEYS, *[F.col(c).cast(k).alias(c) for c, k in (("cap", "int"), ("line_no", "int"), ("word_no", "long"), ("x", "double"), ("width", "double"))], "text")
    typed = typed.filter("text is not null and x is not null and width is not null and line_no is not null")
    if filled is not None:
        one = filled.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("n").cast("int").alias("n"), "source")).alias("filled"))
        typed = typed.join(one, KEYS, "left")
    first = F.row_number().over(W.partitionBy(*KEYS).orderBy("line_no", "x", "word_no", "text")) == 1
    once = lambda c: F.when(F.col("first"), F.col(c)).alias(c)
    placed = typed.withColumn("first", first).select("first", *[once(c) for c in typed.columns if c in (*KEYS, "cap", "filled")], "line_no", "x", "text", "width")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # words of blocks that aren't whole yet
        gc.disable()  # a block makes many small objects and no cycles
        for batch in batches:
            starts = pc.indices_nonzero(batch.column("first")).to_pylist()
            # a batch ends within a block: all but its last one are whole
            while starts:
                cut = starts[-1] if len(starts) <= HELD else starts[HELD]
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if whole.num_rows:
                    yield _read(whole, options)
                held, batch = [], batch.slice(cut)
                starts = [s - cut for s in starts[HELD:]] if len(starts) > HELD else []
            held.append(batch)
        whole = pa.Table.from_batches(held) if held else None
        if whole is not None and whole.num_rows:
            yield _read(whole, options)

    keys = ", ".join(f"{k} {words.schema[k].dataType.simpleString()}" for k in KEYS)
    return placed.mapInArrow(read, f"{keys}, {SCHEMA}")


class Parsed:
    """The tables of parsed blocks: lines, arms, variables, skipped, derived, scores, dispersions.

    Blocks are read once and written by `keep` (to the shared folder); every table is a part of that one.
    """

    def __init__(self, words: DataFrame, filled: DataFrame | None = None, paren: str = "auto", approximate: bool = False, observation_delta: int = 1, keep=DataFrame.checkpoint):
        self.blocks = keep(parsed_blocks(words, filled, paren, approximate, observation_delta))

    def _part(self, name: str) -> DataFrame:
        return self.blocks.select(*KEYS, F.inline(name))

    @property
    def lines(self) -> DataFrame:
        """doc, block, cap, line_no, text, kind, main, label, tokens; main and label of lines that an arm has a cell in."""
        return self.blocks.select(*KEYS, "cap", F.inline("lines"))

    @property
    def all_arms(self) -> DataFrame:
        return self._part("arms").drop("live")

    @property
    def arms(self) -> DataFrame:
        """Arms that have a size or a cell."""
        return self._part("arms").filter("live").drop("live")

    @property
    def variables(self) -> DataFrame:
        return self._part("variables")

    @property
    def skipped(self) -> DataFrame:
        return self._part("skipped")

    @property
    def derived(self) -> DataFrame:
        return self._part("derived")

    @property
    def scores(self) -> DataFrame:
        """doc, block, score of every block that has variables."""
        return self.blocks.filter("score is not null").select(*KEYS, "score")

    @property
    def dispersions(self) -> DataFrame:
        return self.blocks.select(*KEYS, "dispersion")
