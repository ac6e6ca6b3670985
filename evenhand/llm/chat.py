"""Chat formatting with a grammar round trip.

A turn renders as an opening control string, its text, and a closing control string. The rendered
turn is parsed again by a deterministic parser; while the recovered turn differs from its source,
conflicting content is escaped at the next level: nothing, then control strings and escape
look-alikes, then every special character. Parsing always undoes escapes, so it needs no level.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: role -> (opening, closing); other roles render as [ROLE], the role's name, [AS], the text, [/ROLE].
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[AS]", "[/ROLE]")
CONTROL = ("<s>", *(x for pair in TURNS.values() for x in pair), *OTHER)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_LOOKALIKE = re.compile(r"&(?=(?:amp|lt|lsqb);)")
_ESCAPED = re.compile(r"&(amp|lt|lsqb);")
_OUT = {"amp": "&", "lt": "<", "lsqb": "["}
_IN = {"&": "&amp;", "<": "&lt;", "[": "&lsqb;"}


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return _CONTROL.sub(lambda m: _IN[m[0][0]] + m[0][1:], _LOOKALIKE.sub("&amp;", text))
    return re.sub(r"[&<\[]", lambda m: _IN[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _OUT[m[1]], text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, from, to) of the turns, with the text's raw span; None if the string isn't in the grammar."""
    marks, turns, at, i = list(_CONTROL.finditer(rendered)), [], 0, 0
    while i < len(marks):
        opening = marks[i]
        if opening.start() != at:
            return None
        if opening[0] == OTHER[0]:
            if i + 2 >= len(marks) or (marks[i + 1][0], marks[i + 2][0]) != OTHER[1:]:
                return None
            a, b = marks[i + 1].end(), marks[i + 2].start()
            turns.append((unescape(rendered[opening.end() : marks[i + 1].start()]), unescape(rendered[a:b]), a, b))
            i, at = i + 3, marks[i + 2].end()
            continue
        role = next((r for r, (o, _) in TURNS.items() if o == opening[0]), None)
        if role is None or i + 1 >= len(marks) or marks[i + 1][0] != TURNS[role][1]:
            return None
        a, b = opening.end(), marks[i + 1].start()
        turns.append((role, unescape(rendered[a:b]), a, b))
        i, at = i + 2, marks[i + 1].end()
    return turns if at == len(rendered) else None


def render_turn(role: str, text: str) -> tuple[str, tuple[str, str, int, int], int]:
    """The rendered turn, the turn as parsed from it, and the escape level that was needed."""
    for level in (0, 1, 2):
        body = escape(text, level)
        if role in TURNS:
            out = TURNS[role][0] + body + TURNS[role][1]
        else:
            out = OTHER[0] + escape(role, level) + OTHER[1] + body + OTHER[2]
        back = parse(out)
        if back is not None and len(back) == 1 and back[0][:2] == (role, text):
            return out, back[0], level
    raise ValueError("no escape level gives the turn back")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A whole conversation and its loss mask: spans of assistant text in the rendered string."""
    parts, mask, at = ["<s>"], [], 3
    for role, text in turns:
        out, (_, _, a, b), _ = render_turn(role, text)
        if role == "assistant":
            mask.append((at + a, at + b))
        parts.append(out)
        at += len(out)
    return "".join(parts), mask


def parse_conversation(rendered: str) -> list[tuple[str, str, int, int]] | None:
    if not rendered.startswith("<s>"):
        return None
    turns = parse(rendered[3:])
    return None if turns is None else [(r, t, a + 3, b + 3) for r, t, a, b in turns]


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<from,to>> per conversation, in turn order.

    For conversations whose text fits a row; digests() needs no such bound.
    """
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for conv, rows in _streams(it):
            text, mask = render([(r, t) for r, t in rows])
            yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "formatted": [text], "loss_mask": [[{"from": a, "to": b} for a, b in mask]]})

    return _sorted(conversations).mapInPandas(of, "conv_id long, formatted string, loss_mask array<struct<`from`:long,`to`:long>>")


def _sorted(conversations: DataFrame) -> DataFrame:
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return clean.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _streams(it: Iterator[pd.DataFrame]):
    """(conv_id, iterator of (role, text)) over sorted rows; a conversation may span many batches."""
    def rows():
        for pdf in it:
            for c, r, t in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                yield (None if pd.isna(c) else int(c)), r, t

    flow = rows()
    held = next(flow, None)
    while held is not None:
        conv = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == conv:
                yield held[1], held[2]
                held = next(flow, None)

        mine = own()
        yield conv, mine
        for _ in mine:
            pass


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, what parsing its formatted form gives back, as counts and digests.

    Turns stream through one at a time: memory holds one turn, whatever the conversation's length.
    Turns order by turn (null first), then role and text; null role and text are empty; a null
    conv_id is one conversation; repeated rows are turns of their own; an empty table gives no rows.
    Extra columns are ignored.
    """
    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, rows in _streams(it):
            n, turns, loss, loss_chars, chars, most = 0, hashlib.sha256(), hashlib.sha256(), 0, len("<s>"), 0
            for role, text in rows:
                rendered, (role_back, text_back, a, b), level = render_turn(role, text)
                n, chars, most = n + 1, chars + len(rendered), max(most, level)
                turns.update(f"{role_back}\n{text_back}\n".encode())
                if role_back == "assistant":
                    masked = unescape(rendered[a:b])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, most))
            if len(out) >= 4096:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return _sorted(conversations).mapInPandas(of, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escape_level int")


def _frame(rows: list) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escape_level"])
    return pdf.assign(conv_id=pdf["conv_id"].astype("Int64"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(conversations.unionByName(planted))
