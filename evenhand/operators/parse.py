"""One table block at a time: from its positioned words to variables by arm.

A block is a table of a page and small by nature, so each is read by one program in one pass; blocks.py spreads them over tasks.
Patterns are read as Java reads them: classes are ASCII, and a word boundary knows all letters.
"""

from __future__ import annotations

import functools
import math
import re

from ..functions.text import LABEL_TAILS, NUM
from .tokens import TYPES

# What ends a table, what announces one, and the words that decide how a cell is read.
STOP = (
    "(?i)^(values|data|results|numbers|figures)\\s+(are|were)|presented\\s+as|expressed\\s+as|given\\s+as|shown\\s+as|^abbreviations?|^definition\\s+of|^(figure|fig\\.)\\s*\\d|^(\\*|\u2020|\u2021|\u00a7)\\s"
)
CAPTION = "(?i)^(table|tab\\.?)\\s+([0-9]{1,2}|[IVXL]{1,4})\\b"
ARM_SIZE = "(?i)n\\s*=\\s*\\d[\\d,]*"
SIZE_ROW = "(?i)^(no\\.?\\s+of\\s+(patients|subjects|cases)|n|number\\s+of\\s+(patients|subjects))$"
P_COLUMN = "(?i)p[-\u2013 ]?values?|significance"
DASHED = "(?i)mean\\s*[-\u2013\u2212]+\\s*s\\.?d\\b"
MEASURES = (
    "(?i)age|weight|height|bmi|body\\s+mass|duration|time|pressure|rate|score|hemoglobin|haemoglobin|creatinine|glucose|albumin|dose|volume|length|circumference|temperature|count|level"
)
SAYS_SE, SAYS_SD = "(?i)\\bs\\.?e\\.?m?\\.?\\b|standard\\s+error", "(?i)\\bs\\.?d\\.?\\b|standard\\s+deviation"
SAYS_MEAN_SD = "(?i)mean\\s*[(\u00b1]\\s*(sd|standard deviation)"
SAYS_COUNT_PCT = "(?i)(numbers?|counts?|figures?)\\s*\\(\\s*%|\\bn\\s*\\(\\s*%\\s*\\)|number\\s*\\(\\s*per\\s*cent"
SAYS_PCT = "(?i)%|\\bpercent"
DEMOGRAPHIC = "(?i)\\bage\\b|\\bsex\\b|gender|\\bmale\\b|female|weight|height|\\bbmi\\b|body\\s+mass|\\basa\\b"
PERCENT_SKIP = "percent only - needs the arm N, and the printed percent must pin a unique count (or approximate = true); enter by hand"
MEDIAN_SKIP = "median [range/IQR] - integrity analysis needs mean and SD"
BARE_SKIP = "bare number with no category header and no SD - not usable"
COUNT_SKIP = "n (%) with unknown arm N - complement category cannot be computed; edit by hand"

#: Lines below a caption that may hold numbers before the arm sizes; lines without numbers that end a table before and after its first data.
HEAD_LINES, HEAD_NUMBERS, PROSE_BEFORE, PROSE_AFTER, PROSE_WORDS, FOOT_LINES = 8, 3, 6, 3, 8, 4
#: Gap between columns, and the widest range of sizes that a printed percentage may leave.
COLUMN_GAP, LOOSE = 25.0, 400
MAX_INT, MAX_LONG = 2**31 - 1, 2**63 - 1


def java(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("\\b", "(?u:\\b)"), re.ASCII)


def says(pattern: str):
    """Whether a text holds the pattern; texts repeat, so answers are remembered."""
    search = java(pattern).search
    return functools.lru_cache(1 << 14)(lambda text: search(text) is not None)


_TOKEN = java("(?<![A-Za-z0-9_.])(?:" + "|".join(f"(?P<{name}>{p})" for name, p in TYPES) + ")(?![A-Za-z0-9])")
_NUMBER, _GROUPED, _SIGNS = java(NUM), java("^\\s*[-+]?\\d{1,3}(,\\d{3})+\\s*$"), java("[<>\u2212]")
_SPACE, _TAILS = java("\\s+"), [java(t) for t in LABEL_TAILS]
_PERCENT_TAIL = java("(?i)\\s*[,;]?\\s*\\(?\\s*(%|percent(age)?s?)\\s*\\)?\\s*$")
_SIZE_WORDS, _SIZE, _NOT_DIGIT = java("(?i)\\(?\\s*n\\s*=\\s*\\d[\\d,]*\\s*\\)?"), java(ARM_SIZE), java("\\D")
_INSIDE, _BEHIND, _SLASH = java("\\(([^()]*/[^()]*)\\)"), java("[A-Za-z]+(?:\\s*/\\s*[A-Za-z]+)+\\s*[,:]?\\s*$"), java("\\s*/\\s*")
_PART_TAIL, _MARKS = java("[\\s,:]+$"), java("[%\\s]")
_stops, _sized, _dashed = java(f"{STOP}|{CAPTION.removeprefix('(?i)')}").search, _SIZE.search, java(DASHED).search
_size_row, _p_column, _measures, _percent = says(SIZE_ROW), says(P_COLUMN), says(MEASURES), says(SAYS_PCT)
_se, _sd, _mean_sd, _count_pct, _demographic = says(SAYS_SE), says(SAYS_SD), says(SAYS_MEAN_SD), says(SAYS_COUNT_PCT), says(DEMOGRAPHIC)
_labelled_percent, _sexes = says("(?i)\\(%\\)|percent"), says("(?i)sex|gender")


def squish(x: str) -> str:
    return _SPACE.sub(" ", x).strip(" ")


@functools.lru_cache(1 << 14)
def clean_label(x: str) -> str:
    out = squish(x)
    for tail in _TAILS:
        out = tail.sub("", out)
    return squish(out)


@functools.lru_cache(1 << 16)
def number(x: str) -> tuple[float | None, int]:
    """A printed number and its decimals."""
    x = _SIGNS.sub("", x)
    if ("," in x and ("." in x or "\u00b7" in x)) or _GROUPED.search(x):
        x = x.replace(",", "")
    x = x.replace(",", ".").replace("\u00b7", ".")
    places = len(x.split(".", 1)[1]) if "." in x else 0
    try:
        return float(x), places
    except ValueError:
        return None, places


@functools.lru_cache(1 << 16)
def numbers_of(text: str) -> tuple:
    """num1, num2, dec1, dec2 of a cell."""
    found = _NUMBER.findall(text)
    (a, da), (b, db) = (number(x) for x in (found + ["", ""])[:2])
    return a, b, da, db


# A cell: type, text, num1, num2, dec1, dec2, start, x0, x1, mid
TYPE, TEXT, NUM1, NUM2, DEC1, DEC2, START, X0, X1, MID = range(10)


def span(boxes: list, start: int, end: int) -> tuple[float, float]:
    """Left of the first and right of the last box that holds characters from start to before end."""
    touched = [b for b in boxes if b[1] > start and b[0] < end]
    return touched[0][2], touched[-1][3]


def cells_in(text: str, boxes: list) -> list[tuple]:
    out = []
    for m in _TOKEN.finditer(text):
        x0, x1 = span(boxes, m.start(), m.end())
        out.append((m.lastgroup, m[0], *numbers_of(m[0]), m.start(), x0, x1, (x0 + x1) / 2))
    return out


def dash_pairs(text: str, tokens: list[tuple]) -> list[tuple]:
    """Two numbers that a dash joins, such as 40.8-12.0, as mean and SD, where two or more such pairs stand in a line."""
    def pairs(a, b) -> bool:
        if a[TYPE] != "plain" or b[TYPE] != "plain" or a[NUM1] is None or a[NUM1] < 0:
            return False
        end = a[START] + len(a[TEXT])
        return (b[START] == end and b[NUM1] is not None and b[NUM1] < 0) or (b[START] == end + 1 and text[end] in "-\u2013\u2212")

    paired = [pairs(a, b) for a, b in zip(tokens, tokens[1:])] + [False]
    if sum(paired) < 2:
        return tokens
    out = []
    for i, t in enumerate(tokens):
        if paired[i]:
            b = tokens[i + 1]
            whole = text[t[START] : b[START] + len(b[TEXT])]
            out.append(("meanSD", whole, t[NUM1], None if b[NUM1] is None else abs(b[NUM1]), t[DEC1], b[DEC1], t[START], t[X0], b[X1], (t[X0] + b[X1]) / 2))
        elif i == 0 or not paired[i - 1]:
            out.append(t)
    return out


class Line:
    """A line's number, text, boxes (start, end, x0, x1, text), cells and kind, and what its cells are read as."""

    __slots__ = ("line_no", "text", "boxes", "tokens", "kind", "cells", "main", "raw", "label")

    def __init__(self, line_no: int, xs: list, texts: list, widths: list):
        self.line_no, self.text = line_no, " ".join(texts)
        self.boxes, at = [], 0
        for x, text, width in zip(xs, texts, widths):
            end = at + len(text)
            self.boxes.append((at, end, x, x + width, text))
            at = end + 1
        self.tokens = cells_in(self.text, self.boxes)
        self.cells = self.main = self.raw = self.label = None


def classify(lines: list[Line], cap: int | None) -> tuple[str, int | None, int | None]:
    """Sets kind (pre, stop, out, header, data or label), and tokens and texts as repaired; gives foot, first_header and first_data.

    A table ends at a footnote, at the next caption, or at prose: after the first data line a line of more than 8 words
    without numbers or the third one in a row, before it the sixth. Cells of a table that announces mean - SD
    are read so. A line whose only numbers are p values is a label, and so are up to three lines of numbers above the arm sizes.
    """
    end, seen, in_a_row, stopped = None, 0, 0, False
    for line in lines:
        if cap is not None and line.line_no <= cap:
            line.kind = "pre"
        elif _stops(line.text):
            line.kind = "stop"
        elif _sized(line.text):
            line.kind = "header"
        elif line.tokens:
            line.kind, seen, in_a_row = "data", seen + 1, 0
        else:
            line.kind, in_a_row = "label", in_a_row + 1
        prose = line.kind == "label" and ((len(line.boxes) > PROSE_WORDS or in_a_row >= PROSE_AFTER) if seen else in_a_row >= PROSE_BEFORE)
        if end is None and (line.kind == "stop" or prose):
            end, stopped = line.line_no, line.kind == "stop"
    foot = " ".join(x.text for x in lines if end <= x.line_no <= end + FOOT_LINES) if stopped else ""
    dashed = any(_dashed(x.text) for x in lines)
    p_only = set()
    for line in lines:
        if end is not None and line.line_no >= end and line.kind != "pre":
            line.kind = "stop" if line.line_no == end else "out"
        if line.kind != "data":
            continue
        if dashed:
            line.tokens = dash_pairs(line.text, line.tokens)
        # a label whose only numbers are p values
        if all(t[TYPE] == "plain" and t[NUM1] is not None and abs(t[NUM1]) < 1 for t in line.tokens):
            lead = squish(line.text[: line.tokens[0][START]])
            if len(lead) >= 4:
                line.text, line.kind, line.tokens = lead, "label", []
                p_only.add(line.line_no)
    # numbers above the arm sizes
    first_header = min((x.line_no for x in lines if x.kind == "header"), default=None)
    if first_header is not None and cap is not None and first_header - cap <= HEAD_LINES:
        above = [x for x in lines if x.kind == "data" and x.line_no < first_header]
        if len(above) <= HEAD_NUMBERS:
            for line in above:
                line.kind, line.tokens = "label", []
    return foot, first_header, min((x.line_no for x in lines if x.kind == "data"), default=None)


def cluster(mids: list[float]) -> list[float]:
    """Centres of runs of middles with gaps of at most COLUMN_GAP."""
    runs, last = [], None
    for mid in sorted(mids):
        if last is None or mid - last > COLUMN_GAP:
            runs.append([])
        runs[-1].append(mid)
        last = mid
    return [sum(r) / len(r) for r in runs]


def nearest(centers: list[float], x: float) -> int:
    """Index of the nearest centre, the first of equally near ones."""
    best, least = 0, abs(centers[0] - x)
    for i in range(1, len(centers)):
        if (d := abs(centers[i] - x)) < least:
            best, least = i, d
    return best


def header_sizes(lines: list[Line], centers: list[float]) -> dict[int, int]:
    """The first size that header lines print nearest to a column."""
    out: dict[int, int] = {}
    for line in lines:
        if line.kind == "header":
            for m in _SIZE.finditer(line.text):
                x0, x1 = span(line.boxes, m.start(), m.end())
                n = whole(_NOT_DIGIT.sub("", m[0]), MAX_INT)
                if n is not None:
                    out.setdefault(nearest(centers, (x0 + x1) / 2), n)
    return out


def header_names(lines: list[Line], centers: list[float], cap: int | None, first_header: int | None, first_data: int) -> dict[int, str]:
    """The words above a column, between the first line of arm sizes, if there is one, and the data.

    A word counts if it stands nearer to a column's centre than 3 / 4 of the least distance of two centres.
    """
    reach = min(b - a for a, b in zip(centers, centers[1:])) * 0.75 if len(centers) > 1 else 100.0
    names: dict[int, list[str]] = {}
    for line in lines:
        if cap is None or line.kind not in ("header", "label") or not cap < line.line_no < first_data or (first_header is not None and line.line_no < first_header):
            continue
        own: dict[int, list[str]] = {}
        for _, _, x0, x1, text in line.boxes:
            mid = (x0 + x1) / 2
            col = nearest(centers, mid)
            if abs(centers[col] - mid) < reach:
                own.setdefault(col, []).append(text)
        for col, words in own.items():
            if text := squish(_SIZE_WORDS.sub("", " ".join(words))):
                names.setdefault(col, []).append(text)
    return {col: " ".join(x) for col, x in names.items()}


def derived_size(cells: list[tuple]) -> int | None:
    """The one size that all n (%) cells of an arm allow; None on contradiction or doubt."""
    los, his = [], []
    for t in cells:
        count, pct, half = t[NUM1], t[NUM2], 0.5 * 10.0 ** -t[DEC2]
        if count is None or pct is None or not (0 < count <= MAX_INT and 0 < pct <= 100):
            continue
        low, high = (pct - half) / 100, (pct + half) / 100
        lo, hi = int(max(math.ceil(count / high - 1e-9), count)), math.floor(count / low + 1e-9) if low > 0 else -1
        if hi < lo:
            return None
        if hi - lo < LOOSE:
            los.append(lo)
            his.append(hi)
    return max(los) if los and max(los) == min(his) else None


def count_from_pct(t: tuple, n: int | None) -> int | None:
    """The one count of n that prints as the cell's percentage."""
    pct = t[NUM1]
    if n is None or n <= 0 or pct is None or not 0 <= pct <= 100:
        return None
    half = 0.5 * 10.0 ** -t[DEC1]
    lo, hi = max(math.ceil(n * (pct - half) / 100 - 1e-9), 0), min(math.floor(n * (pct + half) / 100 + 1e-9), n)
    return lo if lo == hi else None


def main_type(cells: dict) -> str:
    """The most frequent type, the first by name of equally frequent ones."""
    votes: dict[str, int] = {}
    for t in cells.values():
        votes[t[TYPE]] = votes.get(t[TYPE], 0) + 1
    return min(votes, key=lambda k: (-votes[k], k))


class Column:
    """A column of a block, by its index; arms are those that hold no p values, numbered from 1."""

    __slots__ = ("col", "name", "header_n", "cells", "like_p", "is_p", "arm_no", "n", "source", "live")


def columns_of(lines: list[Line], centers: list[float], sizes: dict, names: dict) -> list[Column]:
    """Every column, and whether it holds p values: it says so, or more than half of its cells are numbers below 1 and it has no size."""
    out = []
    for i in range(len(centers)):
        c = Column()
        c.col, c.name, c.header_n, c.cells, c.like_p, c.n, c.source, c.live = i, names.get(i), sizes.get(i), 0, 0, None, None, False
        out.append(c)
    for line in lines:
        if line.kind != "data":
            continue
        line.cells = {}
        for t in line.tokens:
            col = nearest(centers, t[MID])
            out[col].cells += 1
            out[col].like_p += t[TYPE] in ("plain", "pctOnly") and t[NUM1] is not None and t[NUM1] < 1
            line.cells.setdefault(col, t)  # the first token counts
    for c in out:
        c.is_p = len(out) >= 2 and ((c.name is not None and _p_column(c.name)) or (c.cells > 0 and c.like_p / c.cells > 0.5 and c.header_n is None))
    return out


def size_arms(arms: list[Column], rows: list[Line], filled: dict) -> None:
    """Numbers the arms and sets n and source: sizes are the header's, or a row's.

    Where no arm with data has a size in the header, printed n (%) cells derive sizes, and what they leave open comes from `filled`
    (col: n, source), such as the text's mentions. A row of sizes overrides all.
    """
    unsized = all(a.header_n is None for a in arms if a.cells > 0)
    for k, a in enumerate(arms, 1):
        a.arm_no = k
        row_n = None
        for r in rows:
            if is_size_row(r) and a.col in r.cells:
                row_n = whole(r.cells[a.col][NUM1], MAX_INT)
        a.n = row_n if row_n is not None else a.header_n
        if a.n is None and unsized and a.cells > 0:
            counts = [r.cells[a.col] for r in rows if a.col in r.cells and r.cells[a.col][TYPE] == "nPct"]
            text_n, text_source = filled.get(a.col, (None, None))
            size = derived_size(counts)
            a.n, a.source = (text_n, text_source) if size is None else (size, f"derived from {len(counts)} printed n (%) cell(s) of this arm")


def is_size_row(row: Line) -> bool:
    return row.main == "plain" and _size_row(row.label)


class Mark:
    """What an arm's cell is read as: the count that its percentage pins (exact), or is rounded to (counted)."""

    __slots__ = ("arm", "t", "exact", "counted")

    def __init__(self, arm: Column, t: tuple, approximate: bool):
        usable, n = t[TYPE] in ("pctOnly", "plain"), arm.n
        self.arm, self.t = arm, t
        self.exact = count_from_pct(t, n) if usable else None
        self.counted = self.exact
        if self.exact is None and approximate and usable and n is not None and t[NUM1] is not None and 0 <= t[NUM1] <= 100:
            self.counted = min(max(round(n * t[NUM1] / 100), 0), n)


class Row:
    """A data line as it is read: continuous, fraction, binary, child or skip (for a reason), under its header."""

    __slots__ = ("line_no", "raw", "label", "reads", "header", "marks", "converted", "unique", "reason", "names", "category", "base", "variable")


def interpret(lines: list[Line], rows: list[Line], arms: list[Column], foot: str, first_data: int, paren: str, approximate: bool) -> list[Row]:
    """a (b) is mean (SD) or n (%) by `paren`, or else by its label, by the footnotes, and by whether the table prints plus-minus.

    Percentages become counts where every arm's size and printed percentage leave one count, or by rounding if `approximate`.
    A label line of up to six words heads the counts below it, until a row of another kind.
    """
    has_pm = any(t[TYPE] == "meanSD" for x in lines if x.kind == "data" for t in x.tokens)
    data = {r.line_no for r in rows}
    by_col = {a.col: a for a in arms}
    out, header, header_pct = [], None, False
    for line in lines:
        if line.kind == "label" and line.line_no > first_data and len(line.boxes) <= 6:
            if head := clean_label(line.text):
                header, header_pct = head, _percent(line.text)
            continue
        if line.line_no not in data or is_size_row(line):
            continue
        main = printed = line.main
        if main == "numParen":
            as_sd = not _labelled_percent(line.raw) and (_measures(line.label) or _mean_sd(foot) or (not has_pm and not _count_pct(foot)))
            printed = "meanSD" if {"sd": True, "percent": False}.get(paren, as_sd) else "nPct"
        r = Row()
        r.line_no, r.raw, r.label, r.header, r.reason, r.names = line.line_no, line.raw, line.label, header, None, None
        genre = printed == "pctOnly" or (printed == "plain" and ((header is not None and header_pct) or _percent(line.raw)))
        r.marks = [Mark(by_col[col], line.cells[col], approximate) for col in sorted(line.cells)]
        r.converted = genre and all(m.counted is not None for m in r.marks)
        r.unique = all(m.exact is not None for m in r.marks)
        if main == "medianRng":
            r.reads, r.reason = "skip", MEDIAN_SKIP
        elif genre and not r.converted:
            r.reads, r.reason = "skip", PERCENT_SKIP
        elif r.converted:
            r.reads = "binary" if header is None else "child"
        elif printed in ("meanSD", "fraction", "nPct"):
            r.reads = {"meanSD": "continuous", "fraction": "fraction", "nPct": "binary"}[printed]
        elif header is not None:
            r.reads = "child"
        else:
            r.reads, r.reason = "skip", BARE_SKIP
        if r.converted:
            r.label = clean_label(_PERCENT_TAIL.sub("", r.label))
        out.append(r)
        if printed in ("meanSD", "fraction", "nPct"):
            header, header_pct = None, False
    return out


def part_names(raw: str, label: str, n: int) -> tuple[list[str], str]:
    """Names of the n parts of a fraction, from (M/F) or a trailing A/B of its label, and the label without them."""
    listed, rest = None, label
    if m := _INSIDE.search(raw):
        listed, rest = m[1], clean_label(_INSIDE.sub("", raw))
    elif m := _BEHIND.search(raw):
        listed, rest = _PART_TAIL.sub("", m[0]), clean_label(_BEHIND.sub("", raw))
    names = None if listed is None else _SLASH.split(squish(listed))
    sexes = n == 2 and _sexes(rest)
    if names is None or len(names) != n:
        names = ["Male", "Female"] if sexes else [f"{rest} {i}" for i in range(1, n + 1)]
    if sexes:
        names = [{"M": "Male", "MALE": "Male", "F": "Female", "FEMALE": "Female"}.get(p.upper(), p) for p in names]
    return [f"{rest} {p}" if len(p) <= 3 and p not in ("Male", "Female") else p for p in names], rest


def numbered(name: str, seen: dict) -> str:
    """A name, with 2, 3 and so on where it stood before."""
    seen[name] = seen.get(name, 0) + 1
    return name if seen[name] == 1 else f"{name} {seen[name]}"


def parts_of(t: tuple) -> list[str]:
    return _SPACE.sub("", t[TEXT]).split("/")


def whole(x: float | str | None, most: int = MAX_LONG) -> int | None:
    """x without decimals; None beyond `most`."""
    if x is None or (len(x.lstrip("0")) > 19 if isinstance(x, str) else abs(x) > most):
        return None
    return int(x) if int(x) <= most else None


def variables_of(rows: list[Row], arms: list[Column], foot: str, delta: int) -> list[tuple]:
    """row_no, row, kind, arm_no, n, mean, sd, se, round_mean, round_dispersion, round_observation, categories: a line per variable and arm.

    The dispersion is an SE where the row, or else only the footnotes, say so. An n (%) row has its complement where all sizes are known.
    Names that repeat in a block are numbered.
    """
    all_n = all(a.n is not None for a in arms)
    categories, names, variables = {}, {}, {}
    for r in rows:
        if r.reads == "skip":
            continue
        if r.reads == "fraction":
            n_parts = max(len(parts_of(m.t)) if m.t[TYPE] == "fraction" else 0 for m in r.marks)
            r.names, r.label = part_names(r.raw, r.label, n_parts)
        r.base = r.label or ("Unnamed" if r.reads == "continuous" else "Category")
        if r.reads in ("binary", "child"):
            r.category = numbered(r.base, categories)
        # children of equal headers are one variable
        key = ("h", r.header) if r.reads == "child" else ("l", r.line_no)
        r.base = r.header if r.reads == "child" else r.category if r.reads == "binary" else r.base
        variables.setdefault(key, []).append(r)
    out = []
    for group in variables.values():
        first = group[0]
        row, by_arm = numbered(first.base, names), {}
        for r in group:
            for m in r.marks:
                t = m.t
                if r.reads == "continuous":
                    if t[TYPE] in ("meanSD", "numParen"):
                        se = not _sd(r.raw) and (_se(r.raw) or (_se(foot) and not _sd(foot)))
                        by_arm[m.arm.arm_no] = (m.arm.n, t[NUM1], None if se else t[NUM2], t[NUM2] if se else None, t[DEC1], t[DEC2], t[DEC1] + delta)
                elif r.reads == "fraction":
                    if t[TYPE] == "fraction":
                        by_arm.setdefault(m.arm.arm_no, []).extend((r.names[i], whole(c)) for i, c in enumerate(parts_of(t)))
                else:
                    count = m.counted if r.converted else whole(t[NUM1])
                    entries = by_arm.setdefault(m.arm.arm_no, [])
                    entries.append((r.category, count))
                    if r.reads == "binary" and all_n:
                        entries.append((f"Not {r.category}", None if count is None else m.arm.n - count))
        for arm_no, value in by_arm.items():
            arms[arm_no - 1].live = True
            if first.reads == "continuous":
                out.append((first.line_no, row, "continuous", arm_no, *value, None))
            else:
                out.append((first.line_no, row, "category", arm_no, *[None] * 7, unique_keys(value)))
    return out


def unique_keys(entries: list[tuple]) -> list[tuple]:
    """Entries of a map; one whose key stands before has its key numbered on, so that no count is lost."""
    out: dict = {}
    for k, v in entries:
        name, i = k, 2
        while name in out:
            name, i = f"{k} {i}", i + 1
        out[name] = v
    return list(out.items())


def derived_of(rows: list[Row]) -> list[tuple]:
    """line_no, label, kind (unique or approximate), note: counts that percentages gave."""
    def note(m: Mark) -> str:
        pct = _MARKS.sub("", m.t[TEXT])
        return f"{pct}% of N={m.arm.n} -> {m.counted} (uniquely pinned)" if m.exact is not None else f"APPROXIMATE: {pct}% of N={m.arm.n} -> round() = {m.counted} (not uniquely pinned)"

    return [(r.line_no, r.label, "unique" if r.unique else "approximate", "; ".join(note(m) for m in r.marks)) for r in rows if r.converted]


def skipped_of(rows: list[Row], arms: list[Column]) -> list[tuple]:
    """line_no, label, reason: what can't be used, and n (%) rows without all sizes."""
    all_n = all(a.n is not None for a in arms)
    reasons = ((r, r.reason or (COUNT_SKIP if r.reads == "binary" and not all_n else None)) for r in rows)
    return [(r.line_no, r.label, reason) for r, reason in reasons if reason]


def dispersion(foot: str) -> str:
    """What a table's footnotes say its dispersions are."""
    se, sd = _se(foot), _sd(foot)
    return "mixed (per row)" if se and sd else "se (stated)" if se else "sd (stated)" if sd else "sd (assumed - table does not say)"


def score_of(variables: list[tuple], arms: list[Column], skipped: list[tuple]) -> int | None:
    """What makes a block likely to be the baseline table, read right; None without variables.

    3 a size in the table, 2 a continuous variable, 1 a category, 2 for two arms or more, 2 a demographic name (three at most), less 2
    a skipped line (but for percentages), 1 an unnamed row, and 1 a column beyond six.
    """
    if not variables:
        return None
    cont: dict[str, bool] = {}
    for v in variables:
        cont[v[1]] = cont.get(v[1], False) or v[5] is not None
    live = [a for a in arms if a.live or a.n is not None]
    sized, numeric = sum(a.n is not None and a.source is None for a in live), sum(cont.values())
    hard = sum("unique count" not in s[2] for s in skipped)
    return (
        3 * sized + 2 * numeric + len(cont) - numeric + 2 * (len(live) >= 2) + 2 * min(sum(map(_demographic, cont)), 3) - 2 * hard
        - sum(name.startswith("Unnamed") for name in cont) - max(0, len(arms) - 6)
    )


class Block:
    """A parsed block, from its words in order of line and place; without data it has no lines."""

    def __init__(self, cap: int | None, line_no: list, x: list, text: list, width: list, filled: dict, paren: str = "auto", approximate: bool = False, delta: int = 1):
        lines, a = [], 0
        for b in range(1, len(line_no) + 1):
            if b == len(line_no) or line_no[b] != line_no[a]:
                lines.append(Line(line_no[a], x[a:b], text[a:b], width[a:b]))
                a = b
        self.foot, first_header, first_data = classify(lines, cap)
        self.lines = lines if first_data is not None else []
        if not self.lines:
            return
        self.dispersion = dispersion(self.foot)
        centers = cluster([t[MID] for x in lines if x.kind == "data" for t in x.tokens])
        columns = columns_of(lines, centers, header_sizes(lines, centers), header_names(lines, centers, cap, first_header, first_data))
        self.arms = [c for c in columns if not c.is_p]
        own, rows = {a.col for a in self.arms}, []
        for line in lines:
            if line.kind == "data":
                line.cells = {c: t for c, t in line.cells.items() if c in own}
                if line.cells:
                    line.main = main_type(line.cells)
                    line.raw = line.text[: min(t[START] for t in line.cells.values())]
                    line.label = clean_label(line.raw)
                    rows.append(line)
        size_arms(self.arms, rows, filled)
        read = interpret(lines, rows, self.arms, self.foot, first_data, paren, approximate)
        self.derived, self.skipped = derived_of(read), skipped_of(read, self.arms)
        self.variables = variables_of(read, self.arms, self.foot, delta)
        self.score = score_of(self.variables, self.arms, self.skipped)
