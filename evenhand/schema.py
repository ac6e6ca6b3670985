"""The line-table contract: one line is one variable in one arm of a trial."""

from __future__ import annotations

LINE_SCHEMA = (
    "line_no long, trial string, row string, n int, mean double, sd double, se double, q1 double, q3 double, "
    "round_mean int, round_dispersion int, round_observation int, categories map<string,long>"
)
#: Order in which name fragments claim columns; earlier ones win.
NAME_ORDER = ("TRIAL", "MEASURE", "DECM", "NUMBER", "GROUP", "ROW")
NUMERIC = ("n", "mean", "sd", "se", "q1", "q3")
STATUS = {
    "ONE_LINE": "Only 1 Row",
    "MIXED_QUARTILES": "Mixed SD and quartile lines",
    "SKEWED_QUARTILES": "Quartiles too skewed to simulate",
    "INCOMPLETE_CATEGORIES": "Incomplete category counts across arms",
    "DEGENERATE_CATEGORIES": "Degenerate category table (an arm or every remaining category is empty)",
    "NO_VALUES": "No values",
    "NOT_COMPUTABLE": "not computable (trial p of exactly 0 and 1 both present)",
}
M_STAGES, M_MAX = (1_000, 10_000), 100_000
STOP_P, CAP_P, LICENSE = 0.01, 0.9999, 1e-4
METALOG_LIMIT, UNBIAS_BELOW = 1.667, 30
