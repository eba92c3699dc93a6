"""The judgment scale: one code, five readings of it. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: code: (ordinal for gaps and coverage, ordinal for best match, similarity, audit percent, displayed percent)
JUDGMENTS = {
    "identical": (5, 5, 1.00, 95, 97),
    "substantially_identical": (4, 4, 0.85, 80, 92),
    "partial_difference": (3, 3, 0.55, 60, 87),
    "partial_similarity": (2, 2, 0.35, 35, 82),
    "difference": (0, 1, 0.15, 15, 70),
    "none": (0, 0, 0.00, 0, 0),
}
#: Labels of model responses to codes; white space is folded before the look-up.
JUDGMENT_LABELS = {
    "동일": "identical",
    "실질적동일": "substantially_identical",
    "일부차이": "partial_difference",
    "일부유사": "partial_similarity",
    "차이": "difference",
    "대응없음": "none",
}
COVER, FILL, IMPROVE, SOFT = 3, 3, 4, 3
UNCOVERED_PERCENT, SINGLE_SUFFICIENT_PERCENT = 35.0, 95.0
CORE_IMPORTANCE = 4
ELIGIBLE_RATIO, ELIGIBLE_MARGIN = 0.72, 0.10
SHORTLIST, SECONDARY_SHORTLIST, FORCED_SIMILARITY = 5, 4, 0.85
REUSE_TIEBREAK = 2.0
EXPLICIT_RISKS = ("contrary_teaching", "principle_change", "incompatible")


def _reading(k: int, code: Column | str) -> Column:
    """Unknown and null codes read as zero. A literal map keeps the look-up inside generated code."""
    c = F.col(code) if isinstance(code, str) else code
    out = None
    for name, values in JUDGMENTS.items():
        out = F.when(c == name, F.lit(values[k])) if out is None else out.when(c == name, F.lit(values[k]))
    return out.otherwise(F.lit(type(JUDGMENTS["none"][k])(0)))


def gap_rank(code: Column | str = "judgment") -> Column:
    return _reading(0, code)


def best_rank(code: Column | str = "judgment") -> Column:
    return _reading(1, code)


def similarity(code: Column | str = "judgment") -> Column:
    return _reading(2, code)


def displayed_percent(code: Column | str = "judgment") -> Column:
    return _reading(4, code)


def judgment_code(label: Column | str) -> Column:
    """The code of a response label with its white space folded; null where it is none."""
    folded = F.regexp_replace(F.col(label) if isinstance(label, str) else label, r"\s+", "")
    return F.create_map(*[F.lit(x) for pair in JUDGMENT_LABELS.items() for x in pair])[folded]


def settled(value: Column) -> Column:
    """Nine decimals; the nudge keeps half-way values on one side however their sums were ordered."""
    return F.round(value + 1e-11, 9)
