"""The judgment fact: deduplication, completeness, and the rules that keep a label within its evidence.

A judgment row is keyed by (case_id, claim_number, doc_idx, label). Columns read here: judgment (code), directness
(direct, inferred, absent), has_quote, missing_count, and what each function names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.dims import best_rank

KEY = ["case_id", "claim_number", "doc_idx", "label"]
RISKS = ("none_explicit", "uncertain", "contrary_teaching", "principle_change", "incompatible")


def deduplicated(rows: DataFrame) -> DataFrame:
    """The best row of every key: highest ordinal, then longest quote, then first."""
    order = Window.partitionBy(*KEY).orderBy(best_rank().desc(), F.desc("quote_len"), "seq")
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def missing_cells(cells: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected keys without a judgment."""
    expected = elements.select("case_id", "claim_number", "label").join(documents.select("case_id", "doc_idx"), "case_id")
    return expected.join(cells.select(*KEY), KEY, "left_anti").select(*KEY)


def missing_work(cells: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    """(case, claim, document) triples that have no judgment at all."""
    key = KEY[:3]
    return claims.select("case_id", "claim_number").join(documents.select("case_id", "doc_idx"), "case_id").join(cells.select(*key).distinct(), key, "left_anti").select(*key)


def normalized_label(label: Column | str) -> Column:
    """P for a preamble; else a leading letter, alone or in brackets, with an optional -n; else the text in capitals."""
    raw = F.trim(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")))
    bare = F.upper(F.regexp_replace(raw, r"(?U)^[\s(\[{]+|[\s)\]}:：._-]+$", ""))
    ends = r"[\s)\]}]*(?=$|\s|[:：._-])"
    letter = rf"(?U)^[\s(\[{{]*([A-Za-z])\s*(?:-\s*(\d+))?{ends}"
    head, number = F.upper(F.regexp_extract(raw, letter, 1)), F.regexp_extract(raw, letter, 2)
    lettered = F.when(number != "", F.concat(head, F.lit("-"), number)).otherwise(head)
    preamble = bare.isin("P", "PRE", "PREAMBLE", "전제부") | raw.rlike(rf"(?iU)^[\s(\[{{]*P{ends}")
    return F.when(preamble, "P").when(head != "", lettered).otherwise(F.upper(raw))


def reconciled(rows: DataFrame, same_wording: Column) -> DataFrame:
    """partial_difference that is direct, complete, quoted and called the same in its reason is substantially_identical."""
    hit = (F.col("judgment") == "partial_difference") & (F.col("directness") == "direct") & (F.col("missing_count") == 0) & F.col("has_quote") & same_wording
    return rows.withColumn("judgment", F.when(hit, "substantially_identical").otherwise(F.col("judgment")))


def capped(rows: DataFrame, not_disclosed: Column) -> DataFrame:
    """Labels held down to what directness and missing limitations allow; judgment_before keeps what came in."""
    high = F.col("judgment").isin("identical", "substantially_identical")
    upper = high | (F.col("judgment") == "partial_difference")
    flawed = (F.col("missing_count") > 0) | not_disclosed
    several = F.col("missing_count") >= 2
    out = (
        F.when((F.col("directness") == "absent") & upper, "partial_similarity")
        .when(flawed & high & (F.col("directness") == "inferred"), "partial_difference")
        .when(flawed & high & several, "partial_similarity")
        .when(flawed & high, "partial_difference")
        .when((F.col("judgment") == "partial_difference") & several, "partial_similarity")
        .otherwise(F.col("judgment"))
    )
    code = (
        F.when(F.col("judgment") == out, "")
        .when(F.col("directness") == "absent", "evidence_absent")
        .when(several, "several_limitations_missing")
        .when(F.col("missing_count") > 0, "limitation_missing")
        .otherwise("reason_says_not_disclosed")
    )
    return rows.withColumns({"judgment_before": F.col("judgment"), "judgment": out, "adjustment": code})


def with_valid_risk(rows: DataFrame, risk: str = "combination_risk") -> DataFrame:
    """Unknown risks are uncertain."""
    return rows.withColumn(risk, F.when(F.col(risk).isin(*RISKS), F.col(risk)).otherwise("uncertain"))


def merged_by_claim(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving judgment sets replace all rows of their (case, document, claim); others stay."""
    scope = ["case_id", "doc_idx", "claim_number"]
    return existing.join(arriving.select(*scope).distinct(), scope, "left_anti").unionByName(arriving)


def compatible(rows: DataFrame, schema_version: int, mode: str) -> DataFrame:
    """Rows written under the schema version and comparison mode asked for."""
    folded = F.when(F.lower("mode").isin("hybrid", "precision"), "hybrid").when(F.lower("mode").isin("mixed", "fast", "fast_hybrid"), "mixed").otherwise("per_doc")
    return rows.filter((F.col("schema_version") == schema_version) & (folded == mode))
