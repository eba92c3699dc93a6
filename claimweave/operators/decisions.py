"""Applying outside decisions to shortlists, and what is reported of the documents in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIM = ["case_id", "claim_number"]


def validated_primary(shortlist: DataFrame, decisions: DataFrame) -> DataFrame:
    """The proposed document where it is on the claim's shortlist (doc_idx, rank), else the first of the list.

    Gives the choice, its rank, whether it differs from the first, and a reason code.
    """
    listed = shortlist.select(*CLAIM, "doc_idx", "rank")
    lists = listed.groupBy(*CLAIM).agg(F.min_by("doc_idx", "rank").alias("first"), F.map_from_entries(F.collect_list(F.struct("doc_idx", "rank"))).alias("ranks"))
    out = lists.join(decisions.select(*CLAIM, "proposed"), CLAIM, "left")
    rank = F.when(F.col("proposed").isNotNull(), F.col("ranks")[F.col("proposed")])
    choice = F.when(rank.isNotNull(), F.col("proposed")).otherwise(F.col("first"))
    code = F.when(F.col("proposed").isNull(), "no_decision").when(rank.isNull(), "outside_shortlist").when(F.col("proposed") == F.col("first"), "confirmed").otherwise("changed")
    return out.select(*CLAIM, choice.alias("primary_idx"), F.coalesce(rank, F.lit(1)).alias("rank"), (choice != F.col("first")).alias("changed"), code.alias("reason"))


def combination_basis(conflict: Column, quote_ref: Column, known_refs: Column, adjacent: Column, compatible: Column, substitutable: Column) -> Column:
    """unproven, explicit or implicit: a stated conflict beats a reference, which beats technical closeness."""
    explicit = F.coalesce(F.array_contains(known_refs, quote_ref), F.lit(False))
    return F.when(conflict, "unproven").when(explicit, "explicit").when(adjacent & compatible & substitutable, "implicit").otherwise("unproven")


def decision_gate(shortlist: DataFrame, novelty: DataFrame) -> DataFrame:
    """Which claims need a decision: two candidates or more and no document that discloses everything."""
    n = shortlist.groupBy(*CLAIM).agg(F.count("*").alias("candidates"))
    out = novelty.join(n, CLAIM, "left").na.fill(0, ["candidates"])
    gate = F.when(F.col("selected_doc").isNotNull(), "single_document").when(F.col("candidates") < 2, "no_choice").otherwise("decide")
    return out.select(*CLAIM, "candidates", gate.alias("gate"))


def used_documents(selection: DataFrame) -> DataFrame:
    """One row per document in use (primary_idx, secondary_idx), with its place, role and the basis on the first."""
    both = F.array_compact(F.array("primary_idx", "secondary_idx"))
    basis = F.when(F.col("track") == "single_document", "novelty").when(F.size(both) >= 2, "combination_of_2").otherwise("single")
    out = selection.select(*CLAIM, basis.alias("basis"), F.posexplode(both).alias("pos", "doc_idx"))
    return out.select(*CLAIM, "pos", "doc_idx", F.when(F.col("pos") == 0, "primary").otherwise("secondary").alias("role"), F.when(F.col("pos") == 0, F.col("basis")).otherwise("").alias("basis"))


def scope_violations(texts: DataFrame, text: str, allowed: str, pattern: str = r"D(\d+)") -> DataFrame:
    """texts with outside, the document numbers that the text mentions and the array `allowed` lacks."""
    named = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    return texts.withColumn("outside", F.array_sort(F.array_except(named, F.col(allowed))))


def validated_secondary(shortlist: DataFrame, decided: DataFrame) -> DataFrame:
    """The support that each claim's decision chose, if it may; else the shortlist's first.

    shortlist: case_id, claim_number, primary_idx, doc_idx, rank. decided: case_id, claim_number, proposed, says_none.
    """
    first = shortlist.groupBy(*CLAIM, "primary_idx").agg(F.min_by("doc_idx", "rank").alias("first"))
    named = first.join(decided, CLAIM, "left").join(shortlist.select(*CLAIM, "primary_idx", F.col("doc_idx").alias("proposed"), F.col("rank").alias("at")), [*CLAIM, "primary_idx", "proposed"], "left")
    none = F.coalesce("says_none", F.lit(False))
    reason = F.when(none, "none_chosen").when(F.col("proposed").isNull(), "no_decision").when(F.col("proposed") == F.col("primary_idx"), "same_as_primary").when(F.col("at").isNull(), "outside_shortlist").when(F.col("at") == 1, "confirmed").otherwise("changed")
    chosen = F.when(none, None).when(F.col("at").isNotNull(), F.col("proposed")).otherwise(F.col("first"))
    return named.select(*CLAIM, "primary_idx", chosen.alias("secondary_idx"), F.coalesce("at", F.when(~none, 1)).alias("rank"), reason.alias("reason"))


def decision_audit(shortlist: DataFrame, primary: DataFrame, score: str) -> DataFrame:
    """Rank, score margin over the first and reason codes of every primary decision (case_id, claim_number, primary_idx, rank, changed, reason)."""
    best = shortlist.groupBy(*CLAIM).agg(F.max_by(score, -F.col("rank")).alias("_first"))
    own = shortlist.select(*CLAIM, F.col("doc_idx").alias("primary_idx"), F.col(score).alias("_own"))
    df = primary.join(best, CLAIM, "left").join(own, [*CLAIM, "primary_idx"], "left")
    margin = F.round(F.col("_own") - F.col("_first"), 6)
    codes = F.array_compact(F.array(F.when(F.col("changed"), "changed"), F.when(margin < 0, "below_first"), F.when(F.col("reason") != "confirmed", F.col("reason"))))
    return df.select(*CLAIM, "primary_idx", "rank", margin.alias("margin"), F.concat_ws(",", F.array_distinct(codes)).alias("codes"))


def decision_key(stage: Column, claim: Column, judgments: Column, shortlist: Column, version: Column, model: Column) -> Column:
    """A digest under which a decision may be used again: equal inputs, whatever the order of judgments, have equal keys."""
    parts = F.struct(stage.alias("stage"), claim.alias("claim"), F.array_sort(judgments).alias("judgments"), shortlist.alias("shortlist"), version.alias("version"), model.alias("model"))
    return F.sha2(F.to_json(parts), 256)
