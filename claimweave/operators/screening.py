"""What to compare next and where: budgets, stages, retries, routes and search targets. Groups are single claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import dims, predicates

CLAIM = ["case_id", "claim_number"]
PAIR = [*CLAIM, "doc_idx"]

# Limits that results depend on.
SEPARATOR = "\n\n---\n\n"
RETRY_OVERLAP, RETRY_DOCUMENTS = 0.55, 5
STAGED_DOCUMENTS, STAGED_CELLS, STAGED_GENERIC = 3, 20, 2
SCREENED = 2
OPEN_TARGET, CRITICAL_TARGET = 0.55, 0.35


def document_budgets(documents: DataFrame, total: int, least: int, mixed: bool = False) -> DataFrame:
    """documents (case_id, claim_number, doc_idx, filename, n_chars) with whole and the budget of characters for each.

    Where all texts with their headers fit the total, each is given whole; in mixed mode none is. Otherwise all get the
    same share of what headers and separators leave, and `least` at any rate. Null counts and names are empty.
    """
    claim = Window.partitionBy(*CLAIM)
    header = F.length(F.concat(F.lit("[doc_index="), F.col("doc_idx").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("")), F.lit("\n")))
    n = F.count("*").over(claim)
    around = F.sum(header).over(claim) + len(SEPARATOR) * (n - 1)
    whole = (around + F.sum(F.coalesce("n_chars", F.lit(0))).over(claim) <= total) & F.lit(not mixed)
    share = F.greatest(F.lit(least).cast("long"), F.floor(F.greatest(F.lit(0), total - around) / n))
    return documents.withColumn("whole", whole).withColumn("budget", F.when(~whole, share))


def staged_claims(elements: DataFrame, documents: DataFrame, generic: Column) -> DataFrame:
    """(case_id, claim_number, staged): whether core elements are compared first and generic ones after.

    elements: one row per label; generic tells those that may wait. documents: case_id, doc_idx.
    """
    docs = documents.groupBy("case_id").agg(F.count_distinct("doc_idx").alias("n_docs"))
    e = elements.groupBy(*CLAIM).agg(F.count("*").alias("n"), F.count_if(generic).alias("n_generic")).join(docs, "case_id", "left")
    large = (F.col("n_docs") >= STAGED_DOCUMENTS) & (F.col("n") * F.col("n_docs") >= STAGED_CELLS)
    return e.select(*CLAIM, F.coalesce(large & (F.col("n_generic") < F.col("n")) & (F.col("n_generic") >= STAGED_GENERIC), F.lit(False)).alias("staged"))


def core_candidates(rows: DataFrame, core: Column, most: int = SCREENED) -> DataFrame:
    """Documents that stay after the core elements were compared: every one that may disclose them all, and the `most` best.

    rows are dense. Order: score, coverage, then the lower document. rank is the place among all documents.
    """
    factor = F.when(~F.col("has_quote") | (F.col("directness") == "absent"), 0.0).when(F.col("directness") == "inferred", 0.65).otherwise(1.0)
    sim, w = dims.similarity(), F.col("importance").cast("double")
    full = F.col("judgment").isin("identical", "substantially_identical") & F.col("has_quote") & (F.col("directness") == "direct") & (F.col("missing_count") == 0)
    each = rows.filter(core).groupBy(*PAIR).agg(
        dims.settled(F.sum(w * sim * factor) / F.sum(w)).alias("score"),
        dims.settled(F.sum(F.when((sim >= 0.55) & (factor > 0), w).otherwise(0.0)) / F.sum(w)).alias("coverage"),
        F.bool_and(full).alias("complete"),
    )
    rank = F.row_number().over(Window.partitionBy(*CLAIM).orderBy(F.desc("score"), F.desc("coverage"), "doc_idx"))
    return each.withColumn("rank", rank).filter(F.col("complete") | (F.col("rank") <= most))


def second_look(rows: DataFrame, overlaps: DataFrame, most: int = RETRY_DOCUMENTS) -> DataFrame:
    """(case_id, claim_number, doc_idx, score, labels, rank): documents whose compound elements deserve another comparison.

    rows are dense with text; an element is open unless it is disclosed without missing limitations. overlaps: PAIR,
    label, overlap (reports.concept_overlap). At most `most` documents a claim, which is the feature.
    """
    closed = F.col("judgment").isin("identical", "substantially_identical") & (F.col("missing_count") == 0)
    near = overlaps.filter(F.col("overlap") >= RETRY_OVERLAP).select(*PAIR, "label", "overlap")
    hits = rows.filter(predicates.needs_second_look("text") & ~closed).join(near, [*PAIR, "label"])
    each = hits.groupBy(*PAIR).agg(dims.settled(F.sum(F.col("overlap") * F.greatest(F.lit(1), "importance"))).alias("score"), F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("labels"))
    rank = F.row_number().over(Window.partitionBy(*CLAIM).orderBy(F.desc("score"), "doc_idx"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= most)


def retry_list(*lists: DataFrame) -> DataFrame:
    """(case_id, claim_number, doc_idx, label), once each, of lists that hold at least these columns."""
    out = lists[0].select(*PAIR, "label")
    for more in lists[1:]:
        out = out.unionByName(more.select(*PAIR, "label"))
    return out.distinct()


def comparison_routes(work: DataFrame, mode: str, staged: DataFrame, failed: DataFrame) -> DataFrame:
    """(case_id, claim_number, doc_idx, route): how every comparison that is missing is to be made.

    work: case_id, claim_number, claim_type, doc_idx, is_cached, one row for each claim and document of its case. A claim
    of which some documents are cached, one with a single document, one whose integrated answer failed (failed: case_id,
    claim_number) and every claim in mode per_doc go document by document; in mode mixed an independent claim that is
    staged goes core first; all others are integrated. Cached pairs have no route.
    """
    claim = Window.partitionBy(*CLAIM)
    df = work.join(staged.filter("staged").select(*CLAIM).withColumn("_s", F.lit(True)), CLAIM, "left")
    df = df.join(failed.select(*CLAIM).distinct().withColumn("_f", F.lit(True)), CLAIM, "left")
    df = df.withColumn("_some", F.bool_or("is_cached").over(claim)).withColumn("_n", F.count("*").over(claim))
    alone = F.col("_some") | (F.col("_n") == 1) | F.col("_f").isNotNull() | F.lit(mode == "per_doc")
    first = F.lit(mode == "mixed") & (F.col("claim_type") == "independent") & F.col("_s").isNotNull()
    route = F.when(alone, "per_document").when(first, "core_first").otherwise("integrated")
    return df.filter("not is_cached").select(*PAIR, route.alias("route"))


def search_targets(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Elements (case_id, claim_number, label, importance, reason) that new documents are to be searched for.

    What is requested (case_id, claim_number, label, in either case of letters); without a request the critical elements
    that no row discloses, without those all that none does. rows are dense, of the documents that count.
    """
    best = rows.groupBy(*CLAIM, "label", "importance").agg(F.max(dims.similarity()).alias("best"))
    wanted = requested.select(*CLAIM, F.upper(F.trim("label")).alias("_label")).filter("_label <> ''").distinct()
    asked = wanted.select(*CLAIM).distinct().withColumn("_asked", F.lit(True))
    df = best.withColumn("_label", F.upper("label")).join(wanted.withColumn("_hit", F.lit(True)), [*CLAIM, "_label"], "left").join(asked, CLAIM, "left")
    critical = (F.col("importance") >= dims.CORE_IMPORTANCE) & (F.col("best") < CRITICAL_TARGET)
    df = df.withColumn("_critical", critical).withColumn("_any", F.bool_or("_critical").over(Window.partitionBy(*CLAIM)))
    reason = F.when(F.col("_asked").isNotNull(), F.when(F.col("_hit").isNotNull(), "requested")).when(F.col("_any"), F.when(F.col("_critical"), "critical")).when(F.col("best") < OPEN_TARGET, "uncovered")
    return df.withColumn("reason", reason).filter("reason is not null").select(*CLAIM, "label", "importance", "reason")


def unselected_documents(rows: DataFrame, totals: DataFrame, independent: DataFrame) -> DataFrame:
    """What every document outside an independent claim's chain says: closest label, up to two differing ones, and a status.

    rows are dense with pos; totals: case_id, claim_number, total (array); independent: case_id, claim_number. A document
    of which nothing was judged is not_stored; one that judges nothing above none has no closest label. Ties go to the
    earlier element. Claims without a chain and cases of one document have no rows.
    """
    used = totals.filter(F.size("total") > 0).select(*CLAIM, "total")
    df = rows.join(independent.select(*CLAIM).distinct(), CLAIM, "left_semi").join(used, CLAIM).filter(~F.array_contains("total", F.col("doc_idx")))
    rank = dims.best_rank()
    similar = ~F.col("not_evaluated") & (F.col("judgment") != "none")
    differs = ~F.col("not_evaluated") & ~F.col("judgment").isin("identical", "substantially_identical")
    each = df.groupBy(*PAIR).agg(
        F.max_by("label", F.when(similar, F.struct(F.col("has_quote").alias("q"), rank.alias("r"), (-F.col("pos")).alias("p")))).alias("closest_label"),
        F.array_sort(F.collect_list(F.when(differs, F.struct(rank.alias("r"), "pos", "label")))).alias("_d"),
        F.bool_or(~F.col("not_evaluated")).alias("_stored"),
        F.bool_or(similar).alias("_similar"),
    )
    status = F.when(~F.col("_stored"), "not_stored").when(F.col("_similar"), "related").otherwise("nothing_similar")
    many = rows.groupBy("case_id").agg(F.count_distinct("doc_idx").alias("_n")).filter("_n > 1").select("case_id")
    return each.join(many, "case_id", "left_semi").select(*PAIR, status.alias("status"), F.when(F.col("_similar"), F.col("closest_label")).alias("closest_label"), F.array_join(F.slice(F.col("_d.label"), 1, 2), ",").alias("differing_labels"))
