"""Scores over the judgment fact, each one grouped aggregation over a dense element-by-document matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import dims, text

CLAIM = ["case_id", "claim_number"]
PAIR = [*CLAIM, "doc_idx"]


def item_similarity(code: Column | str = "judgment") -> Column:
    """The label's similarity, lowered by missing limitations and by indirect evidence where they are listed."""
    listed = F.col("evidence_count") + F.col("missing_count")
    share = F.col("evidence_count") / listed
    directness = F.when(F.col("directness").isin("", "direct"), 1.0).when(F.col("directness") == "inferred", 0.9).otherwise(0.8)
    return F.when(listed == 0, dims.similarity(code)).otherwise(dims.similarity(code) * (0.7 + 0.3 * share) * directness)


def direct_similarity(sim: Column | str = "item_sim") -> Column:
    s = F.col(sim) if isinstance(sim, str) else sim
    return F.when(s < 0.35, 0.0).when(~F.col("has_quote"), s * 0.35).when(F.col("directness") == "absent", 0.0).when(F.col("directness") == "inferred", s * 0.65).otherwise(s)


def _one(flag: str) -> Column:
    return F.col(flag).cast("int")


def selection_factor() -> Column:
    return 0.55 + 0.25 * _one("has_quote") + 0.10 * _one("has_location") + 0.10 * _one("has_reason")


def metric_factor() -> Column:
    d = F.col("directness")
    disclosure = F.when(d == "direct", 1.0).when(d == "inferred", 0.7).otherwise(0.2)
    evidence = F.when(F.col("has_quote") | F.col("has_location"), 0.5 * _one("has_quote") + 0.5 * _one("has_location")).otherwise(0.2)
    relation = F.when((F.col("missing_count") == 0) & (d == "direct"), 0.9).when(F.col("missing_count") == 0, 0.5).otherwise(0.3)
    concrete = F.when(F.col("has_reason") & F.col("has_quote"), 1.0).when(F.col("has_reason"), 0.6).otherwise(0.3)
    raw = 0.40 * disclosure + 0.25 * evidence + 0.25 * relation + 0.10 * concrete - F.when(d == "inferred", 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def dense(cells: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Every element of every claim against every document of its case; what was not judged is none and absent.

    motivation_quote and combination_risk of cells and text of elements are read where they are given; without them
    no pair has a motivation or an explicit risk, and every element is of the generic cluster.
    """
    motivated = F.coalesce(F.col("motivation_quote").rlike(r"\S"), F.lit(False)) if "motivation_quote" in cells.columns else F.lit(False)
    risky = F.coalesce(F.lower(F.regexp_replace("combination_risk", r"^\s+|\s+$", "")).isin(*dims.EXPLICIT_RISKS), F.lit(False)) if "combination_risk" in cells.columns else F.lit(False)
    elements = elements.withColumn("cluster", text.element_cluster("text") if "text" in elements.columns else F.lit(text.GENERIC))
    read = cells.select(*PAIR, "label", "judgment", "directness", "has_quote", "has_location", "has_reason", "missing_count", "evidence_count", F.lit(False).alias("not_evaluated"), motivated.alias("motivated"), risky.alias("risky"))
    out = elements.join(documents, "case_id").join(read, [*PAIR, "label"], "left")
    blank = {"judgment": "none", "directness": "absent", "has_quote": False, "has_location": False, "has_reason": False, "missing_count": 0, "evidence_count": 0, "not_evaluated": True, "motivated": False, "risky": False}
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in blank.items()})
    out = out.withColumns({"gap_rank": dims.gap_rank(), "item_sim": item_similarity()})
    return out.withColumns({"direct_sim": direct_similarity(), "selection_factor": selection_factor(), "metric_factor": metric_factor()})


def coverage_metrics(rows: DataFrame, value: Column | None = None, threshold: float = 0.55, critical: float = 0.35, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage, evidence strength and status of every claim over its documents, which `pos` puts in order."""
    value = dims.similarity() if value is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    key = [*CLAIM, *by]
    best = F.max(F.struct(value.alias("v"), (-F.col("pos_doc")).alias("p"), (value * F.col("metric_factor")).alias("adjusted")))
    each = rows.groupBy(*key, "label", "importance").agg(best.alias("best"), F.max(F.when(F.col("pos_doc") == 0, value)).alias("primary"))
    w, v, primary = F.col("importance"), F.col("best.v"), F.coalesce(F.col("primary"), F.lit(0.0))
    sums = each.groupBy(*key).agg(
        F.sum(w).alias("total"),
        F.sum(w * primary).alias("primary"),
        F.sum(w * v).alias("combined"),
        F.sum(w * F.col("best.adjusted")).alias("evidence"),
        F.sum(F.when((F.col("best.p") != 0) & (v > primary), w).otherwise(0)).alias("complement"),
        F.count_if(v < threshold).alias("n_uncovered"),
        F.count_if((w >= dims.CORE_IMPORTANCE) & (v < critical)).alias("n_critical"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(v < threshold, F.col("label"))))).alias("uncovered_labels"),
    )
    share = {x: F.col(x) / F.col("total") for x in ("primary", "combined", "evidence", "complement")}
    both = share["combined"] + share["evidence"]
    reliability = F.when(both > 0, 2 * share["combined"] * share["evidence"] / both).otherwise(0.0)
    status = F.when(F.col("n_critical") > 0, "critical_gap").when(F.col("n_uncovered") > 0, "incomplete_coverage").when(reliability < 0.70, "evidence_review_required").otherwise("coverage_supported")
    return sums.select(
        *key,
        dims.settled(share["primary"]).alias("primary_coverage"),
        dims.settled(share["combined"]).alias("combined_coverage"),
        dims.settled(share["evidence"]).alias("evidence_strength"),
        dims.settled(reliability).alias("reliability"),
        dims.settled(share["complement"]).alias("complement_dependency"),
        status.alias("status"),
        "uncovered_labels",
        F.col("n_critical").cast("long").alias("n_critical"),
    )


def rarity_weights(rows: DataFrame) -> DataFrame:
    """Weights of elements by how many evaluated documents disclose them, with a reason code."""
    hit = F.col("has_quote") & (F.col("directness") != "absent") & (dims.similarity() >= 0.55)
    freq = rows.groupBy(*CLAIM, "label", "importance", "is_generic", "is_simple", "is_distinctive").agg(F.count_if(hit & ~F.col("not_evaluated")).alias("hits"), F.count_if(~F.col("not_evaluated")).alias("evaluated"))
    w = F.col("importance").cast("double")
    ratio = F.when(F.col("evaluated") > 0, F.col("hits") / F.col("evaluated")).otherwise(1.0)
    floor4 = F.greatest(F.lit(4.0), w)
    rare, common = (F.col("hits") > 0) & (ratio <= 0.5), ratio >= 0.70
    weight = (
        F.when(F.col("is_generic"), F.least(F.lit(2.0), F.greatest(F.lit(1.0), w * 0.5)))
        .when(F.col("is_simple"), F.least(F.lit(2.0), F.greatest(F.lit(1.0), w * 0.4)))
        .when(F.col("is_distinctive") & rare, F.least(F.lit(10.0), floor4 * 1.25))
        .when(F.col("is_distinctive") & common, F.greatest(F.lit(4.0), floor4 * 0.85))
        .when(F.col("is_distinctive"), floor4)
        .when(common, F.greatest(F.lit(1.0), w * 0.5))
        .otherwise(w)
    )
    reason = (
        F.when(F.col("is_generic"), "generic_interface")
        .when(F.col("is_simple"), "simple_component")
        .when(F.col("is_distinctive") & rare, "distinctive_rare")
        .when(F.col("is_distinctive") & common, "distinctive_common")
        .when(F.col("is_distinctive"), "distinctive")
        .when(common, "common")
        .otherwise("declared")
    )
    return freq.select(*CLAIM, "label", dims.settled(ratio).alias("disclosure_frequency"), weight.alias("weight"), reason.alias("weight_reason"))


def weighted(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
    """rows with the weight of their element; without weights it is the rows' base_weight, or importance where they have none."""
    if weights is None:
        return rows.withColumn("weight", F.col("base_weight" if "base_weight" in rows.columns else "importance").cast("double"))
    return rows.join(weights.select(*CLAIM, "label", "weight"), [*CLAIM, "label"])


def primary_scores(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """How well each document would lead: core elements first, breadth last. An element that selects by a condition (is_selection) is core."""
    rows = weighted(rows, weights)
    if "is_selection" in rows.columns:
        rows = rows.withColumn("weight", F.when(F.col("is_selection"), F.greatest(F.col("weight"), F.lit(float(dims.CORE_IMPORTANCE)))).otherwise(F.col("weight")))
    w, sim, direct = F.col("weight"), F.col("item_sim"), F.col("direct_sim")
    core = w >= dims.CORE_IMPORTANCE
    names = {
        "all_w": w, "all_sim": w * sim, "all_evidence": w * sim * F.col("selection_factor"), "all_strong": F.when(sim >= 0.85, w).otherwise(0.0),
        "direct_n": F.when(direct >= 0.55, 1).otherwise(0), "n": F.lit(1), "match": F.when(F.col("gap_rank") >= dims.FILL, 1).otherwise(0),
        "core_w": w, "core_sim": w * F.when(sim >= 0.35, sim).otherwise(0.0), "core_direct": w * direct, "core_strong": F.when(direct >= 0.55, w).otherwise(0.0), "core_gap": F.when(sim < 0.35, w).otherwise(0.0),
        "side_n": F.lit(1), "side_direct": direct, "side_hits": F.when(direct >= 0.55, 1).otherwise(0),
    }
    sums = []
    for name, value in names.items():
        sums.append(F.sum(value).alias(name))
        if name.startswith("core_"):
            sums.append(F.sum(F.when(core, value)).alias(f"c_{name}"))
        if name.startswith("side_"):
            sums.append(F.sum(F.when(~core, value)).alias(f"s_{name}"))
    g = rows.groupBy(*PAIR).agg(*sums)
    has_core, has_side = F.col("c_core_w").isNotNull(), F.col("c_core_w").isNotNull() & F.col("s_side_n").isNotNull()
    c = lambda x: F.when(has_core, F.col(f"c_{x}")).otherwise(F.col(x))
    s = lambda x: F.when(has_side, F.col(f"s_{x}")).otherwise(F.col(x))
    g = g.withColumns({
        "distinctive_direct": c("core_direct") / c("core_w"), "core_coverage": c("core_sim") / c("core_w"), "core_breadth": c("core_strong") / c("core_w"), "core_gap_weight": c("core_gap") / c("core_w"),
        "element_coverage": F.col("all_sim") / F.col("all_w"), "evidence_coverage": F.col("all_evidence") / F.col("all_w"), "strong_breadth": F.col("all_strong") / F.col("all_w"),
        "direct_breadth": F.col("direct_n") / F.col("n"), "field_alignment": F.when(s("side_hits") >= 2, s("side_direct") / s("side_n")).otherwise(0.0),
    })
    score = 0.40 * F.col("distinctive_direct") + 0.25 * F.col("core_coverage") + 0.15 * F.col("core_breadth") + 0.12 * F.col("element_coverage") + 0.08 * F.col("evidence_coverage") - 0.20 * F.col("core_gap_weight")
    out = ["distinctive_direct", "core_coverage", "core_breadth", "core_gap_weight", "element_coverage", "evidence_coverage", "strong_breadth", "direct_breadth", "field_alignment"]
    return g.select(*PAIR, dims.settled(F.greatest(F.lit(0.0), score) * 100).alias("primary_score"), *[dims.settled(F.col(x)).alias(x) for x in out], F.col("match").cast("long").alias("match_count"))


def gaps(rows: DataFrame) -> DataFrame:
    """Elements that a document leaves open (hard) or half open (soft)."""
    kind = F.when(F.col("gap_rank") < dims.COVER, "hard").when(F.col("gap_rank") == dims.SOFT, "soft")
    return rows.withColumn("gap", kind).filter("gap is not null").select(*PAIR, "label", "gap")


def _against(rows: DataFrame, weights: DataFrame | None, leads: DataFrame | None) -> DataFrame:
    """The gaps of every document, or of those that leads names, as primary, met by every other document of the case.

    Each row gets the gaps of its element, a few for each, from a window; rows are neither made nor dealt a second time.
    """
    kind = F.when(F.col("gap_rank") < dims.COVER, "hard").when(F.col("gap_rank") == dims.SOFT, "soft")
    first = F.when(kind.isNotNull(), F.struct(F.col("doc_idx").alias("primary_idx"), kind.alias("gap"), F.col("item_sim").alias("primary_sim")))
    met = weighted(rows, weights).withColumn("_open", F.collect_list(first).over(Window.partitionBy(*CLAIM, "label")))
    met = met.select(*[c for c in met.columns if c != "_open"], F.inline("_open")).filter("doc_idx <> primary_idx")
    return met if leads is None else met.join(leads.select(*CLAIM, "primary_idx"), [*CLAIM, "primary_idx"], "left_semi")


def secondary_scores(rows: DataFrame, weights: DataFrame | None = None, leads: DataFrame | None = None) -> DataFrame:
    """What every document adds to every other as primary, or to those of leads (case_id, claim_number, primary_idx): gains, fills and the reason of a combination.

    rows are dense: a pair meets at every label once.
    risky marks a document with an explicit risk at any target: it takes no part in a combination. The score falls only
    for risks at targets that it reaches.
    """
    m = _against(rows, weights, leads)
    hard = F.col("gap") == "hard"
    w = F.when(hard, F.col("weight")).otherwise(F.col("weight") * 0.65)
    gain = F.greatest(F.lit(0.0), F.col("item_sim") - F.col("primary_sim"))
    rank = F.col("gap_rank")
    filled = hard & (rank >= dims.FILL) | ~hard & (rank >= dims.IMPROVE)
    reached = dims.similarity() >= 0.35
    clusters = [*text.CLUSTERS, text.GENERIC]
    g = m.groupBy(*CLAIM, "primary_idx", "doc_idx").agg(
        F.sum(w).alias("den"),
        F.sum(w * gain).alias("gain"),
        F.sum(w * F.col("item_sim")).alias("residual"),
        F.sum(w * gain * F.col("selection_factor")).alias("evidence"),
        F.count_if(hard & (rank >= dims.FILL)).alias("hard_fill"),
        F.count_if(~hard & (rank >= dims.IMPROVE)).alias("soft_fill"),
        F.count_if((F.col("primary_sim") > 0.15) & (F.col("primary_sim") <= 0.55) & (F.col("item_sim") >= 0.85)).alias("specific_fill"),
        F.count_if(filled).alias("filled_labels"),
        F.count("*").alias("targets"),
        F.count_if(reached).alias("reached"),
        F.sum(F.when(reached, w).otherwise(0.0)).alias("reached_w"),
        *[F.sum(F.when(reached & (F.col("cluster") == c), w).otherwise(0.0)).alias(f"in_{c}") for c in clusters],
        F.sum(F.when(reached & F.col("motivated"), w).otherwise(0.0)).alias("motivated_w"),
        F.count_if(reached & F.col("risky")).alias("reached_risks"),
        F.bool_or("risky").alias("risky"),
        F.sum(F.when(hard & F.col("is_distinctive") & F.col("has_quote"), F.col("weight") * gain).otherwise(0.0)).alias("critical_gain"),
        F.sum(F.when(hard & (rank >= dims.FILL), rank * F.col("weight")).otherwise(0.0)).alias("complement_score"),
        F.sum(F.when(~hard & (rank >= dims.IMPROVE), rank * F.col("weight")).otherwise(0.0)).alias("soft_score"),
        F.sum(F.when(F.col("has_quote") & (F.col("judgment") != "none"), F.greatest(F.lit(1), rank) * F.col("weight")).otherwise(0.0)).alias("support_score"),
    )
    base = 100 * (0.60 * F.col("gain") / F.col("den") + 0.20 * F.col("residual") / F.col("den") + 0.20 * F.col("evidence") / F.col("den"))
    g = g.withColumn("base_score", base)
    penalty = F.when((F.col("targets") >= 3) & (F.col("reached") <= 1) & (F.col("base_score") > 0), F.least(F.lit(12.0), 8.0 + 0.06 * F.col("base_score"))).otherwise(0.0)
    consistency = F.when((F.col("reached") >= 2) & (F.col("reached_w") > 0), F.greatest(*[F.col(f"in_{c}") for c in clusters]) / F.col("reached_w")).otherwise(0.0)
    motivation = F.col("motivated_w") / F.col("den")
    risk = F.when(F.col("reached_risks") > 0, 40.0).otherwise(0.0)
    adjusted = F.col("base_score") + 8.0 * F.col("reached_w") / F.col("den") + 7.0 * consistency + 3.0 * motivation - penalty - risk
    reason = F.when(F.col("hard_fill") > 0, "hard").when(F.col("soft_fill") > 0, "soft").when(F.col("evidence") > 0, "support")
    return g.select(
        *CLAIM, "primary_idx", "doc_idx",
        dims.settled(F.col("base_score")).alias("base_score"), dims.settled(adjusted).alias("adjusted_score"), dims.settled(F.col("critical_gain")).alias("critical_gain"),
        F.coalesce(reason, F.lit("")).alias("reason"), *[F.col(x).cast("long").alias(x) for x in ("hard_fill", "soft_fill", "specific_fill", "filled_labels")],
        *[dims.settled(F.col(x)).alias(x) for x in ("complement_score", "soft_score", "support_score")],
        "risky",
    )


def claim_similarity(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Primary and combined percent of the selected documents (doc_idx, pos_doc; the primary is at 0)."""
    m = rows.join(selected, PAIR)
    whole = (F.col("gap_rank") >= dims.IMPROVE) & (F.col("missing_count") == 0)
    each = m.groupBy(*CLAIM, "label", "importance").agg(F.max(F.when(F.col("pos_doc") == 0, F.col("item_sim"))).alias("p"), F.max("item_sim").alias("c"), F.bool_or(whole).alias("whole"), F.max(F.when(F.col("pos_doc") == 0, F.col("gap_rank"))).alias("p_rank"), F.max("gap_rank").alias("c_rank"))
    w = F.col("importance")
    return each.groupBy(*CLAIM).agg(
        dims.settled(100 * F.sum(w * F.coalesce("p", F.lit(0.0))) / F.sum(w)).alias("primary_similarity"),
        dims.settled(100 * F.sum(w * F.col("c")) / F.sum(w)).alias("combined_similarity"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("c") * 100 <= dims.UNCOVERED_PERCENT, F.col("label"))))).alias("uncovered_labels"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(~F.col("whole"), F.col("label"))))).alias("residual_labels"),
        F.bool_and(F.col("c_rank") >= dims.FILL).alias("full_coverage"),
    )


def directly_disclosed() -> Column:
    return ~F.col("not_evaluated") & F.col("has_quote") & F.col("judgment").isin("identical", "substantially_identical") & F.col("directness").isin("", "direct") & (F.col("missing_count") == 0)


def single_document_disclosure(rows: DataFrame) -> DataFrame:
    """Whether one document alone discloses every element, and which it does not."""
    ok = directly_disclosed()
    return rows.groupBy(*PAIR).agg(F.bool_and(ok).alias("is_complete"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(~ok, F.col("label"))))).alias("missing_labels"), F.count_if(F.col("not_evaluated")).alias("n_not_evaluated"))


def novelty_screen(rows: DataFrame) -> DataFrame:
    """The complete document with the best primary score, the lower index on a tie; null where there is none."""
    best = single_document_disclosure(rows).join(primary_scores(rows), PAIR)
    pick = F.max(F.when(F.col("is_complete"), F.struct("primary_score", (-F.col("doc_idx")).alias("d"))))
    return best.groupBy(*CLAIM).agg((-pick["d"]).alias("selected_doc"), F.count_if("is_complete").alias("n_complete"))


def dependent_reuse(rows: DataFrame, families: DataFrame) -> DataFrame:
    """How far a document supports the dependents of a family (case_id, root, claim_number): near claims count more."""
    dependents = families.filter("claim_number <> root")
    order = F.row_number().over(Window.partitionBy("case_id", "root").orderBy("claim_number")) - 1
    dependents = dependents.withColumn("depth", F.greatest(F.lit(0.65), 1.0 - 0.05 * order))
    m = rows.join(dependents, CLAIM)
    w = F.col("importance") * F.col("depth")
    value = F.when(F.col("has_quote") & (F.col("directness") != "absent"), w * F.col("item_sim")).otherwise(0.0)
    return m.groupBy("case_id", "root", "doc_idx").agg(dims.settled(F.sum(value) / F.sum(w)).alias("reuse"))


def best_matches(rows: DataFrame, position: str) -> DataFrame:
    """The strongest row of every element; ties go to the document that comes first by position."""
    order = Window.partitionBy(*CLAIM, "label").orderBy(dims.best_rank().desc(), position)
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def dependent_gain(rows: DataFrame, inherited: Column, total: Column) -> DataFrame:
    """Coverage by the inherited documents, by all, and what the added ones gain."""
    value = dims.similarity()
    each = rows.groupBy(*CLAIM, "label", "importance").agg(F.max(F.when(inherited, value)).alias("i"), F.max(F.when(total, value)).alias("t"))
    w = F.col("importance")
    before, after = F.sum(w * F.coalesce("i", F.lit(0.0))) / F.sum(w), F.sum(w * F.coalesce("t", F.lit(0.0))) / F.sum(w)
    return each.groupBy(*CLAIM).agg(dims.settled(before).alias("inherited_coverage"), dims.settled(after).alias("total_coverage"), dims.settled(after - before).alias("coverage_gain"))


def gap_evidence(rows: DataFrame, primary_idx: int) -> DataFrame:
    """The primary's open elements with all other documents' quoted judgments."""
    first = rows.filter((F.col("doc_idx") == primary_idx) & (F.col("gap_rank") < dims.COVER)).select(*CLAIM, "label", F.col("judgment").alias("primary_judgment"))
    others = rows.filter(F.col("doc_idx") != primary_idx).join(first, [*CLAIM, "label"])
    quoted = F.when(F.col("has_quote"), F.concat_ws(":", "doc_idx", "judgment"))
    return others.groupBy(*CLAIM, F.lit(primary_idx).cast("long").alias("primary_idx"), "label", "primary_judgment").agg(F.concat_ws(",", F.sort_array(F.collect_list(quoted))).alias("evidence"))
