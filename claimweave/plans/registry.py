"""All registered queries of the evidence engine and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import dims, predicates, text
from claimweave.operators import claims as claim_ops
from claimweave.operators import chains, claim_text, decisions, evidence, judgments, patents, reports, responses, scoring, segments, selection
from claimweave.sources import fixtures as fx
from claimweave.sources import tables
from claimweave.sources.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments.deduplicated(fx.raw_judgments(spark, sf_dir))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dense(cells(spark, sf_dir), fx.elements(spark, sf_dir), fx.case_documents(spark, sf_dir))


@query(fx.ctes() + "\nSELECT case_id, claim_number, doc_idx, label, judgment, directness, quote_len, seq FROM cells")
def dedup_judgments(spark, sf_dir):
    return cells(spark, sf_dir).select(*fx.KEY, "judgment", "directness", "quote_len", "seq")


@query(fx.ctes() + "\nSELECT case_id, claim_number, doc_idx, label FROM dense WHERE not_evaluated")
def completeness_gaps(spark, sf_dir):
    return judgments.missing_cells(cells(spark, sf_dir), fx.elements(spark, sf_dir), fx.case_documents(spark, sf_dir))


@query(fx.ctes() + "\nSELECT c.case_id, c.claim_number, d.doc_idx FROM claims c JOIN docs d USING (case_id) ANTI JOIN cells x ON x.case_id = c.case_id AND x.claim_number = c.claim_number AND x.doc_idx = d.doc_idx")
def missing_work(spark, sf_dir):
    return judgments.missing_work(cells(spark, sf_dir), fx.claims(spark, sf_dir), fx.case_documents(spark, sf_dir))


@query(fx.ctes() + "\nSELECT case_id, claim_number, doc_idx, label, round(item_sim + 1e-11, 9) AS item_similarity, round(direct_sim + 1e-11, 9) AS direct_similarity, round(selection_factor + 1e-11, 9) AS selection_factor, round(metric_factor + 1e-11, 9) AS metric_factor FROM scored")
def item_similarity(spark, sf_dir):
    return dense(spark, sf_dir).select(*fx.KEY, dims.settled(F.col("item_sim")).alias("item_similarity"), dims.settled(F.col("direct_sim")).alias("direct_similarity"), dims.settled(F.col("selection_factor")).alias("selection_factor"), dims.settled(F.col("metric_factor")).alias("metric_factor"))


COVERAGE = """each AS (SELECT case_id, claim_number, label, importance, max(base_sim) AS v, arg_max(doc_idx, (base_sim, -doc_idx)) AS best_doc,
  arg_max(base_sim * metric_factor, (base_sim, -doc_idx)) AS adjusted, coalesce(max(base_sim) FILTER (doc_idx = 0), 0.0) AS p FROM scored GROUP BY ALL),
sums AS (SELECT case_id, claim_number, sum(importance)::DOUBLE AS t, sum(importance * p) AS p, sum(importance * v) AS c, sum(importance * adjusted) AS e,
  coalesce(sum(importance) FILTER (best_doc <> 0 AND v > p), 0) AS d, count(*) FILTER (v < 0.55) AS n_uncovered, count(*) FILTER (importance >= 4 AND v < 0.35) AS n_critical,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (v < 0.55), '') AS uncovered_labels FROM each GROUP BY ALL),
shares AS (SELECT *, CASE WHEN c + e > 0 THEN 2 * (c / t) * (e / t) / (c / t + e / t) ELSE 0.0 END AS r FROM sums)"""


@query(fx.ctes(COVERAGE) + """
SELECT case_id, claim_number, round(p / t + 1e-11, 9) AS primary_coverage, round(c / t + 1e-11, 9) AS combined_coverage, round(e / t + 1e-11, 9) AS evidence_strength, round(r + 1e-11, 9) AS reliability, round(d / t + 1e-11, 9) AS complement_dependency,
  CASE WHEN n_critical > 0 THEN 'critical_gap' WHEN n_uncovered > 0 THEN 'incomplete_coverage' WHEN r < 0.70 THEN 'evidence_review_required' ELSE 'coverage_supported' END AS status, uncovered_labels, n_critical FROM shares""")
def coverage_metrics(spark, sf_dir):
    return scoring.coverage_metrics(dense(spark, sf_dir).withColumn("pos_doc", F.col("doc_idx")))


@query(fx.ctes("""each AS (SELECT case_id, claim_number, label, importance, max(base_sim) FILTER (doc_idx <= 1) AS inherited, max(base_sim) FILTER (doc_idx <= 2) AS total FROM scored GROUP BY ALL)""") + """
SELECT case_id, claim_number, round(sum(importance * inherited) / sum(importance) + 1e-11, 9) AS inherited_coverage, round(sum(importance * total) / sum(importance) + 1e-11, 9) AS total_coverage,
  round(sum(importance * total) / sum(importance) - sum(importance * inherited) / sum(importance) + 1e-11, 9) AS coverage_gain FROM each JOIN claims USING (case_id, claim_number) WHERE claim_type = 'dependent' GROUP BY ALL""")
def dependent_gain(spark, sf_dir):
    """Coverage of dependents by documents 0 and 1, which they inherit, and with 2, which is added."""
    dependents = fx.claims(spark, sf_dir).filter("claim_type = 'dependent'").select("case_id", "claim_number")
    rows = dense(spark, sf_dir).join(dependents, ["case_id", "claim_number"], "left_semi")
    return scoring.dependent_gain(rows, F.col("doc_idx") <= 1, F.col("doc_idx") <= 2)


@query(fx.ctes() + """
SELECT case_id, claim_number, label, doc_idx, judgment FROM (SELECT *, row_number() OVER (PARTITION BY case_id, claim_number, label ORDER BY CASE judgment WHEN 'difference' THEN 1 ELSE gap_rank END DESC, doc_idx) AS rn FROM scored) WHERE rn = 1""")
def best_match(spark, sf_dir):
    return scoring.best_matches(dense(spark, sf_dir), "doc_idx").select("case_id", "claim_number", "label", "doc_idx", "judgment")


WEIGHTS = """freq AS (SELECT case_id, claim_number, label, importance::DOUBLE AS w, is_generic, is_simple, is_distinctive,
  count(*) FILTER (has_quote AND directness <> 'absent' AND base_sim >= 0.55 AND NOT not_evaluated) AS hits, count(*) FILTER (NOT not_evaluated) AS n FROM scored GROUP BY ALL),
ratio AS (SELECT *, CASE WHEN n > 0 THEN hits / n ELSE 1.0 END AS r FROM freq),
weights AS (SELECT *, CASE WHEN is_generic THEN least(2.0::DOUBLE, greatest(1.0::DOUBLE, w * 0.5)) WHEN is_simple THEN least(2.0::DOUBLE, greatest(1.0::DOUBLE, w * 0.4))
  WHEN is_distinctive AND hits > 0 AND r <= 0.5 THEN least(10.0::DOUBLE, greatest(4.0::DOUBLE, w) * 1.25) WHEN is_distinctive AND r >= 0.7 THEN greatest(4.0::DOUBLE, greatest(4.0::DOUBLE, w) * 0.85)
  WHEN is_distinctive THEN greatest(4.0::DOUBLE, w) WHEN r >= 0.7 THEN greatest(1.0::DOUBLE, w * 0.5) ELSE w END AS weight,
  CASE WHEN is_generic THEN 'generic_interface' WHEN is_simple THEN 'simple_component' WHEN is_distinctive AND hits > 0 AND r <= 0.5 THEN 'distinctive_rare' WHEN is_distinctive AND r >= 0.7 THEN 'distinctive_common'
  WHEN is_distinctive THEN 'distinctive' WHEN r >= 0.7 THEN 'common' ELSE 'declared' END AS weight_reason FROM ratio)"""


@query(fx.ctes(WEIGHTS) + "\nSELECT case_id, claim_number, label, round(r + 1e-11, 9) AS disclosure_frequency, weight, weight_reason FROM weights")
def rarity_weights(spark, sf_dir):
    return scoring.rarity_weights(dense(spark, sf_dir))


PRIMARY = """g AS (SELECT s.case_id, s.claim_number, s.doc_idx, sum(w) AS w, sum(w * item_sim) AS a, sum(w * item_sim * selection_factor) AS ev, sum(w) FILTER (item_sim >= 0.85) AS strong,
  count(*) AS n, count(*) FILTER (direct_sim >= 0.55) AS nd, count(*) FILTER (gap_rank >= 3) AS match_count, count(*) FILTER (w >= 4) AS nc,
  sum(w) FILTER (w >= 4) AS cw, sum(w * CASE WHEN item_sim >= 0.35 THEN item_sim ELSE 0 END) FILTER (w >= 4) AS cs, sum(w * direct_sim) FILTER (w >= 4) AS cd, sum(w) FILTER (w >= 4 AND direct_sim >= 0.55) AS cb, sum(w) FILTER (w >= 4 AND item_sim < 0.35) AS cg,
  sum(w * CASE WHEN item_sim >= 0.35 THEN item_sim ELSE 0 END) AS s_, sum(w * direct_sim) AS d_, sum(w) FILTER (direct_sim >= 0.55) AS b_, sum(w) FILTER (item_sim < 0.35) AS g_,
  avg(direct_sim) AS fa_all, avg(direct_sim) FILTER (w < 4) AS fa_side, count(*) FILTER (w < 4 AND direct_sim >= 0.55) AS hits_side
  FROM (SELECT *, importance::DOUBLE AS w FROM scored) s GROUP BY ALL),
p AS (SELECT *, CASE WHEN nc > 0 THEN cd / cw ELSE d_ / w END AS distinctive_direct, CASE WHEN nc > 0 THEN cs / cw ELSE s_ / w END AS core_coverage,
  CASE WHEN nc > 0 THEN coalesce(cb, 0) / cw ELSE coalesce(b_, 0) / w END AS core_breadth, CASE WHEN nc > 0 THEN coalesce(cg, 0) / cw ELSE coalesce(g_, 0) / w END AS core_gap_weight,
  a / w AS element_coverage, ev / w AS evidence_coverage, coalesce(strong, 0) / w AS strong_breadth, nd / n AS direct_breadth,
  CASE WHEN nc > 0 AND nc < n THEN CASE WHEN hits_side >= 2 THEN fa_side ELSE 0 END ELSE CASE WHEN nd >= 2 THEN fa_all ELSE 0 END END AS field_alignment FROM g)"""


@query(fx.ctes(PRIMARY) + """
SELECT case_id, claim_number, doc_idx, round(greatest(0.0::DOUBLE, 0.40 * distinctive_direct + 0.25 * core_coverage + 0.15 * core_breadth + 0.12 * element_coverage + 0.08 * evidence_coverage - 0.20 * core_gap_weight) * 100 + 1e-11, 9) AS primary_score,
  round(distinctive_direct + 1e-11, 9) AS distinctive_direct, round(core_coverage + 1e-11, 9) AS core_coverage, round(core_breadth + 1e-11, 9) AS core_breadth, round(core_gap_weight + 1e-11, 9) AS core_gap_weight, round(element_coverage + 1e-11, 9) AS element_coverage,
  round(evidence_coverage + 1e-11, 9) AS evidence_coverage, round(strong_breadth + 1e-11, 9) AS strong_breadth, round(direct_breadth + 1e-11, 9) AS direct_breadth, round(field_alignment + 1e-11, 9) AS field_alignment, match_count FROM p""")
def primary_score(spark, sf_dir):
    return scoring.primary_scores(dense(spark, sf_dir))


@query(fx.ctes() + "\nSELECT case_id, claim_number, doc_idx, label, CASE WHEN gap_rank < 3 THEN 'hard' ELSE 'soft' END AS gap FROM scored WHERE gap_rank <= 3")
def hard_soft_gaps(spark, sf_dir):
    return scoring.gaps(dense(spark, sf_dir))


SECONDARY = """m AS (SELECT c.*, p.doc_idx AS primary_idx, p.item_sim AS psim, p.gap_rank < 3 AS hard, c.importance::DOUBLE * CASE WHEN p.gap_rank < 3 THEN 1 ELSE 0.65 END AS w, c.importance::DOUBLE AS w0,
  greatest(0.0::DOUBLE, c.item_sim - p.item_sim) AS gain FROM scored c JOIN scored p USING (case_id, claim_number, label) WHERE c.doc_idx <> p.doc_idx AND p.gap_rank <= 3),
q AS (SELECT case_id, claim_number, primary_idx, doc_idx, sum(w) AS den, 100 * (0.60 * sum(w * gain) / sum(w) + 0.20 * sum(w * item_sim) / sum(w) + 0.20 * sum(w * gain * selection_factor) / sum(w)) AS base, sum(w * gain * selection_factor) AS ev,
  count(*) FILTER (hard AND gap_rank >= 3) AS hard_fill, count(*) FILTER (NOT hard AND gap_rank >= 4) AS soft_fill, count(*) FILTER (psim > 0.15 AND psim <= 0.55 AND item_sim >= 0.85) AS specific_fill,
  count(DISTINCT label) FILTER ((hard AND gap_rank >= 3) OR (NOT hard AND gap_rank >= 4)) AS filled_labels, count(*) AS targets, count(*) FILTER (base_sim >= 0.35) AS reached, coalesce(sum(w) FILTER (base_sim >= 0.35), 0) AS rw,
  coalesce(sum(w0 * gain) FILTER (hard AND is_distinctive AND has_quote), 0) AS cg, coalesce(sum(gap_rank * w0) FILTER (hard AND gap_rank >= 3), 0)::DOUBLE AS complement_score, coalesce(sum(gap_rank * w0) FILTER (NOT hard AND gap_rank >= 4), 0)::DOUBLE AS soft_score,
  coalesce(sum(greatest(1, gap_rank) * w0) FILTER (has_quote AND judgment <> 'none'), 0)::DOUBLE AS support_score FROM m GROUP BY ALL)"""


@query(fx.ctes(SECONDARY) + """
SELECT case_id, claim_number, primary_idx, doc_idx, round(base + 1e-11, 9) AS base_score, round(base + 8 * rw / den + CASE WHEN reached >= 2 THEN 7 ELSE 0 END - CASE WHEN targets >= 3 AND reached <= 1 AND base > 0 THEN least(12.0::DOUBLE, 8 + 0.06 * base) ELSE 0 END + 1e-11, 9) AS adjusted_score,
  round(cg + 1e-11, 9) AS critical_gain, CASE WHEN hard_fill > 0 THEN 'hard' WHEN soft_fill > 0 THEN 'soft' WHEN ev > 0 THEN 'support' ELSE '' END AS reason, hard_fill, soft_fill, specific_fill, filled_labels, round(complement_score + 1e-11, 9) AS complement_score, round(soft_score + 1e-11, 9) AS soft_score, round(support_score + 1e-11, 9) AS support_score FROM q""")
def secondary_score(spark, sf_dir):
    return scoring.secondary_scores(dense(spark, sf_dir)).drop("risky")


@query(fx.ctes("""each AS (SELECT case_id, claim_number, label, importance, max(item_sim) FILTER (doc_idx = 0) AS p, max(item_sim) AS c, bool_or(gap_rank >= 4 AND missing_count = 0) AS whole, max(gap_rank) AS r FROM scored WHERE doc_idx <= 1 GROUP BY ALL)""") + """
SELECT case_id, claim_number, round(100 * sum(importance * p) / sum(importance) + 1e-11, 9) AS primary_similarity, round(100 * sum(importance * c) / sum(importance) + 1e-11, 9) AS combined_similarity,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (c * 100 <= 35), '') AS uncovered_labels, coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT whole), '') AS residual_labels, bool_and(r >= 3) AS full_coverage FROM each GROUP BY ALL""")
def claim_similarity(spark, sf_dir):
    """Documents 0 and 1 selected, 0 as primary."""
    chosen = fx.case_documents(spark, sf_dir).filter("doc_idx <= 1").join(fx.claims(spark, sf_dir).select("case_id", "claim_number"), "case_id")
    return scoring.claim_similarity(dense(spark, sf_dir), chosen.withColumn("pos_doc", F.col("doc_idx")))


DISCLOSURE = """disclosure AS (SELECT case_id, claim_number, doc_idx, bool_and(NOT not_evaluated AND has_quote AND gap_rank >= 4 AND directness = 'direct' AND missing_count = 0) AS is_complete,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT (NOT not_evaluated AND has_quote AND gap_rank >= 4 AND directness = 'direct' AND missing_count = 0)), '') AS missing_labels, count(*) FILTER (not_evaluated) AS n_not_evaluated FROM scored GROUP BY ALL)"""


@query(fx.ctes(DISCLOSURE) + "\nSELECT * FROM disclosure")
def single_document_disclosure(spark, sf_dir):
    return scoring.single_document_disclosure(dense(spark, sf_dir))


@query(fx.ctes(DISCLOSURE, PRIMARY, "ps AS (SELECT *, round(greatest(0.0::DOUBLE, 0.40 * distinctive_direct + 0.25 * core_coverage + 0.15 * core_breadth + 0.12 * element_coverage + 0.08 * evidence_coverage - 0.20 * core_gap_weight) * 100 + 1e-11, 9) AS primary_score FROM p)") + """
SELECT case_id, claim_number, arg_max(doc_idx, (primary_score, -doc_idx)) FILTER (is_complete) AS selected_doc, count(*) FILTER (is_complete) AS n_complete FROM disclosure JOIN ps USING (case_id, claim_number, doc_idx) GROUP BY ALL""")
def novelty_screen(spark, sf_dir):
    return scoring.novelty_screen(dense(spark, sf_dir))


ROOTS = """up AS (SELECT case_id, claim_number, claim_number AS at, claim_type, parent_claim FROM claims
  UNION ALL SELECT u.case_id, u.claim_number, c.claim_number, c.claim_type, c.parent_claim FROM up u JOIN claims c ON c.case_id = u.case_id AND c.claim_number = u.parent_claim WHERE u.claim_type = 'dependent'),
roots AS (SELECT c.case_id, c.claim_number, r.at AS root FROM claims c LEFT JOIN (SELECT * FROM up WHERE claim_type = 'independent') r USING (case_id, claim_number))"""


@query(fx.ctes(ROOTS) + "\nSELECT * FROM roots")
def family_root(spark, sf_dir):
    return claim_ops.family_roots(fx.claims(spark, sf_dir))


@query(fx.ctes("""up AS (SELECT c.case_id, c.claim_number, p.claim_number AS ancestor, p.parent_claim, 1 AS depth FROM claims c JOIN claims p ON p.case_id = c.case_id AND p.claim_number = c.parent_claim
  UNION ALL SELECT u.case_id, u.claim_number, p.claim_number, p.parent_claim, u.depth + 1 FROM up u JOIN claims p ON p.case_id = u.case_id AND p.claim_number = u.parent_claim)""") + "\nSELECT case_id, claim_number, ancestor, depth FROM up")
def ancestors(spark, sf_dir):
    return claim_ops.ancestors(fx.claims(spark, sf_dir))


@query(fx.ctes("""hit AS (SELECT case_id, claim_number FROM claims WHERE claim_number = 2),
down AS (SELECT * FROM hit UNION SELECT c.case_id, c.claim_number FROM down d JOIN claims c ON c.case_id = d.case_id AND c.parent_claim = d.claim_number)""") + "\nSELECT * FROM down")
def descendant_invalidation(spark, sf_dir):
    """What falls when claim 2 of every case changes."""
    claims = fx.claims(spark, sf_dir)
    return claim_ops.descendants(claims, claims.filter("claim_number = 2"))


@query(fx.ctes(ROOTS, """fam AS (SELECT *, greatest(0.65::DOUBLE, 1 - 0.05::DOUBLE * (row_number() OVER (PARTITION BY case_id, root ORDER BY claim_number) - 1)) AS depth FROM roots WHERE claim_number <> root)""") + """
SELECT case_id, root, doc_idx, round(sum(importance * depth * CASE WHEN has_quote AND directness <> 'absent' THEN item_sim ELSE 0 END) / sum(importance * depth) + 1e-11, 9) AS reuse FROM scored JOIN fam USING (case_id, claim_number) GROUP BY ALL""")
def dependent_reuse(spark, sf_dir):
    return scoring.dependent_reuse(dense(spark, sf_dir), claim_ops.family_roots(fx.claims(spark, sf_dir)))


ELIGIBLE = PRIMARY + """,
core AS (SELECT case_id, claim_number, doc_idx, string_agg(label, ',' ORDER BY label) AS core_labels FROM scored WHERE is_distinctive AND has_quote AND directness <> 'absent' AND item_sim >= 0.85 GROUP BY ALL),
elig AS (SELECT case_id, claim_number, doc_idx, round(distinctive_direct + 1e-11, 9) AS distinctive_direct, round(core_coverage + 1e-11, 9) AS core_coverage, round(greatest(0.0::DOUBLE, 0.40 * distinctive_direct + 0.25 * core_coverage + 0.15 * core_breadth + 0.12 * element_coverage + 0.08 * evidence_coverage - 0.20 * core_gap_weight) * 100 + 1e-11, 9) AS primary_score,
  coalesce(core_labels, '') AS core_labels, max(round(distinctive_direct + 1e-11, 9)) OVER (PARTITION BY case_id, claim_number) AS best FROM p LEFT JOIN core USING (case_id, claim_number, doc_idx)),
eligible AS (SELECT *, best <= 0 OR distinctive_direct >= best * 0.72::DOUBLE OR distinctive_direct >= best - 0.10::DOUBLE OR core_labels <> '' AS eligible FROM elig)"""


@query(fx.ctes(ELIGIBLE) + "\nSELECT case_id, claim_number, doc_idx, core_labels, eligible FROM eligible")
def eligible_primary(spark, sf_dir):
    rows = dense(spark, sf_dir)
    out = selection.eligible_primaries(scoring.primary_scores(rows), selection.core_disclosers(rows))
    return out.select("case_id", "claim_number", "doc_idx", F.coalesce("core_labels", F.lit("")).alias("core_labels"), "eligible")


@query(fx.ctes(ELIGIBLE) + """
SELECT case_id, claim_number, doc_idx, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, claim_number ORDER BY distinctive_direct DESC, core_coverage DESC, primary_score DESC, doc_idx) AS INTEGER) AS rank FROM eligible WHERE eligible) WHERE rank <= 5""")
def primary_shortlist(spark, sf_dir):
    rows = dense(spark, sf_dir)
    return selection.primary_shortlist(selection.eligible_primaries(scoring.primary_scores(rows), selection.core_disclosers(rows))).select("case_id", "claim_number", "doc_idx", "rank")


@query(fx.ctes(SECONDARY, """sc AS (SELECT *, round(base + 8 * rw / den + CASE WHEN reached >= 2 THEN 7 ELSE 0 END - CASE WHEN targets >= 3 AND reached <= 1 AND base > 0 THEN least(12.0::DOUBLE, 8 + 0.06 * base) ELSE 0 END + 1e-11, 9) AS adjusted_score, round(cg + 1e-11, 9) AS critical_gain FROM q WHERE hard_fill > 0 OR soft_fill > 0 OR ev > 0)""") + """
SELECT case_id, claim_number, primary_idx, doc_idx, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, claim_number, primary_idx ORDER BY critical_gain DESC, adjusted_score DESC, doc_idx) AS INTEGER) AS rank FROM sc WHERE adjusted_score > 0) WHERE rank <= 4""")
def secondary_shortlist(spark, sf_dir):
    return selection.secondary_shortlist(scoring.secondary_scores(dense(spark, sf_dir))).select("case_id", "claim_number", "primary_idx", "doc_idx", "rank")


def _renamed(ctes: str, **names: str) -> str:
    """Table expressions under other names, so that both forms can stand in one query."""
    for old, fresh in names.items():
        ctes = re.sub(rf"(?<![\w.]){old} AS \(", f"{fresh} AS (", ctes)
        ctes = re.sub(rf"FROM {old}(?!\w)", f"FROM {fresh}", ctes)
    return ctes


#: The flagship's oracle: the same scores under rarity weights, the best support of every eligible primary, and the best pair.
WEIGHTED_PRIMARY = _renamed(PRIMARY, g="gw", p="pw").replace("SELECT *, importance::DOUBLE AS w FROM scored", "SELECT scored.*, weight AS w FROM scored JOIN weights USING (case_id, claim_number, label)")
WEIGHTED_SECONDARY = _renamed(SECONDARY, m="mw", q="qw").replace("c.importance::DOUBLE", "wt.weight").replace("JOIN scored p USING (case_id, claim_number, label)", "JOIN scored p USING (case_id, claim_number, label) JOIN (SELECT case_id, claim_number, label, weight FROM weights) wt USING (case_id, claim_number, label)")
FAMILY = """fam AS (SELECT *, greatest(0.65::DOUBLE, 1 - 0.05::DOUBLE * (row_number() OVER (PARTITION BY case_id, root ORDER BY claim_number) - 1)) AS depth FROM roots WHERE claim_number <> root),
reuse AS (SELECT case_id, root AS claim_number, doc_idx, round(sum(importance * depth * CASE WHEN has_quote AND directness <> 'absent' THEN item_sim ELSE 0 END) / sum(importance * depth) + 1e-11, 9) AS reuse FROM scored JOIN fam USING (case_id, claim_number) GROUP BY ALL),
corew AS (SELECT DISTINCT case_id, claim_number, doc_idx, true AS core FROM scored WHERE is_distinctive AND has_quote AND directness <> 'absent' AND item_sim >= 0.85),
eligw AS (SELECT case_id, claim_number, doc_idx, coalesce(core, false) AS core, round(distinctive_direct + 1e-11, 9) AS dd, round(core_coverage + 1e-11, 9) AS cc, round(core_breadth + 1e-11, 9) AS cb, round(field_alignment + 1e-11, 9) AS fa, round(element_coverage + 1e-11, 9) AS ec, round(direct_breadth + 1e-11, 9) AS db,
  round(greatest(0.0::DOUBLE, 0.40 * distinctive_direct + 0.25 * core_coverage + 0.15 * core_breadth + 0.12 * element_coverage + 0.08 * evidence_coverage - 0.20 * core_gap_weight) * 100 + 1e-11, 9) AS ps,
  max(round(distinctive_direct + 1e-11, 9)) OVER (PARTITION BY case_id, claim_number) AS best FROM pw LEFT JOIN corew USING (case_id, claim_number, doc_idx)),
lead AS (SELECT *, max(dd) OVER (PARTITION BY case_id, claim_number) AS top FROM eligw WHERE best <= 0 OR dd >= best * 0.72::DOUBLE OR dd >= best - 0.10::DOUBLE OR core),
supports AS (SELECT s.case_id, s.claim_number, primary_idx, s.doc_idx, round(cg + 1e-11, 9) AS cg9, hard_fill, coalesce(reuse, 0.0) AS reuse,
  round(base + 8 * rw / den + CASE WHEN reached >= 2 THEN 7 ELSE 0 END - CASE WHEN targets >= 3 AND reached <= 1 AND base > 0 THEN least(12.0::DOUBLE, 8 + 0.06 * base) ELSE 0 END + 1e-11, 9) AS adj
  FROM qw s LEFT JOIN reuse USING (case_id, claim_number, doc_idx) WHERE hard_fill > 0 OR soft_fill > 0 OR ev > 0),
bests AS (SELECT case_id, claim_number, primary_idx AS doc_idx, arg_max(struct_pack(d := doc_idx, s := adj + least(2.0::DOUBLE, reuse * 2), h := hard_fill > 0), (cg9, adj + least(2.0::DOUBLE, reuse * 2), -doc_idx)) AS b FROM supports WHERE adj > 0 GROUP BY ALL),
chosen AS (SELECT l.*, b.d AS second, coalesce(b.s, 0.0) AS score2, coalesce(b.h, false) AS fills, coalesce(r.reuse, 0.0) AS reuse FROM lead l LEFT JOIN bests USING (case_id, claim_number, doc_idx) LEFT JOIN reuse r USING (case_id, claim_number, doc_idx)),
both_ AS (SELECT case_id, claim_number, doc_idx AS primary_idx, doc_idx FROM chosen UNION ALL SELECT case_id, claim_number, doc_idx, second FROM chosen WHERE second IS NOT NULL),
eachw AS (SELECT s.case_id, s.claim_number, primary_idx, label, any_value(importance) AS importance, any_value(weight) AS weight, max(item_sim) AS c FROM scored s JOIN both_ USING (case_id, claim_number, doc_idx) JOIN (SELECT case_id, claim_number, label, weight FROM weights) USING (case_id, claim_number, label) GROUP BY s.case_id, s.claim_number, primary_idx, label),
joint AS (SELECT case_id, claim_number, primary_idx AS doc_idx, count(*) FILTER (c * 100 <= 35 AND weight >= 4) AS critical_open, coalesce(sum(weight) FILTER (c * 100 <= 35), 0.0) AS open_weight, 100 * sum(importance * c) / sum(importance) AS combined FROM eachw GROUP BY ALL),
picked AS (SELECT case_id, claim_number, arg_max(struct_pack(p := doc_idx, s := second), (-critical_open, -round(open_weight + 1e-9, 6), round(CASE WHEN top < 0.35 THEN fa ELSE 0.0 END + 1e-9, 6), round(combined + 1e-9, 6), dd, cc, fills, cb, ec, db, round(ps + least(2.0::DOUBLE, reuse * 2) + 1e-9, 6), round(score2 + 1e-9, 6), -doc_idx)) AS b FROM chosen JOIN joint USING (case_id, claim_number, doc_idx) GROUP BY ALL),
ps AS (SELECT *, round(greatest(0.0::DOUBLE, 0.40 * distinctive_direct + 0.25 * core_coverage + 0.15 * core_breadth + 0.12 * element_coverage + 0.08 * evidence_coverage - 0.20 * core_gap_weight) * 100 + 1e-11, 9) AS primary_score FROM p),
novel AS (SELECT case_id, claim_number, arg_max(doc_idx, (primary_score, -doc_idx)) FILTER (is_complete) AS alone FROM disclosure JOIN ps USING (case_id, claim_number, doc_idx) GROUP BY ALL),
families AS (SELECT case_id, claim_number, coalesce(alone, b.p) AS primary_idx, CASE WHEN alone IS NULL THEN b.s END AS secondary_idx, CASE WHEN alone IS NOT NULL THEN 'single_document' WHEN b.s IS NULL THEN 'single_best' ELSE 'combination' END AS track
  FROM picked JOIN novel USING (case_id, claim_number) JOIN claims USING (case_id, claim_number) WHERE claim_type = 'independent')"""
FAMILY_CTES = fx.ctes(ROOTS, DISCLOSURE, PRIMARY, WEIGHTS, WEIGHTED_PRIMARY, WEIGHTED_SECONDARY, FAMILY)


@query(FAMILY_CTES + "\nSELECT * FROM families")
def family_selection(spark, sf_dir):
    """The best pair of documents for every independent claim: the flagship."""
    rows = stored(dense(spark, sf_dir))  # read by every score below
    claims = fx.claims(spark, sf_dir)
    roots = claims.filter("claim_type = 'independent'").select("case_id", "claim_number")
    reuse = scoring.dependent_reuse(rows, claim_ops.family_roots(claims))
    return selection.selected_pairs(rows.join(roots, ["case_id", "claim_number"], "left_semi"), reuse).drop("secondary_reason")


@query(fx.ctes() + """
SELECT case_id, claim_number, primary_idx, label, primary_judgment, coalesce(string_agg(doc_idx || ':' || judgment, ',' ORDER BY doc_idx) FILTER (has_quote), '') AS evidence
FROM (SELECT s.*, p.doc_idx AS primary_idx, p.judgment AS primary_judgment FROM scored s JOIN scored p USING (case_id, claim_number, label) WHERE p.doc_idx = 0 AND p.gap_rank < 3 AND s.doc_idx <> 0) GROUP BY ALL""")
def gap_matrix(spark, sf_dir):
    """Document 0 as primary: its open elements and the other documents' quoted evidence."""
    return scoring.gap_evidence(dense(spark, sf_dir), 0)


@query(fx.ctes("""cap AS (SELECT *, CASE WHEN directness = 'absent' AND judgment IN ('identical', 'substantially_identical', 'partial_difference') THEN 'partial_similarity'
  WHEN missing_count > 0 AND judgment IN ('identical', 'substantially_identical') AND directness = 'inferred' THEN 'partial_difference' WHEN missing_count >= 2 AND judgment IN ('identical', 'substantially_identical') THEN 'partial_similarity'
  WHEN missing_count > 0 AND judgment IN ('identical', 'substantially_identical') THEN 'partial_difference' WHEN judgment = 'partial_difference' AND missing_count >= 2 THEN 'partial_similarity' ELSE judgment END AS capped FROM cells)""") + """
SELECT case_id, claim_number, doc_idx, label, judgment AS judgment_before, capped AS judgment, CASE WHEN judgment = capped THEN '' WHEN directness = 'absent' THEN 'evidence_absent' WHEN missing_count >= 2 THEN 'several_limitations_missing' ELSE 'limitation_missing' END AS adjustment FROM cap""")
def coverage_cap(spark, sf_dir):
    return judgments.capped(cells(spark, sf_dir), F.lit(False)).select(*fx.KEY, "judgment_before", "judgment", "adjustment")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\[\]【】()（）,.;:"''“”‘’<>]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized_text, sha256(coalesce(text, '')) AS text_hash FROM documents""")
def normalize_text_hash(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", text.normalized_text("text").alias("normalized_text"), text.text_hash("text").alias("text_hash"))


WINDOWS = r"""windows AS (SELECT doc_id, i AS window_no, regexp_replace(substr(text, (i - 1) * 1200 + 1, 1200), '^\s+|\s+$', '', 'g') AS piece FROM
  (SELECT doc_id, coalesce(text, '') AS text, CAST(unnest(range(1, CAST(floor((greatest(length(coalesce(text, '')), 1) - 1) / 1200) AS BIGINT) + 2)) AS INTEGER) AS i FROM documents))"""


@query(f"WITH {WINDOWS} SELECT doc_id, window_no, length(piece) AS n_chars, sha256(piece) AS text_hash FROM windows WHERE piece <> ''")
def windows_1200(spark, sf_dir):
    cut = segments.fixed_windows(fx.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "window_no", F.length("window").cast("long").alias("n_chars"), text.text_hash("window").alias("text_hash"))


@query(f"WITH {WINDOWS} SELECT doc_id, window_no, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3000 AS excluded FROM windows WHERE piece <> ''")
def abstract_cap(spark, sf_dir):
    cut = segments.fixed_windows(fx.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return segments.summary_capped(cut).select("doc_id", "window_no", "excluded")


#: Documents and items that share eight words in a row.
PAIRS = r"""runs_d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM
  (SELECT doc_id, string_split(trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), ' ') AS w FROM documents))),
runs_b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM
  (SELECT item_id, string_split(trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), ' ') AS w FROM benchmark))),
pairs AS (SELECT DISTINCT doc_id, item_id FROM runs_d JOIN runs_b USING (g))"""


@query(f"WITH {PAIRS} SELECT doc_id, item_id FROM pairs")
def citing_documents(spark, sf_dir):
    """A search by content: the documents that have a run of words in common with a benchmark item."""
    return evidence.citing_pairs(fx.read(spark, sf_dir, "documents"), fx.read(spark, sf_dir, "benchmark"))


@query(rf"""WITH {fx.EVERYWHERE},
q AS (SELECT quote_id, named, trim(quote) AS q, d.doc_id IS NOT NULL AS known, lower(d.text) AS low FROM everywhere n LEFT JOIN texts d ON d.doc_id = n.named),
s AS (SELECT *, CASE WHEN len(list_filter(list_transform(string_split_regex(q, '\s*(?:…|\.{{3,}})\s*'), lambda x: trim(x)), lambda x: length(x) >= 15)) > 0
  THEN list_filter(list_transform(string_split_regex(q, '\s*(?:…|\.{{3,}})\s*'), lambda x: trim(x)), lambda x: length(x) >= 15) ELSE [q] END AS parts FROM q),
m AS (SELECT *, list_transform(parts, lambda p: CASE WHEN contains(low, lower(substr(p, 1, 70))) THEN 2 WHEN contains(low, lower(substr(p, 1, 30))) THEN 1
  WHEN len(list_filter(string_split_regex(lower(substr(p, 1, 70)), '\s+'), lambda w: length(w) >= 3)) > 0 AND
    len(list_filter(string_split_regex(lower(substr(p, 1, 70)), '\s+'), lambda w: length(w) >= 3 AND contains(low, w))) / len(list_filter(string_split_regex(lower(substr(p, 1, 70)), '\s+'), lambda w: length(w) >= 3)) >= 0.6 THEN 1 ELSE 0 END) AS marks FROM s)
SELECT quote_id, named, CASE WHEN coalesce(q, '') = '' THEN 'empty' WHEN length(q) < 15 THEN 'short' WHEN NOT known THEN 'no_doc' WHEN list_min(marks) = 2 THEN 'verified' WHEN list_max(marks) > 0 THEN 'partial' ELSE 'not_found' END AS status FROM m""")
def quote_verify(spark, sf_dir):
    """Every quotation in the document that it names, and every item in all others too."""
    texts = fx.document_texts(spark, sf_dir)
    own = evidence.with_lowered(evidence.named_documents(fx.quotations(spark, sf_dir), texts), "text")
    others = evidence.quote_status_everywhere(fx.items_as_quotations(spark, sf_dir), texts).filter("named <> number")
    status = evidence.quote_status(F.col("quote"), F.col("text"), F.col("_low")).alias("status")
    return own.select("quote_id", "named", status).unionByName(others.select("quote_id", "named", "status"))


@query(rf"""WITH {fx.EVERYWHERE}, low AS MATERIALIZED (SELECT doc_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS low FROM texts),
q AS (SELECT quote_id, named, list_filter(list_transform(string_split_regex(quote, '\s*(?:…|\.{{3,}})\s*'), lambda x: trim(lower(regexp_replace(regexp_replace(x, '^\s*\[[^\]]+\]\s*', ''), '\s+', ' ', 'g')))), lambda x: length(x) >= 12) AS parts, low
  FROM everywhere n LEFT JOIN low d ON d.doc_id = n.named)
SELECT quote_id, named, coalesce(len(parts), 0) > 0 AND low IS NOT NULL AND len(list_filter(parts, lambda x: NOT contains(low, x))) = 0 AS verbatim FROM q""")
def quote_verbatim(spark, sf_dir):
    """Whether a quotation stands word for word in the document that it names; of every item, in all others too. Not, where there is no such document."""
    texts = fx.document_texts(spark, sf_dir)
    own = evidence.named_documents(fx.quotations(spark, sf_dir), texts)
    items = fx.items_as_quotations(spark, sf_dir).withColumn("parts", evidence.verbatim_parts(F.col("quote")))
    others = evidence.every_document(items, texts).filter("named <> number")
    found = [F.coalesce(c, F.lit(False)).alias("verbatim") for c in (evidence.is_verbatim(F.col("quote"), F.col("text")), evidence.holds_all(F.col("parts"), F.col("_whole")))]
    return own.select("quote_id", "named", found[0]).unionByName(others.select("quote_id", "named", found[1]))


STOP = "[" + ", ".join(f"'{w}'" for w in text.CLAIM_STOPWORDS) + "]"
#: The windows of every document with the words of its case's claim; a word of the claim that a window holds scores one.
SCORED_WINDOWS = rf"""{WINDOWS}, {fx.CASE_CLAIMS},
k AS (SELECT case_no, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9가-힣]{{2,}}|[ぁ-んァ-ヶー一-龯]{{2,}}')), lambda w: NOT list_contains({STOP}, w)) AS k FROM case_claims),
first80 AS (SELECT case_no, coalesce(k, [])[1:80] AS k FROM k),
scored AS (SELECT doc_id, window_no, case_no, piece, CAST(len(list_filter(k, lambda w: contains(lower(piece), w))) AS INTEGER) AS score FROM windows JOIN first80 ON case_no = doc_id // 5 WHERE piece <> '')"""


def claim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every document with the keywords of the claim of its case."""
    claims = fx.case_claims(spark, sf_dir).select("case_no", text.claim_keywords("claim").alias("keywords"))
    cut = segments.fixed_windows(fx.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.withColumn("case_no", F.floor(F.col("doc_id") / fx.DOCS_PER_CASE)).join(claims, "case_no")


@query(rf"""WITH {SCORED_WINDOWS},
item_words AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9가-힣]{{2,}}|[ぁ-んァ-ヶー一-龯]{{2,}}'), lambda w: NOT list_contains({STOP}, w)) AS k FROM benchmark),
item_first80 AS (SELECT item_id, coalesce(list_filter(k, lambda w, i: list_position(k, w) = i), [])[1:80] AS k FROM item_words),
low AS MATERIALIZED (SELECT doc_id, window_no, lower(piece) AS low FROM windows WHERE piece <> ''),
of_items AS (SELECT doc_id, window_no, -1 - item_id AS case_no, CAST(len(list_filter(k, lambda w: contains(low, w))) AS INTEGER) AS score FROM low, item_first80)
SELECT doc_id, window_no, case_no, score FROM (SELECT doc_id, window_no, case_no, score FROM scored UNION ALL FROM of_items) WHERE score > 0""")
def keyword_score(spark, sf_dir):
    """Every window against the claim of its document's case, and against every benchmark item; case_no is -1 - item_id there."""
    own = evidence.keyword_scores(claim_windows(spark, sf_dir)).select("doc_id", "window_no", "case_no", "score")
    items = fx.read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("case_no"), text.claim_keywords("text").alias("keywords"))
    cut = segments.fixed_windows(fx.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "window_no", "window")
    return own.unionByName(evidence.keyword_scores_of_all(cut, items, "case_no"))


#: Budgets of the context query: whole texts up to HARD characters, RELEVANT of longer ones, and of non-patent documents at most OTHER.
HARD, RELEVANT, OTHER = 1_500, 1_300, 1_100


@query(f"""WITH RECURSIVE {SCORED_WINDOWS},
each AS (SELECT s.doc_id, count(*) AS n, sum(length(piece) + 8) - 1 AS whole, any_value(len(k)) AS n_words, max(score) AS top,
  CASE WHEN s.doc_id % 3 = 0 THEN least({HARD}, {OTHER}) ELSE {HARD} END AS hard, CASE WHEN s.doc_id % 3 = 0 THEN least({RELEVANT}, {OTHER}) ELSE {RELEVANT} END AS relevant,
  list(length(piece) + 8 ORDER BY window_no) AS sizes FROM scored s JOIN first80 USING (case_no) GROUP BY s.doc_id),
hits AS (SELECT s.doc_id, p, row_number() OVER (PARTITION BY s.doc_id ORDER BY score DESC, p) AS r FROM
  (SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY window_no) - 1 AS p FROM scored) s WHERE score > 0),
fold AS (SELECT doc_id, 0::BIGINT AS r, CASE WHEN doc_id % 3 = 0 THEN []::BIGINT[] ELSE [0::BIGINT] END AS kept, CASE WHEN doc_id % 3 = 0 THEN 0::HUGEINT ELSE sizes[1]::HUGEINT END AS total FROM each
  UNION ALL SELECT f.doc_id, h.r,
    CASE WHEN f.total + list_sum(coalesce(list_transform(new, lambda x: sizes[x + 1]), [])) <= relevant OR len(new) = 0 THEN list_concat(f.kept, new)
      WHEN NOT list_contains(f.kept, h.p) AND f.total + sizes[h.p + 1] <= relevant THEN list_append(f.kept, h.p) ELSE f.kept END,
    CASE WHEN len(new) = 0 THEN f.total WHEN f.total + list_sum(list_transform(new, lambda x: sizes[x + 1])) <= relevant THEN f.total + list_sum(list_transform(new, lambda x: sizes[x + 1]))
      WHEN NOT list_contains(f.kept, h.p) AND f.total + sizes[h.p + 1] <= relevant THEN f.total + sizes[h.p + 1] ELSE f.total END
  FROM (SELECT fold.*, h.p AS hp, e.sizes, e.relevant, list_filter(list_distinct([greatest(0, h.p - 1), h.p, least(e.n - 1, h.p + 1)]), lambda x: NOT list_contains(fold.kept, x)) AS new
    FROM fold JOIN hits h ON h.doc_id = fold.doc_id AND h.r = fold.r + 1 JOIN each e ON e.doc_id = fold.doc_id) f JOIN hits h ON h.doc_id = f.doc_id AND h.r = f.r + 1),
last AS (SELECT doc_id, arg_max(kept, r) AS kept FROM fold GROUP BY doc_id)
SELECT doc_id, CASE WHEN whole <= hard THEN 'whole' WHEN n_words = 0 THEN 'no_keywords' WHEN top = 0 THEN 'no_hit' ELSE 'selected' END AS mode,
  CASE WHEN whole <= hard OR n_words = 0 THEN hard WHEN top = 0 THEN relevant END AS first_chars,
  CASE WHEN whole <= hard OR n_words = 0 OR top = 0 THEN '' ELSE array_to_string(list_sort(kept), ',') END AS kept FROM each JOIN last USING (doc_id)""")
def budget_context(spark, sf_dir):
    """What two limits let of every document into the context of its case's claim; every third is no patent document."""
    docs = evidence.gathered(claim_windows(spark, sf_dir), ["doc_id"], "window_no", "window", label_chars=6)
    chosen = evidence.selected_context("chunks", F.size("keywords"), F.col("doc_id") % 3 == 0, HARD, RELEVANT, OTHER)
    return docs.select("doc_id", chosen.alias("c")).select("doc_id", "c.mode", "c.first_chars", F.array_join("c.kept", ",").alias("kept"))


@query(r"""WITH r AS (SELECT page_id // 4 AS batch, url || CASE page_id % 5 WHEN 0 THEN ' and US ' || (20000000 + page_id % 7) || 'A1.' WHEN 1 THEN ' arXiv: 2401.0' || (1000 + page_id % 3) || 'v2 ' WHEN 2 THEN ' doi 10.1000/x.' || page_id % 2 ELSE '' END AS t FROM pages),
u AS (SELECT batch, count(DISTINCT u) AS n FROM (SELECT batch, regexp_replace(unnest(regexp_extract_all(t, '(?i)https?://[^\s)<>\]]+')), '[.,;]+$', '') AS u FROM r) GROUP BY batch),
i AS (SELECT batch, count(DISTINCT i) AS n FROM (SELECT batch, upper(replace(unnest(regexp_extract_all(t, '(?i)\b(?:US|WO|EP|KR|JP|CN)\s*[-/]?\s*\d{4,}[A-Z]\d?\b|\barXiv\s*:?\s*\d{4}\.\d{4,5}(?:v\d+)?\b|\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b')), ' ', '')) AS i FROM r) GROUP BY batch)
SELECT b.batch, coalesce(u.n, 0) AS url_count, coalesce(i.n, 0) AS identifier_count, coalesce(u.n, 0) < 3 OR coalesce(i.n, 0) < 2 AS needs_expansion FROM (SELECT DISTINCT batch FROM r) b LEFT JOIN u USING (batch) LEFT JOIN i USING (batch)""")
def search_stats(spark, sf_dir):
    """Distinct addresses and identifiers over batches of four pages, most of which name a document."""
    k = F.col("page_id")
    s = lambda c: c.cast("string")
    named = F.when(k % 5 == 0, F.concat(F.lit(" and US "), s(20000000 + k % 7), F.lit("A1."))).when(k % 5 == 1, F.concat(F.lit(" arXiv: 2401.0"), s(1000 + k % 3), F.lit("v2 "))).when(k % 5 == 2, F.concat(F.lit(" doi 10.1000/x."), s(k % 2))).otherwise("")
    rows = fx.read(spark, sf_dir, "pages").select(F.floor(k / 4).alias("batch"), F.concat("url", named).alias("t"))
    return evidence.search_stats(rows, "batch", "t")


@query(fx.ctes("""arriving AS (SELECT case_id, claim_number, doc_idx, label, judgment, seq FROM cells WHERE seq % 7 = 0)""") + """
SELECT case_id, claim_number, doc_idx, label, judgment FROM cells c WHERE NOT EXISTS (SELECT 1 FROM arriving a WHERE a.case_id = c.case_id AND a.doc_idx = c.doc_idx AND a.claim_number = c.claim_number)
UNION ALL SELECT case_id, claim_number, doc_idx, label, judgment FROM arriving""")
def judgment_merge(spark, sf_dir):
    """Every seventh row arrives again and replaces all rows of its document and claim."""
    rows = cells(spark, sf_dir).select(*fx.KEY, "judgment", "seq")
    return judgments.merged_by_claim(rows, rows.filter("seq % 7 = 0")).drop("seq")


@query(fx.ctes() + """
SELECT case_id, claim_number, role, seq FROM (SELECT case_id, claim_number, label AS role, seq, row_number() OVER (PARTITION BY case_id, claim_number, label ORDER BY seq DESC) AS rn FROM raw WHERE doc_idx = 1) WHERE rn = 1
UNION ALL SELECT case_id, claim_number, label, seq FROM raw r WHERE doc_idx = 0 AND NOT EXISTS (SELECT 1 FROM raw a WHERE a.doc_idx = 1 AND a.case_id = r.case_id AND a.claim_number = r.claim_number)""")
def reference_history(spark, sf_dir):
    """Rows of document 0 as the history, those of document 1 as the batch that replaces its scopes."""
    rows = fx.raw_judgments(spark, sf_dir).select("case_id", "claim_number", F.col("label").alias("role"), "seq", "doc_idx")
    old, new = (rows.filter(F.col("doc_idx") == k).drop("doc_idx") for k in (0, 1))
    return tables.upsert_scoped(old, new, ["case_id", "claim_number"], ["case_id", "claim_number", "role"], F.col("seq"))


@query("""WITH f AS (SELECT doc_id // 8 * 2 + (doc_id % 8 >= 5)::INT AS case_id, 'doc-' || doc_id AS filename, doc_id FROM documents), m AS (SELECT case_id, filename, doc_id % 13 AS position FROM f WHERE doc_id % 3 = 0),
o AS (SELECT case_id, filename, CAST(row_number() OVER (PARTITION BY case_id ORDER BY position NULLS LAST, filename) - 1 AS INTEGER) AS doc_idx, count(*) OVER (PARTITION BY case_id) AS n FROM f LEFT JOIN m USING (case_id, filename))
SELECT case_id, filename, doc_idx FROM o WHERE n <= 4""")
def document_order(spark, sf_dir):
    """Cases of five and three documents, of which those over four are gone."""
    k = F.col("doc_id")
    files = fx.read(spark, sf_dir, "documents").select((F.floor(k / 8) * 2 + (k % 8 >= 5).cast("long")).alias("case_id"), F.concat(F.lit("doc-"), "doc_id").alias("filename"), "doc_id")
    manifest = files.filter("doc_id % 3 = 0").withColumn("position", F.col("doc_id") % 13)
    return tables.document_order(files, manifest, most=4)


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'en')""")
def incremental_intake(spark, sf_dir):
    """Documents whose content no English document has: what must be parsed after those."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    known = docs.filter("lang = 'en'").select(text.text_hash("text").alias("sha256"))
    return tables.new_content(docs, known).select("doc_id", "sha256")


@query(fx.ctes() + "\nSELECT d.case_id, CAST(n_documents AS BIGINT) AS n_documents, n_claims, n_independent FROM (SELECT case_id, count(*) AS n_documents FROM docs GROUP BY ALL) d JOIN (SELECT case_id, count(*) AS n_claims, count(*) FILTER (claim_type = 'independent') AS n_independent FROM claims GROUP BY ALL) c USING (case_id)")
def case_counters(spark, sf_dir):
    return tables.case_counters(fx.case_documents(spark, sf_dir), fx.claims(spark, sf_dir))


@query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC, value DESC) AS rn FROM events) WHERE rn = 1")
def latest_arrivals(spark, sf_dir):
    """The batch form of the streaming upsert: each user's latest event."""
    rows = fx.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*rows.columns), F.struct("ts", "event_id", "event_type", "value")).alias("row")).select("row.*")


DECIDED = """l AS (SELECT case_id, claim_number, doc_idx, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, claim_number ORDER BY distinctive_direct DESC, core_coverage DESC, primary_score DESC, doc_idx) AS INTEGER) AS rank FROM eligible WHERE eligible) WHERE rank <= 5),
f AS (SELECT case_id, claim_number, arg_min(doc_idx, rank) AS first, count(*) AS candidates FROM l GROUP BY ALL)"""


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense(spark, sf_dir)
    return selection.primary_shortlist(selection.eligible_primaries(scoring.primary_scores(rows), selection.core_disclosers(rows)))


@query(fx.ctes(ELIGIBLE, DECIDED) + """
SELECT f.case_id, f.claim_number, CASE WHEN l.rank IS NOT NULL THEN f.case_id % 7 ELSE f.first END AS primary_idx, coalesce(l.rank, 1) AS rank, l.rank IS NOT NULL AND f.case_id % 7 <> f.first AS changed,
  CASE WHEN l.rank IS NULL THEN 'outside_shortlist' WHEN f.case_id % 7 = f.first THEN 'confirmed' ELSE 'changed' END AS reason FROM f LEFT JOIN l ON l.case_id = f.case_id AND l.claim_number = f.claim_number AND l.doc_idx = f.case_id % 7""")
def decision_validation(spark, sf_dir):
    """Every claim's decision proposes document case_id % 7, of which 5 and 6 do not exist."""
    proposed = fx.claims(spark, sf_dir).select("case_id", "claim_number", (F.col("case_id") % 7).alias("proposed"))
    return decisions.validated_primary(shortlist(spark, sf_dir), proposed)


@query("SELECT source, avg(CASE WHEN trim(text) <> '' THEN length(text) END) AS mean_chars, coalesce(avg(CASE WHEN trim(text) <> '' THEN length(text) END), 0) < 100 AS rejected FROM documents GROUP BY source")
def text_layer_gate(spark, sf_dir):
    """A source's documents as the pages of one text."""
    return tables.text_layer_gate(fx.read(spark, sf_dir, "documents"), ["source"], "text")


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS text_hash FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def joined_pages(spark, sf_dir):
    """A conversation's turns as the pages of one text."""
    out = tables.joined_pages(fx.read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return out.select("conv_id", text.text_hash("raw_text").alias("text_hash"))


@query("""SELECT doc_id, coalesce(string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)), '') AS outside FROM
(SELECT doc_id, CASE WHEN n NOT IN (0, 1, 2) THEN n END AS n FROM (SELECT doc_id, unnest(list_append(list_transform(regexp_extract_all(text, '([0-9])\\.', 1), lambda x: CAST(x AS INTEGER)), 0)) AS n FROM documents)) GROUP BY doc_id""")
def scope_violations(spark, sf_dir):
    """Digits before a stop as document numbers, of which 0 to 2 are allowed."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.lit(0), F.lit(1), F.lit(2)).alias("allowed"))
    out = decisions.scope_violations(docs, "text", "allowed", r"([0-9])\.")
    return out.select("doc_id", F.array_join(F.col("outside").cast("array<string>"), ",").alias("outside"))


@query(fx.ctes() + """
SELECT case_id * 8 + claim_number - 1 AS response_id, doc_idx, label, judgment, judgment <> 'none' AS found, CASE WHEN judgment <> 'none' THEN 'words quoted from place ' || seq ELSE '' END AS quote,
  CASE WHEN seq % 100 % 3 = 2 THEN 'missing_fields:chunk_id' WHEN doc_idx = 4 THEN 'doc_index_out_of_range' END AS reject FROM raw""")
def response_rows(spark, sf_dir):
    """Items of made-up responses back to judgment rows and rejects; document 4 is not among those asked for."""
    texts = fx.responses(spark, sf_dir)
    key = (F.col("case_id") * 8 + F.col("claim_number") - 1).alias("response_id")
    elements = fx.elements(spark, sf_dir).select(key, "label", F.lit("").alias("text"))
    documents = texts.select("response_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("doc_idx"))
    none = spark.createDataFrame([], "response_id long, doc_idx int, corpus string, chunk_id string, chunk string")
    out = responses.normalized(texts, elements, documents, none.select("response_id", "doc_idx", "corpus"), none.select("response_id", "doc_idx", "chunk_id", "chunk"))
    return out.select("response_id", F.col("doc_idx").cast("long").alias("doc_idx"), "label", "judgment", "found", "quote", "reject")


def _hit(pattern: str) -> str:
    return f"regexp_matches(text, '(?i)(?:{pattern})')"


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '(?i)(?:{pattern})'))"


SELECTS = f"({_hit(predicates.SELECTION_OR)} AND {_hit(predicates.SELECTION_CONDITION)})"
AXES = " + ".join(f"{_hit(p)}::INT" for n, p in predicates.CONCEPTS.items() if n != predicates.SIGNAL_PATH)


@query(f"""WITH {fx.ELEMENT_TEXTS} SELECT element_id, CAST(weight AS INTEGER) AS importance, {SELECTS} AS conditioned,
  length(text) <= 80 AND {_hit(predicates.GENERIC_INTERFACE)} AND NOT {_hit(predicates.SPECIALIZED_CONSTRAINT)} AND NOT is_sub AS interface,
  length(text) > 100 OR {_hit(predicates.SPECIALIZED_CONSTRAINT)} OR {_hit(predicates.TECHNICAL_RELATION)} OR {SELECTS} AS distinctive,
  length(text) <= 80 AND {_hit(predicates.CONVENTIONAL_COMPONENT)} AND NOT {_hit(predicates.SPECIALIZED_CONSTRAINT)} AND NOT {_hit(predicates.TECHNICAL_RELATION)} AND {_hits(predicates.FUNCTIONAL_VERB)} <= 1 AND NOT is_sub AS simple,
  length(text) <= 120 AND weight <= 3 AND NOT is_sub AND {_hit(predicates.CONVENTIONAL_COMPONENT)} AND NOT {_hit(predicates.SPECIALIZED_CONSTRAINT)} AND {_hits(predicates.FUNCTIONAL_VERB)} <= 1 AND {_hits(predicates.CONJUNCTION)} <= 1 AS conventional,
  length(text) <= 140 AND weight <= 3 AND NOT is_sub AND NOT {SELECTS} AND {_hit(predicates.GENERIC_COMPONENT)} AND NOT {_hit(predicates.NON_GENERIC_LIMITATION)}
    AND len(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:{predicates.GENERIC_FUNCTION})'), lambda x: lower(x)))) <= 3 AND {_hits(predicates.CONJUNCTION)} <= 1 AS batchable,
  length(text) > 100 OR ({AXES}) >= 2 OR {SELECTS} AS second_look, {_hit(predicates.CORE_RELATION)} AS core_relation FROM texts""")
def element_predicates(spark, sf_dir):
    t, sub, w = "text", F.col("is_sub"), F.col("weight")
    return fx.element_texts(spark, sf_dir).select(
        "element_id", predicates.importance("weight").alias("importance"), predicates.is_conditioned_selection(t).alias("conditioned"), predicates.is_generic_interface(t, sub).alias("interface"),
        predicates.is_distinctive(t).alias("distinctive"), predicates.is_simple_component(t, sub).alias("simple"), predicates.is_conventional(t, w, sub).alias("conventional"),
        predicates.is_batchable_generic(t, w, sub).alias("batchable"), predicates.needs_second_look(t).alias("second_look"), predicates.has_core_relation(t).alias("core_relation"),
    )


@query(r"""SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS signs, coalesce(figure, '') AS figure, hangul FROM (SELECT doc_id,
  list_transform(list_filter(list_zip(s, range(1, len(s) + 1)), lambda x: list_position(s, x[1]) = x[2]), lambda x: x[1])[1:30] AS list_distinct_in_order, nullif(replace(regexp_extract(t, '도\s*\d+[A-Za-z가-힣]?'), ' ', ''), '') AS figure, regexp_matches(t, '[가-힣]') AS hangul
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '\((\d{2,4}[a-zA-Z]?)\)', 1) AS s FROM documents))""")
def document_signs(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.reference_signs("text"), ",").alias("signs"), F.coalesce(text.figure_no("text"), F.lit("")).alias("figure"), text.has_hangul("text").alias("hangul"))


@query(r"""SELECT doc_id, CASE WHEN length(q) <= 350 THEN q ELSE (CASE WHEN h <> '' THEN h ELSE substr(q, 1, 190) END) || ' ... ' || (CASE WHEN l <> '' THEN l ELSE right(q, 140) END) END AS quote FROM
(SELECT doc_id, q, rtrim(regexp_replace(substr(q, 1, 190), '(?s) [^ ]*$', '')) AS h, ltrim(regexp_replace(right(q, 140), '(?s)^[^ ]* ', '')) AS l FROM (SELECT doc_id, replace(trim(coalesce(text, '')), '…', '...') AS q FROM documents))""")
def shortened_quotes(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", text.shortened_quote("text").alias("quote"))


@query(fx.ctes() + "\nSELECT case_id, claim_number, sha256('{\"claim_number\":' || claim_number || ',\"claim_type\":\"' || claim_type || '\"' || CASE WHEN parent_claim IS NULL THEN '' ELSE ',\"parent_claim\":' || parent_claim END || ',\"text\":\"claim ' || claim_number || '\"}') AS signature FROM claims")
def claim_signatures(spark, sf_dir):
    """Signatures of claims whose text has odd white space."""
    rows = fx.claims(spark, sf_dir).withColumn("text", F.concat(F.lit("  claim \t "), F.col("claim_number").cast("string"), F.lit("\n")))
    return claim_ops.signatures(rows).select("case_id", "claim_number", "signature")


@query(fx.ctes() + "\nSELECT case_id, claim_number, role, seq FROM (SELECT case_id, claim_number, label AS role, seq FROM raw) r WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.case_id = r.case_id AND c.claim_number = r.claim_number AND c.claim_type = 'independent')")
def history_deleted(spark, sf_dir):
    """History rows of independent claims are deleted by their key."""
    rows = fx.raw_judgments(spark, sf_dir).select("case_id", "claim_number", F.col("label").alias("role"), "seq")
    return tables.deleted(rows, fx.claims(spark, sf_dir).filter("claim_type = 'independent'"), ["case_id", "claim_number"])


@query(fx.ctes(fx.CLAIM_PARTS) + """
SELECT l.case_id, l.claim_number, c.claim_type, c.parent_claim, CAST(pos AS INTEGER) AS pos, CASE WHEN kind = 2 THEN '_' WHEN sub THEN chr(65 + n_first) || '-1' ELSE chr(65 + n) END AS label,
  CAST(CASE WHEN kind = 2 THEN 2 WHEN sub THEN 3 WHEN n = 0 THEN 5 WHEN n < 3 THEN 3 ELSE 2 END AS INTEGER) AS importance, CASE WHEN sub THEN chr(65 + n_first) END AS parent_label, CASE WHEN count(*) OVER (PARTITION BY l.case_id, l.claim_number) > 1 THEN 'regex' ELSE 'fallback' END AS split_method
FROM lettered l JOIN claims c USING (case_id, claim_number)""")
def claim_elements(spark, sf_dir):
    """Parents, labels, weights and sub-elements that made-up claim texts are parsed to."""
    rows = claim_text.with_elements(claim_text.with_parents(fx.claim_texts(spark, sf_dir)))
    # outer, as else a filter on the elements is put below them, which parses each claim many times over
    return rows.select("case_id", "claim_number", "claim_type", "parent_claim", "split_method", F.posexplode_outer("elements").alias("pos", "e")).select("case_id", "claim_number", "claim_type", "parent_claim", "pos", "e.label", "e.importance", "e.parent_label", "split_method")


RISKS = """rk AS (SELECT case_id, claim_number, doc_idx, label, quote_len % 6 = 0 AS motivated, quote_len % 11 <= 1 AS risky FROM cells),
mr AS (SELECT m.*, coalesce(motivated, false) AS motivated, coalesce(risky, false) AS risky, (m.case_id + ascii(m.label)) % 3 AS cluster FROM m LEFT JOIN rk USING (case_id, claim_number, doc_idx, label)),
per AS (SELECT case_id, claim_number, primary_idx, doc_idx, cluster, coalesce(sum(w) FILTER (base_sim >= 0.35), 0) AS rw FROM mr GROUP BY ALL),
qr AS (SELECT case_id, claim_number, primary_idx, doc_idx, bool_or(risky) AS risky, count(*) FILTER (risky AND base_sim >= 0.35) AS risks, coalesce(sum(w) FILTER (motivated AND base_sim >= 0.35), 0) AS mw FROM mr GROUP BY ALL),
qs AS (SELECT q.*, risky, risks, mw, best FROM q JOIN qr USING (case_id, claim_number, primary_idx, doc_idx) JOIN (SELECT case_id, claim_number, primary_idx, doc_idx, max(rw) AS best FROM per GROUP BY ALL) USING (case_id, claim_number, primary_idx, doc_idx)),
scr AS (SELECT *, round(base + 8 * rw / den + CASE WHEN reached >= 2 AND rw > 0 THEN 7 * best / rw ELSE 0 END + 3 * mw / den - CASE WHEN targets >= 3 AND reached <= 1 AND base > 0 THEN least(12.0::DOUBLE, 8 + 0.06 * base) ELSE 0 END - CASE WHEN risks > 0 THEN 40 ELSE 0 END + 1e-11, 9) AS adjusted_score, round(cg + 1e-11, 9) AS critical_gain FROM qs)"""


def risky_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense matrix with motivations, combination risks and element texts of three clusters."""
    k = F.col("quote_len")
    rows = cells(spark, sf_dir).withColumn("motivation_quote", F.when(k % 6 == 0, "to save power").otherwise(" ")).withColumn("combination_risk", F.when(k % 11 == 0, "contrary_teaching").when(k % 11 == 1, " Incompatible ").when(k % 11 == 2, "uncertain"))
    texts = F.element_at(F.array(*map(F.lit, ("a gear", "a pixel", "a thing"))), ((F.col("case_id") + F.ascii("label")) % 3 + 1).cast("int"))
    return scoring.dense(rows, fx.elements(spark, sf_dir).withColumn("text", texts), fx.case_documents(spark, sf_dir))


@query(fx.ctes(SECONDARY, RISKS) + "\nSELECT case_id, claim_number, primary_idx, doc_idx, adjusted_score, risky FROM scr")
def secondary_risk(spark, sf_dir):
    """Secondary scores with motivation, risk and cluster terms."""
    return scoring.secondary_scores(risky_dense(spark, sf_dir)).select("case_id", "claim_number", "primary_idx", "doc_idx", "adjusted_score", "risky")


@query(fx.ctes(SECONDARY, RISKS) + """
SELECT case_id, claim_number, primary_idx, doc_idx, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, claim_number, primary_idx ORDER BY critical_gain DESC, adjusted_score DESC, doc_idx) AS INTEGER) AS rank FROM scr WHERE adjusted_score > 0 AND NOT risky AND (hard_fill > 0 OR soft_fill > 0 OR ev > 0)) WHERE rank <= 4""")
def safe_shortlist(spark, sf_dir):
    """Supports of every primary, none with an explicit risk at a target."""
    return selection.secondary_shortlist(scoring.secondary_scores(risky_dense(spark, sf_dir))).select("case_id", "claim_number", "primary_idx", "doc_idx", "rank")


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part) SELECT k AS document, CASE k % 6 WHEN 0 THEN 'WO2023/' || (10000 + k % 80000) || 'A1' WHEN 1 THEN 'KR10-2020-' || (1000000 + k) WHEN 2 THEN 'US11,123,' || (100 + k % 900) WHEN 3 THEN 'CN' || (115000000 + k) || 'A' WHEN 4 THEN '10-' || (2000000 + k) ELSE 'file.' || k END AS publication_no,
  CASE WHEN k % 4 = 0 THEN 'Name ' || k ELSE CASE WHEN k % 6 = 4 THEN 'KR 10-' || (2000000 + k) ELSE 'file.' || k END END AS title, k % 6 = 0 AS patent FROM p""")
def publication_numbers(spark, sf_dir):
    """Numbers, titles and kinds of made-up front pages; a sixth has its number in the file name alone, a sixth none."""
    k = F.col("p_partkey").cast("long")
    s = lambda c: c.cast("string")
    number = F.when(k % 6 == 0, F.concat(F.lit("x WO 2023 / "), s(10000 + k % 80000), F.lit(" A1 y"))).when(k % 6 == 1, F.concat(F.lit("kr 10-2020-"), s(1000000 + k))).when(k % 6 == 2, F.concat(F.lit("(US 11,123,"), s(100 + k % 900))).when(k % 6 == 3, F.concat(F.lit("CN "), s(115000000 + k), F.lit(" A."))).otherwise("none")
    named = F.when(k % 4 == 0, F.concat(F.lit("\nTitle:  Name "), s(k), F.lit(" \nmore"))).otherwise("")
    file = F.when(k % 6 == 4, F.concat(F.lit("KR 10-"), s(2000000 + k), F.lit(".pdf"))).otherwise(F.concat(F.lit("file."), s(k), F.lit(".pdf")))
    rows = fx.read(spark, sf_dir, "part").select(k.alias("document"), F.concat(number, named).alias("text"), file.alias("file"))
    return rows.select("document", patents.publication_no(F.col("text"), F.col("file")).alias("publication_no"), patents.title(F.col("text"), F.col("file")).alias("title"), patents.looks_like_patent(F.col("text")).alias("patent"))


@query(fx.ctes() + "\nSELECT case_id, CAST(claim_number AS VARCHAR) AS number, 'item ' || label || ' of ' || claim_number AS body FROM (SELECT case_id, claim_number, max(label) AS label FROM elements GROUP BY ALL)")
def claims_section(spark, sf_dir):
    """Claims of made-up documents, one for each case, in two notations; of a number that comes twice the last body counts."""
    rows = fx.elements(spark, sf_dir).select("case_id", "claim_number", "label")
    n = F.col("claim_number").cast("string")
    body = F.concat(F.lit(" item "), "label", F.lit(" of "), n, F.lit("\n"))
    item = F.when(F.col("case_id") % 2 == 0, F.concat(F.lit("청구항 "), n, body)).otherwise(F.concat(n, F.lit("."), body))
    texts = rows.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_number", "label", item.alias("i")))), lambda x: x["i"]), "").alias("items"))
    head = F.when(F.col("case_id") % 2 == 0, "청구항 99 before\n【청구범위】\n").otherwise("7. before\nCLAIMS\n")
    return patents.claims(texts.select("case_id", F.concat(head, "items").alias("text")), "case_id").select("case_id", "number", "body")


@query(FAMILY_CTES + """
SELECT case_id, claim_number, 0 AS pos, primary_idx AS doc_idx, 'primary' AS role, CASE WHEN track = 'single_document' THEN 'novelty' WHEN secondary_idx IS NULL THEN 'single' ELSE 'combination_of_2' END AS basis FROM families
UNION ALL SELECT case_id, claim_number, 1, secondary_idx, 'secondary', '' FROM families WHERE secondary_idx IS NOT NULL""")
def used_documents(spark, sf_dir):
    """The flagship's documents, one row each."""
    return decisions.used_documents(family_selection(spark, sf_dir))


@query(fx.ctes(ELIGIBLE, DECIDED, DISCLOSURE) + """
SELECT case_id, claim_number, candidates, CASE WHEN n > 0 THEN 'single_document' WHEN candidates < 2 THEN 'no_choice' ELSE 'decide' END AS gate
FROM f JOIN (SELECT case_id, claim_number, count(*) FILTER (is_complete) AS n FROM disclosure GROUP BY ALL) USING (case_id, claim_number)""")
def decision_gate(spark, sf_dir):
    """Which claims need a decision between shortlisted primaries."""
    return decisions.decision_gate(shortlist(spark, sf_dir), scoring.novelty_screen(dense(spark, sf_dir)))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents), l AS (SELECT *, length(c) AS n, regexp_extract(c, '^.*[.!?] (.*)$', 1) AS last FROM c),
h AS (SELECT *, last <> '' AND length(last) <= 72 AS short, CASE WHEN last <> '' AND length(last) <= 72 THEN 155 - length(last) ELSE 105 END AS hb, ltrim(right(c, 50)) AS t FROM l),
j AS (SELECT *, CASE WHEN hb < n AND substr(c, hb + 1, 1) <> ' ' THEN regexp_replace(rtrim(substr(c, 1, hb)), ' [^ ]*$', '') ELSE rtrim(substr(c, 1, hb)) END AS head, CASE WHEN substr(c, n - 50, 1) <> ' ' THEN regexp_replace(t, '^[^ ]* ', '') ELSE t END AS tail FROM h)
SELECT doc_id, CASE WHEN n <= 160 THEN c WHEN short THEN rtrim(substr(head || ' ... ' || last, 1, 160)) ELSE rtrim(substr(trim(head || ' ... ' || tail), 1, 160)) END AS excerpt FROM j""")
def report_excerpts(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", reports.one_line_excerpt(F.col("text")).alias("excerpt"))


@query(fx.ctes("""old AS (SELECT case_id, claim_number, doc_idx, label, judgment, has_quote, missing_count AS issues, CASE judgment WHEN 'identical' THEN 5 WHEN 'substantially_identical' THEN 4 WHEN 'partial_difference' THEN 3 WHEN 'partial_similarity' THEN 2 WHEN 'difference' THEN 1 ELSE 0 END AS r FROM cells),
new AS (SELECT case_id, claim_number, doc_idx, label, CASE quote_len % 3 WHEN 0 THEN 'identical' WHEN 1 THEN 'difference' ELSE judgment END AS judgment, evidence_count > 0 AS has_quote, quote_len % 2 AS issues FROM cells WHERE quote_len % 4 <> 0),
j AS (SELECT o.*, n.judgment AS nj, n.has_quote AS nq, n.issues AS ni, CASE n.judgment WHEN 'identical' THEN 5 WHEN 'substantially_identical' THEN 4 WHEN 'partial_difference' THEN 3 WHEN 'partial_similarity' THEN 2 WHEN 'difference' THEN 1 ELSE 0 END AS nr FROM old o LEFT JOIN new n USING (case_id, claim_number, doc_idx, label)),
b AS (SELECT *, coalesce(nq AND (nr > r OR (issues > 0 AND ni < issues)), false) AS up FROM j)""") + """
SELECT case_id, claim_number, doc_idx, label, CASE WHEN up THEN nj ELSE judgment END AS judgment, CASE WHEN up THEN nq ELSE has_quote END AS has_quote, CAST(CASE WHEN up THEN ni ELSE issues END AS BIGINT) AS issues, up AS precision_review FROM b""")
def recheck_merge(spark, sf_dir):
    """Cells against made-up rechecks of three quarters of them."""
    rows, k = cells(spark, sf_dir), F.col("quote_len")
    old = rows.withColumn("issues", F.col("missing_count").cast("long"))
    judged = F.when(k % 3 == 0, "identical").when(k % 3 == 1, "difference").otherwise(F.col("judgment"))
    new = rows.filter(k % 4 != 0).select(*fx.KEY, judged.alias("judgment"), (F.col("evidence_count") > 0).alias("has_quote"), (k % 2).alias("issues"))
    return reports.rechecked(old, new)


@query(fx.ctes("best AS (SELECT case_id, claim_number, label, coalesce(max(gap_rank) FILTER (doc_idx <= 1), 0) AS r FROM scored GROUP BY ALL)") + """
SELECT case_id, claim_number, coalesce(string_agg(label, ',' ORDER BY label) FILTER (r < 3), '') AS residual_labels FROM best JOIN claims USING (case_id, claim_number) WHERE claim_type = 'dependent' GROUP BY ALL""")
def dependent_residual(spark, sf_dir):
    """Elements of dependents that documents 0 and 1 leave open."""
    dependents = fx.claims(spark, sf_dir).filter("claim_type = 'dependent'").select("case_id", "claim_number")
    rows = dense(spark, sf_dir).join(dependents, ["case_id", "claim_number"], "left_semi")
    return reports.dependent_residual(rows, fx.case_documents(spark, sf_dir).filter("doc_idx <= 1").join(dependents, "case_id"))


@query(fx.ctes() + "\nSELECT DISTINCT case_id, claim_number, doc_idx, label, judgment, has_reason FROM raw WHERE judgment <> 'none'")
def meaningful_matches(spark, sf_dir):
    """Raw rows that judge anything, once for each judgment and reason."""
    return reports.meaningful_matches(fx.raw_judgments(spark, sf_dir), ["judgment", "has_reason"]).select(*fx.KEY, "judgment", "has_reason")


@query(fx.ctes("""rec AS (SELECT *, CASE WHEN judgment = 'partial_difference' AND directness = 'direct' AND missing_count = 0 AND has_quote AND has_reason THEN 'substantially_identical' ELSE judgment END AS after FROM cells)""") + "\nSELECT case_id, claim_number, doc_idx, label, after AS judgment FROM rec")
def label_reconciliation(spark, sf_dir):
    """Rows with a reason are taken to call the two the same."""
    return judgments.reconciled(cells(spark, sf_dir), F.col("has_reason")).select(*fx.KEY, "judgment")


@query(fx.ctes() + "\nSELECT case_id, claim_number, doc_idx, label FROM cells WHERE seq % 3 = 1 AND seq % 5 IN (0, 1)")
def compatible_cells(spark, sf_dir):
    """Cells written under schema 1 and one of two names of a mode."""
    modes = F.element_at(F.array(*map(F.lit, ("HYBRID", "precision", "mixed", "per_doc", "other"))), (F.col("seq") % 5 + 1).cast("int"))
    rows = cells(spark, sf_dir).withColumns({"schema_version": F.col("seq") % 3, "mode": modes})
    return judgments.compatible(rows, 1, "hybrid").select(*fx.KEY)


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 4 WHEN 0 THEN '00' || p_partkey % 90 WHEN 1 THEN '7' WHEN 2 THEN '7~9' ELSE 'G-' || p_partkey END AS place,
  'x ' || CASE WHEN p_partkey % 3 < 2 THEN 'D' || (2 - p_partkey % 3) ELSE '인용발명 3' END || ', 인용발명' || ' ' || 9 || '.' AS said FROM part""")
def citation_places(spark, sf_dir):
    """Places of chunk ids with and without paragraph numbers, and mentions renamed where the map names them."""
    k = F.col("p_partkey").cast("long")
    s = k.cast("string")
    chunk = F.when(k % 4 == 0, F.concat(F.lit("D1-P-[00"), (k % 90).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("G-"), s))
    numbers = F.when(k % 4 == 1, F.array(F.lit("7"))).when(k % 4 == 2, F.array(F.lit("7"), F.lit("8"), F.lit("9"))).otherwise(F.array().cast("array<string>"))
    text_ = F.concat(F.lit("x 인용발명"), F.when(k % 3 == 2, F.lit(" ")).otherwise(F.lit("  ")), (k % 3 + 1).cast("string"), F.lit(", 인용발명 9."))
    names = F.create_map(F.lit(0), F.lit("D2"), F.lit(1), F.lit("D1"))
    return fx.read(spark, sf_dir, "part").select(k.alias("id"), reports.citation_location(chunk, numbers).alias("place"), reports.renumbered(text_, names).alias("said"))


@query(fx.ctes("""s AS (SELECT case_id, claim_number, doc_idx, CAST(sum(gap_rank * importance) AS BIGINT) AS score, string_agg(label, ',' ORDER BY label) AS labels FROM scored WHERE has_quote AND gap_rank >= 4 AND label <> 'C' AND doc_idx <> 0 GROUP BY ALL)""") + """
SELECT case_id, claim_number, b.d AS doc_idx, b.s AS score, b.l AS labels FROM (SELECT case_id, claim_number, arg_max(struct_pack(d := doc_idx, s := score, l := labels), (score, -doc_idx)) AS b FROM s GROUP BY ALL)""")
def best_support(spark, sf_dir):
    """Documents but 0 for the labels A and B."""
    rows = dense(spark, sf_dir)
    none = fx.claims(spark, sf_dir).select("case_id", "claim_number", F.lit(0).cast("long").alias("doc_idx"))
    return chains.best_support(rows, fx.elements(spark, sf_dir).filter("label <> 'C'"), none)


CHAIN = """walk AS (SELECT case_id, claim_number, claim_number AS node, parent_claim, claim_type, 0 AS depth FROM claims
  UNION ALL SELECT w.case_id, w.claim_number, c.claim_number, c.parent_claim, c.claim_type, w.depth + 1 FROM walk w JOIN claims c ON c.case_id = w.case_id AND c.claim_number = w.parent_claim),
docs_of AS (SELECT case_id, claim_number, depth, unnest(CASE WHEN claim_type = 'independent' THEN [0, 1 + case_id % 3] WHEN node % 3 = 0 THEN [4] ELSE [] END) AS doc, unnest(CASE WHEN claim_type = 'independent' THEN [0, 1] WHEN node % 3 = 0 THEN [0] ELSE [] END) AS pos FROM walk),
first_of AS (SELECT case_id, claim_number, doc, arg_min(struct_pack(d := -depth, p := pos), (-depth, pos)) AS f FROM docs_of GROUP BY ALL),
rooted AS (SELECT DISTINCT case_id, claim_number FROM walk WHERE claim_type = 'independent'),
totals AS (SELECT c.case_id, c.claim_number, CASE WHEN r.case_id IS NULL THEN NULL ELSE list(doc ORDER BY f.d, f.p) FILTER (doc IS NOT NULL) END AS total FROM claims c LEFT JOIN first_of o USING (case_id, claim_number) LEFT JOIN rooted r USING (case_id, claim_number) GROUP BY c.case_id, c.claim_number, r.case_id)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent claims select documents 0 and 1 to 3; every third dependent adds document 4."""
    claims = fx.claims(spark, sf_dir)
    selected = claims.filter("claim_type = 'independent'").select("case_id", "claim_number", F.lit(0).cast("long").alias("primary_idx"), (1 + F.col("case_id") % 3).alias("secondary_idx"))
    added = claims.filter("claim_type = 'dependent' and claim_number % 3 = 0").select("case_id", "claim_number", F.lit(4).cast("long").alias("doc_idx"))
    return chains.chain_totals(claims, selected, added)


@query(fx.ctes(CHAIN) + "\nSELECT case_id, claim_number, coalesce(array_to_string(total, ','), '') AS total FROM totals")
def chain_totals(spark, sf_dir):
    return chained(spark, sf_dir).select("case_id", "claim_number", F.array_join(F.col("total").cast("array<string>"), ",").alias("total"))


@query(fx.ctes(CHAIN, """uses AS (SELECT case_id, doc AS doc_idx, min((claim_number, p)) AS first FROM (SELECT case_id, claim_number, unnest(total) AS doc, unnest(range(0, len(total))) AS p FROM totals WHERE total IS NOT NULL) GROUP BY ALL),
locked AS (SELECT case_id, doc_idx, CAST(2 AS BIGINT) AS number FROM docs WHERE doc_idx = case_id % 5 AND case_id % 2 = 0),
ranked AS (SELECT d.case_id, d.doc_idx, l.number, row_number() OVER (PARTITION BY d.case_id ORDER BY l.number IS NOT NULL, first IS NULL, first, (d.doc_idx * 7 + d.case_id) % 5 DESC, d.doc_idx) AS rank, max(l.number) OVER (PARTITION BY d.case_id) AS taken FROM docs d LEFT JOIN uses u USING (case_id, doc_idx) LEFT JOIN locked l USING (case_id, doc_idx))""") + """
SELECT case_id, doc_idx, coalesce(number, CASE WHEN taken IS NOT NULL AND rank >= 2 THEN rank + 1 ELSE rank END) AS number FROM ranked""")
def document_numbers(spark, sf_dir):
    """Numbers of documents over the chains; half of the cases have document case_id % 5 locked as number 2."""
    documents = fx.case_documents(spark, sf_dir)
    locked = documents.filter("doc_idx = case_id % 5 and case_id % 2 = 0").withColumn("number", F.lit(2).cast("long"))
    return chains.document_numbers(chained(spark, sf_dir), documents.withColumn("score", (F.col("doc_idx") * 7 + F.col("case_id")) % 5), locked)


@query(fx.ctes(SECONDARY, """sc AS (SELECT *, round(base + 8 * rw / den + CASE WHEN reached >= 2 THEN 7 ELSE 0 END - CASE WHEN targets >= 3 AND reached <= 1 AND base > 0 THEN least(12.0::DOUBLE, 8 + 0.06 * base) ELSE 0 END + 1e-11, 9) AS adjusted_score, round(cg + 1e-11, 9) AS critical_gain FROM q WHERE hard_fill > 0 OR soft_fill > 0 OR ev > 0),
l AS (SELECT * FROM (SELECT case_id, claim_number, primary_idx, doc_idx, CAST(row_number() OVER (PARTITION BY case_id, claim_number, primary_idx ORDER BY critical_gain DESC, adjusted_score DESC, doc_idx) AS INTEGER) AS rank FROM sc WHERE adjusted_score > 0) WHERE rank <= 4),
one AS (SELECT case_id, claim_number, primary_idx, arg_min(doc_idx, rank) AS first FROM l GROUP BY ALL)""") + """
SELECT o.case_id, o.claim_number, o.primary_idx, CASE WHEN o.claim_number % 4 = 0 THEN NULL WHEN l.rank IS NOT NULL THEN l.doc_idx ELSE first END AS secondary_idx, CASE WHEN o.claim_number % 4 = 0 THEN NULL ELSE coalesce(l.rank, 1) END AS rank,
  CASE WHEN o.claim_number % 4 = 0 THEN 'none_chosen' WHEN o.case_id % 6 = o.primary_idx THEN 'same_as_primary' WHEN l.rank IS NULL THEN 'outside_shortlist' WHEN l.rank = 1 THEN 'confirmed' ELSE 'changed' END AS reason
FROM one o LEFT JOIN l ON l.case_id = o.case_id AND l.claim_number = o.claim_number AND l.primary_idx = o.primary_idx AND l.doc_idx = o.case_id % 6 AND o.claim_number % 4 <> 0""")
def secondary_decisions(spark, sf_dir):
    """Decisions name document case_id % 6, of which 5 does not exist; every fourth claim wants none."""
    short = selection.secondary_shortlist(scoring.secondary_scores(dense(spark, sf_dir)))
    none = F.col("claim_number") % 4 == 0
    decided = fx.claims(spark, sf_dir).select("case_id", "claim_number", F.when(~none, F.col("case_id") % 6).alias("proposed"), none.alias("says_none"))
    return decisions.validated_secondary(short, decided)


@query(fx.ctes() + """
SELECT case_id, claim_number, CASE WHEN claim_number % 2 = 0 AND claim_number <> 4 THEN 'new' ELSE 'old' END AS version FROM claims""")
def claim_registry(spark, sf_dir):
    """Even claims arrive again, claim 4 as its own parent."""
    old = fx.claims(spark, sf_dir).withColumn("version", F.lit("old"))
    new = old.filter("claim_number % 2 = 0").withColumn("version", F.lit("new")).withColumn("parent_claim", F.when(F.col("claim_number") == 4, F.lit(4)).otherwise(F.col("parent_claim")).cast("long"))
    return tables.registered_claims(old, new, F.col("claim_number"))[0].select("case_id", "claim_number", "version")


@query(fx.ctes() + "\nSELECT d.case_id, d.doc_idx, count(c.case_id) FILTER (c.seq % 2 = 0) AS paragraph_chunks, count(c.case_id) FILTER (c.seq % 2 = 1) AS group_chunks FROM docs d LEFT JOIN cells c USING (case_id, doc_idx) GROUP BY ALL")
def extraction_manifest(spark, sf_dir):
    """Cells as the chunks of their documents."""
    chunks = cells(spark, sf_dir).select("case_id", "doc_idx", F.when(F.col("seq") % 2 == 0, "paragraph").otherwise("group").alias("chunk_type"))
    return tables.extraction_manifest(fx.case_documents(spark, sf_dir), chunks)


@query(fx.ctes() + "\nSELECT case_id, doc_idx, claim_number, label, judgment FROM cells WHERE doc_idx <> 3")
def cached_comparisons(spark, sf_dir):
    """Comparison files of made-up cases; those of document 3 are cut short and cannot be read."""
    rows = cells(spark, sf_dir).groupBy("case_id", "doc_idx", "claim_number").agg(F.collect_list(F.struct("label", "judgment")).alias("items"))
    files = rows.groupBy("case_id", "doc_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("claim_number").cast("string"), "items"))).alias("m"))
    body = F.concat(F.lit('{"_meta": [1], "notes": {"a": 1}, '), F.expr("substring(to_json(m), 2)"))
    files = files.select("case_id", "doc_idx", F.when(F.col("doc_idx") == 3, F.expr("substring(to_json(m), 1, 9)")).otherwise(body).alias("body"))
    out = tables.cached_judgments(files)
    return out.select("case_id", "doc_idx", "claim_number", F.variant_get("item", "$.label", "string").alias("label"), F.variant_get("item", "$.judgment", "string").alias("judgment"))
