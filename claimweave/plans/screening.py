"""Queries of screening, chains built level by level and layout sources, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import chains, reports, responses, scoring, screening
from claimweave.operators import claims as claim_ops
from claimweave.plans.registry import CHAIN, dense, cells, chained, query
from claimweave.sources import fixtures as fx
from claimweave.sources import layout

CLAIM = ["case_id", "claim_number"]
LONG_TEXT = "a plate and a hinge " * 6


@query(fx.ctes("""w AS (SELECT case_id, claim_number, doc_idx, 'f' || doc_idx AS filename, (case_id * 7 + doc_idx * 131 + claim_number * 53) % 500 AS n_chars FROM claims JOIN docs USING (case_id)),
s AS (SELECT *, count(*) OVER c AS n, sum(length('[doc_index=' || doc_idx || '] ' || filename) + 1) OVER c + 7 * (count(*) OVER c - 1) AS around, sum(n_chars) OVER c AS texts FROM w WINDOW c AS (PARTITION BY case_id, claim_number))""") + """
SELECT case_id, claim_number, doc_idx, around + texts <= 1300 AS whole, CAST(CASE WHEN around + texts > 1300 THEN greatest(150, floor((1300 - around) / n)) END AS BIGINT) AS budget FROM s""")
def document_budgets(spark, sf_dir):
    """Made-up lengths under 500 characters against a total of 1 300."""
    work = fx.claims(spark, sf_dir).select(*CLAIM).join(fx.case_documents(spark, sf_dir), "case_id")
    size = (F.col("case_id") * 7 + F.col("doc_idx") * 131 + F.col("claim_number") * 53) % 500
    docs = work.withColumns({"filename": F.concat(F.lit("f"), F.col("doc_idx").cast("string")), "n_chars": size})
    return screening.document_budgets(docs, 1_300, 150).select(*CLAIM, "doc_idx", "whole", "budget")


@query(fx.ctes("e AS (SELECT case_id, claim_number, 2 * count(*) AS n, 2 * count(*) FILTER (is_generic OR is_simple) AS g FROM elements GROUP BY ALL)") + "\nSELECT case_id, claim_number, n * 5 >= 20 AND g < n AND g >= 2 AS staged FROM e")
def staged_claims(spark, sf_dir):
    """Every element stands for two, as a claim of the table has three at most."""
    twice = fx.elements(spark, sf_dir).withColumn("half", F.explode(F.array(F.lit(1), F.lit(2))))
    return screening.staged_claims(twice, fx.case_documents(spark, sf_dir), F.col("is_generic") | F.col("is_simple"))


@query(fx.ctes("""f AS (SELECT *, CASE WHEN NOT has_quote OR directness = 'absent' THEN 0.0::DOUBLE WHEN directness = 'inferred' THEN 0.65 ELSE 1.0 END AS fac, importance::DOUBLE AS w FROM scored WHERE NOT (is_generic OR is_simple)),
g AS (SELECT case_id, claim_number, doc_idx, round(sum(w * base_sim * fac) / sum(w) + 1e-11, 9) AS score, round(coalesce(sum(w) FILTER (base_sim >= 0.55 AND fac > 0), 0) / sum(w) + 1e-11, 9) AS coverage,
  bool_and(judgment IN ('identical', 'substantially_identical') AND has_quote AND directness = 'direct' AND missing_count = 0) AS complete FROM f GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, claim_number ORDER BY score DESC, coverage DESC, doc_idx) AS INTEGER) AS rank FROM g)""") + "\nSELECT case_id, claim_number, doc_idx, score, coverage, complete, rank FROM r WHERE complete OR rank <= 2")
def core_candidates(spark, sf_dir):
    return screening.core_candidates(dense(spark, sf_dir), ~(F.col("is_generic") | F.col("is_simple")))


SECOND = """hit AS (SELECT s.case_id, s.claim_number, s.doc_idx, s.label, s.importance, (c.quote_len % 5) / 4.0::DOUBLE AS overlap FROM scored s JOIN cells c USING (case_id, claim_number, doc_idx, label)
  WHERE (s.case_id + ascii(s.label)) % 3 <> 0 AND NOT (s.judgment IN ('identical', 'substantially_identical') AND s.missing_count = 0) AND (c.quote_len % 5) / 4.0 >= 0.55),
looks AS (SELECT case_id, claim_number, doc_idx, round(sum(overlap * importance) + 1e-11, 9) AS score, string_agg(label, ',' ORDER BY label) AS labels FROM hit GROUP BY ALL)"""


def texts_dense(spark, sf_dir):
    kinds = F.array(F.lit("a housing"), F.lit("adjust an image within the coordinate system"), F.lit(LONG_TEXT))
    return dense(spark, sf_dir).withColumn("text", F.element_at(kinds, ((F.col("case_id") + F.ascii("label")) % 3 + 1).cast("int")))


@query(fx.ctes(SECOND) + "\nSELECT * FROM (SELECT case_id, claim_number, doc_idx, score, labels, CAST(row_number() OVER (PARTITION BY case_id, claim_number ORDER BY score DESC, doc_idx) AS INTEGER) AS rank FROM looks) WHERE rank <= 2")
def second_look(spark, sf_dir):
    """Elements of three texts, of which one is no compound; overlaps from the cells; two documents a claim."""
    overlaps = cells(spark, sf_dir).select(*fx.KEY, ((F.col("quote_len") % 5) / 4).alias("overlap"))
    return screening.second_look(texts_dense(spark, sf_dir), overlaps, most=2)


@query(fx.ctes("""work AS (SELECT case_id, claim_number, claim_type, doc_idx, claim_number % 3 = 0 AND doc_idx < 2 AS is_cached, claim_number % 3 = 0 AS partly FROM claims JOIN docs USING (case_id))""") + """
SELECT case_id, claim_number, doc_idx, CASE WHEN partly OR (case_id % 5 = 0 AND claim_number > 4) THEN 'per_document' WHEN claim_type = 'independent' AND case_id % 2 = 0 THEN 'core_first' ELSE 'integrated' END AS route FROM work WHERE NOT is_cached""")
def comparison_routes(spark, sf_dir):
    """Every third claim has two documents cached; claims of even cases are staged; the later claims of every fifth case failed."""
    claims = fx.claims(spark, sf_dir)
    work = claims.join(fx.case_documents(spark, sf_dir), "case_id").withColumn("is_cached", (F.col("claim_number") % 3 == 0) & (F.col("doc_idx") < 2))
    staged = claims.select(*CLAIM, (F.col("case_id") % 2 == 0).alias("staged"))
    return screening.comparison_routes(work, "mixed", staged, claims.filter("case_id % 5 = 0 and claim_number > 4"))


@query(fx.ctes("""b AS (SELECT case_id, claim_number, label, importance, max(base_sim) AS best FROM scored WHERE doc_idx <= 2 GROUP BY ALL),
m AS (SELECT *, importance >= 4 AND best < 0.35 AS crit, bool_or(importance >= 4 AND best < 0.35) OVER (PARTITION BY case_id, claim_number) AS any_crit FROM b),
t AS (SELECT case_id, claim_number, label, importance, CASE WHEN case_id % 4 = 0 THEN CASE WHEN label = 'B' THEN 'requested' END WHEN any_crit THEN CASE WHEN crit THEN 'critical' END WHEN best < 0.55 THEN 'uncovered' END AS reason FROM m)""") + "\nSELECT * FROM t WHERE reason IS NOT NULL")
def search_targets(spark, sf_dir):
    """Documents 0 to 2 count; in every fourth case the labels b and Z are requested."""
    asked = fx.claims(spark, sf_dir).filter("case_id % 4 = 0").select(*CLAIM, F.explode(F.array(F.lit(" b"), F.lit("Z"), F.lit(" "))).alias("label"))
    return screening.search_targets(dense(spark, sf_dir).filter("doc_idx <= 2"), asked)


@query(fx.ctes("""o AS (SELECT s.*, CASE judgment WHEN 'identical' THEN 5 WHEN 'substantially_identical' THEN 4 WHEN 'partial_difference' THEN 3 WHEN 'partial_similarity' THEN 2 WHEN 'difference' THEN 1 ELSE 0 END AS r
  FROM scored s JOIN claims c USING (case_id, claim_number) WHERE c.claim_type = 'independent' AND s.doc_idx <> 0 AND s.doc_idx <> 1 + s.case_id % 3),
d AS (SELECT case_id, claim_number, doc_idx, label, row_number() OVER (PARTITION BY case_id, claim_number, doc_idx ORDER BY r, pos) AS rn FROM o WHERE NOT not_evaluated AND r < 4),
dl AS (SELECT case_id, claim_number, doc_idx, string_agg(label, ',' ORDER BY rn) AS differing_labels FROM d WHERE rn <= 2 GROUP BY ALL),
c AS (SELECT case_id, claim_number, doc_idx, label AS closest_label FROM (SELECT *, row_number() OVER (PARTITION BY case_id, claim_number, doc_idx ORDER BY has_quote DESC, r DESC, pos) AS rn FROM o WHERE NOT not_evaluated AND r > 0) WHERE rn = 1),
a AS (SELECT case_id, claim_number, doc_idx, bool_or(NOT not_evaluated) AS kept FROM o GROUP BY ALL)""") + """
SELECT case_id, claim_number, doc_idx, CASE WHEN NOT kept THEN 'not_stored' WHEN closest_label IS NOT NULL THEN 'related' ELSE 'nothing_similar' END AS status, closest_label, coalesce(differing_labels, '') AS differing_labels
FROM a LEFT JOIN c USING (case_id, claim_number, doc_idx) LEFT JOIN dl USING (case_id, claim_number, doc_idx)""")
def unselected_documents(spark, sf_dir):
    return screening.unselected_documents(dense(spark, sf_dir), chained(spark, sf_dir), fx.claims(spark, sf_dir).filter("claim_type = 'independent'"))


def _added(name: str, inherited: str) -> str:
    """Table expressions of what the claims of `inherited` (case_id, claim_number, doc_idx) add."""
    return f"""{name}_h AS (SELECT s.*, i.doc_idx IS NOT NULL AS held, coalesce(max(gap_rank) FILTER (i.doc_idx IS NOT NULL) OVER (PARTITION BY s.case_id, s.claim_number, label), 0) AS had
  FROM scored s LEFT JOIN {inherited} i USING (case_id, claim_number, doc_idx) WHERE (s.case_id, s.claim_number) IN (SELECT (case_id, claim_number) FROM {inherited})),
{name}_t AS (SELECT *, bool_or(had < 3) OVER (PARTITION BY case_id, claim_number) AS hard FROM {name}_h),
{name}_g AS (SELECT case_id, claim_number, doc_idx, hard, round((0.75 * sum(importance * greatest(0, gap_rank - had) / 5.0::DOUBLE) + 0.25 * sum(importance * greatest(0, gap_rank - had) / 5.0::DOUBLE * selection_factor)) / sum(importance) + 1e-11, 9) AS gain,
  bool_and(gap_rank >= CASE WHEN hard THEN 3 ELSE 4 END) AS full_, bool_or(has_quote AND gap_rank > had) AS better, bool_and(has_quote AND gap_rank >= 2) AS rescue, max(gap_rank) AS top, count(*) AS n
  FROM {name}_t WHERE NOT held AND CASE WHEN hard THEN had < 3 ELSE had = 3 END GROUP BY ALL),
{name}_u AS (SELECT DISTINCT case_id, claim_number, doc_idx FROM scored WHERE has_quote AND gap_rank >= 3),
{name}_s AS (SELECT g.*, CASE WHEN gain > 0 AND better AND full_ THEN 2 WHEN gain > 0 AND better THEN 1 WHEN n = 1 AND rescue THEN 0 END AS tier, CASE WHEN gain > 0 AND better THEN round(gain * 100 + 1e-9, 2) ELSE top::DOUBLE END AS score,
  CASE WHEN gain > 0 AND better THEN (SELECT count(*) FROM {name}_u u WHERE u.case_id = g.case_id AND u.doc_idx = g.doc_idx AND u.claim_number <> g.claim_number) ELSE 0 END AS reuse FROM {name}_g g),
{name} AS (SELECT case_id, claim_number, doc_idx, CASE WHEN tier < 2 THEN 'partial_support' WHEN hard THEN 'fills_gaps' ELSE 'improves' END AS basis, score
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, claim_number ORDER BY tier DESC, score DESC, reuse DESC, doc_idx) AS rn FROM {name}_s WHERE tier IS NOT NULL) WHERE rn = 1)"""


@query(fx.ctes("given AS (SELECT case_id, claim_number, doc_idx FROM claims JOIN docs USING (case_id) WHERE claim_type = 'dependent' AND doc_idx <= 1)", _added("more", "given")) + "\nSELECT * FROM more")
def dependent_added(spark, sf_dir):
    """Dependents inherit documents 0 and 1."""
    dependents = fx.claims(spark, sf_dir).filter("claim_type = 'dependent'").select(*CLAIM)
    return chains.added_documents(dense(spark, sf_dir), dependents.join(fx.case_documents(spark, sf_dir).filter("doc_idx <= 1"), "case_id"))


LEVELS = ["l0 AS (SELECT case_id, claim_number, [0, 1 + case_id % 3] AS total, CAST(NULL AS BIGINT) AS added FROM claims WHERE claim_type = 'independent')"]
for _k in (1, 2):
    LEVELS += [
        f"b{_k} AS (SELECT c.case_id, c.claim_number, l.total AS given FROM claims c JOIN l{_k - 1} l ON l.case_id = c.case_id AND l.claim_number = c.parent_claim WHERE c.claim_type = 'dependent')",
        f"x{_k} AS (SELECT case_id, claim_number, CAST(unnest(given) AS BIGINT) AS doc_idx FROM b{_k})",
        _added(f"m{_k}", f"x{_k}"),
        f"l{_k} AS (SELECT b.case_id, b.claim_number, CASE WHEN m.doc_idx IS NULL THEN given ELSE list_append(given, m.doc_idx) END AS total, m.doc_idx AS added FROM b{_k} b LEFT JOIN m{_k} m USING (case_id, claim_number))",
    ]


@query(fx.ctes(*LEVELS) + "\nSELECT case_id, claim_number, array_to_string(total, ',') AS total, added FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)")
def built_chains(spark, sf_dir):
    """Independent claims select documents 0 and 1 to 3; the trees of the table are three levels deep."""
    claims = fx.claims(spark, sf_dir)
    selected = claims.filter("claim_type = 'independent'").select(*CLAIM, F.lit(0).cast("long").alias("primary_idx"), (1 + F.col("case_id") % 3).alias("secondary_idx"))
    out = chains.built_chains(dense(spark, sf_dir), claims, selected)
    return out.select(*CLAIM, F.array_join(F.col("total").cast("array<string>"), ",").alias("total"), "added")


@query(fx.ctes(CHAIN, """i AS (SELECT case_id, claim_number, CAST(0 AS BIGINT) AS p, 1 + case_id % 3 AS s, case_id % 3 = 0 AND claim_number = 1 AS held, case_id % 7 AS d FROM claims WHERE claim_type = 'independent')""") + """
SELECT case_id, claim_number, CASE WHEN NOT held THEN p WHEN d > 4 THEN 2 ELSE d END AS primary_idx, CASE WHEN NOT held THEN s WHEN d > 4 OR d = 2 THEN NULL ELSE 2 END AS secondary_idx,
  CASE WHEN held THEN p END AS proposed_primary, CASE WHEN held THEN s END AS proposed_secondary, held AS locked FROM i""")
def locked_pairs(spark, sf_dir):
    """Every third case has locks: for claim 1 of this version, for claim 5 of another; documents 5 and 6 do not exist."""
    pairs = fx.claims(spark, sf_dir).filter("claim_type = 'independent'").select(*CLAIM, F.lit(0).cast("long").alias("primary_idx"), (1 + F.col("case_id") % 3).alias("secondary_idx"))
    own = F.col("case_id") % 7
    locks = pairs.filter("case_id % 3 = 0").select(*CLAIM, F.when(F.col("claim_number") == 1, "v2").otherwise("v1").alias("version"), F.array(own, F.lit(2).cast("long"), own).alias("total"))
    return chains.locked_pairs(pairs, locks, fx.case_documents(spark, sf_dir), "v2")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i // 3 + 1 AS VARCHAR) AS page, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i) || chr(10)) AS text_sha256 FROM l WHERE i % 5 <> 4 AND regexp_matches(line, '\\S') GROUP BY ALL""")
def layout_pages(spark, sf_dir):
    """Every document as an element tree with a line for each element: a third of them within lists, a fifth headers."""
    item = lambda x, i, a, b: F.struct(F.lit("item").alias("type"), (F.floor(i / 3) + 1).alias(a), x.alias(b))

    def element(x, i):
        skipped, nested = i % 5 == 4, i % 3 == 1
        below = F.when(nested, F.array(item(x, i, "page", "text")))
        return F.struct(F.when(skipped, "header").otherwise("paragraph").alias("type"), (F.floor(i / 3) + 1).alias("page number"), F.when(~nested, x).alias("content"), below.alias("list items"))

    tree = F.struct(F.transform(F.split("text", "\n"), element).alias("kids"))
    lines = layout.layout_lines(fx.read(spark, sf_dir, "documents").select("doc_id", F.to_json(tree).alias("body")))
    n = lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))
    return layout.layout_pages(lines).join(n, ["doc_id", "page"]).select("doc_id", "page", "n_lines", F.sha2("page_text", 256).alias("text_sha256"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_partkey % 10 = 9 THEN 'f' WHEN p_partkey % 3 = 2 THEN 'Named ' || p_partkey || ' anew' ELSE 'Named ' || p_partkey || ' anew and more' END AS title FROM part""")
def layout_titles(spark, sf_dir):
    """First pages with a large journal line, a title of one or two lines and small words; a tenth has small words alone."""
    k = F.col("p_partkey").cast("long")
    size = 12 + (k % 3) * 0.6
    line = lambda n, at, text, size: F.struct(F.lit(n).alias("line"), F.lit(at).alias("span"), text.alias("text"), size.cast("double").alias("size"))
    named = [line(1, 1, F.concat(k.cast("string"), F.lit(" anew ")), F.lit(3)), line(1, 0, F.lit(" Named "), size), line(2, 0, F.lit("and  more"), F.lit(12.4))]
    always = [line(0, 0, F.lit("JOURNAL  OF things"), F.lit(30)), line(3, 0, F.lit("a b"), F.lit(40)), line(4, 0, F.lit("words"), F.lit(5))]
    spans = fx.read(spark, sf_dir, "part").select(k.alias("doc_id"), F.explode(F.when(k % 10 == 9, F.array(*always)).otherwise(F.array(*named, *always))).alias("s")).select("doc_id", "s.*")
    docs = fx.read(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit("f").alias("fallback"))
    return layout.layout_titles(docs, spans).select("doc_id", "title")


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part),
r AS (SELECT k AS doc_id, unnest(['0001', '0002', '0003']) AS no, k FROM p)
SELECT doc_id, doc_id || '-P-' || no AS chunk_id, CASE no WHEN '0001' THEN 2 WHEN '0002' THEN 3 END AS page_no, CASE WHEN no = '0001' THEN 'FIELD' ELSE CASE WHEN k % 5 = 0 THEN '청구범위' ELSE 'FIELD' END END AS section,
  '[' || no || '] ' || CASE no WHEN '0001' THEN 'first words of ' || k || ' in 도 3a' WHEN '0002' THEN CASE WHEN k % 2 = 0 THEN 'second words of ' || k ELSE 'lost words' END ELSE 'third words' END AS original_text
FROM r WHERE NOT (no <> '0001' AND k % 5 = 0) AND NOT (no = '0003' AND k % 3 = 0)""")
def paragraph_chunks(spark, sf_dir):
    """Three paragraphs on made-up pages: found by words, by words or their marker, and not at all; some are claims."""
    k = F.col("p_partkey").cast("long")
    s = k.cast("string")
    docs = fx.read(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit("P").alias("publication_no"), F.lit("t").alias("title"))
    first, second = F.concat(F.lit("first words of "), s, F.lit(" in 도 3a")), F.concat(F.lit("second words of "), s)
    third = F.when(k % 3 == 0, "1. third words").otherwise("third words")
    each = lambda name, *pairs: fx.read(spark, sf_dir, "part").select(k.alias("doc_id"), F.explode(F.array(*[F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in zip(name, p)]) for p in pairs])).alias("e")).select("doc_id", "e.*")
    pages = each(("page_no", "page_text"), (1, "cover"), (2, F.concat(F.lit("[0001] "), first)), (3, F.concat(F.lit("【0002】\n"), second)))
    paragraphs = each(("paragraph_no", "paragraph", "at"), ("0001", first, 10), ("0002", F.when(k % 2 == 0, second).otherwise("lost words"), 20), ("0003", third, 30))
    headings = each(("at", "heading"), (5, "FIELD"), (15, F.when(k % 5 == 0, "청구범위").otherwise("FIELD")))
    records = layout.paragraph_records(docs, paragraphs, pages, headings)
    return layout.paragraph_chunks(records).select("doc_id", "chunk_id", "page_no", "section", "original_text")


@query(fx.ctes("given AS (SELECT case_id, claim_number, doc_idx FROM claims JOIN docs USING (case_id) WHERE claim_type = 'dependent' AND doc_idx <= 1)", _added("more", "given"), """lab AS (SELECT s.case_id, s.claim_number, label, coalesce(max(gap_rank) FILTER (s.doc_idx <= 1), 0) AS had, coalesce(max(gap_rank) FILTER (s.doc_idx <= 1 OR s.doc_idx = m.doc_idx), 0) AS has, bool_or(NOT not_evaluated) AS judged
  FROM scored s JOIN claims c USING (case_id, claim_number) LEFT JOIN more m ON m.case_id = s.case_id AND m.claim_number = s.claim_number WHERE c.claim_type = 'dependent' GROUP BY ALL),
per AS (SELECT case_id, claim_number, string_agg(label, ',' ORDER BY label) AS evaluated_labels, coalesce(string_agg(label, ',' ORDER BY label) FILTER (has < 3), '') AS remaining_labels, bool_or(judged) AS judged, bool_or(had <= 3) AS open_ FROM lab GROUP BY ALL)""") + """
SELECT case_id, claim_number, CASE WHEN NOT judged THEN 'evidence_missing' WHEN NOT open_ THEN 'covered_by_inherited' ELSE coalesce(basis, 'no_candidate') END AS basis, evaluated_labels, remaining_labels FROM per LEFT JOIN more USING (case_id, claim_number)""")
def dependent_basis(spark, sf_dir):
    """Dependents inherit documents 0 and 1."""
    rows, dependents = dense(spark, sf_dir), fx.claims(spark, sf_dir).filter("claim_type = 'dependent'").select(*CLAIM)
    inherited = dependents.join(fx.case_documents(spark, sf_dir).filter("doc_idx <= 1"), "case_id")
    return chains.dependent_basis(rows, inherited, chains.added_documents(rows, inherited))


@query(fx.ctes("""pr AS (SELECT case_id, claim_number, CASE claim_number WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 7 WHEN 7 THEN 8 WHEN 8 THEN 6 WHEN 4 THEN 9 END AS same_as FROM claims WHERE claim_number NOT IN (1, 5)),
hops AS (SELECT case_id, claim_number, same_as AS node, same_as AS low, 1 AS n FROM pr UNION ALL SELECT h.case_id, h.claim_number, p.same_as, least(h.low, p.same_as), n + 1 FROM hops h JOIN pr p ON p.case_id = h.case_id AND p.claim_number = h.node WHERE n < 9),
ends AS (SELECT case_id, claim_number, max(n) AS n, arg_max(node, n) AS node, arg_max(low, n) AS low FROM hops GROUP BY ALL),
roots AS (SELECT case_id, claim_number, CASE WHEN n = 9 THEN low ELSE node END AS root FROM ends)""") + """
SELECT case_id, CAST(root AS BIGINT) AS root, claim_number FROM roots UNION SELECT case_id, root, root FROM roots""")
def equivalent_claims(spark, sf_dir):
    """Claims 2 and 3 lead to 1, 6 to 8 come round, 4 is the same as one that does not exist."""
    claims = fx.claims(spark, sf_dir)
    same = F.create_map(*[F.lit(x).cast("long") for pair in {2: 1, 3: 2, 6: 7, 7: 8, 8: 6, 4: 9}.items() for x in pair])
    pairs = claims.filter("claim_number not in (1, 5)").select(*CLAIM, same[F.col("claim_number")].alias("same_as"))
    return claim_ops.equivalent_claims(claims, pairs)


@query(fx.ctes("""ch AS (SELECT case_id, claim_number, unnest(CASE WHEN claim_number = 1 THEN [1 + case_id % 3] ELSE [3, 0] END) AS doc_idx, unnest(CASE WHEN claim_number = 1 THEN [0] ELSE [0, 1] END) AS turn, claim_number = 1 AS alone FROM claims WHERE claim_type = 'independent'),
j AS (SELECT s.*, turn, alone FROM scored s JOIN ch USING (case_id, claim_number, doc_idx)),
sd AS (SELECT case_id, claim_number, turn, doc_idx || ':' || array_to_string((list(label ORDER BY pos))[1:3], '') || '+' || greatest(0, count(*) - 3) AS t FROM j WHERE judgment NOT IN ('difference', 'none') GROUP BY case_id, claim_number, turn, doc_idx),
ss AS (SELECT case_id, claim_number, string_agg(t, ' ' ORDER BY turn) AS resembling FROM sd GROUP BY ALL),
op AS (SELECT case_id, claim_number, alone, label, pos, bool_or(judgment IN ('identical', 'substantially_identical') AND missing_count = 0) AS closed FROM j GROUP BY ALL),
oo AS (SELECT case_id, claim_number, alone, coalesce(string_agg(label, ',' ORDER BY pos) FILTER (NOT closed), '') AS remaining_labels FROM op GROUP BY ALL)""") + """
SELECT case_id, claim_number, coalesce(resembling, '') AS resembling, remaining_labels, CASE WHEN alone THEN CASE WHEN remaining_labels = '' THEN 'one_discloses_all' ELSE 'one_leaves_open' END WHEN remaining_labels = '' THEN 'combination_covers_all' ELSE 'combination_leaves_open' END AS conclusion FROM oo LEFT JOIN ss USING (case_id, claim_number)""")
def claim_summaries(spark, sf_dir):
    """Claim 1 rests on one document, claim 5 on documents 3 and 0."""
    own = F.when(F.col("claim_number") == 1, F.array(1 + F.col("case_id") % 3)).otherwise(F.array(F.lit(3).cast("long"), F.lit(0).cast("long")))
    out = reports.claim_summaries(dense(spark, sf_dir), fx.claims(spark, sf_dir).filter("claim_type = 'independent'").select(*CLAIM, own.alias("total")))
    said = F.transform("similar", lambda s: F.concat(s["document"].cast("string"), F.lit(":"), F.array_join(s["labels"], ""), F.lit("+"), s["more"].cast("string")))
    return out.select(*CLAIM, F.coalesce(F.array_join(said, " "), F.lit("")).alias("resembling"), "remaining_labels", "conclusion")


@query(fx.ctes("""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, claim_number, label ORDER BY CASE judgment WHEN 'difference' THEN 1 ELSE gap_rank END DESC, doc_idx) AS rn FROM scored) WHERE rn = 1 AND has_quote AND judgment <> 'none')""") + """
SELECT s.case_id, s.claim_number, s.label, s.doc_idx, s.judgment FROM scored s LEFT JOIN best b USING (case_id, claim_number, label)
WHERE s.has_quote AND s.judgment <> 'none' AND (s.doc_idx = b.doc_idx OR (s.doc_idx <= 2 AND (b.doc_idx IS NULL OR b.judgment IN ('partial_difference', 'partial_similarity', 'difference'))))""")
def dependent_quotes(spark, sf_dir):
    """The best match of every element, and documents 0 to 2 as the chain."""
    rows = dense(spark, sf_dir)
    return reports.dependent_quotes(scoring.best_matches(rows, "doc_idx").select(*fx.KEY, "judgment", "has_quote"), rows.filter("doc_idx <= 2").select(*fx.KEY, "judgment", "has_quote")).select(*fx.KEY, "judgment")


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part) SELECT k AS id, CASE WHEN k % 7 = 0 OR (k % 2 = 0 AND k % 3 = 1) OR (k % 5 = 1 AND k % 4 = 1) THEN 'inferred' ELSE 'direct' END AS directness,
  concat_ws('|', 'given', CASE WHEN k % 2 = 0 AND k % 3 = 1 THEN 'a minimum of ' || k END, CASE WHEN k % 5 = 1 AND k % 4 = 1 THEN '형상 파라미터를 실제로 조정하여 모델을 생성하는 실행 단계' END) AS missing FROM p""")
def value_guards(spark, sf_dir):
    """Claims of a minimum or an adjustment against evidence of averages and quotations that advise or act."""
    k = F.col("p_partkey").cast("long")
    element = F.concat_ws(", ", F.lit("a wall"), F.when(k % 2 == 0, F.concat(F.lit("a minimum of "), k.cast("string"))), F.when(k % 5 == 1, "adjusted in size"))
    evidence = F.when(k % 3 == 1, "an Average of 3").when(k % 3 == 2, "an average, not less  than 2").otherwise("a wall")
    quote = F.when(k % 4 == 1, "we recommend it").when(k % 4 == 2, "we suggest and modify it").otherwise("it is")
    rows = fx.read(spark, sf_dir, "part").select(k.alias("id"), element.alias("element_text"), evidence.alias("evidence_text"), quote.alias("quote"), F.when(k % 7 == 0, "inferred").otherwise("direct").alias("directness"), F.array(F.lit("given")).alias("missing_limitations"))
    return responses.value_guards(rows).select("id", "directness", F.array_join("missing_limitations", "|").alias("missing"))
