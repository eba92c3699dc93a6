"""Queries of whole claim sets and of relations that claims state, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import claim_sets, relations
from claimweave.plans.registry import query
from claimweave.sources import fixtures as fx


def sets_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set for every document: its sentences as claims under headers of five forms or none, every fifth under a number that goes back."""
    k = F.col("doc_id") % 6

    def claim(s, i):
        n = F.when(i % 5 == 3, 1).otherwise(i + 1).cast("string")
        body = F.concat(F.when(i % 3 == 1, "제 1 항에 있어서, ").otherwise(""), s)
        head = F.when(k == 0, F.concat(F.lit("청구항 "), n, F.lit("\n"))).when(k == 1, F.concat(F.lit(" 제 "), n, F.lit(" 항.\n"))).when(k == 2, F.concat(F.lit("【청구항 "), n, F.lit("】 "))).when(k == 3, F.concat(F.lit("[claim "), n, F.lit("]. "))).when(k == 4, F.concat(n, F.lit(". "))).otherwise("")
        return F.concat(head, body)

    pieces = F.array_join(F.transform(F.split("text", r"\. "), claim), "\n")
    return fx.document_texts(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, "What is claimed\n").otherwise(""), pieces).alias("text"))


SETS = r"""pieces AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '. ')) AS s, generate_subscripts(string_split(coalesce(text, ''), '. '), 1) - 1 AS i FROM documents),
told AS (SELECT doc_id, i, CASE WHEN i % 5 = 3 THEN 1 ELSE i + 1 END AS n, CASE WHEN i % 3 = 1 THEN '제 1 항에 있어서, ' ELSE '' END || s AS body FROM pieces),
sets AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'What is claimed' || chr(10) ELSE '' END || string_agg(CASE doc_id % 6 WHEN 0 THEN '청구항 ' || n || chr(10) WHEN 1 THEN ' 제 ' || n || ' 항.' || chr(10)
  WHEN 2 THEN '【청구항 ' || n || '】 ' WHEN 3 THEN '[claim ' || n || ']. ' WHEN 4 THEN n || '. ' ELSE '' END || body, chr(10) ORDER BY i) AS text FROM told GROUP BY doc_id),
given AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM sets),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM given WHERE text <> ''),
marks AS (SELECT *, regexp_extract(trim(line), '^(?:【\s*청구항\s*([0-9]+)\s*】[.．]?\s*(.*)|\[\s*(?i:claim)\s*([0-9]+)\s*\][.．]?\s*(.*)|청구항\s*([0-9]+)[.．]?\s*|제\s*([0-9]+)\s*항[.．]?\s*)$', ['a', 'ta', 'b', 'tb', 'c', 'd']) AS m FROM lines),
heads AS (SELECT *, TRY_CAST(m.a || m.b || m.c || m.d AS BIGINT) AS number, m.ta || m.tb AS inline FROM marks),
before AS (SELECT doc_id, pos, number > coalesce(lag(number) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS opens FROM heads WHERE number IS NOT NULL),
runs AS (SELECT h.*, coalesce(opens, false) AS opens, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM heads h LEFT JOIN before USING (doc_id, pos)),
headed AS (SELECT doc_id, run, max(number) FILTER (opens) AS claim_number, regexp_replace(string_agg(CASE WHEN opens THEN inline ELSE line END, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM runs WHERE run > 0 GROUP BY ALL HAVING regexp_replace(string_agg(CASE WHEN opens THEN inline ELSE line END, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') <> ''),
stops AS (SELECT *, count(*) FILTER (regexp_matches(line, '^(청구항\s*)?[0-9]+[.．][ \t]')) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM headed)),
parts AS (SELECT doc_id, run, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS part FROM stops GROUP BY ALL HAVING regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') <> ''),
plain AS (SELECT doc_id, run, TRY_CAST(regexp_extract(part, '^(?:청구항\s*)?([0-9]+)[.．]', 1) AS BIGINT) AS claim_number, regexp_replace(regexp_replace(part, '^(청구항\s*)?[0-9]+[.．][ \t]*', ''), '^\s+|\s+$', '', 'g') AS text FROM parts WHERE doc_id IN (SELECT doc_id FROM parts GROUP BY 1 HAVING count(*) > 1)),
either AS (SELECT * FROM headed UNION ALL SELECT * FROM plain WHERE claim_number IS NOT NULL),
every AS (SELECT * FROM either UNION ALL SELECT doc_id, 0, 1, text FROM given WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM either))"""


@query("WITH " + SETS + r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS place, claim_number, CASE WHEN regexp_matches(text, '(제\s*[0-9]+\s*항|청구항\s*[0-9]+)에\s*있어서|청구항\s*[0-9]+\s*(내지|또는)\s*(청구항\s*)?[0-9]+.*있어서') THEN 'dependent' ELSE 'independent' END AS claim_type, md5(text) AS text_md5 FROM every""")
def claim_sets_split(spark, sf_dir):
    out = claim_sets.split_claims(sets_of_claims(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "place", "claim_number", "claim_type", F.md5("text").alias("text_md5"))


#: What claims and evidence say; which rule a claim calls for, and what evidence holds, is worked out by hand in the oracle.
CLAIM_SAYS = ("영상 정보를 제어 정보로 변환하는 변환부", "설치 환경에 따른 오차를 보정하는 보정부", "현재 동작 상태에 따라 방향 전환 여부를 결정하는 판단부", "결정 결과 및 보정부의  출력값에 따라 카메라를 제어하는 제어부", "광을 감지하는 센서", "a sensor that converts light")
EVIDENCE_SAYS = ("values are converted into a coordinate system", "the mounted camera, corrected along its axis", "an installed camera", "the coordinate deviation is compensated", "the current mode is considered\nto decide a turn", "the decision result", "both the decision result and the output value, used as input", "")


def relation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim of two phrases, evidence of two phrases, directness and up to six missing limitations for every part."""
    k, n = F.col("p_partkey"), F.col("p_size")
    said = lambda phrases, *at: F.concat_ws(", ", *[F.element_at(F.array(*map(F.lit, phrases)), (a % len(phrases) + 1).cast("int")) for a in at])
    missing = F.transform(F.slice(F.sequence(F.lit(0), n % 7), F.lit(2), F.lit(6)), lambda i: F.concat(F.lit("m"), i.cast("string")))
    return fx.read(spark, sf_dir, "part").select(
        k.cast("long").alias("part_id"), said(CLAIM_SAYS, k, F.floor(k / 6)).alias("claim"), said(EVIDENCE_SAYS, F.floor(k / 36), n).alias("evidence"),
        F.element_at(F.array(*map(F.lit, ("direct", "inferred", "absent"))), (n % 3 + 1).cast("int")).alias("directness"), missing.alias("missing"),
    )


RELATIONS = """says AS (SELECT p_partkey, p_size, [p_partkey % 6, p_partkey // 6 % 6] AS c, [p_partkey // 36 % 8, p_size % 8] AS e FROM part),
holds AS (SELECT *, list_contains(e, 0) AS h1, list_contains(e, 1) OR (list_contains(e, 2) AND list_contains(e, 3)) AS h2, list_contains(e, 4) AS h3, list_contains(e, 6) AS h4 FROM says),
fired AS (SELECT *, list_filter([CASE WHEN list_contains(c, 0) AND NOT h1 THEN '{0}' END, CASE WHEN list_contains(c, 1) AND NOT h2 THEN '{1}' END, CASE WHEN list_contains(c, 2) AND NOT h3 THEN '{2}' END, CASE WHEN list_contains(c, 3) AND NOT h4 THEN '{3}' END], lambda x: x IS NOT NULL) AS found FROM holds)""".format(*[name for *_, name in relations.RULES])


@query("WITH " + RELATIONS + """
SELECT CAST(p_partkey AS BIGINT) AS part_id, CASE WHEN p_size % 3 = 0 THEN CASE WHEN len(found) > 0 THEN 'inferred' ELSE 'direct' END WHEN p_size % 3 = 1 THEN 'inferred' ELSE 'absent' END AS directness,
  array_to_string((list_transform(range(1, p_size % 7 + 1), lambda i: 'm' || i) || found)[:greatest(5, p_size % 7)], '|') AS missing FROM fired""")
def stated_relations(spark, sf_dir):
    guard = relations.relation_guard(F.col("claim"), F.col("evidence"), F.col("directness"), F.col("missing"))
    return relation_claims(spark, sf_dir).select("part_id", guard.alias("g")).select("part_id", "g.directness", F.array_join("g.missing", "|").alias("missing"))
