"""Evidence tables derived from the driver's TPC-H tables and documents, for queries and their oracles.

Every table has its Spark form and, beside it, the same rows as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS_PER_CASE = 5
KEY = ["case_id", "claim_number", "doc_idx", "label"]
CASE = "CAST(floor(l_orderkey / 8) AS BIGINT) AS case_id"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem, with repeated keys, dealt by case before columns are made of the line's.

    Every later key begins with the case, so that joins need not deal the rows again by all of it; Spark is told so.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus".split()
    return _judged(read(spark, sf_dir, "lineitem").selectExpr(*columns, CASE).repartition("case_id"))


def _judged(lines: DataFrame) -> DataFrame:
    q = F.col("l_quantity")
    judgment = F.when(q >= 44, "identical").when(q >= 33, "substantially_identical").when(q >= 23, "partial_difference").when(q >= 13, "partial_similarity").when(q >= 6, "difference").otherwise("none")
    return lines.select(
        "case_id",
        (F.col("l_orderkey") % 8 + 1).cast("long").alias("claim_number"),
        (F.col("l_suppkey") % DOCS_PER_CASE).cast("long").alias("doc_idx"),
        F.element_at(F.array(*map(F.lit, "ABC")), ((F.col("l_linenumber") - 1) % 3 + 1).cast("int")).alias("label"),
        judgment.alias("judgment"),
        F.when(F.col("l_returnflag") == "N", "direct").when(F.col("l_returnflag") == "R", "inferred").otherwise("absent").alias("directness"),
        ((F.col("l_linestatus") == "O") | (q >= 33)).alias("has_quote"),
        (F.col("l_linenumber") % 2 == 0).alias("has_location"),
        (F.col("l_suppkey") % 3 != 0).alias("has_reason"),
        (F.round(F.col("l_tax") * 100).cast("int") % 3).alias("missing_count"),
        (F.round(F.col("l_discount") * 100).cast("int") % 4).alias("evidence_count"),
        F.col("l_partkey").cast("long").alias("quote_len"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("seq"),
    )


def _of_cases(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The distinct values of some columns in every case, gathered in one row a case, so that they too are dealt by case."""
    rows = _judged(read(spark, sf_dir, "lineitem").selectExpr("*", CASE)).groupBy("case_id").agg(F.collect_set(F.struct(*columns)).alias("_s"))
    return rows.select("case_id", F.inline("_s"))


RAW = """raw AS (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS case_id, CAST(l_orderkey % 8 + 1 AS BIGINT) AS claim_number,
  CAST(l_suppkey % 5 AS BIGINT) AS doc_idx, chr(CAST(65 + (l_linenumber - 1) % 3 AS INTEGER)) AS label,
  CASE WHEN l_quantity >= 44 THEN 'identical' WHEN l_quantity >= 33 THEN 'substantially_identical' WHEN l_quantity >= 23 THEN 'partial_difference'
       WHEN l_quantity >= 13 THEN 'partial_similarity' WHEN l_quantity >= 6 THEN 'difference' ELSE 'none' END AS judgment,
  CASE l_returnflag WHEN 'N' THEN 'direct' WHEN 'R' THEN 'inferred' ELSE 'absent' END AS directness,
  (l_linestatus = 'O' OR l_quantity >= 33) AS has_quote, l_linenumber % 2 = 0 AS has_location, l_suppkey % 3 <> 0 AS has_reason,
  CAST(round(l_tax * 100) AS INTEGER) % 3 AS missing_count, CAST(round(l_discount * 100) AS INTEGER) % 4 AS evidence_count,
  CAST(l_partkey AS BIGINT) AS quote_len, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS seq FROM lineitem)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct labels of every claim, weighted and flagged."""
    mixed = F.col("case_id") * 8 + F.col("claim_number") - 1 + F.ascii("label")
    rows = _of_cases(spark, sf_dir, "claim_number", "label")
    return rows.select(
        "*",
        (F.ascii("label") - 65).alias("pos"),
        (1 + mixed % 5).cast("int").alias("importance"),
        (mixed % 4 == 0).alias("is_distinctive"),
        (mixed % 4 == 1).alias("is_generic"),
        (mixed % 4 == 2).alias("is_simple"),
    )


ELEMENTS = """elements AS (SELECT case_id, claim_number, label, ascii(label) - 65 AS pos,
  CAST(1 + (case_id * 8 + claim_number - 1 + ascii(label)) % 5 AS INTEGER) AS importance,
  (case_id * 8 + claim_number - 1 + ascii(label)) % 4 = 0 AS is_distinctive,
  (case_id * 8 + claim_number - 1 + ascii(label)) % 4 = 1 AS is_generic,
  (case_id * 8 + claim_number - 1 + ascii(label)) % 4 = 2 AS is_simple
  FROM (SELECT DISTINCT case_id, claim_number, label FROM raw))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims 1 and 5 of a case are independent; the others depend on 1, 2, 2, 5, 6 and 5."""
    parent = F.create_map(*[F.lit(x).cast("long") for pair in {2: 1, 3: 2, 4: 2, 6: 5, 7: 6, 8: 5}.items() for x in pair])
    rows = _of_cases(spark, sf_dir, "claim_number")
    return rows.select("*", F.when(F.col("claim_number").isin(1, 5), "independent").otherwise("dependent").alias("claim_type"), parent[F.col("claim_number")].alias("parent_claim"))


CLAIMS = """claims AS (SELECT case_id, claim_number, CASE WHEN claim_number IN (1, 5) THEN 'independent' ELSE 'dependent' END AS claim_type,
  CAST(CASE claim_number WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 6 THEN 5 WHEN 7 THEN 6 WHEN 8 THEN 5 END AS BIGINT) AS parent_claim
  FROM (SELECT DISTINCT case_id, claim_number FROM raw))"""


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr(CASE).distinct()
    return rows.select("case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DOCS_PER_CASE - 1).cast("long"))).alias("doc_idx"))


DOCS = "docs AS (SELECT case_id, CAST(unnest(range(0, 5)) AS BIGINT) AS doc_idx FROM (SELECT DISTINCT case_id FROM raw))"

CELLS = """cells AS (SELECT * EXCLUDE (rn) FROM (SELECT raw.*, row_number() OVER (PARTITION BY case_id, claim_number, doc_idx, label
  ORDER BY CASE judgment WHEN 'identical' THEN 5 WHEN 'substantially_identical' THEN 4 WHEN 'partial_difference' THEN 3 WHEN 'partial_similarity' THEN 2 WHEN 'difference' THEN 1 ELSE 0 END DESC,
  quote_len DESC, seq) AS rn FROM raw) WHERE rn = 1)"""

#: The dense matrix with its readings, as scoring.dense gives it.
DENSE = """dense AS (SELECT e.*, d.doc_idx, coalesce(c.judgment, 'none') AS judgment, coalesce(c.directness, 'absent') AS directness,
  coalesce(c.has_quote, false) AS has_quote, coalesce(c.has_location, false) AS has_location, coalesce(c.has_reason, false) AS has_reason,
  coalesce(c.missing_count, 0) AS missing_count, coalesce(c.evidence_count, 0) AS evidence_count, c.case_id IS NULL AS not_evaluated
  FROM elements e JOIN docs d USING (case_id) LEFT JOIN cells c USING (case_id, claim_number, doc_idx, label)),
base AS (SELECT *, CASE judgment WHEN 'identical' THEN 5 WHEN 'substantially_identical' THEN 4 WHEN 'partial_difference' THEN 3 WHEN 'partial_similarity' THEN 2 ELSE 0 END AS gap_rank,
  CASE judgment WHEN 'identical' THEN 1.0::DOUBLE WHEN 'substantially_identical' THEN 0.85 WHEN 'partial_difference' THEN 0.55 WHEN 'partial_similarity' THEN 0.35 WHEN 'difference' THEN 0.15 ELSE 0.0 END AS base_sim FROM dense),
sims AS (SELECT *, CASE WHEN evidence_count + missing_count = 0 THEN base_sim
  ELSE base_sim * (0.7::DOUBLE + 0.3::DOUBLE * evidence_count / (evidence_count + missing_count)) * CASE directness WHEN 'direct' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.9 ELSE 0.8 END END AS item_sim FROM base),
scored AS (SELECT *, CASE WHEN item_sim < 0.35 THEN 0.0 WHEN NOT has_quote THEN item_sim * 0.35::DOUBLE WHEN directness = 'absent' THEN 0.0 WHEN directness = 'inferred' THEN item_sim * 0.65::DOUBLE ELSE item_sim END AS direct_sim,
  0.55::DOUBLE + 0.25::DOUBLE * has_quote::INT + 0.10::DOUBLE * has_location::INT + 0.10::DOUBLE * has_reason::INT AS selection_factor,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.40::DOUBLE * CASE directness WHEN 'direct' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.7 ELSE 0.2 END
   + 0.25::DOUBLE * CASE WHEN has_quote OR has_location THEN 0.5::DOUBLE * has_quote::INT + 0.5::DOUBLE * has_location::INT ELSE 0.2 END
   + 0.25::DOUBLE * CASE WHEN missing_count = 0 AND directness = 'direct' THEN 0.9::DOUBLE WHEN missing_count = 0 THEN 0.5 ELSE 0.3 END
   + 0.10::DOUBLE * CASE WHEN has_reason AND has_quote THEN 1.0::DOUBLE WHEN has_reason THEN 0.6 ELSE 0.3 END
   - CASE WHEN directness = 'inferred' THEN 0.25::DOUBLE ELSE 0.0 END)) AS metric_factor FROM sims)"""


def ctes(*more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([RAW, ELEMENTS, CLAIMS, DOCS, CELLS, DENSE, *more])


#: Phrases of which the text of an element is made.
PHRASES = (
    "a housing", "a motor to drive a wheel", "a sensor", "an input", "an output or an input", "a processor to receive and store data", "a filter based on a threshold",
    "adjust the operating frequency", "a mode select branch", "a display", "an image and a coordinate system", "a controller to determine a condition",
)


def element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of one to three phrases, a weight and a flag for every part."""
    k = F.col("p_partkey")
    chosen = [F.element_at(F.array(*map(F.lit, PHRASES)), (n % len(PHRASES) + 1).cast("int")) for n in (k, F.floor(k / 12), F.col("p_size"))]
    text = F.array_join(F.slice(F.array(*chosen), F.lit(1), (k % 3 + 1).cast("int")), ", ")
    return read(spark, sf_dir, "part").select(k.cast("long").alias("element_id"), text.alias("text"), (F.col("p_size") % 8).cast("string").alias("weight"), (k % 10 == 0).alias("is_sub"))


ELEMENT_TEXTS = "texts AS (SELECT CAST(p_partkey AS BIGINT) AS element_id, array_to_string(([{0}[p_partkey % 12 + 1], {0}[CAST(floor(p_partkey / 12) AS BIGINT) % 12 + 1], {0}[p_size % 12 + 1]])[1:CAST(p_partkey % 3 + 1 AS BIGINT)], ', ') AS text, greatest(1, least(5, p_size % 8)) AS weight, p_partkey % 10 = 0 AS is_sub FROM part)".format(list(PHRASES))

#: What a response calls the judgments, in two ways.
SAID = {"identical": ("동일", "동일 95~100"), "substantially_identical": ("실질적 동일", "실질적 동일 90~94"), "partial_difference": ("일부 차이", "부분 대응"), "partial_similarity": ("일부 유사", "유사"), "difference": ("차이", "약한 관련성"), "none": ("대응 없음", "없음")}


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per claim with an item per raw row: canonical fields, other names for them, or a field left out; arrays in fences or nested objects."""
    rows = raw_judgments(spark, sf_dir)
    said = [F.create_map(*[F.lit(x) for code, names in SAID.items() for x in (code, names[k])])[F.col("judgment")] for k in (0, 1)]
    found, line = F.col("judgment") != "none", F.col("seq") % 100
    quote = F.when(found, F.concat(F.lit("words quoted from place "), F.col("seq").cast("string"))).otherwise("")
    own = F.struct(F.col("doc_idx").alias("doc_index"), F.col("label").alias("label"), found.alias("found"), quote.alias("quote"), F.lit("c1").alias("chunk_id"), said[0].alias("judgment"), F.lit("r").alias("판단_이유"))
    other = F.struct(F.col("doc_idx").cast("string").alias("document_index"), F.concat(F.lit("("), F.lower("label"), F.lit(") part")).alias("element"), F.when(found, "yes").otherwise("no").alias("matched"), quote.alias("citation"), F.lit("c2").alias("paragraph"), said[1].alias("판정"), F.lit("r").alias("reason"))
    less = F.struct(F.col("doc_idx").alias("doc_index"), F.col("label").alias("label"), found.alias("found"), quote.alias("quote"), said[0].alias("judgment"), F.lit("r").alias("similarity_reason"))
    item = F.when(line % 3 == 0, F.to_json(own)).when(line % 3 == 1, F.to_json(other)).otherwise(F.to_json(less))
    each = rows.groupBy("case_id", "claim_number").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"))
    text = F.when(F.col("case_id") % 2 == 0, F.concat(F.lit("Result {so far}:\n```json\n["), "items", F.lit("]\n``` done]"))).otherwise(F.concat(F.lit('{"note": 1, "comparisons": {"results": ['), "items", F.lit("]}}")))
    return each.select((F.col("case_id") * 8 + F.col("claim_number") - 1).alias("response_id"), text.alias("text"))


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for every claim: its parent in the preamble, and a part for each label that makes, extends or names a component."""
    kind = (F.col("case_id") + F.ascii("label")) % 3
    rows = elements(spark, sf_dir).select("case_id", "claim_number", "label", kind.alias("kind"))
    first = rows.groupBy("case_id", "claim_number").agg(F.coalesce(F.min(F.when(F.col("kind") == 0, F.col("label"))), F.lit("Q")).alias("first"))
    part = F.when(F.col("kind") == 0, F.concat(F.lit("빛을 감지하는 부품 "), "label")).when(F.col("kind") == 1, F.concat(F.lit("상기 부품 "), "first", F.lit("에 연결되는 축"))).otherwise(F.concat(F.lit("센서"), "label"))
    texts = rows.join(first, ["case_id", "claim_number"]).groupBy("case_id", "claim_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", part.alias("p")))), lambda x: x["p"]), "; ").alias("parts"))
    own = F.when(F.col("parent_claim").isNull(), "").otherwise(F.concat(F.lit("제 "), F.col("parent_claim").cast("string"), F.lit(" 항에 있어서, ")))
    return claims(spark, sf_dir).join(texts, ["case_id", "claim_number"]).select("case_id", "claim_number", F.lit("independent").alias("claim_type"), F.lit(None).cast("long").alias("parent_claim"), F.concat(own, "parts").alias("text"))


CLAIM_PARTS = """parts AS (SELECT case_id, claim_number, label, (case_id + ascii(label)) % 3 AS kind, row_number() OVER (PARTITION BY case_id, claim_number ORDER BY label) - 1 AS pos FROM elements),
firsts AS (SELECT case_id, claim_number, min(label) FILTER (kind = 0) AS first FROM parts GROUP BY ALL),
kinds AS (SELECT p.*, first, kind = 1 AND first IS NOT NULL AND first < label AS sub, kind = 0 OR (kind = 1 AND NOT (first IS NOT NULL AND first < label)) AS plain FROM parts p JOIN firsts USING (case_id, claim_number)),
numbered AS (SELECT *, CAST(count(*) FILTER (plain) OVER (PARTITION BY case_id, claim_number ORDER BY label) AS INTEGER) - 1 AS n FROM kinds),
lettered AS (SELECT *, min(n) FILTER (kind = 0) OVER (PARTITION BY case_id, claim_number) AS n_first FROM numbered)"""


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: What follows the cut of a quotation whose end nobody wrote, and one that nobody wrote at all.
UNWRITTEN, FOREIGN = " zqx wvk jjq xxz qqv kzz vvx", "zqx wvk jjq xxz qqv kzz vvx wwq"


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote_id, named, quote: what each document says of itself or of no one, and each benchmark item of the document of its number.

    By turns a passage, one with another end, words backwards, something short, nothing, a passage that breaks off into
    words of no one, one that names a document that is not there, and words of no one.
    """
    k, t = F.col("doc_id") % 8, F.col("text")
    backwards = F.array_join(F.reverse(F.slice(F.split(t, " "), 1, 12)), " ")
    forms = [F.substring(t, 101, 120), F.concat(F.substring(t, 1, 40), F.lit(UNWRITTEN)), backwards, F.substring(t, 1, 8), F.lit(""), F.concat(F.substring(t, 51, 40), F.lit(" … " + FOREIGN)), F.substring(t, 1, 60), F.lit(FOREIGN)]
    quote = F.lit(None).cast("string")
    for n, form in reversed(list(enumerate(forms))):
        quote = F.when(k == n, form).otherwise(quote)
    own = document_texts(spark, sf_dir).select(F.col("doc_id").alias("quote_id"), F.when(k == 6, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("named"), quote.alias("quote"))
    items = read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("quote_id"), F.col("item_id").alias("named"), F.col("text").alias("quote"))
    return own.unionByName(items)


QUOTATIONS = f"""texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
quotations AS (SELECT doc_id AS quote_id, CASE WHEN doc_id % 8 = 6 THEN -1 - doc_id ELSE doc_id END AS named,
  CASE doc_id % 8 WHEN 0 THEN substr(text, 101, 120) WHEN 1 THEN substr(text, 1, 40) || '{UNWRITTEN}' WHEN 2 THEN array_to_string(list_reverse(string_split(text, ' ')[1:12]), ' ') WHEN 3 THEN substr(text, 1, 8)
    WHEN 4 THEN '' WHEN 5 THEN substr(text, 51, 40) || ' … {FOREIGN}' WHEN 6 THEN substr(text, 1, 60) ELSE '{FOREIGN}' END AS quote FROM texts
  UNION ALL SELECT -1 - item_id, item_id, text FROM benchmark)"""


def items_as_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote_id, quote, number: the benchmark items, which `quotations` holds against the document of their number alone."""
    return read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("quote_id"), F.col("text").alias("quote"), F.col("item_id").alias("number"))


#: The quotations, and every item as one of every other document.
EVERYWHERE = f"""{QUOTATIONS},
everywhere AS (SELECT quote_id, named, quote FROM quotations
  UNION ALL SELECT -1 - item_id, doc_id, text FROM benchmark JOIN (SELECT DISTINCT doc_id FROM documents) d ON doc_id <> item_id)"""


def case_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_no, claim: of every five documents in a row the beginning of the first, as the claim that they are compared with."""
    docs = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / DOCS_PER_CASE).alias("case_no"), "doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("claim"))
    return docs.groupBy("case_no").agg(F.min_by("claim", "doc_id").alias("claim"))


CASE_CLAIMS = "case_claims AS (SELECT doc_id // 5 AS case_no, arg_min(substr(coalesce(text, ''), 1, 200), doc_id) AS claim FROM documents GROUP BY 1)"
