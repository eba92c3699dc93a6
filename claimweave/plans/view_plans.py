"""Queries of what documents are compared by, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import comparison_view as view
from claimweave.plans.registry import query
from claimweave.sources import fixtures as fx

SECTIONS = ("Abstract", " claims ", "Detailed description", "Abstract of the art")


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Five sources made of each document's sentences and halves: which of them a document has goes by its number."""
    docs, k = fx.document_texts(spark, sf_dir), F.col("doc_id") % 6
    each = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("at", "s"))
    no = F.col("at").cast("string")
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.substring("text", F.lit(1), half), F.concat(F.when(F.col("doc_id") % 9 < 4, "What is  claimed:\n").otherwise("A claims list\n"), F.substring("text", half + 1, F.length("text"))))
    return {
        "documents": docs.select("doc_id", F.when(F.col("doc_id") % 12 == 0, "non_patent").otherwise("patent").alias("document_type"), F.col("text").alias("raw_text")),
        "chunks": each.filter(k.isin(0, 5)).select("doc_id", "at", F.when(F.col("at") % 2 == 0, F.concat(F.lit("c"), no)).alias("chunk_id"), no.alias("paragraph_no"), F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("at") % 4 + 1).alias("section"), F.col("s").alias("text")),
        "records": each.filter(k.isin(1, 4)).select("doc_id", "at", F.when(F.col("at") % 5 > 0, no).alias("paragraph_no"), F.when(F.col("at") % 3 > 0, F.col("s")).otherwise(" ").alias("original_text"), F.concat(F.lit("n "), "s").alias("normalized_text"), (F.col("at") % 7 == 6).alias("excluded")),
        "paragraphs": each.filter(k.isin(1, 2)).select("doc_id", "at", F.concat(F.lit("["), no, F.lit("]")).alias("paragraph_id"), F.col("s").alias("text")),
        "pages": docs.filter(k.isin(3, 5)).select("doc_id", F.posexplode(halves).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text"),
    }


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.comparison_chunks(**sources(spark, sf_dir), key=["doc_id"])


VIEW = r"""given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sents AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM given),
halves AS (SELECT doc_id, 1 AS n, substr(text, 1, length(text) // 2) AS t FROM given WHERE doc_id % 6 = 3 UNION ALL SELECT doc_id, 2, 'A claims list' || chr(10) || substr(text, length(text) // 2 + 1) FROM given WHERE doc_id % 6 = 3 AND doc_id % 9 >= 4),
clean AS (SELECT doc_id, n, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM halves),
cuts AS (SELECT doc_id, n, k, regexp_replace(substr(t, k * 1200 + 1, 1200), '^\s+|\s+$', '', 'g') AS t FROM clean, LATERAL (SELECT unnest(range(0, length(t) // 1200 + 1)) AS k)),
tails AS (SELECT doc_id, k, regexp_replace(substr(text, k * 1200 + 1, 1200), '^\s+|\s+$', '', 'g') AS t FROM given, LATERAL (SELECT unnest(range(0, length(text) // 1200 + 1)) AS k) WHERE doc_id % 6 = 4),
told AS (SELECT doc_id, i AS at1, 0 AS at2, CASE WHEN i % 2 = 0 THEN 'c' || i ELSE CAST(i AS VARCHAR) END AS chunk_id, s AS t, 'chunks' AS source FROM sents WHERE doc_id % 6 IN (0, 5) AND (doc_id % 12 = 0 OR i % 4 >= 2)
  UNION ALL SELECT doc_id, i, 0, CASE WHEN i % 5 > 0 THEN '[' || i || ']' ELSE '' END, CASE WHEN i % 3 > 0 THEN s ELSE 'n ' || s END, 'records' FROM sents WHERE doc_id % 6 = 1 AND i % 7 <> 6
  UNION ALL SELECT doc_id, i, 0, '[' || i || ']', s, 'paragraphs' FROM sents WHERE doc_id % 6 = 2
  UNION ALL SELECT doc_id, n, k, '[P' || n || '-' || (k + 1) || ']', t, 'pages' FROM cuts
  UNION ALL SELECT doc_id, 0, k, '[T' || (k + 1) || ']', t, 'text' FROM tails),
viewed AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at1, at2) - 1 AS INTEGER) AS place, chunk_id, t AS text, source FROM (SELECT * REPLACE (regexp_replace(t, '^\s+|\s+$', '', 'g') AS t) FROM told) WHERE t <> '')"""


@query("WITH " + VIEW + " SELECT doc_id, place, chunk_id, md5(text) AS text_md5, source FROM viewed")
def compared_chunks(spark, sf_dir):
    return compared(spark, sf_dir).select("doc_id", "place", "chunk_id", F.md5("text").alias("text_md5"), "source")


@query("WITH " + VIEW + " SELECT doc_id, md5(string_agg(chunk_id || ' ' || text, chr(10) ORDER BY place)) AS corpus_md5 FROM viewed GROUP BY doc_id")
def compared_corpus(spark, sf_dir):
    return view.document_corpus(compared(spark, sf_dir), ["doc_id"]).select("doc_id", F.md5("corpus").alias("corpus_md5"))
