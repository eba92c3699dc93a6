"""Queries over stored cases, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimweave.plans.registry import query
from claimweave.sources import case_store as cs
from claimweave.sources import fixtures as fx
from claimweave.sources.storage import shared_folder

SCOPES = {"documents": "case_id", "judgments": "case_id", "chains": "case_id", "doc_cache": "sha256"}
KEYS = {"documents": ["case_id", "doc_id"], "judgments": fx.KEY, "chains": ["case_id", "claim_number"], "doc_cache": ["sha256"]}


@query("WITH " + fx.RAW + """,
papers AS (SELECT doc_id // 5 AS case_id, doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents),
chosen AS (SELECT case_id, claim_number, doc_idx, label, max(seq) AS seq FROM raw WHERE case_id % 3 <> 0 OR seq % 2 = 0 GROUP BY ALL)
SELECT 'judgments' AS "table", CAST(case_id AS VARCHAR) AS scope, count(*) AS n_rows, CAST(sum(seq) AS BIGINT) AS total FROM chosen WHERE case_id % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'chains', CAST(case_id AS VARCHAR), count(DISTINCT claim_number), CAST(sum(DISTINCT claim_number) AS BIGINT) FROM raw WHERE case_id % 5 <> 0 AND case_id % 4 <> 0 GROUP BY ALL
UNION ALL SELECT 'documents', CAST(case_id AS VARCHAR), count(*), CAST(sum(doc_id) AS BIGINT) FROM papers WHERE case_id % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'doc_cache', sha256, 1, max(doc_id) FROM papers WHERE sha256 NOT IN (SELECT sha256 FROM papers WHERE case_id % 5 = 0) GROUP BY ALL""")
def case_store_states(spark, sf_dir):
    """A store after all cases were written, every third got other judgments, every fourth was reset and every fifth purged."""
    store = cs.CaseStore(f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}", SCOPES)
    papers = fx.document_texts(spark, sf_dir).select(F.floor(F.col("doc_id") / fx.DOCS_PER_CASE).alias("case_id"), "doc_id", F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"))
    raw, claims = fx.raw_judgments(spark, sf_dir), fx.claims(spark, sf_dir).withColumn("seq", F.col("claim_number"))
    cases = raw.select("case_id").unionByName(papers.select("case_id")).distinct()
    rows = {"documents": papers, "judgments": raw, "chains": claims, "doc_cache": papers.select("sha256", "seq")}
    cs.replace_cases(spark, store, cases, rows, KEYS, "seq")
    cs.replace_cases(spark, store, cases.filter("case_id % 3 = 0"), {"judgments": raw.filter("seq % 2 = 0")}, KEYS, "seq")
    cs.reset_cases(spark, store, cases.filter("case_id % 4 = 0"))
    cs.purge_cases(spark, store, cases.filter("case_id % 5 = 0"))
    out = None
    for table, scope in SCOPES.items():
        each = cs.current(spark, store, table).groupBy(F.lit(table).alias("table"), F.col(scope).cast("string").alias("scope")).agg(F.count("*").alias("n_rows"), F.sum("seq").alias("total"))
        out = each if out is None else out.unionByName(each)
    return out
