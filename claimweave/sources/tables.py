"""Keyed maintenance of case tables: manifests, incremental intake, scoped upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_order(files: DataFrame, manifest: DataFrame, most: int | None = 7) -> DataFrame:
    """(case_id, filename, doc_idx): manifest order first, then unlisted files by name; cases over `most` are gone.

    A file of the manifest that does not exist is dropped, and a name listed twice counts once.
    """
    listed = manifest.groupBy("case_id", "filename").agg(F.min("position").alias("position"))
    known = files.select("case_id", "filename").distinct().join(listed, ["case_id", "filename"], "left")
    order = Window.partitionBy("case_id").orderBy(F.asc_nulls_last("position"), "filename")
    out = known.withColumn("doc_idx", F.row_number().over(order) - 1)
    if most is not None:
        n = F.count("*").over(Window.partitionBy("case_id"))
        out = out.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")
    return out.drop("position")


def new_content(arriving: DataFrame, known: DataFrame, text: str = "text", version: int | None = None) -> DataFrame:
    """Arriving rows whose content hash the known table lacks, with that hash: what must be parsed anew.

    With a version, only rows that the known table holds under the same extractor version (its column) count as known.
    """
    if version is not None:
        known = known.filter(F.col("version") == version)
    return arriving.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(known.select("sha256").distinct(), "sha256", "left_anti")


def upsert_scoped(existing: DataFrame, arriving: DataFrame, scope: list[str], key: list[str], order: Column) -> DataFrame:
    """Every scope of the arriving rows is replaced whole; the last arriving row of a key wins."""
    last = Window.partitionBy(*key).orderBy(order.desc())
    newest = arriving.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    return existing.join(arriving.select(*scope).distinct(), scope, "left_anti").unionByName(newest)


def deleted(existing: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return existing.join(keys.select(*on).distinct(), on, "left_anti")


def case_counters(documents: DataFrame, claims: DataFrame) -> DataFrame:
    d = documents.groupBy("case_id").agg(F.count("*").alias("n_documents"))
    c = claims.groupBy("case_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("claim_type") == "independent").alias("n_independent"))
    return d.join(c, "case_id", "full").na.fill(0, ["n_documents", "n_claims", "n_independent"])


def joined_pages(pages: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """One text for every key: its non-blank pages in order, joined by line ends."""
    kept = pages.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_p")).select(*key, F.array_join(F.col(f"_p.{text}"), "\n").alias("raw_text"))


def text_layer_gate(pages: DataFrame, key: list[str], text: str, least: float = 100.0) -> DataFrame:
    """Mean characters of a document's non-blank pages, and whether it is rejected as scanned."""
    size = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.length(text))
    out = pages.groupBy(*key).agg(F.avg(size).alias("mean_chars"))
    return out.withColumn("rejected", F.coalesce(F.col("mean_chars"), F.lit(0.0)) < least)


def registered_claims(existing: DataFrame, arriving: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(claims, rejects): arriving claims replace those of their number, the last one wins; a claim that is its own parent is a reject."""
    own = F.col("parent_claim") == F.col("claim_number")
    good = arriving.filter(~F.coalesce(own, F.lit(False)))
    return upsert_scoped(existing, good, ["case_id", "claim_number"], ["case_id", "claim_number"], order), arriving.filter(own)


def extraction_manifest(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents (case_id, doc_idx, ..) with the number of their chunks of either kind."""
    n = chunks.groupBy("case_id", "doc_idx").agg(F.count_if(F.col("chunk_type") == "paragraph").alias("paragraph_chunks"), F.count_if(F.col("chunk_type") == "group").alias("group_chunks"))
    return documents.join(n, ["case_id", "doc_idx"], "left").na.fill(0, ["paragraph_chunks", "group_chunks"])


def cached_judgments(files: DataFrame) -> DataFrame:
    """(case_id, doc_idx, claim_number, item) of comparison files (case_id, doc_idx, body): unreadable files, _meta and what is no list give nothing."""
    parsed = files.select("case_id", "doc_idx", F.try_variant_get(F.try_parse_json(F.coalesce("body", F.lit(""))), "$", "map<string,variant>").alias("_m"))
    each = parsed.select("case_id", "doc_idx", F.explode("_m").alias("key", "value")).filter("key <> '_meta'")
    items = each.select("case_id", "doc_idx", F.col("key").try_cast("long").alias("claim_number"), F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("item"))
    return items.filter("claim_number is not null and item is not null")
