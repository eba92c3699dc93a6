"""What of a document is compared: the first of five sources that it has, chosen in one pass over their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.segments import WINDOW_CHARS

SOURCES = ("chunks", "records", "paragraphs", "pages", "text")

# Headings of pages and names of sections that do not describe.
PAGE_HEADINGS = (r"(?imU)^\s*(?:초록|요약|abstract|summary|what\s+is\s+claimed\s*:?)\s*$|^\s*(?:특허)?청구(?:의)?\s*범위\s*$", r"(?imU)^\s*claims\s*:?\s*$")
SECTIONS = r"(?iU)\A\s*(?:초록|요약|abstract|summary|claims?|(?:특허)?청구(?:의)?\s*범위)\s*\z"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def is_non_description(page: Column) -> Column:
    """Whether a line of the page is the heading of an abstract, a summary or claims; null pages have none."""
    return reduce(lambda a, b: a | b, [F.coalesce(page, F.lit("")).rlike(p) for p in PAGE_HEADINGS])


def is_other_section(section: Column, document_type: Column) -> Column:
    """Whether a patent's section is its abstract, summary or claims by its whole name; other documents keep theirs."""
    return ~document_type.eqNullSafe(F.lit("non_patent")) & F.coalesce(section, F.lit("")).rlike(SECTIONS)


def comparison_chunks(documents: DataFrame, chunks: DataFrame, records: DataFrame, paragraphs: DataFrame, pages: DataFrame, key: list[str], size: int = WINDOW_CHARS) -> DataFrame:
    """(key, place, chunk_id, text, source) of documents (key, document_type, raw_text): what each is compared by.

    A document with chunks (at, chunk_id, paragraph_no, section, text) is compared by these, but for a patent's abstract and
    claims; else, if it has paragraphs (at, paragraph_id, text), by their records (at, paragraph_no, original_text,
    normalized_text, excluded) or, without records, by themselves; else by its pages (page_no, text) that describe, cut every
    `size` characters; else by its raw text, cut likewise. Having a source decides, not what is left of it: a patent
    whose chunks are all claims is compared by nothing. Blank texts are left out; places count from 0 in the order of a source.

    Rows of unknown documents are left out. Rows that tie on their place are ordered by id and text.
    """
    none = F.lit(None).cast("string")

    def rows(n: int, df: DataFrame, at, chunk_id: Column, text: Column, usable: Column = F.lit(True), section: Column = none) -> DataFrame:
        return df.select(*key, F.lit(n).alias("_n"), F.col(at).cast("long").alias("_at"), chunk_id.alias("chunk_id"), text.alias("text"), usable.alias("_usable"), section.alias("_section"), none.alias("_type"))

    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    every = [
        rows(0, chunks, "at", F.coalesce(given("chunk_id"), given("paragraph_no"), F.lit("")), _strip(F.col("text")), section=F.col("section")),
        rows(1, records, "at", F.coalesce(F.concat(F.lit("["), given("paragraph_no"), F.lit("]")), F.lit("")), F.coalesce(F.nullif(_strip(F.col("original_text")), F.lit("")), _strip(F.col("normalized_text"))), ~F.coalesce("excluded", F.lit(False))),
        rows(2, paragraphs, "at", F.coalesce("paragraph_id", F.lit("")), _strip(F.col("text"))),
        rows(3, pages, "page_no", F.concat(F.lit("P"), F.col("page_no").cast("string")), _strip(F.col("text")), ~is_non_description(_strip(F.col("text")))),
        documents.select(*key, F.lit(4).alias("_n"), F.lit(0).cast("long").alias("_at"), F.lit("T").alias("chunk_id"), F.coalesce("raw_text", F.lit("")).alias("text"), F.lit(True).alias("_usable"), none.alias("_section"), F.coalesce("document_type", F.lit("")).alias("_type")),
    ]
    own = Window.partitionBy(*key)
    has = lambda n: F.max(F.col("_n") == n).over(own)
    both = reduce(DataFrame.unionByName, every).withColumn("_type", F.max("_type").over(own))
    chosen = F.when(has(0), 0).when(has(2), F.when(has(1), 1).otherwise(2)).when(has(3), 3).otherwise(4)
    df = both.withColumn("_chosen", chosen).filter((F.col("_n") == F.col("_chosen")) & F.col("_type").isNotNull() & F.col("_usable") & ~is_other_section(F.col("_section"), F.col("_type")))
    pieces = F.when(F.col("_n") < 3, F.array(F.struct(F.col("chunk_id").alias("id"), F.col("text").alias("t")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int")), lambda k: F.struct(
            F.concat(F.lit("["), F.col("chunk_id"), F.when(F.col("_n") == 3, "-").otherwise(""), (k + 1).cast("string"), F.lit("]")).alias("id"), _strip(F.substring(F.col("text"), k * size + 1, F.lit(size))).alias("t"))))
    cut = df.select(*key, "_n", "_at", F.posexplode(F.filter(pieces, lambda p: p["t"] != "")).alias("_k", "_p"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_at", "_k", "_p")) - 1
    return cut.select(*key, place.alias("place"), F.col("_p.id").alias("chunk_id"), F.col("_p.t").alias("text"), F.element_at(F.array(*map(F.lit, SOURCES)), F.col("_n") + 1).alias("source"))


def document_corpus(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, corpus): the document's chunks in order, a line for each with its id before its text."""
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "chunk_id", "text").alias("line"))))
    return chunks.groupBy(*key).agg(F.array_join(lines["line"], "\n").alias("corpus"))
