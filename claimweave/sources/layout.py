"""Documents from layout analysis: element trees to page texts, titles by type size, pages and records of paragraphs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import text as tx
from claimweave.operators import patents, segments

# Names, patterns and limits that results depend on.
SKIPPED = ("image", "header", "footer")
CHILDREN, PAGE = ("list items", "kids"), ("page number", "page_number", "page")
ROOTS = ("kids", "elements", "content")
BOILERPLATE = (
    r"(?iU)JOURNAL\s+OF|PROCEEDINGS|TRANSACTIONS\s+ON|CONFERENCE\s+ON|VOL\.\s*\d|^\s*(?:arXiv|doi|DOI|https?://)|PREPRINT|SUBMITTED\s+TO"
    r"|^\s*(?:[A-Z]{2}\s*)?\d{4}/\d{7}|^\s*\(\s*\d{2}\s*\)|^\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d{1,2},\s*\d{4}\s*$"
)
LINE_LEAST, SIZE_MARGIN, TITLE_LEAST, TITLE_MOST = 4, 0.5, 8, 200
NEEDLE = 40


def _first(node: dict, names: tuple[str, ...], default):
    return next((node[n] for n in names if n in node), default)


def _walk(body: str | None):
    """(page, text) of every element in reading order; nothing for what is no JSON, or nests deeper than the parser reads."""
    try:
        data = json.loads(body or "")
    except (ValueError, RecursionError):
        return
    top = data if isinstance(data, list) else _first(data, ROOTS, []) if isinstance(data, dict) else []
    stack = list(reversed(top)) if isinstance(top, list) else []
    while stack:
        node = stack.pop()
        if not isinstance(node, dict) or node.get("type", "") in SKIPPED:
            continue
        words = _first(node, ("content", "text"), "")
        if isinstance(words, str) and words.strip():
            yield str(_first(node, PAGE, 1)), words
        below = _first(node, CHILDREN, [])
        stack.extend(reversed(below if isinstance(below, list) else []))


def layout_lines(files: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """(key, at, page, text) of layout files: a JSON array of elements, or an object that holds one.

    Images, headers and footers go with all they hold; blank texts go. A null, empty or unreadable file has no rows, nor
    has one that nests deeper than Python's JSON parser reads. Trees are walked by a small Python function over Arrow batches, one file at a time, as JSON functions need a
    depth; extra columns are left out.
    """

    @F.pandas_udf("array<struct<page:string,text:string>>")
    def lines(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"page": p, "text": t} for p, t in _walk(b)])

    return files.select(key, F.posexplode(lines(F.col(body))).alias("at", "line")).select(key, "at", "line.page", "line.text")


def layout_pages(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, first_at, page_text): every line of a page and a line end, in reading order."""
    each = lines.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_l"))
    return each.select(key, "page", F.get("_l", F.lit(0))["at"].alias("first_at"), F.concat(F.array_join(F.col("_l.text"), "\n"), F.lit("\n")).alias("page_text"))


def layout_titles(documents: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents (key, fallback) with title: the largest lines of the first page that are no boilerplate, in one line.

    spans: key, line, span, text, size of the first page. Without such a line, or where it has under 8 or over 200
    characters, the title is the fallback.
    """
    kept = spans.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"))
    each = kept.groupBy(key, "line").agg(F.max(F.coalesce("size", F.lit(0.0))).alias("_size"), F.array_sort(F.collect_list(F.struct("span", "text"))).alias("_s"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    each = each.withColumn("_line", strip(F.array_join(F.col("_s.text"), ""))).filter((F.length("_line") >= LINE_LEAST) & ~F.col("_line").rlike(BOILERPLATE))
    largest = each.withColumn("_top", F.max("_size").over(Window.partitionBy(key))).filter(F.col("_size") >= F.col("_top") - SIZE_MARGIN)
    found = largest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "_line"))).alias("_l")).select(key, strip(F.regexp_replace(F.array_join(F.col("_l._line"), " "), r"(?U)\s+", " ")).alias("_title"))
    out = documents.join(found, key, "left")
    return out.withColumn("title", F.when(F.length("_title").between(TITLE_LEAST, TITLE_MOST), F.col("_title")).otherwise(F.col("fallback"))).drop("_title")


def with_pages(paragraphs: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs (key, paragraph_no, paragraph, ..) with page_no: the first page that holds their first 40 characters, else their marker; null if none.

    A marker in brackets counts anywhere, a bare one of three signs and over only where no digit is beside it: 0003 is not within 10003.

    pages: key, page_no, page_text. A document's pages and paragraphs meet as two arrays in one row, as large as the
    document itself, so that no page is copied to every paragraph and no pairs are made.
    """
    p = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t")))).alias("_pages"))
    whole = paragraphs.groupBy(key).agg(F.collect_list(F.struct(*[c for c in paragraphs.columns if c != key])).alias("_items")).join(p, key, "left")
    body = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x["paragraph"], F.lit("")), F.concat(F.lit(r"(?U)^\[\s*\Q"), x["paragraph_no"], F.lit(r"\E\s*\]\s*")), F.lit("")), r"(?U)^\s+|\s+$", "")

    def place(x: Column) -> Column:
        needle, no = F.substring(body(x), 1, NEEDLE), x["paragraph_no"]
        marked = lambda g: F.contains(g["t"], F.concat(F.lit("["), no, F.lit("]"))) | F.contains(g["t"], F.concat(F.lit("【"), no, F.lit("】"))) | F.contains(g["t"], F.concat(F.lit("("), no, F.lit(")"))) | ((F.length(no) > 2) & F.rlike(g["t"], F.concat(F.lit(r"(?<![0-9])\Q"), no, F.lit(r"\E(?![0-9])"))))
        held = F.get(F.filter("_pages", lambda g: (needle != "") & F.contains(g["t"], needle)), F.lit(0))["page_no"]
        return F.coalesce(held, F.get(F.filter("_pages", marked), F.lit(0))["page_no"])

    each = whole.select(key, F.explode(F.transform("_items", lambda x: F.struct(x.alias("item"), place(x).alias("page_no")))).alias("_e"))
    return each.select(key, "_e.item.*", "_e.page_no")


def paragraph_records(documents: DataFrame, paragraphs: DataFrame, pages: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """One record for every paragraph: place, section, figure, signs, texts, and whether it is a claim and left out.

    documents: key, publication_no, title. paragraphs: key, paragraph_no, paragraph, at. pages: key, page_no, page_text.
    headings: key, at, heading, where `at` is on one scale with the paragraphs'.
    """
    df = segments.with_sections(with_pages(paragraphs, pages, key), headings, key).join(documents.select(key, "publication_no", "title"), key, "left")
    body = F.regexp_replace(F.coalesce("paragraph", F.lit("")), r"(?U)^\s+|\s+$", "")
    df = df.withColumn("original_text", F.regexp_replace(F.concat(F.lit("["), "paragraph_no", F.lit("] "), body), r"(?U)\s+$", ""))
    df = df.withColumns({"figure_no": tx.figure_no("paragraph"), "reference_signs": tx.reference_signs("paragraph"), "excluded": patents.is_claim_paragraph(F.col("section"), F.col("paragraph"))})
    df = df.withColumn("exclusion_reason", F.when(F.col("excluded"), "prior_claim").otherwise(""))
    return segments.described(df, "original_text")


def paragraph_chunks(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """The records that are kept, as chunks with their id and the ranges that they span."""
    kept = records.filter(~F.col("excluded"))
    chunk_id = F.concat(F.col(key).cast("string"), F.lit("-P-"), "paragraph_no")
    pages = F.when(F.col("page_no").isNotNull(), F.array("page_no")).otherwise(F.slice(F.array("page_no"), 1, 0))
    return kept.select(F.lit("paragraph").alias("chunk_type"), chunk_id.alias("chunk_id"), key, "publication_no", "title", "section", "paragraph_no", "page_no", F.array("paragraph_no").alias("paragraph_range"), pages.alias("page_range"), "original_text", "normalized_text", "text_hash")
