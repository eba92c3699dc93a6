"""Documents to paragraphs, blocks and windows, with functions over arrays and window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.text import normalized_text, text_hash

WINDOW_CHARS, SUMMARY_CHARS, BLOCK_CHARS, OVERLAP_CHARS, SECTION_CHARS = 1_200, 3_000, 2_000, 400, 1_000
MARKER = r"[\[【(]\s*(0\d{3})\s*[\]】)]"
COVERED_SHARE, COVERED_FROM = 0.35, 5_000


def fixed_windows(docs: DataFrame, text: str = "text", size: int = WINDOW_CHARS) -> DataFrame:
    """docs with window_no and window: the text cut every `size` characters, without blank pieces."""
    t = F.coalesce(F.col(text), F.lit(""))
    numbers = F.sequence(F.lit(1), F.floor((F.greatest(F.length(t), F.lit(1)) - 1) / size).cast("int") + 1)
    cut = docs.withColumn("window_no", F.explode(numbers))
    piece = F.regexp_replace(F.substring(t, (F.col("window_no") - 1) * size + 1, F.lit(size)), r"^\s+|\s+$", "")
    return cut.withColumn("window", piece).filter("window <> ''")


def marker_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = MARKER, covered: bool = True) -> DataFrame:
    """(key, paragraph_no, paragraph): from each marked line on to the next; the last of a repeated number wins.

    With covered, texts over COVERED_FROM characters of which the paragraphs hold under COVERED_SHARE have none.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = docs.select(key, F.length(text).alias("whole"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("at", "line"))
    mark = F.regexp_extract("line", pattern, 1)
    order = Window.partitionBy(key).orderBy("at")
    body = F.when(mark != "", strip(F.regexp_replace("line", rf"^.*?{pattern}", ""))).otherwise(F.col("line"))
    marked = lines.withColumns({"no": F.when(mark != "", mark), "body": body, "part": F.sum(F.when(mark != "", 1).otherwise(0)).over(order)}).filter("part > 0")
    parts = marked.groupBy(key, "part").agg(F.max("no").alias("paragraph_no"), F.first("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("lines"))
    out = parts.withColumn("paragraph", strip(F.array_join(F.col("lines.body"), "\n")))
    last = Window.partitionBy(key, "paragraph_no").orderBy(F.desc("part"))
    out = out.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    if not covered:
        return out.select(key, "paragraph_no", "paragraph")
    held = F.sum(F.length("paragraph")).over(Window.partitionBy(key))
    return out.withColumn("held", held).filter((F.col("whole") < COVERED_FROM) | (F.col("held") / F.col("whole") >= COVERED_SHARE)).select(key, "paragraph_no", "paragraph")


def with_sections(paragraphs: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs (key, at, ..) with the last heading (key, at, heading) at or before their place: an as-of join."""
    both = paragraphs.withColumn("heading", F.lit(None).cast("string")).withColumn("_kind", F.lit(1)).unionByName(headings.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit(""))).filter("_kind = 1").drop("_kind", "heading")


def summary_capped(blocks: DataFrame, key: str = "doc_id", position: str = "window_no", text: str = "window", limit: int = SUMMARY_CHARS) -> DataFrame:
    """blocks of a summary section with excluded: the characters before a block are under the limit."""
    before = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("excluded", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)) < limit)


def grouped_paragraphs(records: DataFrame, boundary: Column, key: str = "doc_id", at: str = "at", size: int = 5) -> DataFrame:
    """records (key, at, section, ..) with group_no: a new group at a section change, a boundary, or after `size`."""
    order = Window.partitionBy(key).orderBy(at)
    before = F.last(F.when(F.col("section") != "", F.col("section")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    hard = F.when(F.lag(at).over(order).isNull() | ((F.col("section") != "") & (F.col("section") != F.coalesce(before, F.lit("")))) | boundary, 1).otherwise(0)
    out = records.withColumn("_hard", hard).withColumn("_island", F.sum("_hard").over(order))
    within = F.row_number().over(Window.partitionBy(key, "_island").orderBy(at)) - 1
    out = out.withColumn("_part", F.floor(within / size))
    starts = F.when((F.lag("_island").over(order).eqNullSafe(F.col("_island"))) & (F.lag("_part").over(order).eqNullSafe(F.col("_part"))), 0).otherwise(1)
    out = out.withColumn("_start", starts)
    return out.withColumn("group_no", F.sum("_start").over(order)).drop("_hard", "_island", "_part", "_start")


def accumulated_sections(docs: DataFrame, text: str = "text", least: int = SECTION_CHARS) -> DataFrame:
    """docs with sections: blank-line blocks joined until they hold `least` characters."""
    blocks = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), F.trim), lambda b: b != "")

    def step(s: Column, b: Column) -> Column:
        joined = F.when(s["open"] == "", b).otherwise(F.concat(s["open"], F.lit("\n\n"), b))
        full = F.length(joined) >= least
        return F.struct(F.when(full, F.concat(s["done"], F.array(joined))).otherwise(s["done"]).alias("done"), F.when(full, "").otherwise(joined).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    close = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    return docs.withColumn("sections", F.aggregate(blocks, start, step, close))


def described(chunks: DataFrame, text: str) -> DataFrame:
    """chunks with normalized_text and text_hash."""
    return chunks.withColumns({"normalized_text": normalized_text(text), "text_hash": text_hash(text)})
