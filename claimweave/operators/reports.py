"""What report tables are made of: excerpts, places, renumbering, rechecks and what dependents leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import dims
from claimweave.functions.text import folded

# Patterns and limits that results depend on.
EXCERPT_CHARS, TAIL_SHARE, HEAD_SHARE, BETWEEN = 160, 0.45, 0.68, " ... "
PLACE = r"-P-(?:\[)?([^]\s]+)(?:\])?"
TOOL_CALL = r"(?m)^[ \t]*[a-z][a-z0-9_]*\([a-z_]+\s*=\s*['\"].*\)[ \t]*-*[ \t]*$\n?"
DOCUMENT_MENTION, DOCUMENT_NAME = r"인용발명\s*(\d+)", "인용발명 "
KEY = ["case_id", "claim_number", "doc_idx", "label"]
#: How many labels a summary names for a document, and the judgments that are not enough alone.
SHOWN = 3
WEAK = ("partial_difference", "partial_similarity", "difference")


def clean_response_text(text: Column) -> Column:
    """Without replacement characters, repeated blanks, blanks at line ends and one-line tool calls."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "�+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"[ \t]+(\r?\n)", "$1")
    return F.regexp_replace(F.regexp_replace(out, TOOL_CALL, ""), r"(?U)^\s+|\s+$", "")


def one_line_excerpt(text: Column, most: int = EXCERPT_CHARS) -> Column:
    """The text in one line of at most `most` characters: whole, or a head with a short last sentence, or a head and a tail cut at words."""
    c = folded(text)
    n, sep = F.length(c), len(BETWEEN)
    last = F.regexp_extract(c, r"(?s)^.*[.!?]\s+(.*)$", 1)

    def head(budget: Column) -> Column:
        h = F.rtrim(F.substring(c, F.lit(1), budget))
        cut = (budget < n) & (F.substring(c, budget + 1, F.lit(1)) != " ")
        return F.when(cut, F.regexp_replace(h, r"(?s) [^ ]*$", "")).otherwise(h)

    first = int((most - sep) * HEAD_SHARE)
    rest = most - sep - first
    t = F.ltrim(F.right(c, F.lit(rest)))
    tail = F.when(F.substring(c, n - rest, F.lit(1)) != " ", F.regexp_replace(t, r"(?s)^[^ ]* ", "")).otherwise(t)
    short = (last != "") & (F.length(last) <= int(most * TAIL_SHARE))
    joined = F.when(short, F.concat(head(most - sep - F.length(last)), F.lit(BETWEEN), last)).otherwise(F.trim(F.concat(head(F.lit(first)), F.lit(BETWEEN), tail)))
    return F.when(n <= most, c).otherwise(F.rtrim(F.substring(joined, 1, most)))


def citation_location(chunk_id: Column, numbers: Column) -> Column:
    """The paragraph numbers of a chunk, first and last; without any the number within its id, else the id."""
    place = F.regexp_extract(chunk_id, PLACE, 1)
    single = F.get(numbers, F.lit(0))
    known = F.when(F.size(numbers) == 1, single).when(F.size(numbers) > 1, F.concat(single, F.lit("~"), F.element_at(numbers, -1)))
    return F.coalesce(known, F.when(place != "", place).otherwise(chunk_id))


def renumbered(text: Column, names: Column) -> Column:
    """The text with every document mention named by the map of its place (from 0) to a name; others stay."""
    t = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(t, F.lit(DOCUMENT_MENTION), F.lit(0))
    pieces = F.split(t, DOCUMENT_MENTION, -1)
    said = F.transform(hits, lambda h: F.coalesce(F.try_element_at(names, F.regexp_extract(h, DOCUMENT_MENTION, 1).try_cast("int") - 1), h))
    both = F.zip_with(pieces, said, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    return F.array_join(both, "")


def rechecked(existing: DataFrame, reviewed: DataFrame) -> DataFrame:
    """existing rows, replaced by their recheck where that is quoted and judges higher or has fewer open issues.

    Both have KEY, judgment, has_quote and issues; precision_review marks rows that were replaced.
    """
    new = reviewed.select(*KEY, F.struct("judgment", "has_quote", "issues").alias("_new"), dims.best_rank().alias("_rank"))
    df = existing.select(*KEY, "judgment", "has_quote", "issues").withColumn("_old", dims.best_rank()).join(new, KEY, "left")
    better = (F.col("_rank") > F.col("_old")) | ((F.col("issues") > 0) & (F.col("_new.issues") < F.col("issues")))
    df = df.withColumn("precision_review", F.coalesce(F.col("_new.has_quote") & better, F.lit(False)))
    return df.select(*KEY, *[F.when(F.col("precision_review"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("judgment", "has_quote", "issues")], "precision_review")


def dependent_residual(rows: DataFrame, used: DataFrame) -> DataFrame:
    """(case_id, claim_number, labels) of elements that no used document (case_id, claim_number, doc_idx) covers; rows are dense."""
    claim = KEY[:2]
    best = rows.join(used.select(*KEY[:3]).withColumn("_used", F.lit(True)), KEY[:3], "left").groupBy(*claim, "label").agg(F.max(F.when(F.col("_used"), F.col("gap_rank")).otherwise(0)).alias("best"))
    return best.groupBy(*claim).agg(F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("best") < dims.COVER, F.col("label"))))).alias("residual_labels"))


def meaningful_matches(rows: DataFrame, like: list[str]) -> DataFrame:
    """Rows that judge anything, each once by key and what `like` names."""
    return rows.filter(F.col("judgment") != "none").dropDuplicates([*KEY, *like])


def concept_overlap(chunks: DataFrame, elements: DataFrame, key: list[str], at: str = "at", chunk: str = "chunk", span: int = 3) -> DataFrame:
    """(key, element, overlap): the largest share of an element's technical axes that `span` chunks in a row touch.

    elements: key, element, concepts (an array without the signal path); those with fewer than two count 0. A chunk's axes
    are found once; a run's are the union over a window.
    """
    from pyspark.sql import Window

    from claimweave.functions.predicates import technical_concepts

    axes = chunks.select(*key, at, technical_concepts(chunk).alias("_axes"))
    run = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.currentRow, span - 1)
    runs = axes.select(*key, F.array_sort(F.array_distinct(F.flatten(F.collect_list("_axes").over(run)))).alias("_run")).distinct()
    share = F.when(F.size("concepts") >= 2, F.size(F.array_intersect("concepts", "_run")) / F.size("concepts")).otherwise(0.0)
    best = elements.join(runs, key, "left").groupBy(*key, "element").agg(F.max(share).alias("overlap"))
    return best.select(*key, "element", dims.settled(F.coalesce("overlap", F.lit(0.0))).alias("overlap"))


def claim_summaries(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(case_id, claim_number, similar, remaining_labels, conclusion) of claims with a chain, over the documents in it.

    rows are dense with pos. similar: for each document in the chain's order that resembles any element its index, its
    first SHOWN labels and how many more there are. Remaining are the elements that no document discloses without missing
    limitations; with them, and by whether one document stands alone, there are four conclusions.
    """
    claim = KEY[:2]
    chain = totals.filter(F.size("total") > 0).select(*claim, F.size("total").alias("_n"), F.posexplode("total").alias("_at", "doc_idx"))
    df = rows.join(chain, KEY[:3])
    similar = ~F.col("judgment").isin("difference", "none")
    closed = F.col("judgment").isin("identical", "substantially_identical") & (F.col("missing_count") == 0)
    each = df.groupBy(*claim, "_at", "doc_idx").agg(F.array_sort(F.collect_list(F.when(similar, F.struct("pos", "label"))))["label"].alias("_l")).filter(F.size("_l") > 0)
    said = F.struct("_at", F.col("doc_idx").alias("document"), F.slice("_l", 1, SHOWN).alias("labels"), F.greatest(F.lit(0), F.size("_l") - SHOWN).alias("more"))
    docs = each.groupBy(*claim).agg(F.array_sort(F.collect_list(said)).alias("similar"))
    open_ = df.groupBy(*claim, "_n", "label", "pos").agg(F.bool_or(closed).alias("_closed")).groupBy(*claim, "_n").agg(F.array_sort(F.collect_list(F.when(~F.col("_closed"), F.struct("pos", "label"))))["label"].alias("_open"))
    alone, left = F.col("_n") <= 1, F.size("_open") > 0
    conclusion = F.when(alone & ~left, "one_discloses_all").when(alone, "one_leaves_open").when(left, "combination_leaves_open").otherwise("combination_covers_all")
    return open_.join(docs, claim, "left").select(*claim, "similar", F.array_join("_open", ",").alias("remaining_labels"), conclusion.alias("conclusion"))


def dependent_quotes(best: DataFrame, others: DataFrame) -> DataFrame:
    """The quoted rows that speak for a claim: the best of every element, and others' where that is missing or weak, each key once.

    Both have KEY, judgment and has_quote; best has one row a label at most. Rows that judge none, or quote nothing, go.
    """
    good = lambda df: df.filter(F.col("has_quote") & (F.col("judgment") != "none")).dropDuplicates(KEY)
    kept = good(best)
    strong = kept.filter(~F.col("judgment").isin(*WEAK)).select(*KEY[:2], "label")
    return kept.unionByName(good(others).join(kept.select(*KEY), KEY, "left_anti").join(strong, [*KEY[:2], "label"], "left_anti"), allowMissingColumns=True)
