"""Retrieval under a budget and verification of quotations against their documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from claimweave.functions.text import document_ids, folded, urls, verbatim_text
from claimweave.operators.word_search import SPACE, Words, answered

MIN_QUOTE, MIN_SEGMENT, LONG_PROBE, SHORT_PROBE, WORD_SHARE = 15, 12, 70, 30, 0.60
STATUSES = ("verified", "partial", "not_found", "empty", "short", "no_doc")
#: Words in a row that a document and a quotation share before the quotation is looked for in it.
RUN = 8
#: A word as claim_keywords finds it, or a longer one that holds it.
KEYWORD = "[a-z0-9가-힣]+|[ぁ-んァ-ヶー一-龯]+"
_CUT = r"\s*(?:…|\.{3,})\s*"


def keyword_scores(chunks: DataFrame, text: str = "window", keywords: str = "keywords") -> DataFrame:
    """chunks with score, the number of keywords that their text holds; those without any are gone."""
    lowered = with_lowered(chunks, text)
    return lowered.withColumn("score", F.size(F.filter(F.col(keywords), lambda k: F.contains("_low", k)))).filter("score > 0").drop("_low")


def keyword_scores_of_all(chunks: DataFrame, items: DataFrame, key: str, text: str = "window", block: int = 256) -> DataFrame:
    """Every chunk (without its text) beside every item (key, keywords) of which it holds a keyword, with score, their number.

    The items are dealt to blocks of about `block`; tokens of the chunks are searched for each different word of a block.
    """

    def answers(held: list[dict]):
        words = Words([list({w for w in i["keywords"] or [] if w is not None}) for i in held], KEYWORD)

        def scores(texts: list[str]) -> np.ndarray:
            found = np.stack([words.counts(t) for t in texts])
            return np.where(found > 0, found, -1)

        return scores

    lowered = chunks.withColumn(text, F.lower(F.col(text))).filter(F.col(text).isNotNull())
    return answered(lowered, text, items.select(key, "keywords"), key, block, answers, _schema(chunks.drop(text), items.select(key), "score"))


def _schema(texts: DataFrame, items: DataFrame, answer: str) -> StructType:
    return StructType([*texts.schema.fields, *items.schema.fields, StructField(answer, IntegerType())])


def with_lowered(rows: DataFrame, text: str) -> DataFrame:
    """rows with _low, the text in lower case, made once a row however many words are looked for in it."""
    return rows.select("*", F.explode(F.array(F.lower(F.col(text)))).alias("_low"))


def word_runs(rows: DataFrame, key: str, text: str, size: int = RUN) -> DataFrame:
    """(key, run): hashes of the distinct runs of `size` words of every text, case and white space folded."""
    words = rows.select(key, F.explode(F.array(F.split(F.lower(folded(text)), " "))).alias("_w"))
    starts = F.when(F.size("_w") >= size, F.sequence(F.lit(1), F.greatest(F.size("_w") - (size - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(size)), " ")))
    return words.select(key, F.explode(F.array_distinct(runs)).alias("run"))


def citing_pairs(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", quote: str = "text", size: int = RUN) -> DataFrame:
    """(doc_key, item_key) for every document that holds a run of `size` words of an item: an equality join on runs."""
    return word_runs(docs, doc_key, text, size).join(word_runs(items, item_key, quote, size), "run").select(doc_key, item_key).distinct()


def budgeted_orders(chunks: Column, limit: int, first: bool = True) -> Column:
    """Places of the chunks kept, ascending. chunks: array<struct<place int, size int, score int>>, in document order.

    By score, each hit is taken with its neighbours if they fit, else alone if it fits; first keeps place 0 always.
    """
    n = F.size(chunks)
    sizes = F.transform(chunks, lambda c: c["size"])
    hits = F.array_sort(F.transform(F.filter(chunks, lambda c: c["score"] > 0), lambda c: F.struct((-c["score"]).alias("s"), c["place"].alias("place"), c["size"].alias("size"))))
    begin = F.array(F.lit(0)) if first else F.array().cast("array<int>")
    start = F.struct(begin.alias("kept"), (F.get(sizes, F.lit(0)) if first else F.lit(0)).alias("total"))

    def step(s: Column, c: Column) -> Column:
        near = F.array_distinct(F.array(F.greatest(F.lit(0), c["place"] - 1), c["place"], F.least(n - 1, c["place"] + 1)))
        new = F.array_except(near, s["kept"])
        total = s["total"] + F.aggregate(new, F.lit(0), lambda t, p: t + F.get(sizes, p))
        alone = ~F.array_contains(s["kept"], c["place"]) & (s["total"] + c["size"] <= limit)
        kept = F.when(total <= limit, F.concat(s["kept"], new)).when(alone, F.concat(s["kept"], F.array(c["place"]))).otherwise(s["kept"])
        sum_ = F.when(total <= limit, total).when(alone, s["total"] + c["size"]).otherwise(s["total"])
        return F.struct(kept.alias("kept"), sum_.alias("total"))

    return F.aggregate(hits, start, step, lambda s: F.sort_array(s["kept"]))


def named_documents(quotations: DataFrame, documents: DataFrame) -> DataFrame:
    """quotations (named, quote) with the text of the document that each names, null where there is none; of repeated documents any one."""
    texts = documents.groupBy(F.col("doc_id").alias("named")).agg(F.first("text", ignorenulls=True).alias("text"))
    return quotations.join(texts, "named", "left")


def every_document(quotations: DataFrame, documents: DataFrame) -> DataFrame:
    """quotations, which name no document, beside every document with an id: named, text, _low, _words (its distinct words) and _whole (as verbatim quotations are compared), made once a document.

    Only the quotations are sent around; the documents are dealt evenly, as each meets all of them.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias("named")).agg(F.first("text", ignorenulls=True).alias("text"))
    lowered = with_lowered(texts.repartition(n, "named"), "text")
    made = F.struct(F.array_join(F.array_distinct(F.split("_low", r"\s+")), " ").alias("_words"), verbatim_text("text").alias("_whole"))
    return lowered.select("*", F.explode(F.array(made)).alias("_m")).select("*", "_m._words", "_m._whole").drop("_m").join(F.broadcast(quotations))


def gathered(windows: DataFrame, key: list[str], place: str, text: str, label_chars: int) -> DataFrame:
    """(key, keywords, chunks) of the windows of every document, in order, with their sizes and scores; label_chars is what an identifier takes."""
    scored = with_lowered(windows, text).withColumn("score", F.size(F.filter("keywords", lambda k: F.contains("_low", k))))
    each = F.struct(place, (F.length(text) + label_chars + 2).alias("size"), "score")
    docs = scored.groupBy(*key).agg(F.first("keywords").alias("keywords"), F.array_sort(F.collect_list(each)).alias("_w"))
    return docs.select(*key, "keywords", F.transform("_w", lambda c, i: F.struct(i.alias("place"), c["size"].alias("size"), c["score"].alias("score"))).alias("chunks"))


def selected_context(chunks: str, n_keywords: Column, other: Column, hard: int, relevant: int, most_other: int) -> Column:
    """What of a document goes into the context of a claim: struct of mode, first_chars and kept.

    whole: its chunks fit under hard, of which first_chars is the cut. Without keywords that cut is taken (no_keywords), where no chunk has one, the
    first of relevant characters (no_hit). Else the chunks in kept (selected), under relevant. Where other is true, no
    patent document, both limits are at most most_other and the first chunk has no place of its own.
    """
    c = F.col(chunks)
    cut = lambda limit: F.when(other, F.lit(min(limit, most_other))).otherwise(F.lit(limit))
    whole = F.aggregate(c, F.lit(0), lambda t, x: t + x["size"]) - 1
    mode = F.when(whole <= cut(hard), "whole").when(n_keywords == 0, "no_keywords").when(~F.exists(c, lambda x: x["score"] > 0), "no_hit").otherwise("selected")
    kept = F.when(mode != "selected", F.array().cast("array<int>")).when(other, budgeted_orders(c, min(relevant, most_other), first=False)).otherwise(budgeted_orders(c, relevant))
    return F.struct(mode.alias("mode"), F.when(mode.isin("whole", "no_keywords"), cut(hard)).when(mode == "no_hit", cut(relevant)).alias("first_chars"), kept.alias("kept"))


def verbatim_parts(quote: Column) -> Column:
    """The segments of MIN_SEGMENT characters and over that a quotation's gaps leave, in the form that they are compared in."""
    parts = F.transform(F.split(quote, _CUT), lambda s: verbatim_text(F.regexp_replace(s, r"^\s*\[[^\]]+\]\s*", "")))
    return F.filter(parts, lambda s: F.length(s) >= MIN_SEGMENT)


def holds_all(parts: Column, whole: Column) -> Column:
    return (F.size(parts) > 0) & F.forall(parts, lambda s: F.contains(whole, s))


def is_verbatim(quote: Column, corpus: Column) -> Column:
    """Whether every segment of MIN_SEGMENT characters and over, at least one, occurs in the corpus."""
    return holds_all(verbatim_parts(quote), verbatim_text(corpus))


def quote_probes(quote: Column) -> Column:
    """What is looked for of every part of a quotation: array<struct<full, short, words>>. It depends on no document."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    parts = F.filter(F.transform(F.split(q, _CUT), F.trim), lambda s: F.length(s) >= MIN_QUOTE)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(q))

    def probe(s: Column) -> Column:
        full, short = F.lower(F.substring(s, 1, LONG_PROBE)), F.lower(F.substring(s, 1, SHORT_PROBE))
        return F.struct(full.alias("full"), short.alias("short"), F.filter(F.split(full, r"\s+"), lambda w: F.length(w) >= 3).alias("words"))

    return F.transform(parts, probe)


def quote_status(quote: Column, corpus: Column, lowered: Column | None = None, probes: Column | None = None, words: Column | None = None) -> Column:
    """verified, partial, not_found, empty, short or no_doc. lowered, probes, words: the corpus in lower case, the quotation's probes and the corpus's distinct words, where columns hold them."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    low = F.lower(corpus) if lowered is None else lowered

    def mark(p: Column) -> Column:
        n, found = F.size(p["words"]), F.size(F.filter(p["words"], lambda w: F.contains(low if words is None else words, w)))
        return F.when(F.contains(low, p["full"]), 2).when(F.contains(low, p["short"]), 1).when((n > 0) & (found / n >= WORD_SHARE), 1).otherwise(0)

    marks = F.transform(quote_probes(quote) if probes is None else probes, mark)
    of_marks = lambda m: F.when(F.array_min(m) == 2, "verified").when(F.array_max(m) > 0, "partial").otherwise("not_found")
    status = F.get(F.transform(F.array(marks), of_marks), F.lit(0))  # so that the marks are made once
    return F.when(q == "", "empty").when(F.length(q) < MIN_QUOTE, "short").when(corpus.isNull(), "no_doc").otherwise(status)


def quote_status_everywhere(quotations: DataFrame, documents: DataFrame, block: int = 256) -> DataFrame:
    """quotations (quote_id, quote), which name no document, beside every document with an id (named), with status as quote_status has it."""
    q = F.trim(F.coalesce("quote", F.lit("")))
    texts = documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias("named")).agg(F.lower(F.first("text", ignorenulls=True)).alias("_low"))
    fixed = F.when(q == "", STATUSES.index("empty")).when(F.length(q) < MIN_QUOTE, STATUSES.index("short"))
    items = quotations.withColumns({"_fixed": fixed, "_probes": quote_probes(F.col("quote"))})

    def answers(held: list[dict]):
        probes = [(p["full"], p["short"], len(p["words"])) for i in held for p in i["_probes"]]
        words = Words([p["words"] for i in held for p in i["_probes"]], f"[^{SPACE}]+")
        sizes = np.array([len(i["_probes"]) for i in held])
        begin, total = np.cumsum(sizes) - sizes, np.array([p[2] for p in probes])
        given = np.array([-1 if i["_fixed"] is None else i["_fixed"] for i in held])
        verified, partial, missing, none = (STATUSES.index(s) for s in ("verified", "partial", "not_found", "no_doc"))

        def marks(low: str) -> np.ndarray:
            n = words.counts(low)
            out = ((total > 0) & (n / np.maximum(total, 1) >= WORD_SHARE)).astype(int)
            for i in np.flatnonzero(out == 0):
                out[i] = probes[i][1] in low
            for i in np.flatnonzero(n == total):  # a text that holds the probe holds its words
                if probes[i][0] in low:
                    out[i] = 2
            return out

        def status(low: str | None) -> np.ndarray:
            if low is None:
                return np.where(given >= 0, given, none)
            m = marks(low)
            least, most = np.minimum.reduceat(m, begin), np.maximum.reduceat(m, begin)
            return np.where(given >= 0, given, np.where(least == 2, verified, np.where(most > 0, partial, missing)))

        return lambda texts: np.stack([status(t) for t in texts])

    found = answered(texts, "_low", items, "quote_id", block, answers, _schema(texts.drop("_low"), quotations, "_s"))
    return found.select("named", *quotations.columns, F.element_at(F.array(*map(F.lit, STATUSES)), F.col("_s") + 1).alias("status"))


def search_stats(results: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct URLs and document identifiers over each key's texts, and whether the search should be widened."""
    each = results.select(key, urls(text).alias("u"), document_ids(text).alias("i"))
    found = each.select(key, F.explode(F.concat(F.transform("u", lambda x: F.struct(F.lit("u").alias("kind"), x.alias("v"))), F.transform("i", lambda x: F.struct(F.lit("i").alias("kind"), x.alias("v"))))).alias("x")).distinct()
    counts = found.groupBy(key).agg(F.count_if(F.col("x.kind") == "u").alias("url_count"), F.count_if(F.col("x.kind") == "i").alias("identifier_count"))
    out = results.select(key).distinct().join(counts, key, "left").na.fill(0, ["url_count", "identifier_count"])
    return out.withColumn("needs_expansion", (F.col("url_count") < 3) | (F.col("identifier_count") < 2))
