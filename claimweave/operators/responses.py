"""Model responses to judgment rows: payloads, nested items, canonical fields, rejects and the fidelity of quotations.

A response is a row with a response_id and a text. Items travel as variants, so that fields of any type survive until
they are read. Rows of a response that is no JSON at all are reported as rejects, never dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.dims import JUDGMENT_LABELS
from claimweave.functions.text import folded, has_hangul, quote_tokens, shortened_quote
from claimweave.operators.evidence import is_verbatim
from claimweave.operators.judgments import normalized_label
from claimweave.sources.storage import stored

# Field names, their other names, containers, labels and limits that results depend on.
ALIASES = {
    "doc_index": ("document_index", "cited_invention_index", "prior_art_index", "인용발명_index", "문헌_index"),
    "label": ("claim_element", "element", "element_label", "구성요소", "구성요소_label"),
    "quote": ("citation", "excerpt", "quoted_text", "근거", "인용문", "원문"),
    "chunk_id": ("chunk", "chunkId", "paragraph", "paragraph_id", "location", "문단", "위치"),
    "judgment": ("판정", "판단", "comparison_judgment"),
    "판단_이유": ("판단 이유", "판단이유", "reason", "judgment_reason", "comparison_reason"),
    "found": ("matched", "is_found", "disclosed", "대응여부"),
}
CONTAINERS = (
    "results", "comparisons", "items", "matches", "elements", "documents", "docs", "document_results", "judgments",
    "판정", "구성대비", "비교결과", "문헌별_결과", "인용발명별_결과", "구성요소별_판정", "구성요소별결과",
)
JUDGMENT_ALIASES = {
    "동일 95~100": "동일", "실질적 동일 90~94": "실질적 동일", "일부 차이 85~89": "일부 차이", "일부 유사 80~84": "일부 유사", "차이 1~79": "차이",
    "대응 없음 0": "대응 없음", "동일 개시": "동일", "부분 대응": "일부 차이", "부분 차이": "일부 차이", "기술적 관련성": "일부 유사", "부분 유사": "일부 유사",
    "유사": "일부 유사", "관련성": "일부 유사", "약한 관련성": "차이", "없음": "대응 없음",
}
NO_LIMITATION = ("", "-", "n/a", "na", "none", "null", "없음", "해당 없음", "차이 없음", "누락 없음")
MOST_LIMITATIONS, MOST_EVIDENCE = 5, 5
EVIDENCE_TEXTS = ("limitation", "subject", "input", "process", "output", "condition", "relationship", "chunk_id", "section")
WHOLE_QUOTE, RECOVERED = "대표 근거", "지정 문단에서 복구된 부분 근거"
NOT_IN_SOURCE = "대표 발췌가 인용발명 원문과 일치하지 않아 직접 근거로 사용할 수 없음"
NONE_LABEL = "대응 없음"
MIN_SHARED, MIN_SHARE, SENTENCES, MOST_CHARS = 2, 0.20, 4, 350
#: Strings and brackets of JSON, what closes what, and the depth to which a span is read.
TOKENS, PAIRED, DEEPEST = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL), {"]": "[", "}": "{"}, 200
#: A leaf has one of these; a row that has none of the markers is no judgment.
FIELDS = ("label", "found", "quote", "judgment", "판단_이유", "similarity_reason")
EVIDENCE = "array<struct<limitation:string,subject:string,input:string,process:string,output:string,condition:string,relationship:string,chunk_id:string,section:string,quote:string,quote_translation:string>>"
# What claims a minimum or an act, what shows them, and the limitations that are named where none is found.
MINIMUM_CLAIMED, AVERAGE_SHOWN = r"(?iU)최소|minimum|at\s+least|lower\s+bound", r"(?iU)평균|average|mean"
MINIMUM_SHOWN = r"(?iU)최소|minimum|at\s+least|not\s+less\s+than|lower\s+bound"
ACT = r"(?iU)조정하여|수정하여|변경하여|adjust(?:ing|s|ed)?|modif(?:y|ies|ied)|chang(?:e|es|ed|ing)|apply|applies|applied|perform|execute"
ADVICE = r"(?iU)권고|추천|제안|recommend|suggest|propose"
MINIMUM_LIMITATION, ACT_LIMITATION = "최소값 또는 하한 조건", "형상 파라미터를 실제로 조정하여 모델을 생성하는 실행 단계"


def bracket_spans(text: str, start: int, spans: dict[int, tuple[int, int] | None]) -> None:
    """Fills spans with (end, depth) of every bracket from start on that closes, and None where it does not; strings are skipped.

    What follows a bracket is read alike from wherever reading began, so one pass answers for every bracket that it meets.
    """
    opened: list[list[int]] = []  # place, depth of what it holds
    for token in TOKENS.finditer(text, start):
        mark = token[0]
        if mark in "[{":
            opened.append([token.start(), 1])
        elif mark in PAIRED and opened:
            if text[opened[-1][0]] != PAIRED[mark]:  # none of the open brackets can be JSON
                spans.update((place, None) for place, _ in opened)
                opened = []
                continue
            place, depth = opened.pop()
            spans[place] = (token.end(), depth)
            if opened:
                opened[-1][1] = max(opened[-1][1], depth + 1)
    spans.update((place, None) for place, _ in opened)


def payload_strings(text: str | None) -> tuple[list[str], int]:
    """The top-level JSON objects of a text, arrays opened, and how many spans nest deeper than DEEPEST and stay unread."""
    text = (text or "").replace("```json", "").replace("```", "").strip()
    spans: dict[int, tuple[int, int] | None] = {}
    out, refused, read_to = [], 0, 0
    for bracket in re.finditer(r"[\[{]", text):
        at = bracket.start()
        if at < read_to:
            continue
        if at not in spans:
            bracket_spans(text, at, spans)
        if spans[at] is None:
            continue
        end, depth = spans[at]
        if depth > DEEPEST:
            refused, read_to = refused + 1, end
            continue
        try:
            value = json.loads(text[at:end])
        except ValueError:
            continue
        read_to = end
        out += [json.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    return out, refused


def payloads(responses: DataFrame) -> DataFrame:
    """responses with payloads, the JSON objects of the text, and refused. Brackets in free text need a scanner, so it runs in Python."""

    @F.pandas_udf("payloads array<string>, refused int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [payload_strings(t) for t in texts]
            yield pd.DataFrame({"payloads": [f[0] for f in found], "refused": [f[1] for f in found]})

    return responses.select("*", run("text").alias("_p")).select(*responses.columns, "_p.payloads", "_p.refused")


def _path(name: str) -> str:
    return "$['" + name + "']"


def _field(item: str, name: str) -> str:
    """SQL of a field under its own name or the first of its other names that is there."""
    each = [f"variant_get({item}, \"{_path(n)}\", 'variant')" for n in (name, *ALIASES.get(name, ()))]
    return f"coalesce({', '.join(each)})" if len(each) > 1 else each[0]


def _text(value: str) -> str:
    """SQL of a variant as a string; JSON nulls and missing fields are empty."""
    return f"coalesce(try_variant_get({value}, '$', 'string'), '')"


def expanded(found: DataFrame) -> DataFrame:
    """response_id, place, item (a variant), doc_index and own_label of every judgment-like object, at any depth.

    Containers and label-named keys are opened; a child without a doc_index has its parent's, one without a label the
    key's. place orders them: children before their parent, containers in their order, then label-named keys by name.
    Every level is one job over all responses, stored once, so that the plan of none grows with the deepest response.
    """
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(CONTAINERS) for x in (name, k)])
    kind = lambda v: F.schema_of_variant(v)
    at = found.select("response_id", F.posexplode("payloads").alias("i", "j")).select("response_id", F.lpad(F.col("i").cast("string"), 6, "0").alias("place"), F.expr("try_parse_json(j)").alias("item"), F.expr("cast(null as variant)").alias("above"), F.lit("").alias("own_label"))
    at, out = at.filter("item is not null"), None
    while True:
        at = at.withColumn("doc_index", F.expr(f"coalesce({_field('item', 'doc_index')}, above)"))
        at = stored(at)
        if out is not None and at.isEmpty():
            break
        leaves = at.select("response_id", F.concat("place", F.lit("~")).alias("place"), "item", "doc_index", "own_label")
        out = leaves if out is None else out.unionByName(leaves)
        entries = at.select("response_id", "place", "doc_index", F.explode(F.try_variant_get("item", "$", "map<string,variant>")).alias("key", "value"))
        label, held = normalized_label("key"), F.col("key").isin(*CONTAINERS)
        named = label.rlike(r"^(?:P|[A-Z](?:-[0-9]+)?)$") & ~held
        entries = entries.filter(F.col("value").isNotNull() & (held | named)).withColumn("own_label", F.when(named, label).otherwise(""))
        several = F.when(kind("value").startswith("OBJECT"), F.array("value")).when(kind("value").startswith("ARRAY"), F.try_variant_get("value", "$", "array<variant>"))
        each = entries.select("response_id", "doc_index", "own_label", F.concat("place", F.lit("/"), F.lpad(F.coalesce(rank[F.col("key")], F.lit(len(CONTAINERS))).cast("string"), 2, "0"), "own_label").alias("place"), F.posexplode(several).alias("n", "item"))
        each = each.filter(F.col("item").isNotNull() & kind("item").startswith("OBJECT"))
        at = each.select("response_id", F.concat("place", F.lit("."), F.lpad(F.col("n").cast("string"), 6, "0")).alias("place"), "item", F.col("doc_index").alias("above"), "own_label")
    has_any = " OR ".join(f"{_field('item', n)} IS NOT NULL" for n in FIELDS)
    judged = " OR ".join(f"{_field('item', n)} IS NOT NULL" for n in FIELDS if n != "quote")
    return out.filter(f"own_label <> '' OR {judged} OR (({has_any}) AND doc_index IS NOT NULL)")


def _judgment(label: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in JUDGMENT_ALIASES.items() for x in pair])
    known = F.create_map(*[F.lit(x) for pair in JUDGMENT_LABELS.items() for x in pair])
    spaced = F.coalesce(aliases[label], label)
    exact = F.array(*[F.lit(x) for x in ("동일", "실질적 동일", "일부 차이", "일부 유사", "차이", NONE_LABEL)])
    return F.when(F.array_contains(exact, spaced), known[F.regexp_replace(spaced, r"\s+", "")])


def limitations(raw: Column) -> Column:
    """At most MOST_LIMITATIONS missing limitations of a variant that is a text or a list, without those that mean none."""
    one = F.when(F.schema_of_variant(raw) == "STRING", F.array(F.try_variant_get(raw, "$", "string")))
    several = F.try_variant_get(raw, "$", "array<string>")
    trimmed = F.transform(F.coalesce(one, several, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("None"))))
    kept = F.filter(trimmed, lambda x: ~F.lower(F.trim(F.regexp_replace(x, r"[.\s]+$", ""))).isin(*NO_LIMITATION))
    return F.slice(kept, 1, MOST_LIMITATIONS)


def evidence_list(raw: Column, quote: Column, chunk_id: Column) -> Column:
    """At most MOST_EVIDENCE quoted spans of a variant that is a list; without any the quotation itself stands for all."""
    items = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda v, n: F.coalesce(F.try_variant_get(v, "$." + n, "string"), F.lit(""))
    spans = F.transform(items, lambda v: F.struct(*[F.trim(get(v, n)).alias(n) for n in EVIDENCE_TEXTS], shortened_quote(get(v, "quote")).alias("quote"), shortened_quote(get(v, "quote_translation")).alias("quote_translation")))
    spans = F.slice(F.filter(spans, lambda s: s["quote"] != ""), 1, MOST_EVIDENCE)
    return F.when(F.size(spans) > 0, spans).when(quote != "", F.array(_span(WHOLE_QUOTE, quote, F.lit(""), F.trim(chunk_id)))).otherwise(F.array().cast(EVIDENCE))


def _span(limitation: str, quote: Column, translation: Column, chunk_id: Column) -> Column:
    own = {"limitation": F.lit(limitation), "chunk_id": chunk_id}
    return F.struct(*[own.get(n, F.lit("")).alias(n) for n in EVIDENCE_TEXTS], quote.alias("quote"), translation.alias("quote_translation"))


def validated(items: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per item: its canonical fields and reasons, an array that is empty where the row is valid so far.

    elements: response_id, label, text. documents: response_id, doc_idx. An unknown label that is exactly one element's
    text becomes that element's label.
    """
    label = F.when(F.expr(f"{_field('item', 'label')} IS NULL"), F.nullif("own_label", F.lit(""))).otherwise(F.expr(_text(_field("item", "label"))))
    f = {n: F.expr(_field("item", n)) for n in ("label", "found", "quote", "chunk_id", "judgment", "판단_이유")}
    s = lambda n: F.expr(_text(_field("item", n)))
    rows = items.withColumns({
        "missing": F.array_compact(F.array(*[F.when((label if n == "label" else f[n]).isNull(), F.lit(n)) for n in ("label", "found", "quote", "chunk_id", "judgment")], F.when(f["판단_이유"].isNull() & F.expr(f"{_field('item', 'similarity_reason')} IS NULL"), F.lit("reason")), F.when(F.col("doc_index").isNull(), F.lit("doc_index")))),
        "raw_label": F.coalesce(label, F.lit("")), "doc_idx": F.expr("try_variant_get(doc_index, '$', 'int')"), "llm_label": F.trim(s("judgment")),
        "reason": F.when(f["판단_이유"].isNotNull(), s("판단_이유")).otherwise(s("similarity_reason")),
        "quote": shortened_quote(s("quote")), "quote_translation": shortened_quote(s("quote_translation")), "chunk_id": s("chunk_id"),
        "said_directness": F.lower(F.trim(s("directness"))), "found_text": F.lower(F.trim(s("found"))),
        "purpose_effect_similarity": F.substring(folded(s("purpose_effect_similarity")), 1, 240), "motivation_quote": shortened_quote(s("motivation_quote")),
        "said_risk": F.lower(F.trim(s("combination_risk"))), "missing_limitations": limitations(F.expr("variant_get(item, '$.missing_limitations', 'variant')")),
    })
    rows = rows.withColumns({
        "label": normalized_label("raw_label"), "judgment": _judgment(F.col("llm_label")), "evidence": evidence_list(F.expr("variant_get(item, '$.evidence', 'variant')"), F.col("quote"), F.col("chunk_id")),
        "directness": F.when(F.col("said_directness").isin("direct", "inferred", "absent"), F.col("said_directness")).when(F.col("quote") != "", "direct").otherwise("absent"),
        "found": F.col("found_text").isin("true", "1", "yes"), "combination_risk": F.when(F.col("said_risk").isin("none_explicit", "uncertain", "contrary_teaching", "principle_change"), F.col("said_risk")).otherwise("uncertain"),
    })
    bare = lambda c: F.regexp_replace(folded(c), r"^[\s,;:：.]+|[\s,;:：.]+$", "")
    known = elements.select("response_id", normalized_label("label").alias("label")).distinct().withColumn("is_known", F.lit(True))
    whole = elements.select("response_id", normalized_label("label").alias("of_text"), bare("text").alias("bare")).filter("bare <> ''")
    whole = whole.groupBy("response_id", "bare").agg(F.min("of_text").alias("of_text"), F.count_distinct("of_text").alias("n")).filter("n = 1").drop("n")
    rows = rows.withColumn("bare", bare("raw_label")).join(known, ["response_id", "label"], "left").join(whole, ["response_id", "bare"], "left")
    rows = rows.withColumn("label", F.when(F.col("is_known"), F.col("label")).otherwise(F.coalesce("of_text", "label"))).withColumn("is_known", F.coalesce("is_known", F.col("of_text").isNotNull()))
    rows = rows.join(documents.select("response_id", "doc_idx").distinct().withColumn("in_range", F.lit(True)), ["response_id", "doc_idx"], "left")
    reason = (
        F.when(F.size("missing") > 0, F.concat(F.lit("missing_fields:"), F.array_join(F.array_sort("missing"), ",")))
        .when(~F.col("is_known"), "unknown_label").when(F.col("doc_idx").isNull(), "doc_index_not_integer").when(F.col("in_range").isNull(), "doc_index_out_of_range")
        .when(F.col("judgment").isNull(), "judgment_not_allowed")
    )
    gone = ["missing", "raw_label", "doc_index", "said_directness", "said_risk", "found_text", "bare", "of_text", "is_known", "in_range", "item", "own_label", "llm_label"]
    return rows.withColumn("reject", reason).drop(*gone)


def faithful(rows: DataFrame, corpora: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows with quotations held against their documents: evidence_status, unverified_quote, and what follows from them.

    corpora: response_id, doc_idx, corpus. chunks: response_id, doc_idx, chunk_id, chunk. Of a row whose document is
    unknown nothing changes. A quotation that is not in its document gives way to the first span that is, else to the
    best sentences of the chunk it cites, else to nothing; in the last two cases direct becomes inferred.
    """
    key = ["response_id", "doc_idx"]
    cited = chunks.groupBy(*key, F.trim("chunk_id").alias("chunk_id")).agg(F.min("chunk").alias("_chunk")).filter("chunk_id <> ''")
    df = rows.withColumn("_said", F.col("chunk_id")).withColumn("chunk_id", F.trim("chunk_id")).join(corpora, key, "left").join(cited, [*key, "chunk_id"], "left").drop("chunk_id").withColumnRenamed("_said", "chunk_id")
    sourced = F.col("corpus").isNotNull()
    df = df.withColumn("_valid", F.when(sourced, F.filter("evidence", lambda e: is_verbatim(e["quote"], F.col("corpus")))).otherwise(F.col("evidence")))
    df = df.withColumn("_bad", sourced & (F.col("quote") != "") & ~is_verbatim(F.col("quote"), F.col("corpus")))
    df = df.withColumn("_back", F.when(F.col("_bad") & (F.size("_valid") == 0), recovered_quote(F.col("quote"), F.coalesce("_chunk", F.lit("")))).otherwise(F.lit("")))
    first, bad = F.get("_valid", F.lit(0)), F.col("_bad")
    swapped, back = bad & (F.size("_valid") > 0), F.col("_back") != ""
    lost = bad & ~swapped & ~back
    df = df.withColumns({
        "evidence_status": F.when(swapped, "verified_from_evidence").when(back, "recovered_from_cited_chunk").when(lost, "unverified").when(F.col("quote") != "", "verified").otherwise("absent"),
        "unverified_quote": F.when(bad, F.col("quote")).otherwise(""),
        "quote_translation": F.when(swapped, first["quote_translation"]).when(lost, "").otherwise(F.col("quote_translation")),
        "chunk_id": F.when(swapped, first["chunk_id"]).otherwise(F.col("chunk_id")),
        "directness": F.when((back | lost) & (F.col("directness") == "direct"), "inferred").otherwise(F.col("directness")),
        "quote": F.when(swapped, first["quote"]).when(back, F.col("_back")).when(lost, "").otherwise(F.col("quote")),
        "missing_limitations": F.when(lost & (F.size("missing_limitations") < MOST_LIMITATIONS), F.array_distinct(F.concat("missing_limitations", F.array(F.lit(NOT_IN_SOURCE))))).otherwise(F.col("missing_limitations")),
        "evidence": F.when(back, F.array(_span(RECOVERED, F.col("_back"), F.col("quote_translation"), F.col("chunk_id")))).otherwise(F.col("_valid")),
    })
    foreign = sourced & (F.col("quote") != "") & ~has_hangul("quote") & ~has_hangul("quote_translation")
    # a quotation that was withdrawn takes the finding with it
    gone = F.col("found") & (F.col("quote") == "") & bad
    df = df.withColumns({"found": F.col("found") & ~gone, "judgment": F.when(gone, "none").otherwise(F.col("judgment")), "adjustment": F.when(gone, "quote_not_verbatim").otherwise("")})
    reason = F.when(foreign, "foreign_quote_without_translation").when(F.col("found") & (F.col("quote") == ""), "found_without_quote").when(~F.col("found") & ((F.col("quote") != "") | (F.col("judgment") != "none")), "not_found_with_quote_or_judgment")
    return df.withColumn("reject", F.coalesce("reject", reason)).drop("corpus", "_chunk", "_valid", "_bad", "_back")


def recovered_quote(quote: Column, chunk: Column) -> Column:
    """The chunk, or its best run of at most SENTENCES sentences, if it shares enough words with the quotation; else empty."""
    own, text = quote_tokens(quote), F.trim(chunk)
    own = F.array_distinct(own)
    units = F.filter(F.transform(F.split(F.regexp_replace(text, r"(?<=[.!?。！？])\s+|\r?\n+", "\u0001"), "\u0001"), F.trim), lambda u: u != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(units), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SENTENCES), F.size(units) - i + 1)), lambda n: F.array_join(F.slice(units, i, n), " "))))
    long = F.transform(F.filter(units, lambda u: F.length(u) > MOST_CHARS), shortened_quote)
    fits = F.when(F.size(units) > 0, F.concat(F.filter(runs, lambda r: F.length(r) <= MOST_CHARS), long)).otherwise(F.array().cast("array<string>"))
    shared = lambda t: F.size(F.array_intersect(own, quote_tokens(t)))
    best = F.array_max(F.transform(fits, lambda t: F.struct(shared(t).alias("n"), F.length(t).alias("size"), t.alias("t"))))
    enough = lambda n: (n >= MIN_SHARED) & (n >= MIN_SHARE * F.greatest(F.size(own), F.lit(1)))
    return F.when((text == "") | ~enough(shared(text)), "").when(F.length(text) <= MOST_CHARS, text).when(enough(best["n"]), best["t"]).otherwise("")


def normalized(responses: DataFrame, elements: DataFrame, documents: DataFrame, corpora: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every item of every response with its fields and reject, null where it is valid.

    A response has one reject more for JSON that nests deeper than DEEPEST (too_deep), which is not read, and is one
    reject where it has no item and nothing too deep (no_payload).
    """
    found = stored(payloads(responses.select("response_id", "text")))
    items = stored(expanded(found))  # else the checks are planned, compiled and kept by the driver once for each level
    rows = faithful(validated(items, elements, documents), corpora, chunks)
    whole = found.join(items.select("response_id").distinct().withColumn("_any", F.lit(True)), "response_id", "left")
    reject = F.when(F.col("refused") > 0, "too_deep").when(F.col("_any").isNull(), "no_payload")
    return rows.unionByName(whole.select("response_id", reject.alias("reject")).filter("reject is not null"), allowMissingColumns=True)


def value_guards(rows: DataFrame) -> DataFrame:
    """rows (element_text, evidence_text, quote, directness, missing_limitations) held to what the evidence says of minima and of acts.

    A claimed minimum for which the evidence knows an average alone, and a claimed adjustment that the quotation only
    recommends, become missing limitations, once each; what was direct becomes inferred. Null texts are empty.
    """
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    low = t("element_text").rlike(MINIMUM_CLAIMED) & t("evidence_text").rlike(AVERAGE_SHOWN) & ~t("evidence_text").rlike(MINIMUM_SHOWN)
    parts = F.filter(F.split(t("element_text"), "및|그리고|,"), lambda p: p.rlike(MINIMUM_CLAIMED))
    minimum = F.coalesce(F.regexp_replace(F.get(parts, F.lit(0)), r"(?U)^\s+|\s+$", ""), F.lit(MINIMUM_LIMITATION))
    advice = t("element_text").rlike(ACT) & t("quote").rlike(ADVICE) & ~t("quote").rlike(ACT)
    had = F.coalesce("missing_limitations", F.array().cast("array<string>"))
    new = F.array_distinct(F.array_compact(F.array(F.when(low, minimum), F.when(advice, F.lit(ACT_LIMITATION)))))
    more = F.filter(new, lambda x: ~F.array_contains(had, x))
    return rows.withColumns({"missing_limitations": F.concat(had, more), "directness": F.when((low | advice) & (F.col("directness") == "direct"), "inferred").otherwise(F.col("directness"))})
