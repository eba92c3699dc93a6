"""Raw document texts to fields, claims, sections and blocks: the patent path by markers, the other by headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.segments import BLOCK_CHARS, COVERED_FROM, COVERED_SHARE, OVERLAP_CHARS, SECTION_CHARS, accumulated_sections, marker_paragraphs, summary_capped

# Patterns and limits that results depend on.
HEAD_CHARS = 5_000
PUBLICATION = (
    r"(?iU)\b(WO\s*\d{4}\s*/\s*\d{4,6}(?:\s*A\d?)?|WO\s*\d{10,11}(?:\s*A\d?)?|PCT/[A-Z]{2}\s*\d{4}/\d{4,8}|EP\s*\d\s?\d{3}\s?\d{3}(?:\s*[AB]\d?)?|"
    r"KR\s*\d{2}-?\d{4}-?\d{7}|(?:10|20|30)-\d{4}-\d{7}|(?:10|20|30)-\d{7}|US\s*\d{4}/\d{7}|US\s*\d{1,2},\d{3},\d{3}|US\s*\d{7,}|"
    r"(?:特開|特表|特願|特許)\s*\d{4}-\d{6}|JP\s*\d{4}-?\d{6}|CN\s*\d{9,12}\s*[A-Z]\b)"
)
TITLES = (r"(?iU)발명의\s*명칭\s*[:：]?\s*([^\n]+)", r"(?iU)\(54\)\s*(?:Title|발명의\s*명칭)\s*[:：]?\s*([^\n]+)", r"(?iU)Title\s*[:：]\s*([^\n]+)")
DOMESTIC = r"(?iU)대한민국\s*특허청|\(\s*12\s*\)\s*공개특허공보|공개특허\s*10-\d{4}-\d{7}|발명의\s*상세한\s*설명|청구의\s*범위"
INTERNATIONAL = (
    r"(?iU)\bWO\s*\d{4}\s*/\s*\d{4,6}\s*[A-Z]\d?\b|\bWO\s*\d{10,11}\s*[A-Z]\d?\b|\bPCT/[A-Z]{2}\s*\d{4}/\d{4,8}\b|\bWIPO\s+PCT\b|\bWorld\s+Intellectual\s+Property\s+Organization\b|"
    r"INTERNATIONAL\s+(?:APPLICATION|PUBLICATION)\s+(?:PUBLISHED\s+UNDER\s+THE\s+PATENT\s+COOPERATION\s+TREATY|NUMBER)|\bEUROPEAN\s+PATENT\s+(?:APPLICATION|SPECIFICATION|BULLETIN)\b|"
    r"\bEuropean\s+Patent\s+Office\b|\bUnited\s+States\s+Patent(?:\s+Application\s+Publication)?\b|\bPatent\s+Application\s+Publication\b|"
    r"(?:公開特許公報|特許公報|公表特許公報|特開\s*\d{4}-\d{6})|(?:发明专利申请|发明专利说明书|申请公布号|授权公告号)"
)
GROUPS = {"EFFECT": "효과", "PROBLEM": "과제|문제|목적", "SOLUTION": "해결수단|수단|구성", "DRAWING": r"도\s*\d+|도면", "CONTROL-FLOW": r"S\d{3}|흐름|제어", "DETAIL-EMBODIMENT": r"실시예|구체적인\s*내용|DETAILED"}
CLAIM_SECTION, CLAIM_START = r"(?imdU)(?:특허)?청구(?:의)?\s*범위|\ACLAIMS\n?\z", r"(?U)^\s*(청구항\s*)?\d+\s*\."
REFERENCES, SUMMARY, BACK_MATTER = "(?iU)REFERENCES|BIBLIOGRAPHY|참고문헌", r"(?iU)^\s*(?:ABSTRACT|SUMMARY|초록|요약)\b", r"(?iU)^\s*(?:ACKNOWLEDG(?:E)?MENTS?|감사의?\s*글|사사)\b"
SHORT_LINE, SHORT_MARKER, BARE_MARKER = r"^[ \t]*[\[【(]\s*([1-9]\d{0,2})\s*[\]】)\[]?[ \t]*$", r"[\[【(]\s*([1-9]\d{0,2})\s*[\]】)\[]?", r"^\s*(0\d{3})(?:\.|\s|$)"
DENSE_RUN, DENSE_BARE, LATE_FROM, LATE_SHARE = 5, 5, 10_000, 0.3
CLAIMS_HEADING = r"(?mdU)【\s*(?:특허)?청구(?:의)?\s*범위\s*】|^\s*(?:특허)?청구(?:의)?\s*범위\s*$|\[\s*(?:특허)?청구(?:의)?\s*범위\s*\]"
CLAIMS_HEADING_US, CLAIM_ITEM, CLAIM_ITEM_US = r"(?imdU)^CLAIMS\s*$|^What is claimed", r"(?U)청구항\s*(\d+)", r"(?mdU)^\s*(\d+)\.\s"
SECTION_WORDS = (
    r"INTRODUCTION|RELATED\s+WORKS?|METHODS?|METHODOLOGY|APPROACH|PRELIMINARIES|MATERIALS?(?:\s+AND\s+METHODS?)?|MODEL|ARCHITECTURE|IMPLEMENTATION(?:\s+DETAILS?)?|"
    r"DATASETS?|EXPERIMENTS?(?:\s+AND\s+RESULTS?)?|EVALUATION|ABLATION(?:\s+STUD(?:Y|IES))?|RESULTS?|ANALYSIS|DISCUSSION|LIMITATIONS?|FUTURE\s+WORK|CONCLUSIONS?|"
    r"BACKGROUND(?:\s+OF\s+THE\s+INVENTION)?|APPENDI(?:X|CES)|SUPPLEMENTARY(?:\s+MATERIALS?)?"
)
HEADING = (
    r"(?mdU)^[ \t]*(?:\(\s*\d+\s*\)\s*)?((?:[IVXL]{1,5}|\d+(?:\.\d+)*)\.?[ \t]+(?i:" + SECTION_WORDS + r")|(?=[A-Z])(?i:" + SECTION_WORDS
    + r"|ABSTRACT|SUMMARY|CLAIMS|REFERENCES|BIBLIOGRAPHY|ACKNOWLEDG(?:E)?MENTS?|FIELD(?:\s+OF\s+THE\s+INVENTION)?)(?=[ \t]*[:.]?[ \t]*$)|(?i:\d*\s*DETAILED\s+DESCRIPTION(?:\s+OF\s+[^\n]+)?)"
    r"|초록|요약|서론|관련\s*연구|제안\s*방법|실험|결과|고찰|결론|참고문헌|감사의?\s*글|사사|도면의\s*간단한\s*설명|발명의\s*상세한\s*설명|발명의\s*목적"
    r"|발명이\s*속하는\s*기술\s*및\s*그\s*분야의\s*종래기술|발명이\s*이루고자\s*하는\s*기술적\s*과제|발명의\s*구성\s*및\s*작용|(?:특허)?청구(?:의)?\s*범위)\b"
)
_CUT = "\u0001"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def publication_no(text: Column, filename: Column) -> Column:
    """The first publication number of the text's head, else of the file name, else the file name's stem."""
    found = [F.upper(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), PUBLICATION, 1), r"(?U)\s+", "")) for c in (F.substring(text, 1, HEAD_CHARS), filename)]
    return F.when(found[0] != "", found[0]).when(found[1] != "", found[1]).otherwise(_stem(filename))


def _stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?s)(?<=.)\.[^.]*$", "")


def title(text: Column, filename: Column) -> Column:
    out = _stem(filename)
    for pattern in reversed(TITLES):
        found = _strip(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1))
        out = F.when(F.length(found).between(2, 160), found).otherwise(out)
    return out


def looks_like_patent(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.rlike(t, F.lit(DOMESTIC)) | F.rlike(F.substring(t, 1, HEAD_CHARS), F.lit(INTERNATIONAL))


def clean_paragraph_no(key: Column) -> Column:
    found = F.regexp_extract(F.coalesce(key, F.lit("")), r"0\d{3}", 0)
    return F.when(found != "", found).otherwise(F.regexp_replace(F.coalesce(key, F.lit("")), r"^[\[\]]+|[\[\]]+$", ""))


def group_label(section: Column, text: Column) -> Column:
    both, out = F.concat_ws(" ", F.coalesce(section, F.lit("")), F.coalesce(text, F.lit(""))), F.lit("SUMMARY")
    for name, words in reversed(GROUPS.items()):
        flags = "iU" if name in ("CONTROL-FLOW", "DETAIL-EMBODIMENT") else "U"
        out = F.when(F.rlike(both, F.lit(f"(?{flags})(?:{words})")), name).otherwise(out)
    return out


def is_claim_paragraph(section: Column, text: Column) -> Column:
    return F.rlike(F.coalesce(section, F.lit("")), F.lit(CLAIM_SECTION)) | F.rlike(F.coalesce(text, F.lit("")), F.lit(CLAIM_START))


def section_exclusion(section: Column) -> Column:
    """references, summary, back_matter or prior_claim; null where a section counts."""
    s = F.coalesce(section, F.lit(""))
    return F.when(s.rlike(REFERENCES), "references").when(s.rlike(SUMMARY), "summary").when(s.rlike(BACK_MATTER), "back_matter").when(s.rlike(CLAIM_SECTION), "prior_claim")


def short_markers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, start, value) of every line that is a short marker alone; a digit too many by misreading is dropped."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    marks = lines.withColumn("raw", F.regexp_extract(F.regexp_replace("line", "\r$", ""), SHORT_LINE, 1).try_cast("int")).filter("raw is not null")
    cut, before, after = F.floor(F.col("raw") / 10), F.lag("raw").over(order), F.lead("raw").over(order)
    misread = (F.col("raw") > 9) & (cut == before + 1) & (cut == after - 1)
    return marks.select(key, "at", "start", F.when(F.coalesce(misread, F.lit(False)), cut).otherwise(F.col("raw")).cast("int").alias("value"))


def dense_starts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start): where the first run of DENSE_RUN consecutive short markers begins; none if that is late in a long text."""
    order = Window.partitionBy(key).orderBy("at")
    marks = short_markers(docs, key, text).withColumn("island", F.col("value") - F.row_number().over(order))
    fresh = F.coalesce((F.col("island") != F.lag("island").over(order)).cast("int"), F.lit(1))
    runs = marks.withColumn("run", F.sum(fresh).over(order)).groupBy(key, "run").agg(F.count("*").alias("n"), F.min("start").alias("start")).filter(F.col("n") >= DENSE_RUN)
    first = runs.groupBy(key).agg(F.min("start").alias("start")).join(docs.select(key, F.length(text).alias("_n")), key)
    return first.filter((F.col("_n") < LATE_FROM) | (F.col("start") <= F.col("_n") * LATE_SHARE)).select(key, "start")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph_no, paragraph) by the first way that finds any: four-digit markers, a dense run of short markers, bare numbers.

    Paragraphs that cover too little of a long text are dropped: such a document takes the other path.
    """
    own = docs.select(key, F.col(text).alias("text"))
    first = marker_paragraphs(own, key, covered=False)
    rest = own.join(first.select(key).distinct(), key, "left_anti")
    lines = rest.join(dense_starts(rest, key), key).select(key, "start", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marks = short_markers(rest, key).select(key, "at", F.col("start").alias("line_start"), "value")
    begins = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("place", F.coalesce(F.sum(F.length("line") + 1).over(begins), F.lit(0))).filter("place >= start").join(marks, [key, "at"], "left")
    rewritten = F.when(F.col("value").isNotNull(), F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))).otherwise(F.col("line"))
    again = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", rewritten.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    second = marker_paragraphs(again, key, pattern=SHORT_MARKER, covered=False)
    third = marker_paragraphs(rest.join(second.select(key).distinct(), key, "left_anti"), key, pattern=BARE_MARKER, covered=False)
    enough = third.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= DENSE_BARE).select(key)
    every = first.unionByName(second).unionByName(third.join(enough, key, "left_semi"))
    held = every.groupBy(key).agg(F.sum(F.length("paragraph")).alias("_held")).join(own.select(key, F.length("text").alias("_whole")), key)
    kept = held.filter((F.col("_whole") < COVERED_FROM) | (F.col("_held") / F.col("_whole") >= COVERED_SHARE)).select(key)
    return every.join(kept, key, "left_semi")


def _after(text: Column, pattern: str) -> Column:
    """What follows the pattern's first match; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.expr("_t").substr(at + F.length(F.regexp_extract(text, pattern, 0)), F.length(text)))


def _items(section: Column, pattern: str, header: str) -> Column:
    """Numbered items of a section as structs of number and body."""
    numbers = F.regexp_extract_all(section, F.lit(pattern), F.lit(1))
    bodies = F.split(F.regexp_replace(section, pattern, _CUT + "$0"), _CUT)
    bodies = F.transform(F.slice(bodies, 2, F.greatest(F.size(numbers), F.lit(1))), lambda b: _strip(F.regexp_replace(_strip(b), header, "")))
    return F.when(F.size(numbers) > 0, F.arrays_zip(numbers.alias("number"), bodies.alias("body")))


def claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, number, body): items after a claims heading, by the first heading that yields any, else items anywhere; the last of a number wins."""
    df = docs.select(key, F.coalesce(text, F.lit("")).alias("_t"))
    t = F.col("_t")
    df = df.withColumn("_kr", _after(t, CLAIMS_HEADING)).withColumn("_us", _after(t, CLAIMS_HEADING_US))
    kr = r"(?U)^청구항\s*\d+"
    found = F.coalesce(_items(F.col("_kr"), CLAIM_ITEM, kr), _items(F.col("_us"), CLAIM_ITEM_US, r"(?U)^\d+\.\s*"), _items(t, CLAIM_ITEM, kr))
    each = df.select(key, F.posexplode(found).alias("at", "c"))
    return each.groupBy(key, F.col("c.number").alias("number")).agg(F.max_by("c.body", "at").alias("body"))


def heading_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, section, body): from each heading to the next, what is before the first as ABSTRACT; without headings, blocks of SECTION_CHARS."""
    df = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))
    df = df.withColumn("_names", F.regexp_extract_all("text", F.lit(HEADING), F.lit(1))).withColumn("_parts", F.split(F.regexp_replace("text", HEADING, _CUT + "$0"), _CUT))
    headed = df.filter(F.size("_names") > 0)
    names = F.concat(F.array(F.lit("ABSTRACT")), F.transform("_names", lambda n: F.regexp_replace(_strip(n), "\n", " ")))
    headed = headed.select(key, F.filter(F.arrays_zip(names.alias("section"), F.transform("_parts", _strip).alias("body")), lambda s: F.coalesce(s["body"], F.lit("")) != "").alias("s"))
    plain = accumulated_sections(df.filter(F.size("_names") == 0).select(key, "text"), least=SECTION_CHARS)
    plain = plain.select(key, F.transform("sections", lambda b, i: F.struct(F.concat(F.lit("SECTION-"), F.lpad((i + 1).cast("string"), 2, "0")).alias("section"), b.alias("body"))).alias("s"))
    return headed.unionByName(plain).select(key, F.posexplode("s").alias("section_no", "s")).select(key, "section_no", "s.section", "s.body")


def dense_blocks(text: Column, target: int = BLOCK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Paragraphs packed into blocks of about `target` characters; the last ones, `overlap` characters or more, open the next block.

    A paragraph over the target that meets an empty buffer is packed by sentences, with a tail of `overlap` characters.
    """
    strings = F.array().cast("array<string>")
    state = lambda blocks, buffer, size: F.struct(blocks.alias("blocks"), buffer.alias("buffer"), size.alias("size"))
    lengths = lambda buffer: F.aggregate(buffer, F.lit(0), lambda n, x: n + F.length(x) + 2)

    def tail(buffer: Column) -> Column:
        none = F.struct(strings.alias("kept"), F.lit(0).alias("n"))
        grown = lambda s, x: F.when(s["n"] >= overlap, s).otherwise(F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["n"] + F.length(x) + 2).alias("n")))
        return F.aggregate(F.reverse(buffer), none, grown, lambda s: s["kept"])

    def sentence(s: Column, x: Column) -> Column:
        full = (F.size(s["buffer"]) > 0) & (s["size"] + F.length(x) + 1 > target)
        block = F.array_join(s["buffer"], " ")
        rest = _strip(F.right(block, F.lit(overlap)))
        flushed = state(F.concat(s["blocks"], F.array(block)), F.when(rest != "", F.array(rest)).otherwise(strings), F.length(rest))
        now = F.when(full, flushed).otherwise(s)
        return state(now["blocks"], F.concat(now["buffer"], F.array(x)), now["size"] + F.length(x) + 1)

    def step(s: Column, p: Column) -> Column:
        full = (F.size(s["buffer"]) > 0) & (s["size"] + F.length(p) + 2 > target)
        kept = tail(s["buffer"])
        now = F.when(full, state(F.concat(s["blocks"], F.array(F.array_join(s["buffer"], "\n\n"))), kept, lengths(kept))).otherwise(s)
        sentences = F.split(F.regexp_replace(p, r"(?U)(?<=[.!?。！？])\s+", _CUT), _CUT)
        return F.when((F.length(p) > target) & (F.size(now["buffer"]) == 0), F.aggregate(sentences, now, sentence)).otherwise(state(now["blocks"], F.concat(now["buffer"], F.array(p)), now["size"] + F.length(p) + 2))

    def close(s: Column) -> Column:
        last = _strip(F.array_join(s["buffer"], "\n\n"))
        more = (last != "") & ((F.size(s["blocks"]) == 0) | (last != F.element_at(F.concat(F.array(F.lit("")), s["blocks"]), -1)))
        return F.when(more, F.concat(s["blocks"], F.array(last))).otherwise(s["blocks"])

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n"), _strip), lambda p: p != "")
    return F.aggregate(parts, state(strings, strings, F.lit(0)), step, close)


def section_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, section, block, excluded, kept_no): dense blocks of every section, numbered over the document.

    Blocks of references, back matter and claims are excluded, those of a summary while it is under its cap; kept_no
    counts the others alone.
    """
    rows = heading_sections(docs, key, text).select(key, "section_no", "section", F.posexplode(dense_blocks(F.col("body"))).alias("at", "block"))
    rows = summary_capped(rows.withColumn("_s", F.struct(key, "section_no")), "_s", "at", "block").withColumnRenamed("excluded", "_early").drop("_s")
    reason = section_exclusion(F.col("section"))
    rows = rows.withColumn("excluded", F.when((reason != "summary") | F.col("_early"), reason))
    order = Window.partitionBy(key).orderBy("section_no", "at")
    rows = rows.withColumn("block_no", F.row_number().over(order)).withColumn("kept_no", F.when(F.col("excluded").isNull(), F.count_if(F.col("excluded").isNull()).over(order)))
    return rows.select(key, "block_no", "section", "block", "excluded", "kept_no")


def routed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paragraphs of documents with any, section blocks of all others): every document takes one path."""
    marked = paragraphs(docs, key, text)
    return marked, section_blocks(docs.join(marked.select(key).distinct(), key, "left_anti"), key, text)
