"""Claim texts to parents, parts and labelled elements, as columns; folds over a claim's few parts are aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.predicates import is_conditioned_selection
from claimweave.operators.judgments import normalized_label

# Patterns and limits that results depend on.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MENTION = r"(?:제\s*(\d+)\s*항|청구항\s*(\d+))"
MORE = r"(?:\s*(?:내지|또는|및)\s*(?:제\s*\d+\s*항|청구항\s*\d+|\d+))?"
ENDING = MENTION + MORE + r"(?:\s*중\s*어느\s*한\s*항)?(?:에\s*있어서|의)"
DEPENDING = MENTION + MORE + r"\s*(?:(?:을|를)\s*(?:포함|인용|청구|참조|기재)\s*(?:하는|하여|하고)?|에\s*따른|에\s*의한)"
HEAD_CHARS = 150
PREAMBLE = r"^(.*?에\s*있어서)\s*[,，、]\s*"
CLOSING = (
    r"\s*(?=(?:을|를)\s*포함(?:하는|하며|하고)?\s*(?:장치|방법|시스템|프로그램|단말|서버|기기|컴퓨터|기록\s*매체|네트워크|데이터베이스)"
    r"|특징으로\s*하는\s*(?:장치|방법|시스템|프로그램|단말|서버|기기|컴퓨터|기록\s*매체))"
)
STEP, STEP_END = r"\(\s*[A-Za-z]\s*\)\s*단계", r"\(\s*[A-Za-z]\s*\)\s*단계(?!\s*에서)(?:\s*및)?"
LABELLED = r"(?:^|\n|\s)[\(\[]([A-Za-z])[\)\]]\s*(.*?)(?=(?:\n|\s)[\(\[][A-Za-z][\)\]]|\z)"
NAMES = (r"(?:하는|하기\s*위한|구비된|구비한)\s+([\w가-힣]+(?:\s+[\w가-힣]+){0,2})\s*[;,]?\s*$", r"포함하는\s+([\w가-힣]+(?:\s+[\w가-힣]+){0,2})\s*[;,]?\s*$")
VERBAL = "하는|하며|하고|이며|이고|되는|수행|포함|연결|처리|변환|전송|수신|저장|판단|생성|제공|구비"
BARE_CHARS, LINE_CHARS, LEAST_BEFORE_CLOSING = 15, 3, 10
ELEMENT = "struct<label:string,text:string,importance:int,is_sub:boolean,parent_label:string>"
_CUT = "\u0001"


def _u(pattern: str) -> str:
    return "(?sU)" + pattern


def _strip(c: Column, more: str = "") -> Column:
    return F.regexp_replace(c, rf"(?U)^[\s{more}]+|[\s{more}]+$", "")


def _number(text: Column, pattern: str) -> Column:
    one = lambda k: F.regexp_extract(text, _u(pattern), k).try_cast("int")
    return F.coalesce(one(1), one(2))


def with_parents(claims: DataFrame) -> DataFrame:
    """claims (claim_number, claim_type, parent_claim, text) with parents that the text names where none is given.

    First a dependency ending anywhere; then any earlier claim named in the head; then a dependency phrase in the body.
    An independent claim that has a parent is dependent.
    """
    text, own = _strip(F.coalesce("text", F.lit(""))), F.col("claim_number")
    first = F.nullif(_number(text, ENDING), own)
    head = F.substring(text, 1, HEAD_CHARS)
    mentions = F.regexp_extract_all(head, F.lit(_u(r"(?:제\s*\d+\s*항|청구항\s*\d+)")), F.lit(0))
    numbers = F.transform(mentions, lambda m: F.regexp_extract(m, r"\d+", 0).try_cast("int"))
    second = F.get(F.filter(numbers, lambda n: n < own), F.lit(0))
    third = _number(text, DEPENDING)
    parent = F.coalesce("parent_claim", first, second, F.when(third < own, third))
    out = claims.withColumn("parent_claim", parent.cast("long"))
    return out.withColumn("claim_type", F.when((F.col("parent_claim") > 0) & (F.col("claim_type") == "independent"), "dependent").otherwise(F.col("claim_type")))


def with_body(claims: DataFrame) -> DataFrame:
    """claims with preamble, closing and body; a closing counts only beyond the first third after the preamble."""
    df = claims.withColumn("_t", _strip(F.coalesce("text", F.lit(""))))
    df = df.withColumn("preamble", F.nullif(_strip(F.regexp_extract("_t", _u(PREAMBLE), 1)), F.lit(""))).withColumn("_from", F.length(F.regexp_extract("_t", _u(PREAMBLE), 0)))
    rest = F.expr("substring(_t, _from + 1)")
    at = F.when(F.col("_from") == 0, F.regexp_instr(rest, F.lit(_u(r"(?:^|[\n,])" + CLOSING)))).otherwise(F.regexp_instr(rest, F.lit(_u(r"[\n,]" + CLOSING))))
    df = df.withColumn("_at", at - 1).withColumn("_third", F.greatest(F.lit(LEAST_BEFORE_CLOSING), F.floor((F.length("_t") - F.col("_from")) / 3)))
    ends = (F.col("_at") >= 0) & (F.col("_at") > F.col("_third"))
    df = df.withColumn("closing", F.when(ends, F.regexp_replace(_strip(F.expr("substring(_t, _from + _at + 1)")), r"(?U)^[,\s]+", "")))
    body = _strip(F.when(ends, F.expr("substring(_t, _from + 1, _at)")).otherwise(rest), ",")
    return df.withColumn("body", F.when(body == "", F.col("_t")).otherwise(body)).drop("_t", "_from", "_at", "_third")


def _weight(text: Column, place: Column) -> Column:
    """5 first, 3 for the second and third, else 2; a conditioned selection is always 5."""
    return F.when(is_conditioned_selection(text) | (place == 0), 5).when(place < 3, 3).otherwise(2)


def _element(label: Column, text: Column, importance: Column, parent: Column | None = None) -> Column:
    of = F.lit(None).cast("string") if parent is None else parent
    return F.struct(label.alias("label"), text.alias("text"), importance.cast("int").alias("importance"), F.lit(parent is not None).alias("is_sub"), of.alias("parent_label"))


def _letter(place: Column) -> Column:
    return F.substring(F.lit(LETTERS), place + 1, F.lit(1))


def _name(text: Column) -> Column:
    found = [F.regexp_extract(_strip(text), _u(p), 1) for p in NAMES]
    return _strip(F.when(found[0] != "", found[0]).otherwise(found[1]))


def _numbered(parts: Column) -> Column:
    """Elements of parts that have no labels of their own: letters in order, bare nouns as _, and parts of a named one as <letter>-1."""
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<label:string,name:string>>").alias("names"), F.array().cast(f"array<{ELEMENT}>").alias("out"))

    def step(s: Column, part: Column) -> Column:
        text = F.regexp_replace(part, "[; ]+$", "")
        bare = (F.length(_strip(text, ";")) <= BARE_CHARS) & ~text.rlike(VERBAL)
        of = F.when(F.contains(text, F.lit("상기")), F.get(F.filter(s["names"], lambda x: F.rlike(text, F.concat(F.lit(r"(?U)상기\s+"), x["name"]))), F.lit(0))["label"])
        label = _letter(s["n"])
        plain = ~bare & of.isNull()
        one = F.when(bare, _element(F.lit("_"), text, F.lit(2))).when(of.isNotNull(), _element(F.concat(of, F.lit("-1")), text, F.lit(3), of)).otherwise(_element(label, text, _weight(text, s["n"])))
        named = F.when(plain & (_name(text) != ""), F.concat(s["names"], F.array(F.struct(label.alias("label"), _name(text).alias("name"))))).otherwise(s["names"])
        return F.struct((s["n"] + plain.cast("int")).alias("n"), named.alias("names"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(parts, empty, step, lambda s: s["out"])


def with_elements(claims: DataFrame) -> DataFrame:
    """claims with preamble, closing, elements (an array of ELEMENT, at most 26) and split_method.

    Tried in order: step labels at the end of parts, two at least; labels in brackets before parts; semicolons; lines; the
    whole body. A claim without any element is its own only one.
    """
    df = with_body(claims)
    body = F.col("body")
    marked = F.split(F.regexp_replace(body, _u(f"({STEP_END})"), "$1" + _CUT), _CUT)
    clean = lambda x: F.regexp_replace(_strip(F.regexp_replace(_strip(x, ","), _u(STEP), "단계")), r"(?U)^\s*및\s*|\s*및\s*$", "")
    steps = F.transform(F.slice(marked, 1, F.greatest(F.size(marked) - 1, F.lit(0))), lambda x: _strip(clean(x)))
    df = df.withColumn("_steps", F.filter(F.transform(F.slice(steps, 1, len(LETTERS)), lambda x, i: _element(_letter(i), x, _weight(x, i))), lambda e: e["text"] != "")).withColumn("_n", F.size(steps))
    own = [F.regexp_extract_all(body, F.lit(_u(LABELLED)), F.lit(k)) for k in (1, 2)]
    pairs = F.slice(F.arrays_zip(own[0].alias("l"), own[1].alias("t")), 1, len(LETTERS))
    df = df.withColumn("_labelled", F.filter(F.transform(pairs, lambda p, i: _element(F.upper(p["l"]), F.regexp_replace(p["t"], r"^[ \n;]+|[ \n;]+$", ""), _weight(p["t"], i))), lambda e: e["text"] != ""))
    semis = F.filter(F.transform(F.split(body, "[;；]"), _strip), lambda p: p != "")
    lines = F.filter(F.transform(F.split(body, "\n"), _strip), lambda p: F.length(p) > LINE_CHARS)
    df = df.withColumn("_semis", semis).withColumn("_lines", lines)
    parts = F.when(F.size("_semis") > 1, F.col("_semis")).when(F.size("_lines") > 1, F.col("_lines")).otherwise(F.array("body"))
    method = F.when((F.col("_n") >= 2) & (F.size("_steps") >= 2), "trailing_labeled").when(F.size("_labelled") > 0, "labeled").when((F.size("_semis") > 1) | (F.size("_lines") > 1), "regex").otherwise("fallback")
    df = df.withColumn("split_method", method)
    chosen = F.when(F.col("split_method") == "trailing_labeled", F.col("_steps")).when(F.col("split_method") == "labeled", F.col("_labelled")).otherwise(_numbered(F.filter(F.slice(parts, 1, len(LETTERS)), lambda p: p != "")))
    df = df.withColumn("elements", chosen)
    whole = F.array(_element(F.lit("A"), F.coalesce("text", F.lit("")), F.lit(3)))
    return df.withColumn("elements", F.when(F.size("elements") > 0, F.col("elements")).otherwise(whole)).drop("body", "_steps", "_n", "_labelled", "_semis", "_lines")


def with_preamble_element(claims: DataFrame) -> DataFrame:
    """An independent claim's preamble as its first element P, where it has none yet."""
    none = ~F.exists("elements", lambda e: e["label"] == "P")
    first = F.array(_element(F.lit("P"), F.col("preamble"), F.lit(5)))
    wanted = (F.col("claim_type") == "independent") & (F.coalesce("preamble", F.lit("")) != "") & none
    return claims.withColumn("elements", F.when(wanted, F.concat(first, F.col("elements"))).otherwise(F.col("elements")))


def unique_labels(labels: Column) -> Column:
    """Labels fit for comparison: P, a letter or a letter with -n, each once; others get the next free letter, then X<n>."""
    letters = F.array(*map(F.lit, LETTERS))
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, raw: Column) -> Column:
        label = normalized_label(raw)
        good = label.rlike(r"^(?:P|[A-Z](?:-\d+)?)$") & ~F.array_contains(s["used"], label)
        free = F.get(F.filter(F.sequence(s["next"], F.greatest(s["next"], F.lit(len(LETTERS)))), lambda j: (j < len(LETTERS)) & ~F.array_contains(s["used"], F.get(letters, j))), F.lit(0))
        other = F.coalesce(F.get(letters, free), F.concat(F.lit("X"), (F.size(s["used"]) + 1).cast("string")))
        out = F.when(good, label).otherwise(other)
        after = F.when(good, s["next"]).otherwise(F.coalesce(free, F.lit(len(LETTERS))) + 1)
        return F.struct(after.alias("next"), F.array_union(s["used"], F.array(out)).alias("used"), F.concat(s["out"], F.array(out)).alias("out"))

    return F.aggregate(labels, empty, step, lambda s: s["out"])
