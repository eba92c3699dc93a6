"""Operator 3: quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each rule that
the document fails; versioned policies are masks over those bits, so that a new policy, or an ablation that leaves
a rule out, reads the ledger and never the texts again.

Edge cases: a null or empty text has no words and fails the first rule; repeated rows are judged alike, one by
one; null ids are kept; an empty table gives an empty ledger; extra columns of any name are carried by `ledger`, and
replaced where they are called like one of its own. Any length of text is measured whole: windows of three words are compared by a
hash with their position packed in one long, and a document where two different windows share a hash, or with more
words than positions, is measured by the windows themselves.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import SPACE, held

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
POSITION_BITS = 22

#: Each rule as a condition that a failing document meets; a rule's bit is its place here. New rules go last.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_or_long_words": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 60 * word_chars",
}
BASE = ("too_few_words", "repeated_words")
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _covered(positions: Column) -> Column:
    """Words in windows of three that begin at the given distinct positions, in order."""
    pairs = F.arrays_zip(positions.alias("a"), F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1))).alias("b"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, p: n + F.least(F.lit(3).cast("long"), p["b"] - p["a"]))


def _zip3(words: Column) -> Column:
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))


def _neighbours(items: Column) -> Column:
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(F.slice(items, 1, n).alias("a"), F.slice(items, 2, n).alias("b"))


def _ends(pairs: Column, place) -> Column:
    both = F.concat(F.transform(pairs, lambda p: place(p["a"])), F.transform(pairs, lambda p: place(p["b"])))
    return F.sort_array(F.array_distinct(both))


def _measured(own: DataFrame) -> DataFrame:
    """own, which has _row and a text _t, as _row and the MEASURES of every whole text."""
    t = F.col("_t")
    df = held(own, _w=F.array_remove(F.split(t, SPACE), ""), _l=F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    packed = F.transform(_zip3(F.col("_w")), lambda x, i: F.shiftleft(F.xxhash64(x["a"], x["b"], x["c"]), POSITION_BITS).bitwiseOR(i.cast("long")))
    df = held(df, _s=F.sort_array(packed))
    same = F.filter(_neighbours(F.col("_s")), lambda p: F.shiftright(p["a"].bitwiseXOR(p["b"]), POSITION_BITS) == 0)
    df = held(df, _d=same)
    word = lambda at, k: F.element_at(F.col("_w"), at.bitwiseAND(low).cast("int") + k)
    clash = F.exists(F.col("_d"), lambda p: (word(p["a"], 1) != word(p["b"], 1)) | (word(p["a"], 2) != word(p["b"], 2)) | (word(p["a"], 3) != word(p["b"], 3)))
    by_words = F.array_sort(F.transform(_zip3(F.col("_w")), lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), i.cast("long").alias("i"))))
    equal = F.filter(_neighbours(by_words), lambda p: (p["a"]["a"] == p["b"]["a"]) & (p["a"]["b"] == p["b"]["b"]) & (p["a"]["c"] == p["b"]["c"]))
    exact = _covered(_ends(equal, lambda x: x["i"]))
    fast = _covered(_ends(F.col("_d"), lambda x: x.bitwiseAND(low)))
    only = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("long")
    long = lambda c: c.cast("long")
    return df.select(
        "_row",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.when(F.size("_d") == 0, F.lit(0).cast("long")).when((F.size("_w") > 1 << POSITION_BITS) | clash, exact).otherwise(fast).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"),
        only("A-Z").alias("n_upper"),
    )


def _entries(docs: DataFrame, row: Column, text: str) -> DataFrame:
    """_row, measurements and fail_bits of every document; every rule is evaluated once."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    own = docs.select(row.alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    return _measured(own).withColumn("fail_bits", total.cast("long"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and fail_bits in place of any columns of those names."""
    own = [*MEASURES, "fail_bits"]
    return _entries(docs, F.struct("*"), text).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in own], *own)


def judged(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with base_failed, kept and the policy's name."""
    hits = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return rows.withColumns({"base_failed": hits(BASE), "kept": ~(hits(BASE) | hits(POLICIES[policy])), "policy": F.lit(policy)})


def kept_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns as they were."""
    return judged(_entries(docs, F.struct("*"), "text"), policy).filter("kept").select("_row.*")


def ablation(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For every policy and rule in it: documents that fail the rule, that only this rule rejects, and kept without it."""
    sums, names = [F.count("*").alias("n")], []
    for policy, rules in policies.items():
        chosen = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long"))
        for r in rules:
            bit = F.lit(mask((r,))).cast("long")
            k = len(names)
            names.append((policy, r))
            sums += [F.count_if(chosen.bitwiseAND(bit) != 0).alias(f"f{k}"), F.count_if(chosen == bit).alias(f"o{k}"), F.count_if(chosen.bitwiseAND(F.bitwise_not(bit)) == 0).alias(f"k{k}")]
    total = rows.agg(*sums)
    each = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_only"), F.col(f"k{k}").alias("n_kept_without"), F.col("n").alias("n_documents")) for k, (p, r) in enumerate(names)]
    return total.select(F.inline(F.array(*each)))


def by_group(rows: DataFrame, group: str) -> DataFrame:
    """Per group: bits that any document fails, and bits that all fail, by bitwise aggregation."""
    return rows.groupBy(group).agg(F.bit_or("fail_bits").alias("any_failed"), F.bit_and("fail_bits").alias("all_failed"), F.count("*").alias("n_documents"))


def quality_verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    out = judged(_entries(docs, F.struct("doc_id"), "text"), policy)
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_lines", "n_upper")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
i AS (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i+1], w[i+2]) AS n FROM i),
c AS (SELECT row_id, count(DISTINCT p) AS n_repeat FROM (SELECT row_id, unnest([i, i+1, i+2]) AS p FROM g WHERE n > 1) GROUP BY row_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN c USING (row_id)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
             + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
             + 32 * (100 * n_upper > 60 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, n_lines, n_upper FROM b
"""
