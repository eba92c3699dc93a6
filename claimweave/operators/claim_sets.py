"""Texts that hold whole sets of claims to one row per claim, within the row of the text: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a claim's header looks like, and phrases by which a claim depends on another.
INLINE_HEADERS = (r"^【\s*청구항\s*([0-9]+)\s*】[.．]?\s*(.*)$", r"(?i)^\[\s*CLAIM\s*([0-9]+)\s*\][.．]?\s*(.*)$")
LINE_HEADERS = (r"^청구항\s*([0-9]+)[.．]?\s*$", r"^제\s*([0-9]+)\s*항[.．]?\s*$")
NUMBERED = r"(?:청구항\s*)?([0-9]+)[.．]"
DEPENDENT = (
    r"청구항\s*[0-9]+에\s*있어서",
    r"청구항\s*[0-9]+\s*내지\s*청구항\s*[0-9]+.*있어서",
    r"청구항\s*[0-9]+\s*내지\s*[0-9]+.*있어서",
    r"청구항\s*[0-9]+\s*또는\s*청구항\s*[0-9]+.*있어서",
    r"제\s*[0-9]+\s*항에\s*있어서",
    r"제\s*[0-9]+\s*항\s*내지\s*제\s*[0-9]+\s*항.*있어서",
    r"제\s*[0-9]+\s*항\s*또는\s*제\s*[0-9]+\s*항.*있어서",
)
CLAIM = "array<struct<claim_number:long,text:string>>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def is_dependent(text: Column) -> Column:
    """Whether a phrase of the text makes it a dependent claim; null and empty texts are not."""
    return F.coalesce(text, F.lit("")).rlike("(?U)" + "|".join(DEPENDENT))


def _header(line: Column, at: Column) -> Column:
    """(at, number, inline) of a line; number is null where it is no header."""
    number = lambda p: F.regexp_extract(line, "(?U)" + p, 1).try_cast("long")
    inline = F.coalesce(*[F.when(number(p).isNotNull(), F.regexp_extract(line, "(?U)" + p, 2)) for p in INLINE_HEADERS], F.lit(""))
    return F.struct(at.alias("at"), F.coalesce(*map(number, INLINE_HEADERS + LINE_HEADERS)).alias("number"), inline.alias("inline"))


def with_claims(sets: DataFrame, text: str = "text", into: str = "claims") -> DataFrame:
    """sets with an array of their claims (claim_number, text), which is empty where the text holds no set.

    A header is a line of its own, or one in brackets after which the claim may begin. It opens a claim if its number
    exceeds that of the header before it, whether that one opened a claim or not; what lies between goes to the claim
    that is open. Claims without text are left out. Where no claim is left, lines that begin with a number and a stop
    open claims, whatever their order, if they cut the text in two or more. Text before the first header belongs to none.

    Null and empty texts hold no set; a number beyond 18 digits makes no header.
    """
    df = sets.withColumn("_text", _strip(F.coalesce(F.col(text), F.lit("")))).withColumn("_lines", F.split("_text", "\n"))
    heads = F.filter(F.transform("_lines", lambda line, i: _header(_strip(line), i)), lambda h: h["number"].isNotNull())
    df = df.withColumn("_heads", heads)
    df = df.withColumn("_open", F.filter("_heads", lambda h, k: (k == 0) | (h["number"] > F.get(F.col("_heads"), k - 1)["number"])))

    def body(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_open"), k + 1)["at"], F.size("_lines"))
        lines = F.slice("_lines", h["at"] + 2, end - h["at"] - 1)
        return F.struct(h["number"].alias("claim_number"), _strip(F.concat(h["inline"], F.lit("\n"), F.array_join(lines, "\n"))).alias("text"))

    df = df.withColumn("_headed", F.filter(F.transform("_open", body), lambda c: c["text"] != ""))
    parts = F.filter(F.transform(F.split("_text", rf"(?Um)(?=^{NUMBERED}[ \t])"), _strip), lambda p: p != "")
    numbered = F.filter(
        F.transform(parts, lambda p: F.struct(F.regexp_extract(p, rf"(?U)^{NUMBERED}", 1).try_cast("long").alias("claim_number"), _strip(F.regexp_replace(p, rf"(?U)^{NUMBERED}[ \t]*", "")).alias("text"))),
        lambda c: c["claim_number"].isNotNull(),
    )
    plain = F.when(F.size(parts) > 1, numbered).otherwise(F.array().cast(CLAIM))
    return df.withColumn(into, F.when(F.size("_headed") > 0, F.col("_headed")).otherwise(plain)).drop("_text", "_lines", "_heads", "_open", "_headed")


def split_claims(sets: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, place, claim_number, claim_type, text): the claims of every set in order; a text that holds no set is one claim 1.

    A number may come twice where numbers have no headers; claims.registered_claims lets the last one win. Blank texts have no claims.
    """
    given = sets.select(*key, F.col(text).alias("_given")).filter(_strip(F.coalesce("_given", F.lit(""))) != "")
    whole = F.array(F.struct(F.lit(1).cast("long").alias("claim_number"), _strip(F.col("_given")).alias("text")))
    df = with_claims(given, "_given", "_claims").select(*key, F.posexplode(F.when(F.size("_claims") > 0, F.col("_claims")).otherwise(whole)).alias("place", "_c"))
    kind = F.when(is_dependent(F.col("_c.text")), "dependent").otherwise("independent")
    return df.select(*key, "place", "_c.claim_number", kind.alias("claim_type"), "_c.text")
