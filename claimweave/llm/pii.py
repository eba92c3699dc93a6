r"""Operator 8: personal data by boosted trees over candidate spans, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers that pass their checks. Generators of
high recall propose further spans, which may overlap. A span's format and the characters around it are features
of boosted trees, written as one column expression; a threshold for each kind, calibrated on documents held out
of training for a precision, selects the spans that are added. The trees learn from the base spans: a candidate
over one is an example, any other a counter-example, in every document. Spans of equal features and outcome meet in
one counted row before they reach the driver, which so learns from all of them.

All patterns read a text once from left to right: runs are possessive and start only where a run starts, so that
no text, however long, takes quadratic time. Places are code points, summed over the texts between the matches.

Edge cases: null and empty texts hold nothing; repeated rows get equal spans; null ids are kept; without
candidates of both outcomes nothing is added; an empty table gives an empty result; `redacted` keeps extra
columns, and those called like its own helpers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm import trees
from claimweave.llm.common import held

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. (?:\G|(?<!..)) lets a match begin where a run begins or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![^\s@<>()\[\],;:\"'])[^\s@<>()\[\],;:\"']++@[^\s@<>()\[\],;:\"']++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,22}+",
    "phone": r"(?<![0-9+])[+(]{0,2}+[0-9][\x20()./0-9-]{5,22}[0-9](?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = 24
#: Precision of what is added; spans summed at a time.
PRECISION, BLOCK = 0.95, 128
SPAN = "struct<kind:int,start:int,end:int,hit:string,before:string,after:string>"


@dataclass(frozen=True)
class Model:
    forest: trees.Forest | None
    #: For each kind, the raw score from which on a span is added; None: never.
    least: tuple[float | None, ...]


def _places(df: DataFrame, patterns: dict[str, tuple[int, str, str | None]]) -> DataFrame:
    """df with, for every name, the pattern's matches in _t as an array of SPAN, and no other new column."""
    t, none = F.col("_t"), F.array().cast("array<string>")
    able = {n: t.contains(need) if need else F.lit(True) for n, (_, _, need) in patterns.items()}
    df = held(df, **{f"_h_{n}": F.when(able[n], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for n, (_, p, _) in patterns.items()})
    found = {n: F.size(f"_h_{n}") for n in patterns}
    df = held(df, **{f"_g_{n}": F.when(found[n] > 0, F.split(t, p, -1)).otherwise(none) for n, (_, p, _) in patterns.items()})

    def pieces(n: str) -> Column:
        zipped = F.arrays_zip(F.slice(f"_g_{n}", 1, F.greatest(found[n], F.lit(1))).alias("g"), F.col(f"_h_{n}").alias("h"), F.slice(f"_g_{n}", 2, F.greatest(found[n], F.lit(1))).alias("a"))
        return F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["h"]).alias("n"), x["h"].alias("hit"), F.right(x["g"], F.lit(CONTEXT)).alias("before"), F.left(x["a"], F.lit(CONTEXT)).alias("after")))

    df = held(df, **{f"_p_{n}": F.when(found[n] > 0, pieces(n)) for n in patterns})
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor((found[n] - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(f"_p_{n}"), b * BLOCK + 1, F.lit(BLOCK)))
    df = held(df, **{f"_b_{n}": F.when(found[n] > 0, blocks(n)) for n in patterns})
    total = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["g"] + x["n"])
    df = held(df, **{f"_s_{n}": F.transform(f"_b_{n}", total) for n in patterns})

    def placed(n: str, kind: int) -> Column:
        def walk(block: Column, k: Column) -> Column:
            begin = F.aggregate(F.slice(F.col(f"_s_{n}"), F.lit(1), k), F.lit(0), lambda s, x: s + x)
            nothing = F.struct(begin.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

            def step(s: Column, x: Column) -> Column:
                start = s["at"] + x["g"]
                one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
                return F.struct((start + x["n"]).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

            return F.aggregate(block, nothing, step, lambda s: s["out"])

        return F.when(found[n] > 0, F.flatten(F.transform(f"_b_{n}", walk))).otherwise(F.array().cast(f"array<{SPAN}>"))

    out = held(df, **{n: placed(n, kind) for n, (kind, _, _) in patterns.items()})
    return out.drop(*[f"_{x}_{n}" for x in "hgpbs" for n in patterns])


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return s + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _small_parts(hit: Column) -> Column:
    """Whether every dotted part is at most 255."""

    def small(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+", "")
        return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(hit, r"\."), small)


def _valid(kind: str, span: Column) -> Column:
    """Whether a base pattern's match passes its kind's checks."""
    digits = F.regexp_replace(span["hit"], "[^0-9]", "")
    if kind == "ip":
        return _small_parts(span["hit"])
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _features(span: Column) -> Column:
    """Format and context of a span as an array of doubles."""
    hit = span["hit"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    count = lambda chars: F.length(F.regexp_replace(hit, f"[^{chars}]", ""))
    has = lambda c: F.when(c, 1).otherwise(0)
    lower = F.lower(span["before"])
    every = [
        span["kind"],
        F.length(hit),
        F.length(digits),
        count("A-Za-z"),
        count("."),
        count(" "),
        count("()"),
        count(r"\-/"),
        F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))),
        has(F.left(hit, F.lit(1)) == "+"),
        has(F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)),
        has((span["kind"] == 1) & _small_parts(hit)),
        has(hit.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2}")),
        has(hit.rlike(r"[^\x00-\x7F]")),
        has(lower.rlike(r"(?:tel|phone|fon|call|mobile|cell|fax)\W*$")),
        has(lower.rlike(r"(?:mail|contact|write|from|to)\W*$")),
        has(lower.rlike(r"(?:card|visa|account|iban|number|no\.|nr\.?)\W*$")),
        has(lower.rlike(r"(?:ip|host|address|server)\W*$")),
        has(lower.rlike(r"[\p{L}\p{N}]$")),
        has(span["after"].rlike(r"^[\p{L}\p{N}]")),
    ]
    return F.array(*[f.cast("double") for f in every])


def _score(forest: trees.Forest, features: Column) -> Column:
    """The forest's raw score of an array of features as one column."""

    def node(i: int) -> Column:
        f = int(forest.feature[i])
        if f < 0:
            return F.lit(float(forest.value[i]))
        low = int(forest.left[i])
        return F.when(F.get(features, F.lit(f)) <= float(forest.threshold[i]), node(low)).otherwise(node(low + 1))

    return reduce(Column.__add__, [node(int(r)) for r in forest.roots], F.lit(float(forest.base)))


def _spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with _base, the base spans, and _more, the generators' spans."""
    df = docs.withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    patterns = {f"_{k}": (i, BASE[k], NEEDS.get(k)) for i, k in enumerate(KINDS)} | {f"_{k}_g": (i, GENERATORS[k], None if k == "phone" else NEEDS.get(k)) for i, k in enumerate(KINDS)}
    df = _places(df, patterns)
    base = F.concat(*[F.filter(f"_{k}", partial(_valid, k)) for k in KINDS])
    more = F.concat(*[F.col(f"_{k}_g") for k in KINDS])
    return held(df, _base=base, _more=more).drop("_t", *patterns)


def examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """x, y, apart, n: how many spans of all different texts have these features and outcome; apart is held out of training.

    Copies of a text count once, however many there are.
    """
    own = docs.select(F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("k"))
    over = lambda s: F.exists("_base", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (b["end"] > s["start"]))
    spans = F.transform("_more", lambda s: F.struct(_features(s).alias("x"), over(s).cast("int").alias("y")))
    texts = _spans(own, "t").filter(F.size("_more") > 0).select("k", spans.alias("s")).groupBy("k").agg(F.min("s").alias("s"))
    rows = texts.select((F.pmod(F.shiftright("k", 32), F.lit(3)) == 0).alias("apart"), F.explode("s").alias("s"))
    return rows.groupBy(F.col("s.x").alias("x"), F.col("s.y").alias("y"), "apart").agg(F.count("*").alias("n"))


def train(docs: DataFrame, text: str = "text") -> Model:
    """Trees and thresholds from the spans of all different texts: the same ones every time."""
    rows = sorted((tuple(r["x"]), r["y"], r["apart"], r["n"]) for r in examples(docs, text).collect())  # one row for each combination of features
    if not rows:
        return Model(None, (None,) * len(KINDS))
    x, n = np.array([r[0] for r in rows], float), np.array([r[3] for r in rows], float)
    y, apart = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool)
    if not 0 < y[~apart].sum() < (~apart).sum():
        return Model(None, (None,) * len(KINDS))
    forest = trees.fit(x[~apart], y[~apart], trees=24, depth=3, rate=0.3, times=n[~apart])
    raw = forest.raw(x)
    least = []
    for k in range(len(KINDS)):
        own = apart & (x[:, 0] == k)
        at = trees.threshold_for(raw[own], y[own], PRECISION, n[own])
        least.append(None if at == 2.0 else at)
    return Model(forest, tuple(least))


def found(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with base_spans and spans, arrays of kind, start and end: all spans, by kind and place."""
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df, added = _spans(docs, text), F.array().cast(f"array<{SPAN}>")
    if model.forest is not None and any(x is not None for x in model.least):
        df = held(df, _x=F.transform("_more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(s).alias("x"))))
        limits = [(k, x) for k, x in enumerate(model.least) if x is not None]

        def chosen(s: Column) -> Column:
            limit = reduce(lambda c, one: F.when(s["kind"] == one[0], F.lit(float(one[1]))).otherwise(c), limits, F.lit(float("inf")))
            return _score(model.forest, s["x"]) >= limit

        added = F.filter("_x", chosen)
    df = held(df, base_spans=F.sort_array(plain(F.col("_base"))), _added=plain(added))
    return df.withColumn("spans", F.sort_array(F.array_distinct(F.concat("base_spans", "_added")))).drop("_base", "_more", "_x", "_added")


def _of_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans."""
    df = found(docs.select("doc_id", "text"), model or train(docs))
    counts = [F.size(F.filter("base_spans", partial(_of_kind, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; columns and their order stay."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    own = docs.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text"))
    df = found(own, model or train(docs, text), "_text")
    by_place = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def step(s: Column, x: Column) -> Column:
        more = F.array(F.substring(F.col("_text"), s["at"] + 1, x["start"] - s["at"]), F.get(marks, x["kind"]))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], more)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], -x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("_text"), s["at"] + 1, F.length("_text")))
    clean = F.when(F.size("spans") > 0, F.aggregate(by_place, start, step, rest)).otherwise(F.col("_text"))
    df = held(df, _clean=clean)
    return df.select(*[F.col("_clean").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
