"""Operator 10: language by compression.

For every language that the table names, a zstandard dictionary of raw content is made from a bounded sample of its
documents, an excerpt from a place of each that a hash chooses; a text's language is that of the dictionary under which the whole text compresses smallest. Texts are compressed in
pieces of PIECE bytes, each against the fresh dictionary, and a language's size is the sum over all pieces: a dictionary
saves about so many bytes once, which would vanish in a long text. The score is the smallest size's distance from the
second, as a share of the second; a text is rejected where it is narrow.

Edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; ties go to the more frequent
language; if nothing can be learned every text is `und`; repeated rows get equal answers; empty
tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import fold

#: Bounds of the sample: documents of a language, characters of an excerpt from one, bytes of a dictionary.
SAMPLED, TAKEN, DICTIONARY = 400, 2_000, 96_000
LEVEL, NARROW = 3, 0.01
#: Bytes of a normalised text that are compressed at a time; the last piece takes the rest.
PIECE = 16_384
UNDETERMINED = "und"
_LETTER, _NO_LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-case words of letters alone, one space between: marks, numbers and capitals say nothing about a language."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def learn(docs: DataFrame, usable: Column, lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content for each language, from a sample by the id's hash that is bounded for every language."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & (F.col(lang) != UNDETERMINED) & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()}  # a row for each language
    if not counts:
        return {}
    span = 1 << 30
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2 * SAMPLED / n) * span))])
    order = F.xxhash64("doc_id", F.lit(7))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.lit(1), F.length("text") - TAKEN + 1)).cast("int") + 1
    # repeated rows have one text: they count once, and a hot id cannot exceed the bound
    picked = rows.filter(F.pmod(order, F.lit(span)) < shares[F.col(lang)]).select(F.col(lang).alias("lang"), F.lower(F.substring(F.col("text"), place, F.lit(TAKEN))).alias("text"), order.alias("o"))
    picked = picked.groupBy("lang", "text").agg(F.min("o").alias("o")).orderBy("o", "lang", "text").limit(4 * SAMPLED * len(counts))
    out: dict[str, list[bytes]] = {}
    for r in picked.collect():
        out.setdefault(r["lang"], []).append(normal(r["text"]))
    return {k: b" ".join(out[k])[:DICTIONARY] for k in counts if k in out}


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; numerals such as fractions and superscripts are none."""
    first = _LETTER.search(text)
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, text)))


def predict(texts: list[str | None], compressors: list, names: list[str]) -> tuple[list[str], np.ndarray]:
    langs, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not names or not text or not has_letter(text):
            langs.append(UNDETERMINED)
            continue
        raw = normal(text)
        parts = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(sizes[:best] + sizes[best + 1 :], default=2 * sizes[best])
        scores[i] = (second - sizes[best]) / second
        langs.append(names[best])
    return langs, scores


def identifier(dictionaries: dict[str, bytes]):
    """A column function from a text to a struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        names = list(dictionaries)
        compressors = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for texts in batches:
            langs, scores = predict(texts.tolist(), compressors, names)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return run


def _accepted(answer: Column, narrow: float) -> Column:
    return (answer["lang_pred"] != UNDETERMINED) & (answer["score"] >= narrow)


def identified(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """doc_id, lang_pred, score and accepted for every row."""
    out = docs.select("doc_id", identifier(dictionaries)("text").alias("_l"))
    return out.select("doc_id", "_l.lang_pred", "_l.score", _accepted(F.col("_l"), narrow).alias("accepted"))


def accepted_documents(docs: DataFrame, narrow: float = NARROW) -> DataFrame:
    """The rows of docs whose language is clear, with their columns as they were; learns from all rows with a language."""
    out = docs.select(F.struct("*").alias("_row"), identifier(learn(docs, F.lit(True)))("text").alias("_l"))
    return out.filter(_accepted(F.col("_l"), narrow)).select("_row.*")


def predicted_languages(docs: DataFrame) -> DataFrame:
    out = identified(docs, learn(docs, fold("doc_id", 5) != 0))
    return out.withColumn("held_out", fold("doc_id", 5) == 0)
