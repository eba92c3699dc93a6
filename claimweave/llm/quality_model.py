"""Operator 5: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in batches, the forest is trained by the driver on a bounded sample of
labelled rows, and its flat arrays travel to the executors, where all rows descend all trees at once in numpy.

Edge cases: a null or empty text has statistics of zero and is scored like any other; repeated rows get equal
scores; without usable labels, or with one class, every score is the smoothed base rate; empty tables give
empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from claimweave.llm import trees
from claimweave.llm.common import fold, labelled_sample

#: Labelled rows that the forest is trained on, at most.
TRAINING_ROWS = 20_000
PREDICTED_FROM = 0.3

_KINDS = np.full(256, 11)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!", b"?", b"#*$%&|<>", b"\"'()[]{}-_/\\@=+~^`"]):
    _KINDS[list(_chars)] = _k
_KINDS[0xC0:] = 10  # first bytes of characters beyond ASCII; 11: their other bytes, and control characters
STATISTICS = ["lower", "upper", "digit", "blank", "line_end", "stop", "shout", "ask", "symbol", "mark", "beyond", "other", "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "top_run", "log_lines", "distinct_lines", "words_per_line"]


def statistics(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts):
        raw = (text or "").encode()
        if not raw:
            continue
        kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=12)
        row[:12] = kinds / len(raw)
        row[12] = np.log1p(len(raw) - kinds[11])
        words = raw.split()
        n = len(words)
        row[13] = np.log1p(n)
        if n:
            sizes = np.fromiter(map(len, words), np.int64, n)
            row[14], row[15] = sizes.mean(), np.log1p(sizes.max())
            row[16] = len(set(words)) / n
            row[17] = len(set(zip(words, words[1:]))) / max(1, n - 1)
            row[18] = sum(map(bytes.__eq__, words, words[1:])) / n
        lines = [x for x in raw.split(b"\n") if x.strip()]
        row[19] = np.log1p(len(lines))
        row[20] = len(set(lines)) / max(1, len(lines))
        row[21] = n / max(1, len(lines))
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, y) as doc_id, y and an array of STATISTICS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(statistics(b["text"].tolist()))})

    return docs.select("doc_id", "text", "y").mapInPandas(run, "doc_id long, y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = TRAINING_ROWS) -> trees.Forest:
    rows = with_statistics(labelled_sample(docs, labels, label, usable, most)).toPandas()  # at most `most` rows
    rows = rows.sort_values("doc_id")
    x = np.array(rows["x"].tolist()).reshape(-1, len(STATISTICS))
    return trees.fit(x, rows["y"].to_numpy(dtype=float))


def scored(docs: DataFrame, forest: trees.Forest) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": forest.score(statistics(b["text"].tolist()))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels, fold("doc_id", 5) != 0))
    return out.withColumns({"held_out": fold("doc_id", 5) == 0, "predicted": (out["score"] >= PREDICTED_FROM).cast("int")})
