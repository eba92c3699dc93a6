"""Many words looked for in many texts: every text beside every item, without comparing each pair in full.

Texts and items are dealt to the same partitions, a block of items at a time; within one, Python workers keep which words
of the block each token holds, so that a token is searched once however many texts and items it is met by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tokens that a worker remembers, and the longest of them; texts that are answered at a time.
MOST_TOKENS, TOKEN_CHARS, ROWS = 200_000, 64, 512
#: White space as Java's \s has it.
SPACE = r" \t\n\x0b\f\r"


class Words:
    """The words of a block of items, and which of them a text holds anywhere, also within other words.

    words: for each item its words, repeats included; they are counted as often as they are listed. Words are looked for within the tokens that the
    pattern gives, where they consist of a token whole, else in the text itself.
    """

    def __init__(self, words: list[list[str]], token: str):
        self.n, self.token, self.seen = len(words), re.compile(token), {}
        of: dict[str, list[int]] = {}
        for item, each in enumerate(words):
            for w in each:
                of.setdefault(w, []).append(item)
        self.at = {w: i for i, w in enumerate(of)}
        self.items = [np.array(x, dtype=np.int64) for x in of.values()]
        within = {w for w in of if self.token.fullmatch(w)}
        self.lengths = sorted({len(w) for w in within})
        self.within = {w: self.at[w] for w in within}
        self.others = [(w, i) for w, i in self.at.items() if w not in within]

    def _held(self, token: str) -> tuple[int, ...]:
        found = self.seen.get(token)
        if found is None:
            get, n = self.within.get, len(token)
            parts = (get(token[i : i + size]) for size in self.lengths if size <= n for i in range(n - size + 1))
            found = tuple({x for x in parts if x is not None})
            if n <= TOKEN_CHARS:
                if len(self.seen) >= MOST_TOKENS:
                    self.seen.clear()
                self.seen[token] = found
        return found

    def counts(self, text: str) -> np.ndarray:
        """For each item how many of its words the text holds."""
        found: set[int] = set()
        for token in set(self.token.findall(text)):
            found.update(self._held(token))
        found.update(i for w, i in self.others if w in text)
        if not found:
            return np.zeros(self.n, dtype=np.int64)
        return np.bincount(np.concatenate([self.items[i] for i in found]), minlength=self.n)


def answered(texts: DataFrame, text: str, items: DataFrame, key: str, block: int, answers: Callable, schema: StructType) -> DataFrame:
    """Every text beside every item: rows of schema, which has columns of the texts and of the items and, last, an answer (int).

    answers takes the items of a block, as a list of dicts, and gives a function from a list of texts to an array of
    whole numbers by texts and items, of which negative ones make no row. Blocks are dealt by the hash of the key, texts
    by that of the row.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-items.count() // block) or 1
    kept, items_columns = [c for c in texts.columns if c != text], items.columns
    none = lambda df: F.lit(None).cast(df.schema)
    own, of = texts.select(*kept), items
    left = texts.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.pmod(F.xxhash64(*texts.columns), F.lit(n)).cast("int").alias("_p"),
        F.lit(1).alias("_kind"), F.struct(*kept).alias("_row"), F.col(text).alias("_text"), none(of).alias("_item"),
    )
    right = items.select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_p"),
        F.lit(0).alias("_kind"), none(own).alias("_row"), F.lit(None).cast("string").alias("_text"), F.struct(*items.columns).alias("_item"),
    )
    both = left.unionByName(right).repartitionById(n, F.pmod(F.col("_p") + F.col("_b"), F.lit(n))).sortWithinPartitions("_b", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, answer, listed = None, [], None, []
        for batch in batches:
            place, kind = batch.column("_b").to_numpy(), batch.column("_kind").to_numpy()
            cuts = np.flatnonzero(np.diff(place) | np.diff(kind)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                if place[start] != at:
                    at, held, answer = place[start], [], None
                some = batch.slice(start, end - start)
                if kind[start] == 0:
                    held.append(some.column("_item"))
                    continue
                if not held:
                    continue
                if answer is None:
                    whole = pa.concat_arrays(held)
                    answer, listed = answers(whole.to_pylist()), dict(zip(items_columns, whole.flatten()))
                for i in range(0, some.num_rows, ROWS):
                    part = some.slice(i, ROWS)
                    found = answer(part.column("_text").to_pylist())
                    row, item = (pa.array(x) for x in np.nonzero(found >= 0))
                    rows = dict(zip(kept, part.column("_row").flatten()))
                    columns = [rows[c].take(row) if c in rows else listed[c].take(item) for c in schema.names[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found[found >= 0], type=pa.int32())], names=schema.names)

    return both.mapInArrow(run, schema)
