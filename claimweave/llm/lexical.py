"""Operator 11: ranked lexical search over impact-sorted postings, by no-random-access reads (NRA).

An index holds, for every document, its length and the terms of the queries in it with their counts, and is stored once. Of it
come the counts of documents, terms and documents with a term, over the whole table. Tasks then take the index in shards of
consecutive documents: in each, a term's postings are sorted by impact, and every item reads the lists of its terms in
blocks, from the highest impact on. Between blocks each document has a lower score (what was read) and an upper one
(what was read, and the next impact of each list in which it was not met). Reading ends when no document
that could still be among the shard's best has an open interval, so that members, ties and scores are final. The best of
all shards are then ranked.

Items come in blocks of a stated size, each against all documents; what is broadcast is one block's terms and weights.

Edge cases: null texts and texts without a term have no results and are not counted as documents; a term that a query
repeats counts each time; every row of the items is an item of its own, so that a repeated one has its results again; equal scores are
ranked by identifier, nulls last; a repeated document is ranked as often as it occurs; empty tables give empty results;
extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import stored

#: A block of items: rows, and bytes of their texts.
ITEMS, ITEM_BYTES = 4096, 4 << 20
#: A shard: documents, and postings, whichever comes first.
SHARD_DOCUMENTS, SHARD_POSTINGS = 8192, 1 << 21
#: Postings of each list in the first block that an item reads; later ones double.
FIRST_READ = 64

#: ASCII letters and digits, in lower case, and all bytes beyond ASCII belong to terms; others part them.
TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    for row in items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).toLocalIterator():
        block.append((row.item_id, Counter(terms_of(bytes(row.text)))))
        size += len(row.text)
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def term_index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, length, and numbers and counts of the given terms, of every document with a term."""
    numbers = docs.sparkSession.sparkContext.broadcast(numbers)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value.get
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    hits = [(k, c) for w, c in Counter(words).items() if (k := known(w)) is not None]
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append([k for k, _ in hits])
                    counts.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, lengths, terms, counts), INDEX)], schema=INDEX)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInArrow(index, "doc_id long, n long, terms array<int>, counts array<long>"))


def term_weights(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and every term's weight."""
    total = index.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    weights = np.zeros(terms, np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():  # one row a term of the block
        weights[row.term] = math.floor(1000 * math.log((2 * total.n + 2) / (2 * row.df + 1)))
    return total.n, total.l or 0, weights


class Shard:
    """The impact-sorted postings of some documents: term k's are at starts[k] to starts[k + 1]."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, total: tuple[int, int, np.ndarray]):
        n, l, weights = total
        m = (100 - 25 + (25 * lengths * n) // l)[place := np.repeat(np.arange(len(lengths)), sizes)]
        impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))
        order = np.lexsort((-impacts, terms))
        self.documents, self.places, self.impacts = len(lengths), place[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, repeats: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k documents with the highest scores above 0, ties by order."""
        starts, ends = self.starts[terms], self.starts[terms + 1]
        lower, met = np.zeros(self.documents, np.int64), np.zeros(self.documents, np.int64)
        at, depth = starts.copy(), FIRST_READ
        read: list[tuple[np.ndarray, np.ndarray]] = []  # of each block, the places met and in which list
        while True:
            upto = np.minimum(at + depth, ends)
            sizes = upto - at
            lists = np.repeat(np.arange(len(terms)), sizes)
            where = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            places = self.places[where]
            np.add.at(lower, places, self.impacts[where] * repeats[lists])
            read.append((places, lists))
            at, depth = upto, depth * 2
            # the most that a list can still give to a document not met in it
            left = np.where(at < ends, self.impacts[np.minimum(at, len(self.impacts) - 1)], 0) * repeats if len(self.impacts) else np.zeros(len(terms), np.int64)
            met[:] = 0
            for places, lists in read:
                np.add.at(met, places, left[lists])
            upper = lower + left.sum() - met
            kth = max(1, int(np.partition(lower, -k)[-k])) if self.documents >= k else 1
            if not ((upper >= kth) & (upper > lower)).any():
                found = np.flatnonzero(lower >= kth)
                found = found[np.lexsort((order[found], -lower[found]))][:k]
                return found, lower[found]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, documents, postings = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            held.append(piece)
            documents += piece.num_rows
            postings += len(piece.column("terms").flatten())
            if documents >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, documents, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _searched(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], total: tuple[int, int, np.ndarray], k: int) -> DataFrame:
    """item (its place in queries), doc_id and score of every shard's best documents."""
    sent = index.sparkSession.sparkContext.broadcast((queries, total))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, total = sent.value
        for table in _shards(batches):
            ids = table.column("doc_id").combine_chunks()
            terms, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            sizes = np.diff(terms.offsets.to_numpy())
            shard = Shard(table.column("n").to_numpy(), sizes, terms.flatten().to_numpy(), counts.flatten().to_numpy(), total)
            order = np.empty(len(ids), np.int64)  # by identifier, nulls last
            order[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
            for item, (own, repeats) in enumerate(queries):
                places, scores = shard.best(own, repeats, order, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), item, np.int32)), ids.take(pa.array(places)), pa.array(scores)], schema=FOUND)

    return index.mapInArrow(search, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of every item's k best documents."""
    spark, out = docs.sparkSession, None
    for block in query_blocks(items.select("item_id", "text")):
        numbers = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        queries = [(np.array([numbers[t] for t in own], np.int64), np.array(list(own.values()), np.int64)) for _, own in block]
        index = term_index(docs, numbers)
        found = _searched(index, queries, term_weights(index, len(numbers)), k)
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
        found = stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most k rows an item
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents WHERE text IS NOT NULL),
e AS (SELECT row_id, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM e),
p AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM e) GROUP BY row_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, all_docs),
b AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, item_id, term, count(*) AS k FROM b GROUP BY ALL),
s AS (SELECT item, item_id, row_id, doc_id, CAST(sum(k * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * all_docs) // all_terms))))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN e USING (row_id), g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
