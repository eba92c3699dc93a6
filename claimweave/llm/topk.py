"""Operator 9: exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into 4, then 8, then 16 segments; each keeps its mean and deviation per segment. For two segments
of m components the product is at most m * (mean * mean + deviation * deviation), which bounds the inner product
from above - the same as a bound of the distance from below once the norms are known. Blocks of queries meet
blocks of candidates; coarse to fine, pairs whose bound cannot reach the query's k-th best score so far are
dropped, and the survivors are scored exactly in integers.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different
lengths are never compared; a score beyond the whole numbers of 64 bits is the last of them on its side, and vectors that
reach it are ties, as is a scaled component; ties go to the smaller vec_id; repeated vec_ids are rows of their own, and a query
row is not its own candidate, nor is any row of its vec_id; a query with fewer candidates gets all of them; empty
tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = (4, 8, 16)
#: Rows of a block of queries and of candidates: what a task holds at once.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Candidate blocks that meet a block of queries under one key, about.
BLOCKS_PER_TASK = 4
#: Where sums of products may reach this, a double's exact integers, scores are Python integers.
EXACT_BELOW = 1 << 53
#: Scores, and scaled components, beyond this are held to it, on either side.
MOST = (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of every segment divided by the root of its length, and root of the summed squared deviations."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    sizes = np.diff(np.append(edges, x.shape[1]))
    mean = np.add.reduceat(x, edges, axis=1) / sizes
    around = np.add.reduceat((x - np.repeat(mean, sizes, axis=1)) ** 2, edges, axis=1)
    return mean * np.sqrt(sizes), np.sqrt(around)


def block_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(place of query, place of candidate, exact score) of at least every query's k best in the block."""
    big = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] >= EXACT_BELOW
    bounds = [(np.concatenate(statistics(q, s), 1), np.concatenate(statistics(c, s), 1)) for s in SEGMENTS]
    qs, cs, scores = [], [], []
    for i in range(0, len(q), 128):  # the coarsest bounds of 128 queries at a time
        rows = np.arange(i, min(len(q), i + 128))
        upper = bounds[0][0][rows] @ bounds[0][1].T
        upper[qid[rows][:, None] == cid] = -np.inf
        first = np.argpartition(-upper, min(4 * k, len(c) - 1), axis=1)[:, : 4 * k]
        for row, up, start in zip(rows, upper, first):
            own, slack = q[row], 1e-6 * (1 + np.abs(up[np.isfinite(up)]).max(initial=0))
            start = start[np.isfinite(up[start])]
            if not len(start):
                continue
            begun = np.sort(c[start] @ own)
            least = min(begun[-k], float(MOST)) if len(begun) >= k and begun[-k] > -MOST else -np.inf
            left = np.flatnonzero((up >= least - slack) & np.isfinite(up))
            for of_q, of_c in bounds[1:]:
                if len(left) > 2 * k:
                    left = left[of_c[left] @ of_q[row] >= least - slack]
            exact = c[left] @ own
            if not big:
                top = left[exact >= np.sort(exact)[-k]] if len(exact) > k else left
                value = (c[top] @ own).astype(np.int64).tolist()
            else:
                value = [max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(c[j], own)))) for j in left]
                top = left
            order = sorted(range(len(top)), key=lambda j: (-value[j], cid[top[j]]))[:k]
            qs += [row] * len(order)
            cs += top[order].tolist()
            scores += [value[j] for j in order]
    return np.array(qs, np.int64), np.array(cs, np.int64), scores


def _packed(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Blocks of at most block_rows vectors of one length, as two binary columns, packed where the rows lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, vectors = zip(*held.pop(dim))
            return pd.DataFrame({"dim": [dim], f"{name}_ids": [np.array(ids, "<i8").tobytes()], f"{name}_x": [np.array(vectors, "<f8").tobytes()]})

        for b in batches:
            for i, v in zip(b["vec_id"], b["v"]):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == block_rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.select("vec_id", "v").mapInPandas(run, f"dim int, {name}_ids binary, {name}_x binary")


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the floors of the scaled components; rows that take no part are gone."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: every query's k best other rows by exact integer inner product."""
    rows = integer_vectors(vectors)
    queries = rows.filter(is_query)
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    n, parts = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // (BLOCKS_PER_TASK * CANDIDATE_BLOCK)))
    # queries fill n partitions of a block or two; candidate blocks fall in parts by a hash, and every pair of a
    # query partition and a part is a key of its own, so that a key holds a bounded number of blocks
    q_blocks = _packed(queries.repartition(n), QUERY_BLOCK, "q").withColumn("meets", F.spark_partition_id())
    q_blocks = q_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c_blocks = _packed(rows, CANDIDATE_BLOCK, "c").withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(parts)).cast("int"))
    c_blocks = c_blocks.withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = c_blocks.join(q_blocks, ["dim", "meets", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, q_ids, q_x, c_ids, c_x in b[["dim", "q_ids", "q_x", "c_ids", "c_x"]].itertuples(index=False):
                qid, cid = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                qs, cs, scores = block_top(qid, np.frombuffer(q_x, "<f8").reshape(-1, dim), cid, np.frombuffer(c_x, "<f8").reshape(-1, dim), k)
                yield pd.DataFrame({"query_id": qid[qs], "vec_id": cid[cs], "score": pd.Series(scores, dtype="int64")})

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vectors: DataFrame, k: int = 5) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 50 == 0, k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
