"""Operator 6: near-duplicates by a signature-coordinate inverted join.

A document is the set of its distinct word shingles; equal sets form one class, and only classes are joined. Each
class has a signature of COORDINATES values, each of MINIMA MinHash minima, and is posted under every
coordinate-value pair. Pairs posted once are skipped. Two classes that agree in MATCHES coordinates agree in one of
the rarest of each, so only that prefix of a class's pairs, rarest first, is merged.

No posting is expanded into all its pairs, however many copies it holds:

1. Every class of a posting is held against the posting's pivot, the class whose pairs are shared most. Their full
   sets give the link and the difference, the shingles that only one of the two has. Postings of one pivot are one group.
2. Two classes that both link to the pivot are in one component already. For any other two, the differences d(y) and
   d(z) to the pivot decide: the sets of y and z differ in |d(y)| + |d(z)| - 2 |d(y) & d(z)| shingles. If z is not
   linked to the pivot, a link of y and z asks that they share more than four ninths of d(y) at 80 %, the more, the
   farther z is. So differences are joined inverted too, by a prefix of the rarest shingles of each: y's prefix
   shortens with the level of z's distance, and shingles that one member alone differs in are skipped. Where y and z
   meet in a shingle of both prefixes, no more than what follows it in either can be shared. In a group of
   copies with edits of their own little but those is left of a prefix.
3. The pairs so found are retained if their signatures collide MATCHES times, and confirmed on the full differences.

The second join finds every pair that the full sets link, so that no candidate of a posting stays untried. Its rows
grow with edits that unlinked members share, not with the pairs of a group. A pair of exactly 80 % is missed by the
signature with a probability of about 1e-5, one well above it practically never.

Edge cases: null and blank texts have an empty set and are linked with nothing; a text with fewer words than a
shingle is one shingle; rows of one id are one row each in the result; rows with a null id take no part and have
a null component; an empty table gives an empty result; extra columns are not read. Keys that many classes share are
split by the adaptive skew join; counts and minima are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import stored
from claimweave.llm.components import components

#: Length of a signature, how many of its coordinates a candidate must share, and minima to a coordinate. Coordinates of
#: several minima are rarely shared by unlike documents, so that postings and candidates grow with the copies alone.
COORDINATES, MATCHES, MINIMA = 24, 3, 3
#: Steps of distance for each doubling, by which prefixes of differences shorten.
STEPS = 2
#: Parts into which the members of a group are dealt where they meet what is known of the group.
PARTS = 16
_MULTIPLY, _ADD = np.random.default_rng(20_240_601).integers(0, 2**63, (2, COORDINATES * MINIMA), np.uint64)
_MULTIPLY = _MULTIPLY * np.uint64(2) + np.uint64(1)
SIGNED = "doc_id long, n_shingles long, set_key binary, signature array<long>"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z is lower-cased."""

    def __init__(self, size: int):
        self.size, self.words = size, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if len(self.words) > 400_000:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """A hash of every coordinate's minima, with the coordinate's number in the low five bits."""
    least = np.full(COORDINATES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 8192):
        least = np.minimum(least, (_MULTIPLY[:, None] * own[at : at + 8192] + _ADD[:, None]).min(1))
    least = least.reshape(COORDINATES, MINIMA)
    out = least[:, 0]
    for k in range(1, MINIMA):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + least[:, k]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((out & ~np.uint64(31)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """SIGNED rows; an empty set has no key and no signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle)
        for b in batches:
            sets = [shingler(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "signature": [signature(s) if len(s) else None for s in sets],
            })

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(run, SIGNED)


def _apart(star: DataFrame, sets: DataFrame, lists: DataFrame, similarity: int) -> DataFrame:
    """Every member of a group with its difference to the pivot: pivot, cid, pairs, differ, far, n, n_p, w.

    With a = 100 + similarity and b = 100 - similarity, two sets link where a * |difference| <= b * (sum of sizes).
    So a member links to the pivot where w = a * far - b * n is at most b * n_p, and y to z where
    2 * a * |d(y) & d(z)| >= w(y) + w(z).
    """
    a, b = 100 + similarity, 100 - similarity
    pivots = sets.select(F.col("cid").alias("pivot"), F.col("own").alias("own_p"))
    both = star.join(sets, "cid").join(lists.select("cid", "pairs"), "cid").join(pivots, "pivot")
    differ = F.concat(F.array_except("own", "own_p"), F.array_except("own_p", "own"))
    out = both.select("pivot", "cid", "pairs", differ.alias("differ"), F.size("own").alias("n"), F.size("own_p").alias("n_p"))
    return out.withColumn("far", F.size("differ")).withColumn("w", F.expr(f"cast({a} * far - {b} * n as long)"))


def _unlinked_pairs(apart: DataFrame, similarity: int) -> DataFrame:
    """pivot, y, z: pairs whose differences may overlap enough; at least z is not linked to the pivot, and y is no farther."""
    a, b = 100 + similarity, 100 - similarity
    beyond = F.expr(f"w - {b} * n_p")
    level = F.when(beyond > 0, F.greatest(F.lit(0), F.floor(F.log2(beyond / b) * STEPS)).cast("int"))
    placed = apart.withColumn("level", level).withColumn("part", F.expr(f"cast(pmod(xxhash64(cid), {PARTS}) as int)"))
    facts = placed.groupBy("pivot").agg(F.min("w").alias("lowest"), F.max("level").alias("top")).filter("top is not null")
    facts = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # so that no task gets a large group whole
    keys = ["pivot", "cid", "far", "w", "n_p", "level", "lowest", "top"]
    parts = placed.join(facts, ["pivot", "part"]).select(*keys, F.explode("differ").alias("e"))
    shared = parts.groupBy("pivot", "e").agg(F.count("*").alias("f")).filter("f > 1")
    ranked = parts.join(shared, ["pivot", "e"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("ranked"))
    # those that no other member differs in come first and are posted nowhere
    ranked = stored(ranked.select(*keys, F.expr("far - size(ranked)").alias("singles"), F.posexplode("ranked.e").alias("at", "e")).withColumn("at", F.expr("singles + at")))
    # the least that z's w can be at a level (one less, for the rounding of the logarithm), and the overlap it asks of y
    least = f"greatest(1, cast(floor({b} * pow(2, l / {STEPS}D)) as long) - 1)"
    fits = f"at <= far - greatest(1, cast(ceil((w + greatest(w, {b} * n_p + {least})) / {2 * a}D) as long))"
    levels = F.expr(f"filter(sequence(coalesce(level, 0), top), l -> {fits})")
    near = ranked.select("pivot", "e", F.col("cid").alias("y"), F.col("w").alias("w_y"), F.expr("far - at").alias("rest_y"), F.explode(levels).alias("level"))
    far = ranked.filter(f"level is not null and at <= far - greatest(1, cast(ceil((w + lowest) / {2 * a}D) as long))")
    far = far.select("pivot", "e", "level", F.col("cid").alias("z"), F.col("w").alias("w_z"), F.expr("far - at").alias("rest_z"))
    # where y and z first meet, what is left of either holds all their overlap; so the w of both, not their bounds, decide how late that may be
    both = near.join(far, ["pivot", "level", "e"]).filter("struct(w_y, y) < struct(w_z, z)")
    return both.filter(f"{2 * a} * least(rest_y, rest_z) >= w_y + w_z").select("pivot", "y", "z").distinct()


def _confirmed(pairs: DataFrame, apart: DataFrame, similarity: int) -> DataFrame:
    """Links among the pairs: signatures that collide often enough, then full differences."""
    y, z = (apart.select("pivot", F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("pairs", "differ", "w")]) for x in "yz")
    both = pairs.join(y, ["pivot", "y"]).join(z, ["pivot", "z"])
    retained = both.filter(F.size(F.array_intersect("pairs_y", "pairs_z")) >= MATCHES)
    overlap = F.size(F.array_intersect("differ_y", "differ_z"))
    return retained.filter(2 * (100 + similarity) * overlap >= F.col("w_y") + F.col("w_z")).select(F.col("y").alias("a"), F.col("z").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; documents are linked at `similarity` percent and over."""
    marked = stored(signed(docs, shingle))
    classes = marked.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))

    # postings, and the list of every class that could match: its shared pairs, rarest first
    posted = classes.select("cid", F.explode("signature").alias("pair"))
    shared = posted.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    lists = posted.join(shared, "pair").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("pairs"), F.sum("n").alias("shares"))
    lists = lists.filter(F.size("pairs") >= MATCHES).withColumn("pairs", F.col("pairs.pair"))
    lists = stored(lists.join(classes.select("cid", "doc_id", "set_key", "n_shingles"), "cid"))
    prefix = lists.select("cid", "shares", F.explode(F.slice("pairs", 1, F.size("pairs") - (MATCHES - 1))).alias("pair"))

    # every class of a posting against the one whose pairs are shared most
    pivots = prefix.groupBy("pair").agg(F.max(F.struct("shares", "cid"))["cid"].alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    star = stored(prefix.join(pivots, "pair").filter("cid <> pivot").select("pivot", "cid").distinct())

    # the sets of these classes; a row of another text under the same id is none of them
    wanted = star.select("cid").union(star.select("pivot")).distinct()
    wanted = lists.join(wanted, "cid", "left_semi").select("cid", "doc_id", "set_key")

    def own_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                own = [shingler(t) for t in part["text"]]
                meant = [xxhash.xxh3_128_digest(s.tobytes()) == bytes(w) for s, w in zip(own, part["set_key"])]
                yield pd.DataFrame({"cid": part["cid"][meant], "own": [s.view(np.int64) for s, m in zip(own, meant) if m]})

    named = docs.select("doc_id", "text").filter("doc_id is not null").join(wanted, "doc_id")
    sets = stored(named.select("cid", "text", "set_key").mapInPandas(own_set, "cid long, own array<long>").dropDuplicates(["cid"]))
    apart = stored(_apart(star, sets, lists, similarity))
    linked = apart.filter(f"w <= {100 - similarity} * n_p").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    found = stored(components(linked.unionByName(_confirmed(_unlinked_pairs(apart, similarity), apart, similarity))))

    # component_id: the smallest document of all the component's classes
    of_class = classes.select("set_key", "cid", "doc_id").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("set_key", "doc_id", F.coalesce("component", "cid").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(smallest, "component").select("set_key", "component_id")
    linked = marked.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    linked = linked.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(nameless)


def near_duplicate_components(docs: DataFrame, shingle: int = 2, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: whether the document is its component's smallest."""
    return near_duplicates(docs, shingle, similarity).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """docs with one document of each group, that of the smallest id; columns stay as they were.

    Rows with a null id stay. Rows of one id go together, and of rows with the same id and text one stays.
    """
    stay = near_duplicates(docs, shingle, similarity).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))
