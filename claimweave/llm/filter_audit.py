"""Operator 13: what filters that are applied one after the other remove, and what each of them is worth.

Every document is judged once by all filters; the set of those it fails is a mask. Of the masks, the documents that
each of the 32 coalitions of filters removes are tabulated. An order of filters is a path through coalitions: what a
step removes is the difference of two neighbours on it. Shapley values are the solution of a least-squares problem
over the coalitions, weighted by the Shapley kernel, whose parts must sum to what all filters remove; its normal
equations are solved in rationals. Their matrix is the same for every part, so it is solved once for each coalition,
and each part is a sum of whole multiples of its table.

Edge cases: a null text is an empty one; a null source counts as the empty string; an identifier without a label
is neither good nor toxic, one with several labels is what any of them says; repeated rows count one by one and are
no copies of each other while their identifier is the same; a null identifier is larger than any other; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import SPACE, held, stored
from claimweave.llm.exact_dedup import equal_runs

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
COUNTS = ["n", "good", "toxic"]


def _solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of matrix @ x = right, by elimination in rationals."""
    rows, n = [[*m, *r] for m, r in zip(matrix, right)], len(matrix)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[n:] for r in rows]


def shapley_weights(filters: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each filter, the weight of every coalition's value in its Shapley value.

    Minimises the kernel-weighted squares of v(S) - sum of phi over S, over all S but the empty and the full one, under
    sum of phi = v(all), with a multiplier for the constraint; v(empty) is 0.
    """
    full, zero = (1 << filters) - 1, Fraction(0)
    inside = [[Fraction(s >> f & 1) for f in range(filters)] for s in range(full + 1)]
    size = [s.bit_count() for s in range(full + 1)]
    kernel = [Fraction(filters - 1, comb(filters, k) * k * (filters - k)) if 0 < k < filters else zero for k in size]
    normal = [[sum((w * z[a] * z[b] for w, z in zip(kernel, inside)), zero) for b in range(filters)] + [Fraction(1)] for a in range(filters)] + [[Fraction(1)] * filters + [zero]]
    right = [[kernel[s] * inside[s][a] for s in range(full + 1)] for a in range(filters)] + [[Fraction(s == full) for s in range(full + 1)]]
    return _solved(normal, right)[:filters]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part and the mask of failed filters of every document; bit k is the k-th of FILTERS."""
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_t"))
    own = held(own, _w=F.array_remove(F.split("_t", SPACE), ""))
    t, n = F.col("_t"), F.size("_w")
    fails = {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct("_w")).cast("long") < 65 * n,
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 5 * F.length(t),
        "D": F.rlike(t, F.lit("[#$%&*|]")),
    }
    mask = sum((F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(F.lit(0)) for f, c in fails.items()), F.lit(0))
    # texts are read once: from here on a whole text's digest and length stand for it
    own = stored(own.select("doc_id", "part", mask.alias("mask"), F.concat_ws(":", F.sha2(t.cast("binary"), 256), F.length(t)).alias("content")))
    runs = equal_runs(own, F.col("content"), "doc_id", "smallest", ["doc_id", "part", "mask"])
    copy = F.col("_keep_id").isNotNull() & (F.col("_row.doc_id").isNull() | (F.col("_row.doc_id") > F.col("_keep_id")))
    return runs.select("_row.doc_id", "_row.part", (F.col("_row.mask") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))).alias("mask"))


def coalition_table(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part: its documents, and for each of COUNTS an array over the coalitions of what each removes.

    rows have doc_id, part and mask; they are counted by identifier before labels meet them.
    """
    says = lambda c: (F.max(c) == 1).cast("long").alias("good" if c == "quality" else c)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality"), says("toxic"))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = rows.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    unknown = rows.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    weight = {"n": F.col("n"), **{c: F.col("n") * F.coalesce(c, F.lit(0)) for c in COUNTS[1:]}}
    masks = known.unionByName(unknown).groupBy("part", "mask").agg(*[F.sum(w).alias(c) for c, w in weight.items()])
    sets = masks.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", *COUNTS)).alias("sets"))  # at most one a coalition
    hit = lambda s: F.filter("sets", lambda x: x["mask"].bitwiseAND(s) != 0)
    removed = lambda c: F.transform(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), lambda s: F.aggregate(hit(s), F.lit(0).cast("long"), lambda total, x: total + x[c]))
    return sets.select("part", "total", *[removed(c).alias(c) for c in COUNTS])


def _orders_total(weights: list[Fraction]) -> Column:
    """A filter's Shapley value times the number of orders, in whole numbers."""
    scale = lcm(*[w.denominator for w in weights])
    total = F.lit(0).cast("long")
    for s, w in enumerate(weights):
        if w:
            total = total + F.lit(int(w * scale)).cast("long") * F.element_at("n", s + 1)
    return F.call_function("div", total * factorial(len(FILTERS)), F.lit(scale).cast("long"))


def audited(table: DataFrame) -> DataFrame:
    """A row for every part, order of filters and step of a coalition table."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(FILTERS[x] for x in order), "step": k, "filter": f, "alone": 1 << f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    each = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,alone:int,before:int,after:int>>")
    rows = table.withColumn("shapleys", F.array(*[_orders_total(w) for w in shapley_weights()])).select("*", F.explode(each).alias("s"))
    at = lambda c, s: F.element_at(F.col(c), s + F.lit(1))
    everything = F.lit(COALITIONS - 1)
    step = lambda c: at(c, F.col("s.after")) - at(c, F.col("s.before"))
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        (F.col("total") - at("n", F.col("s.after"))).alias("kept"),
        step("n").alias("removed"),
        (at("n", F.col("s.alone")) - step("n")).alias("redundant"),
        (at("n", everything) - at("n", everything - F.col("s.alone"))).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.element_at("shapleys", F.col("s.filter") + 1).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(coalition_table(judged(docs), labels))


#: Every order is walked row by row: nothing is shared with the coalitions above.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) < doc_id AS e FROM t),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
              'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': e} AS fails
      FROM w JOIN m USING (doc_id) LEFT JOIN marks USING (doc_id)),
g AS (SELECT part, good, toxic, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e, count(*) AS n
      FROM f GROUP BY ALL),
h AS (SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                       CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM g),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
      WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, failed, n, good, toxic,
             contains(failed, substr(filter_order, step, 1)) AS fails_it,
             len(regexp_replace(substr(filter_order, 1, step - 1), '[^' || failed || '_]', '', 'g')) > 0 AS gone FROM h, s),
c AS (SELECT part, filter_order, step, any_value(letter) AS letter,
             CAST(sum(n) FILTER (WHERE NOT gone AND NOT fails_it) AS BIGINT) AS kept,
             CAST(sum(n) FILTER (WHERE NOT gone AND fails_it) AS BIGINT) AS removed,
             CAST(sum(n) FILTER (WHERE gone AND fails_it) AS BIGINT) AS redundant,
             CAST(sum(n) FILTER (WHERE failed = letter) AS BIGINT) AS unique_fails,
             CAST(sum(n) FILTER (WHERE NOT gone AND fails_it AND good) AS BIGINT) AS good_lost,
             CAST(sum(n) FILTER (WHERE NOT gone AND fails_it AND toxic) AS BIGINT) AS toxic_lost
      FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""
