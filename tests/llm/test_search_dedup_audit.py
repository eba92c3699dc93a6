"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from conftest import plain

from claimweave.llm import exact_dedup, filter_audit, lexical, queries

DOCS = "doc_id long, text string, source string, n string, terms int, _row int, _text string, mask string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "m", "p") for r in rows], DOCS)


def rows_of(df, columns):
    return plain([r.asDict() for r in df.collect()], columns)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_exact_dedup", "op13_filter_audit"])
def test_against_sql(spark, duck, sf_dir, name):
    df, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df, sorted(df.columns)) == plain([dict(zip(want.columns, r)) for r in want.fetchall()], sorted(df.columns))


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def searched(docs, items, k=20):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        best = []
        for d, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                best.append((-score, d is None, d or 0, d))
        out += [(item, r, b[3], -b[0]) for r, b in enumerate(sorted(best)[:k], 1)]
    return out


TEXTS = [
    (1, "Red apple, red PEAR"), (2, "red apple red pear"), (3, None), (4, ""), (5, "..., !"), (6, "Äpfel äpfel ÄPFEL apple"), (7, "pear " * 3000 + "plum"),
    (2, "red apple red pear"), (None, "apple"), (9, "plum\x00plum_plum9 \U0001f600"), (10, "red"), (11, "green"), (12, "green red"),
]


def test_search_matches_brute_force(spark):
    items = [(1, "red apple"), (2, None), (3, "nothing here"), (4, "RED red plum äpfel Äpfel"), (1, "red apple"), (5, "pear \U0001f600"), (6, "")]
    docs = frame(spark, [(d, t, "s") for d, t in TEXTS]).repartition(3)
    found = lexical.ranked_search(docs, spark.createDataFrame([(*x, "a") for x in items], "item_id long, text string, doc_id string"))
    got = rows_of(found, ["item_id", "rank", "doc_id", "score"])
    assert got == sorted(searched(TEXTS, items), key=repr)
    few = lexical.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string"), k=2)
    assert rows_of(few, ["item_id", "rank", "doc_id", "score"]) == sorted(searched(TEXTS, items, 2), key=repr)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "red")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red")], "doc_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs.withColumn("text", docs.text.substr(1, 0)), items).count() == 0


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 2)
    items = [(i, t) for i, t in enumerate(["red apple", "pear", "plum", "green red", "äpfel"])]
    docs = frame(spark, [(d, t, "s") for d, t in TEXTS])
    got = rows_of(lexical.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string")), ["item_id", "rank", "doc_id", "score"])
    assert got == sorted(searched(TEXTS, items), key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_reads_stop_with_final_scores(seed):
    """Bounds over long lists with many ties, against the sum of all impacts."""
    rng = np.random.default_rng(seed)
    documents, vocabulary = 3000, 40
    sizes = rng.integers(0, 25, documents)
    own = np.concatenate([rng.choice(vocabulary, s, replace=False) for s in sizes]).astype(np.int32)
    counts, lengths = rng.integers(1, 3 + seed, len(own)), rng.integers(30, 40, documents)
    weights = rng.integers(0, 9000, vocabulary)
    shard = lexical.Shard(lengths, sizes, own, counts, (documents, int(lengths.sum()), weights))
    query = rng.choice(vocabulary, 6, replace=False)
    repeats, order = rng.integers(1, 3, 6), rng.permutation(documents)
    m = 75 + (25 * lengths * documents) // lengths.sum()
    scores, at = np.zeros(documents, np.int64), np.repeat(np.arange(documents), sizes)
    for d, t, c in zip(at, own, counts):
        if t in query:
            scores[d] += repeats[list(query).index(t)] * weights[t] * ((1_000_000_000 * c) // (1000 * c + 12 * m[d]))
    for k in (1, 20):
        want = [d for d in np.lexsort((order, -scores)) if scores[d] > 0][:k]
        places, found = shard.best(query, repeats, order, k)
        assert list(places) == want and list(found) == list(scores[want])


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def duplicates(rows, best):
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(d)
    out, stayed = [], set()
    for d, t in sorted(rows, key=lambda x: repr(x)):
        g = groups[lowered(t)]
        keep = best((x for x in g if x is not None), default=None)
        kept = d == keep and lowered(t) not in stayed
        stayed |= {lowered(t)} if kept else set()
        out.append((d, keep, len(g), kept, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("shares", [4, 0])
def test_dedup_matches_brute_force(spark, monkeypatch, shares):
    if not shares:  # every text is dealt in parts, and its runs are joined again
        monkeypatch.setattr(exact_dedup, "SHARES", 1000)
    rng = random.Random(shares)
    rows = [(i, "A copied Text") for i in range(60)] + [(i % 7, "a copied text") for i in range(20)] + [(None, "x"), (None, "X"), (5, "x"), (None, None), (None, "")]
    rows += [(100, "É"), (101, "é"), (102, "long " * 20000), (103, "LONG " * 20000), (104, "a copied text "), (105, None)] + [(200 + i, rng.choice("abAB") * 30) for i in range(30)]
    docs = frame(spark, [(d, t, "s") for d, t in rows]).repartition(5)
    assert rows_of(exact_dedup.duplicate_verdicts(docs), COLUMNS) == duplicates(rows, max)
    assert rows_of(exact_dedup.duplicate_verdicts(docs, "smallest"), COLUMNS) == duplicates(rows, min)
    left = exact_dedup.distinct_documents(docs)
    assert left.columns == docs.columns
    assert rows_of(left.select("doc_id"), ["doc_id"]) == sorted([(x[0],) for x in duplicates(rows, min) if x[3]] , key=repr)


def test_dedup_of_nothing_and_without_python(spark, sf_dir):
    assert exact_dedup.duplicate_verdicts(frame(spark, []).limit(0)).count() == 0
    plan = queries.op12_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def fails(rows):
    first = {}
    for d, t, _ in rows:
        key = math.inf if d is None else d
        first[t or ""] = min(first.get(t or "", math.inf), key)
    for d, t, source in rows:
        t, d = t or "", math.inf if d is None else d
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d > first[t]]
        yield d, source or "", {f for f, b in zip("ABCDE", bad) if b}


def audit(rows, labels):
    judged, out = list(fails(rows)), []
    mark = lambda d, k: max((x[k] or 0 for x in labels if x[0] == d), default=0) == 1
    for part in sorted({p for _, p, _ in judged}):
        own, removed_by = [(d, f) for d, p, f in judged if p == part], Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[f] += len(gone)
                all_failing = sum(f in x[1] for x in own)
                steps.append((part, "".join(order), k, len(left), len(gone), all_failing - len(gone), sum(x[1] == {f} for x in own), sum(mark(d, 1) for d, _ in gone), sum(mark(d, 2) for d, _ in gone)))
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out, key=repr)


def test_audit_matches_every_order(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["red", "Pear", "PLUM", "apple", "#tag", "x", "ÄÖ", "fig", *map(str, range(60))])
    rows = [(i, " ".join(word() for _ in range(rng.choice([3, 49, 50, 80]))), rng.choice(["s1", "s2", None, ""])) for i in range(60)]
    rows += [(i, rows[i % 9][1], rng.choice(["s1", "s3"])) for i in range(60, 80)] + [(3, rows[3][1], "s1"), (None, rows[4][1], "s1"), (None, None, None), (90, "", "s2"), (91, None, "s2")]
    labels = [(i, i % 2, (i % 3 == 0) + 0) for i in range(0, 95, 2)] + [(7, 1, None), (7, 0, 1), (None, 1, 1)]
    docs = frame(spark, rows).repartition(3)
    got = filter_audit.filter_audit(docs, spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, part string"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert rows_of(got, columns) == audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.filter_audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_weights_are_those_of_shapley():
    """The least squares give the average over all orders, exactly, for any value of the coalitions."""
    rng, weights = random.Random(1), filter_audit.shapley_weights()
    value = [0, *[rng.randrange(1000) for _ in range(31)]]
    for f, row in enumerate(weights):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(f)])
            total += value[before | 1 << f] - value[before]
        assert sum(w * v for w, v in zip(row, value)) == Fraction(total, 120)
