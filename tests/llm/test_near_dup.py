import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimweave.llm import near_dup
from claimweave.llm.components import components


def brute(docs, size, percent=80):
    """(set size, smallest reachable id) of every row with an id, over all pairs."""
    sets = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(s), least[root(i)]) for i, (doc_id, s) in enumerate(sets))


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one Two"), (7, "é É"), (8, "É é")]
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(rng.choice([1, 3, 12])):  # near copies that drift, so that chains arise
            docs.append((len(docs), " ".join(words)))
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    docs += [(len(docs), " ".join(rng.choice(vocabulary) for _ in range(60))) for _ in range(20)]
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(spark, size):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, size).collect())
    assert got == brute(docs, size)


def test_large_group_repeated_and_null_rows(spark):
    base = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"x{i}"]), "s") for i in range(100, 300)] + [(i, "same text here", "s") for i in range(50)] + [(7, "same text here", "t"), (None, "same text here", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, signature string")
    got = near_dup.near_duplicate_components(df).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 50} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 100} == {100}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    stay = near_dup.one_of_each(df, shingle=5).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stay) == [(False, 0), (False, 100), (True, 0)] and stay[0].__fields__ == df.columns
    assert near_dup.near_duplicate_components(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_fixture_against_all_pairs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, 2).select("*", F.lit(1)).collect())
    assert got == brute(docs, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_drifting_copies_around_the_threshold(spark, seed):
    """One large group: copies with few and many edits, copies of far copies, a second cloud, deletions and insertions."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            at, kind = rng.randrange(len(out)), rng.random()
            out[at : at + (kind < 0.8)] = [] if 0.6 < kind < 0.8 else [rng.choice(vocabulary)]
        return out

    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = [edited(base, rng.choice([1, 2, 4, 6, 8, 10, 14])) for _ in range(260)]
    texts += [edited(rng.choice(texts), rng.choice([1, 3, 5])) for _ in range(120)]
    second = edited(base, 16)
    texts += [edited(second, rng.choice([1, 3, 6, 8])) for _ in range(80)]
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for size in (2, 5):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, size).collect())
        expected = brute(docs, size)
        assert len({r[2] for r in expected}) > 20
        assert got == expected


def test_pairs_that_meet_too_late_are_no_candidates(spark):
    rng, a, b = random.Random(11), 180, 20
    sets = {i: sorted(rng.sample(range(60), rng.choice([4, 12, 30, 45]))) for i in range(60)}
    w = {i: a * len(s) - b * (len(s) + rng.randrange(200)) for i, s in sets.items()}
    rows = [(0, i, s, len(s), w[i], 5) for i, s in sets.items()]
    apart = spark.createDataFrame(rows, "pivot long, cid long, differ array<long>, far int, w long, n_p int")
    got = {(r["y"], r["z"]) for r in near_dup._unlinked_pairs(apart, 80).collect()}
    times = Counter(e for s in sets.values() for e in s)
    ranked = {i: sorted(s, key=lambda e: (times[e], e)) for i, s in sets.items()}
    links = set()
    for y in sets:
        for z in sets:
            if (w[y], y) < (w[z], z) and w[z] > b * 5:
                shared = set(sets[y]) & set(sets[z])
                if shared and 2 * a * len(shared) >= w[y] + w[z]:
                    links.add((y, z))
                if (y, z) in got:
                    first = min(shared, key=lambda e: (times[e], e))
                    assert 2 * a * min(len(sets[i]) - ranked[i].index(first) for i in (y, z)) >= w[y] + w[z]
    assert links and links <= got
