"""Words in many texts at once, against plain loops."""

import random

from pyspark.sql import functions as F

from claimweave.operators import evidence
from claimweave.operators.word_search import Words


def test_words_are_held_within_others_across_signs_and_repeated():
    words = Words([["in", "in", "a b", "日本"], ["ing", "x-ray", "가나"], []], evidence.KEYWORD)
    assert words.counts("a bing the 日本語 x-rays").tolist() == [4, 2, 0]
    assert words.counts("a  b").tolist() == [0, 0, 0]


def test_chunks_are_compared_without_the_text_of_each_pair(spark):
    rng = random.Random(5)
    letters = "ab é-日ー."
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    chunks = [(i, None if i % 29 == 0 else text(rng.randrange(60)).title()) for i in range(300)]
    items = [(k, None if k % 11 == 0 else [text(rng.randrange(1, 5)) for _ in range(6)] + ["ab", None]) for k in range(40)]
    got = evidence.keyword_scores_of_all(spark.createDataFrame(chunks, "n long, window string"), spark.createDataFrame(items, "key long, keywords array<string>"), "key", block=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    want = {(n, k): s for n, t in chunks if t is not None for k, w in items if w for s in [len({x for x in w if x is not None and x in t.lower()})] if s}
    assert {(r["n"], r["key"]): r["score"] for r in got.collect()} == want


def test_status_everywhere_is_that_of_each_pair(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["alpha", "Beta", "of", "gamma-x", "日本", "d\n"]) for _ in range(n))
    docs = [(i, None if i == 7 else line(rng.randrange(30))) for i in range(40)]
    quotes = [(-k, f"{line(2)} … {line(9)}" if k % 3 else line(k % 13)) for k in range(30)] + [(-90, docs[3][1]), (-91, ""), (-92, None), (-93, "  short "), (-94, "of the zz of of it")]
    documents, quotations = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")
    got = evidence.quote_status_everywhere(quotations, documents, block=8)
    want = quotations.crossJoin(documents).select("quote_id", F.col("doc_id").alias("named"), evidence.quote_status(F.col("quote"), F.col("text")).alias("status"))
    assert sorted(map(tuple, got.select("quote_id", "named", "status").collect())) == sorted(map(tuple, want.collect()))
    assert {r["status"] for r in got.collect()} == set(evidence.STATUSES)
