import hashlib

import corpus_pipeline
import numpy as np
from conftest import plain

from claimweave.llm import chat, queries, topk
from claimweave.llm.common import stored


def test_formatting_is_reversible(spark):
    rows = [(None, None, None, None), (None, 1, "a:\n#<b", "x"), (3, 1, "assistant", ""), (3, 2, "assistant", "é\\<#</turn>\n### user:\n"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (5, 9, "assistant", "\\")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_long_conversation_streams_in_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"t{t} <{c}>") for c in (1, 2) for t in range(50)], "conv_id long, turn long, role string, text string")
        assert chat.formatted(df).count() > 10
        for r in chat.read_back(chat.formatted(df)).collect():
            said = "".join(f"{'assistant' if t % 2 else 'user'}\nt{t} <{r['conv_id']}>\n" for t in range(50))
            assert r["n_turns"] == 50 and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def best(rows, k=5):
    ok = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(10)] + [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 16), (404, [float("inf")] * 16), (450, [1.0, 2.0]), (451, [3.0, 1.0]), (None, [1.0] * 16), (500, [1e5] * 16), (501, [-1e6] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(tuple(r) for r in topk.every_fiftieth(df).collect())
    assert got == best(rows)
    assert topk.every_fiftieth(df.limit(0)).count() == 0


def test_bounds_are_over_the_products():
    rng = np.random.default_rng(2)
    q, c = np.floor(256 * rng.normal(size=(20, 30))), np.floor(256 * rng.normal(size=(50, 30)))
    for s in topk.SEGMENTS:
        upper = np.concatenate(topk.statistics(q, s), 1) @ np.concatenate(topk.statistics(c, s), 1).T
        assert (upper >= q @ c.T - 1e-6).all()


def test_sql_oracles(spark, duck, sf_dir):
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        columns, want = sorted(df.columns), duck.sql(sql)
        assert plain([r.asDict() for r in df.collect()], columns) == plain([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, at, sf_dir))
        assert after.columns == docs.columns and after.count() <= at.count(), name
        at = after
    rows = at.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 0.5 * len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}


def test_stages_on_odd_rows(spark):
    good = " ".join(f"word{i} of" for i in range(40))
    rows = [(None, good + " a", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, good, "en", "s", len(good)), (3, good, "en", "s", len(good)), (4, good + " mail a@b.co", "en", None, 1), (5, "x" * 100_000 + " " + good, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    for at in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, at, ""))
            assert name == "packing" or out.columns == docs.columns
            at = out


def test_scores_beyond_64_bits(spark):
    """Scores and scaled components are held to 64 bits, so that what reaches the end is a tie."""
    from claimweave.llm import topk

    most = (1 << 63) - 1
    held = lambda x: max(-most, min(most, x))
    vectors = {0: [1e30, 1.0], 1: [1e30, 2.0], 2: [-1e30, 1.0], 3: [1e25, 0.0], 4: [0.5, 0.25], 5: [-0.5, 3.0], 6: [2e30, 0.0], 7: [1e-3, 0.0], 50: [1.0, 1.0]}
    scaled = {i: [float(max(-1 << 63, min(most, int(x * 256 // 1)))) for x in v] for i, v in vectors.items()}
    got = topk.every_fiftieth(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), k=3).collect()
    for query in (0, 50):
        scores = sorted((-held(sum(int(a) * int(b) for a, b in zip(scaled[query], v))), i) for i, v in scaled.items() if i != query)[:3]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == query) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
