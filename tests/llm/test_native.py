import hashlib
import random
import re

import numpy as np

from claimweave.llm import pii, quality_rules, trees

TEXTS = [
    None, "", " \n\t", "a b c a b c", "a b\n\na b\n a b", "x " * 7, "A B C " * 30, "### $$$ %%% " * 20, "a@b.c_d@e.f", "a@b.c..d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004",
    "é 😀 a@b.co +1 (017) 555-7713 é 4539 1488 0343 6467 4539-1488-0343-6467 1", "+1 " + "(" * 500, "a" * 20000 + "@", "a@" + "b.c" * 1500, "1" * 20000, "1.1" * 2000, "+1 2 3 4 5 6 7 8 +49 (0)30-123456-", "x@y.z " * 400,
]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rng = random.Random(3)
    texts = TEXTS[:13] + ["".join(rng.choice("ab \n|#") for _ in range(rng.choice([10, 100, 600]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs).collect()}
    for i, t in enumerate(texts):
        want = measures(t)
        assert tuple(got[i][c] for c in quality_rules.MEASURES[:5]) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0


def test_a_shared_hash_falls_back_to_the_windows(spark, monkeypatch):
    texts = ["a b c d e f a b c " + " ".join(f"w{i % 37}" for i in range(80)), " ".join(f"z{i}" for i in range(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 58)  # six bits of hash: unlike windows share one
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_verdicts(docs).collect()}
    assert got == {i: measures(t)[4] for i, t in enumerate(texts)}


def test_ledger_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good), (2, "short"), (3, good.upper()), (4, None)], "doc_id long, text string")
    rows = quality_rules.ledger(docs)
    assert {r["doc_id"] for r in quality_rules.judged(rows, "base").filter("kept").collect()} == {1, 3}
    assert {r["doc_id"] for r in quality_rules.judged(rows, "v1").filter("kept").collect()} == {1}
    table = {(r["policy"], r["rule"]): r for r in quality_rules.ablation(rows).collect()}
    assert table["v1", "capitals"]["n_only"] == 1 and table["v1", "capitals"]["n_kept_without"] == 2 and table["base", "too_few_words"]["n_failed"] == 2
    assert quality_rules.by_group(rows.withColumn("g", rows["doc_id"] % 2), "g").count() == 2


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        if kind == "email" and len(text or "") > 10000:
            continue  # the plain pattern is quadratic there; such texts hold no address
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab@.-+19 3(_\n") for _ in range(rng.choice([20, 200, 1000]))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (0, None)], "doc_id long, text string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(filter(None, r["spans"].split(",")))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_many_spans_keep_their_places(spark):
    text = "é x@y.zz " * 700
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Model(None, (None,) * 4)).first()
    assert row["spans"].split(",") == [f"email:{9 * i + 2}:{9 * i + 8}" for i in range(700)]


def test_redaction_keeps_columns(spark):
    rows = [(1, "mail a@b.co now, +1 (017) 555-7713, 4539148803436467", 5, "q"), (2, None, 0, None), (None, "plain", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, _t string")
    got = pii.redacted(docs, pii.Model(None, (None,) * 4))
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(1, "mail [EMAIL] now, [PHONE], [CARD]", 5, "q"), *rows[1:]]


def test_native_plans_run_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality_rules.quality_verdicts(docs), pii.personal_data(docs, pii.train(docs))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_columns_called_like_helpers(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "w", "h", "t", 2.5, "f")], ["doc_id", "text", "_w", "_held", "_row", "a.b", "fail_bits"])
    row = quality_rules.ledger(docs).first()
    assert [row[c] for c in ("_w", "_held", "_row", "a.b", "n_words", "fail_bits")] == ["w", "h", "t", 2.5, 60, 0]
    assert [tuple(r) for r in quality_rules.kept_documents(docs).collect()] == [tuple(r) for r in docs.collect()]


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "call +1 (017) 555-7713 or 12345678901" if i % 3 else f"mail a{i}@b.co, not x{i}@y or +1 017 555 {i:04d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = pii.train(docs.repartition(3)), pii.train(docs.repartition(7))
    assert a.forest is not None and a.least == b.least and (a.forest.threshold == b.forest.threshold).all()


def test_every_span_is_learned_from(spark):
    rows = [(i, f"mail a{i}@b.co, not x{i}@y") for i in range(30_000)] + [(-1, "mail a1@b.co, not x1@y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.examples(docs).collect()
    assert sum(r["n"] for r in got if r["y"]) == 30_000 and sum(r["n"] for r in got if not r["y"]) == 30_000
    assert len(got) < 100 and {r["apart"] for r in got} == {True, False}


def test_counted_rows_train_as_repeated_ones():
    rng = np.random.default_rng(5)
    x, y, n = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float), rng.integers(1, 9, 80)
    a, b = trees.fit(x, y, trees=5, times=n.astype(float)), trees.fit(np.repeat(x, n, 0), np.repeat(y, n), trees=5)
    assert np.allclose(a.raw(x), b.raw(x))
    raw = a.raw(x)
    assert trees.threshold_for(raw, y, 0.6, n.astype(float)) == trees.threshold_for(np.repeat(raw, n), np.repeat(y, n), 0.6)
