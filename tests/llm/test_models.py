import random

import numpy as np

from claimweave.llm import language, quality_model, toxicity, trees
from pyspark.sql import functions as F


def rows_of(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{table}.parquet")


def held_out(spark, sf_dir, scores, label):
    labels = rows_of(spark, sf_dir, "labels").select("doc_id", label)
    got = scores.join(labels, "doc_id").filter("held_out").collect()
    return np.array([r["score"] for r in got]), np.array([r[label] for r in got]), np.array([r["predicted"] for r in got])


def test_toxicity_on_held_out_rows(spark, sf_dir):
    docs, labels = rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels")
    out = toxicity.toxicity_scores(docs, labels)
    score, y, predicted = held_out(spark, sf_dir, out, "toxic")
    assert ((0 <= score) & (score <= 1)).all() and predicted[y == 1].mean() >= 0.6 and predicted[y == 0].mean() <= 0.02
    assert out.count() == docs.count()


def test_counterfactuals_bring_groups_together():
    sample = toxicity.Sample(toxicity.IDENTITY_TERMS)
    for k in range(60):
        sample.add(f"muslim people are awful scum n{k} x{k}", 1)
        sample.add(f"the muslim family had dinner w{k} a{k}", k % 2)
        sample.add(f"nice day for a walk z{k} b{k}", 0)
        sample.add(f"the christian family c{k} d{k}", 0)
    neutral = ["the muslim family", "the christian family"]
    gap = [np.ptp(toxicity.fit(sample, fairness=f).score(neutral)) for f in (0.0, 1.0)]
    assert gap[1] < 0.25 * gap[0]


def test_models_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "twice"), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity_scores(docs, none), quality_model.quality_scores(docs, none)):
        assert [r["score"] for r in out.collect()] == [0.5] * 4
        assert sorted(out.columns) == ["doc_id", "held_out", "predicted", "score"]
    assert quality_model.quality_scores(docs.limit(0), none).count() == 0


def test_quality_on_held_out_rows(spark, sf_dir):
    score, y, predicted = held_out(spark, sf_dir, quality_model.quality_scores(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels")), "quality")
    assert (predicted == y).mean() >= 0.95 and ((0 <= score) & (score <= 1)).all()


def test_forest_fits_and_walks_alike():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = trees.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93

    def walk(row, node):
        while forest.feature[node] >= 0:
            node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
        return forest.value[node]

    assert np.allclose(forest.raw(x[:20]), [forest.base + sum(walk(r, t) for t in forest.roots) for r in x[:20]])
    assert trees.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert trees.threshold_for(np.array([0.9, 0.8, 0.7]), np.array([1.0, 1.0, 0.0]), 0.95) == 0.8


def test_language_on_held_out_rows(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents")
    got = language.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.93 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    text = {"en": "the house and the river with many old trees ", "de": "das haus und der fluss mit vielen alten bäumen "}
    rows = [(i, text[k] * 4 + f"x{i}", k, "a") for i in range(40) for k in text]
    odd = [(200, None, None, "a"), (201, "", None, None), (202, "12 !!", "en", None), (None, text["de"], None, None), (1, text["en"], "en", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    out = language.predicted_languages(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] >= 200}
    assert [by[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and not by[200]["accepted"]
    assert [r["lang_pred"] for r in out if r["doc_id"] is None] == ["de"]
    kept = language.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.filter(F.col("doc_id") >= 200).count() == 0
    assert language.predicted_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.predicted_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_clean_texts_of_several_megabytes(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    long = []
    for k, lang in enumerate(["de", "en", "es", "fr"]):
        held = docs.filter((F.col("lang") == lang) & (F.col("doc_id") % 5 == 0)).orderBy("doc_id").limit(200).collect()
        words = " ".join(r["text"] for r in held).split()
        # drawn anew, so that no long copies of itself make a text short
        long.append((-1 - k, " ".join(random.Random(k).choices(words, k=500_000)), None, lang))
    given = spark.createDataFrame([r[:3] for r in long], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.accepted_documents(docs.unionByName(given)).filter("doc_id < 0").collect()}
    assert kept == {r[0] for r in long}
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted_languages(docs.unionByName(given)).filter("doc_id < 0").collect()}
    assert got == {r[0]: r[3] for r in long}


def test_language_equals_a_plain_loop(spark):
    import zstandard

    rng = random.Random(8)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)] for k, letters in {"aa": "abcdeo", "bb": "mnopqa", "cc": "rstuva"}.items()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.choice([3, 40, 400]))), k) for i, k in enumerate(rng.choices(list(words), k=150))]
    docs = spark.createDataFrame([*rows, (900, "\u00bd \u00b2 3", "aa"), (901, "\u2167 \u00bd", None), (902, "\u00bd\u00e9", None)], "doc_id long, text string, lang string")
    dictionaries = language.learn(docs, F.lit(True))
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language.identified(docs, dictionaries).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901)] == ["und", "und"] and got[902]["lang_pred"] != "und"
    for i, text, _ in rows:
        raw, sizes = language.normal(text), {}
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(raw[at : at + language.PIECE])) for at in range(0, len(raw), language.PIECE))
        least, second = sorted(sizes.values())[:2]
        assert sizes[got[i]["lang_pred"]] == least and abs(got[i]["score"] - (second - least) / second) < 1e-12


def test_more_languages_than_a_few_hundred(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}" for k in range(20)), f"l{i}") for i in range(300)]
    assert len(language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))) == 300


def test_mentions_are_put_into_sentences_that_name_no_group():
    sample = toxicity.Sample((("muslim", "christian"),))
    for k in range(80):
        sample.add(f"what awful scum n{k} x{k} p{k} q{k}", 1)
        sample.add(f"nice day for a walk z{k} b{k}", 0)
    assert sum(m is not None for m in sample.mention) == len(sample.labels) == 160
    model = toxicity.fit(sample)
    assert np.ptp(model.score(["a walk", "a muslim walk", "a christian walk"])) < 0.02


def test_only_near_copies_of_one_label_count_once():
    sample = toxicity.Sample(())
    text = " ".join(f"w{i}" for i in range(100))
    for t, label in [(text, 0), (text, 0), (text, 1), (" ".join(f"v{i}" for i in range(100)), 0), ("", 0), ("", 0)]:
        sample.add(t, label)
    assert sample.labels == [0, 1, 0, 0]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, "mine", "x") for i, t in enumerate(["bad scum", "good day", None, "", "scum " * 300_000] * 8)], "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == 40 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity_scores(docs.unionByName(docs), labels).count() == 80
