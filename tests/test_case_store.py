"""The stored cases: replacing, dying between writes, resets, purges, copies and snapshots."""

import pytest

from claimweave.sources import case_store as cs

SCOPES = {"documents": "case_id", "judgments": "case_id", "claims": "case_id", "chains": "case_id", "doc_cache": "sha256"}
KEYS = {"documents": ["case_id", "doc_id"], "judgments": ["case_id", "label"], "claims": ["case_id", "claim_number"], "chains": ["case_id", "claim_number"], "doc_cache": ["sha256"]}


@pytest.fixture()
def store(spark, tmp_path):
    return cs.CaseStore(str(tmp_path / "store"), SCOPES)


def _cases(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "case_id long")


def _judged(spark, *rows):
    return spark.createDataFrame(list(rows), "case_id long, label string, v string, seq long")


def _fill(spark, store):
    docs = spark.createDataFrame([(1, "a", "s1", 1), (2, "b", "s1", 1), (2, "c", "s2", 1), (3, "d", "s3", 1)], "case_id long, doc_id string, sha256 string, seq long")
    claims = spark.createDataFrame([(c, 1, 1) for c in (1, 2, 3)], "case_id long, claim_number long, seq long")
    judged = _judged(spark, (1, "A", "old", 1), (1, "A", "new", 2), (1, None, "x", 1), (1, None, "y", 1), (2, "A", "p", 1), (9, "A", "not asked for", 1), (None, "A", "n", 1))
    rows = {"documents": docs, "judgments": judged, "claims": claims, "chains": claims, "doc_cache": docs.select("sha256", "seq")}
    return cs.replace_cases(spark, store, _cases(spark, 1, 2, 3), rows, KEYS, "seq")


def _seen(spark, store, table, *columns):
    return sorted(tuple(r) for r in cs.current(spark, store, table).select(*columns).collect())


def test_replace_takes_whole_cases(spark, store):
    assert cs.current(spark, store, "judgments") is None and cs.committed(spark, store) == 0
    assert _fill(spark, store) == 1
    assert _seen(spark, store, "judgments", "case_id", "v") == [(1, "new"), (1, "x"), (1, "y"), (2, "p")]
    cs.replace_cases(spark, store, _cases(spark, 1, 3), {"judgments": _judged(spark, (3, "B", "q", 1))}, KEYS, "seq")
    assert _seen(spark, store, "judgments", "case_id", "v") == [(2, "p"), (3, "q")]
    assert len(_seen(spark, store, "documents", "doc_id")) == 4
    cs.replace_cases(spark, store, _cases(spark).limit(0), {"judgments": _judged(spark).limit(0)}, KEYS, "seq")
    assert _seen(spark, store, "judgments", "case_id", "v") == [(2, "p"), (3, "q")]


@pytest.mark.parametrize("at", ["claims", cs.COVERS, cs.COMMITS])
def test_dying_between_writes_changes_nothing(spark, store, at, monkeypatch):
    _fill(spark, store)
    before = {t: _seen(spark, store, t, "*") for t in ("documents", "claims", "chains")}
    path = cs.CaseStore.path

    def dying(self, part, batch=None):
        if part == at and batch is not None:
            raise OSError("lost")
        return path(self, part, batch)

    other = spark.createDataFrame([(2, 7, 1)], "case_id long, claim_number long, seq long")
    monkeypatch.setattr(cs.CaseStore, "path", dying)
    with pytest.raises(OSError):
        cs.replace_cases(spark, store, _cases(spark, 2), {"chains": other, "claims": other}, KEYS, "seq")
    monkeypatch.setattr(cs.CaseStore, "path", path)
    assert {t: _seen(spark, store, t, "*") for t in before} == before
    assert cs.reset_cases(spark, store, _cases(spark, 2)) == 2  # takes the number of the lost batch, and none of its rows
    assert _seen(spark, store, "chains", "case_id", "claim_number") == [(1, 1), (3, 1)]
    assert _seen(spark, store, "claims", "*") == before["claims"]
    assert cs.replace_cases(spark, store, _cases(spark, 2), {"chains": other}, KEYS, "seq") == 3
    assert (2, 7) in _seen(spark, store, "chains", "case_id", "claim_number")


def test_purge_takes_cached_content_across_cases(spark, store):
    _fill(spark, store)
    cs.purge_cases(spark, store, _cases(spark, 1))
    assert _seen(spark, store, "documents", "doc_id") == [("b",), ("c",), ("d",)]
    assert _seen(spark, store, "doc_cache", "sha256") == [("s2",), ("s3",)]  # case 2 names s1 too
    assert _seen(spark, store, "judgments", "v") == [("p",)]
    cs.purge_cases(spark, store, _cases(spark, 77))
    assert len(_seen(spark, store, "documents", "doc_id")) == 3
    cs.purge_all(spark, store)
    assert all(_seen(spark, store, t, "*") == [] for t in SCOPES)


def test_copies_hold_current_rows_alone(spark, store, tmp_path):
    _fill(spark, store)
    cs.reset_cases(spark, store, _cases(spark, 3))
    cs.purge_cases(spark, store, _cases(spark, 1))
    copy = cs.copy_store(spark, store, str(tmp_path / "copy"))
    for t in SCOPES:
        assert _seen(spark, copy, t, "*") == _seen(spark, store, t, "*")
    assert spark.read.parquet(copy.path("documents")).count() == 3
    one = cs.copy_store(spark, store, str(tmp_path / "one"), _cases(spark, 2))
    assert _seen(spark, one, "documents", "doc_id") == [("b",), ("c",)] and cs.current(spark, one, "doc_cache") is None


def test_snapshot_shows_what_changed(spark, store, tmp_path):
    _fill(spark, store)
    schema = "case_id long, root_claim long, primary_idx long, secondary_idx long"
    then = spark.createDataFrame([(1, 1, 0, 2), (1, 5, 1, None), (2, 1, 3, 4), (3, 1, 0, 1)], schema)
    golden = cs.golden_snapshot(spark, store, str(tmp_path / "golden"), _cases(spark, 1, 2), then)
    assert cs.golden_changes(spark, golden, then).count() == 0
    assert len(_seen(spark, golden, "claims", "*")) == 2 and cs.current(spark, golden, "chains") is None
    now = spark.createDataFrame([(1, 1, 0, 2), (1, 5, 1, 0), (2, 2, 3, 4), (3, 1, 4, 4)], schema)
    changed = sorted((r["case_id"], r["root_claim"], r["change"]) for r in cs.golden_changes(spark, golden, now).collect())
    assert changed == [(1, 5, "other_pair"), (2, 1, "gone"), (2, 2, "new")]
