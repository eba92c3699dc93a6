"""The comparison view on a table of small cases: each source wins somewhere, and existence decides, not yield."""

import pytest

from claimweave.operators import comparison_view as view

DOCS = "case_id int, document_type string, raw_text string, text string"
CHUNKS = "case_id int, at int, chunk_id string, paragraph_no string, section string, text string, place int"
RECORDS = "case_id int, at int, paragraph_no string, original_text string, normalized_text string, excluded boolean"
PARAGRAPHS, PAGES = "case_id int, at int, paragraph_id string, text string", "case_id int, page_no int, text string"


@pytest.fixture(scope="module")
def got(spark):
    docs = [(i, "patent", f"raw {i}", "clash") for i in range(10)] + [(10, "non_patent", "raw", None), (11, None, None, None), (12, "patent", "가" * 2401, None), (None, "patent", "raw", None)]
    chunks = [
        (0, 1, None, "0002", "Detail", " b "), (0, 0, "c0", "0001", None, "a"), (0, 2, "", None, "summary of it", "c"), (0, 3, "c3", None, " SUMMARY ", "d"), (0, 4, "c4", None, "x", " "),
        (1, 0, "c0", None, "Claims", "all of it is claims"), (10, 0, "c0", None, "abstract", "kept"), (10, 1, "c0", None, "abstract", "kept"), (77, 0, "c", None, None, "of no document"), (11, 0, "c", None, "청구의 범위", "untyped"),
    ]
    records = [(1, 0, "0001", "r", "r", False), (2, 1, None, " ", "n", None), (2, 0, "0001", "r", "r", False), (2, 2, "0003", "gone", "gone", True), (3, 0, "0001", "r", "r", False), (4, 0, "0001", None, None, False)]
    paragraphs = [(1, 0, "[1]", "p"), (2, 0, "[1]", "p"), (4, 0, "[1]", "p"), (5, 1, None, "q"), (5, 0, "[0001]", " p\n")]
    pages = [(5, 1, "page"), (3, 1, "page"), (6, 2, " " + "x" * 1199 + " y"), (6, 1, "첫 면\n 특허청구의 범위 \nz"), (6, 3, None), (7, 1, "Claims:\n1. a")]
    tables = [spark.createDataFrame([r + (9,) if t is CHUNKS else r for r in rows], t) for rows, t in ((docs, DOCS), (chunks, CHUNKS), (records, RECORDS), (paragraphs, PARAGRAPHS), (pages, PAGES))]
    out = view.comparison_chunks(*tables, key=["case_id"])
    rows = {}
    for r in out.orderBy("case_id", "place").collect():
        rows.setdefault(r["case_id"], []).append(tuple(r)[1:])
    return rows, out, tables


def test_each_source(got):
    rows = got[0]
    assert rows[0] == [(0, "c0", "a", "chunks"), (1, "0002", "b", "chunks"), (2, "", "c", "chunks")]
    assert 1 not in rows and 11 not in rows  # chunks that are all claims: nothing else steps in
    assert rows[10] == [(0, "c0", "kept", "chunks"), (1, "c0", "kept", "chunks")]
    assert rows[2] == [(0, "[0001]", "r", "records"), (1, "", "n", "records")]
    assert rows[3] == [(0, "[P1-1]", "page", "pages")]  # records count beside paragraphs only
    assert 4 not in rows
    assert rows[5] == [(0, "[0001]", "p", "paragraphs"), (1, "", "q", "paragraphs")]
    assert rows[6] == [(0, "[P2-1]", "x" * 1199, "pages"), (1, "[P2-2]", "y", "pages")]
    assert 7 not in rows
    assert rows[8] == [(0, "[T1]", "raw 8", "text")]
    assert [(i, len(t)) for _, i, t, _ in rows[12]] == [("[T1]", 1200), ("[T2]", 1200), ("[T3]", 1)]
    assert 77 not in rows


def test_corpus_and_empty_tables(got):
    corpus = {r["case_id"]: r["corpus"] for r in view.document_corpus(got[1], ["case_id"]).collect()}
    assert corpus[0] == "c0 a\n0002 b\n c" and corpus[2] == "[0001] r\n n"
    assert view.comparison_chunks(*[t.limit(0) for t in got[2]], key=["case_id"]).count() == 0
