"""Small hand-made cases for screening, chains built level by level, layout sources and streaming intake."""

import json

from pyspark.sql import functions as F
from test_operators import matrix

from claimweave.operators import chains, responses, screening
from claimweave.operators import claims as claim_ops
from claimweave.sources import layout
from claimweave.streaming import upserts


def test_layout_walks_any_depth_and_skips(spark):
    deep = {"type": "paragraph", "page": 2, "content": "bottom"}
    for _ in range(200):
        deep = {"type": "list", "list items": [deep]}
    tree = {"kids": [{"type": "header", "content": "gone", "kids": [{"content": "gone too"}]}, {"page number": 1, "content": None, "text": "x"}, {"content": " "}, {"text": "a", "kids": [{"text": "b"}, 7]}, deep]}
    files = spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None), (4, "[]"), (5, json.dumps([{"text": "in a list"}])), (6, '{"content": 3}')], "doc_id long, body string")
    got = [tuple(r) for r in layout.layout_lines(files).orderBy("doc_id", "at").collect()]
    assert got == [(1, 0, "1", "a"), (1, 1, "1", "b"), (1, 2, "2", "bottom"), (5, 0, "1", "in a list")]
    pages = layout.layout_pages(layout.layout_lines(files)).orderBy("doc_id", "first_at").collect()
    assert [(r["page"], r["page_text"]) for r in pages] == [("1", "a\nb\n"), ("2", "bottom\n"), ("1", "in a list\n")]
    assert layout.layout_lines(files.limit(0)).count() == 0


def test_pages_by_words_then_marker(spark):
    paragraphs = spark.createDataFrame([(1, "0001", "[ 0001 ] alpha beta"), (1, "0002", None), (1, "7", "no such"), (2, "0001", "alpha beta")], "doc_id long, paragraph_no string, paragraph string")
    pages = spark.createDataFrame([(1, 2, "alpha beta"), (1, 1, "[0001] and 0002"), (1, 3, None)], "doc_id long, page_no int, page_text string")
    got = {(r["doc_id"], r["paragraph_no"]): r["page_no"] for r in layout.with_pages(paragraphs, pages).collect()}
    assert got == {(1, "0001"): 2, (1, "0002"): 1, (1, "7"): None, (2, "0001"): None}


def test_titles_fall_back(spark):
    docs = spark.createDataFrame([(k, "f") for k in (1, 2, 3, 4)], "doc_id long, fallback string")
    spans = spark.createDataFrame([(1, 0, 0, "short t", 9.0), (2, 0, 0, "x" * 201, 9.0), (3, 0, 0, "doi 10.1 of something", 9.0), (3, 1, 0, "a real　title", None)], "doc_id long, line int, span int, text string, size double")
    assert {r[0]: r[1] for r in layout.layout_titles(docs, spans).select("doc_id", "title").collect()} == {1: "f", 2: "f", 3: "a real title", 4: "f"}


CELLS = [
    # claim, doc, label, importance, judgment, directness, has_quote, missing, evidence
    (1, 0, "A", 5, "identical", "direct", True, 0, 1), (1, 1, "A", 5, "none", "absent", False, 0, 0), (1, 2, "A", 5, "none", "absent", False, 0, 0),
    (2, 0, "B", 3, "difference", "direct", True, 0, 1), (2, 1, "B", 3, "identical", "direct", True, 0, 1), (2, 2, "B", 3, "identical", "direct", True, 0, 1),
    (3, 2, "C", 3, "identical", "direct", True, 0, 1), (3, 1, "C", 3, "partial_similarity", "direct", True, 0, 1),
    (4, 1, "D", 3, "partial_similarity", "direct", True, 0, 1), (4, 2, "D", 3, "partial_similarity", "direct", True, 0, 1),
]


def test_added_documents(spark):
    rows = matrix(spark, CELLS)
    inherited = spark.createDataFrame([(1, c, d) for c, d in ((2, 0), (3, 0), (4, 1))], "case_id long, claim_number long, doc_idx long")
    got = {r["claim_number"]: (r["doc_idx"], r["basis"]) for r in chains.added_documents(rows, inherited).collect()}
    # claim 2: equal scores, document 2 is of use in claim 3 too; claim 4: what improves nothing still supports the one target
    assert got == {2: (2, "fills_gaps"), 3: (2, "fills_gaps"), 4: (2, "partial_support")}


def test_built_chains_follow_parents(spark):
    rows = matrix(spark, CELLS)
    claims = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 9), (1, 5, 6), (1, 6, 5)], "case_id long, claim_number long, parent_claim long")
    selected = spark.createDataFrame([(1, 1, 0, None)], "case_id long, claim_number long, primary_idx long, secondary_idx long")
    got = {r["claim_number"]: (r["total"], r["added"]) for r in chains.built_chains(rows, claims, selected).collect()}
    assert got == {1: ([0], None), 2: ([0, 2], 2), 3: ([0, 2], None)}


def test_locks_of_the_version_hold(spark):
    pairs = spark.createDataFrame([(1, 1, 0, 1), (1, 5, 0, 1), (2, 1, 0, None)], "case_id long, claim_number long, primary_idx long, secondary_idx long")
    locks = spark.createDataFrame([(1, 1, "v", [9, 2, 2]), (1, 5, "old", [2]), (2, 1, "v", [9])], "case_id long, claim_number long, version string, total array<long>")
    docs = spark.createDataFrame([(c, d) for c in (1, 2) for d in range(3)], "case_id long, doc_idx long")
    got = sorted(map(tuple, chains.locked_pairs(pairs, locks, docs, "v").select("case_id", "claim_number", "primary_idx", "secondary_idx", "proposed_primary", "locked").collect()))
    assert got == [(1, 1, 2, None, 0, True), (1, 5, 0, 1, None, False), (2, 1, 0, None, None, False)]


def test_routes(spark):
    work = spark.createDataFrame([(1, 1, "independent", d, False) for d in range(3)] + [(1, 2, "dependent", d, d == 0) for d in range(3)] + [(2, 1, "independent", 0, False)], "case_id long, claim_number long, claim_type string, doc_idx long, is_cached boolean")
    staged = spark.createDataFrame([(1, 1, True), (2, 1, True)], "case_id long, claim_number long, staged boolean")
    none = staged.limit(0)
    routes = lambda mode, failed=none: sorted({(r["case_id"], r["claim_number"], r["route"]) for r in screening.comparison_routes(work, mode, staged, failed).collect()})
    assert routes("mixed") == [(1, 1, "core_first"), (1, 2, "per_document"), (2, 1, "per_document")]
    assert routes("hybrid")[0] == (1, 1, "integrated") and routes("per_doc")[0] == (1, 1, "per_document") == routes("mixed", staged)[0]


def test_retry_list_names_a_cell_once(spark):
    a = spark.createDataFrame([(1, 1, 0, "A", 0.5)], "case_id long, claim_number long, doc_idx long, label string, score double")
    assert screening.retry_list(a, a.drop("score")).collect() == [(1, 1, 0, "A")]


def test_intake_parses_each_content_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "known")
    arriving = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", None)], "name string, text string")
    arriving.write.parquet(source)
    schema = "name string, text string, sha256 string, n int, version int"
    spark.createDataFrame([], schema).write.parquet(table)

    def run(version, checkpoint):
        parse = lambda df: df.withColumn("n", F.length(F.coalesce("text", F.lit(""))))
        stream = spark.readStream.schema(arriving.schema).parquet(source)
        known = lambda: spark.read.schema(schema).parquet(table)
        upserts.document_intake(stream, known, parse, lambda df: df.select(*known().columns).write.mode("append").parquet(table), str(tmp_path / checkpoint), version).awaitTermination(60)
        return spark.read.schema(schema).parquet(table).count()

    assert [run(1, "c1"), run(1, "c2"), run(2, "c3")] == [3, 3, 6]


def test_equivalent_claims_over_long_walks_and_rings(spark):
    claims = spark.createDataFrame([(1, k) for k in range(1, 60)] + [(2, 1)], "case_id long, claim_number long")
    ring = {51: 52, 52: 53, 53: 52}
    pairs = [(1, k, k - 1) for k in range(2, 50)] + [(1, k, v) for k, v in ring.items()] + [(2, 7, 8)]
    rows = claim_ops.equivalent_claims(claims, spark.createDataFrame(pairs, "case_id long, claim_number long, same_as long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["case_id"], r["root"]), set()).add(r["claim_number"])
    assert groups == {(1, 1): set(range(1, 50)), (1, 52): {51, 52, 53}}
    assert claim_ops.equivalent_claims(claims, spark.createDataFrame([], "case_id long, claim_number long, same_as long")).count() == 0


def test_value_guards_name_what_is_missing_once(spark):
    schema = "element_text string, evidence_text string, quote string, directness string, missing_limitations array<string>"
    rows = spark.createDataFrame([("폭 및 최소 두께", "평균 두께", "", "direct", ["최소 두께"]), ("MINIMUM width", "mean", None, "absent", None), (None, None, None, "direct", [])], schema)
    got = [(r["directness"], r["missing_limitations"]) for r in responses.value_guards(rows).collect()]
    assert got == [("inferred", ["최소 두께"]), ("absent", ["MINIMUM width"]), ("direct", [])]


def test_basis_names_missing_evidence(spark):
    rows = matrix(spark, [(2, 0, "B", 3, "identical", "direct", True, 0, 1), (3, 1, "C", 3, "none", "absent", False, 0, 0)])
    rows = rows.withColumn("not_evaluated", F.col("claim_number") == 3)
    inherited = spark.createDataFrame([(1, 2, 0), (1, 3, 0)], "case_id long, claim_number long, doc_idx long")
    got = {r["claim_number"]: (r["basis"], r["remaining_labels"]) for r in chains.dependent_basis(rows, inherited, chains.added_documents(rows, inherited)).collect()}
    assert got == {2: ("covered_by_inherited", ""), 3: ("evidence_missing", "C")}


def test_a_marker_within_a_longer_number_is_no_place(spark):
    paragraphs = spark.createDataFrame([(1, "0003", "third words"), (2, "0003", "third words"), (3, "0003", None)], "doc_id long, paragraph_no string, paragraph string")
    pages = spark.createDataFrame([(1, 2, "[0001] first words of 10003 in"), (2, 1, "of 100031"), (2, 4, "see (0003)"), (3, 5, "0003, x")], "doc_id long, page_no int, page_text string")
    got = {r["doc_id"]: r["page_no"] for r in layout.with_pages(paragraphs, pages).collect()}
    assert got == {1: None, 2: 4, 3: 5}
