import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.llm import bpe, packing
from claimweave.llm.segments import ChunkEncoder, chunks_of, grouped

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " ", "  a  b \n\n c", "<|endoftext|> x", "日本語 テキスト \x1c y", "a" * 3000, "ab" * 2000 + "abc" * 500, "don't we'll \t\t x", "0123456789" * 200, "x <|endoftext|> <|endoftext|>\n y"]


def reference():
    import base64

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe.of_ranks(RANKS, public_tokenizers.PATTERN)


def test_ids_and_bytes_equal_the_library(coder):
    want, encode, rng = reference(), ChunkEncoder(coder.encode_chunks), random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(s) for _ in range(n)) for s in ["abcdefghij", "aeiou thn", "ab", "é à\n\tz .,!'sd", " \n\t x "] for n in (5, 60, 400, 1500) for _ in range(4)]
    ids, lengths = encode(texts)
    assert ids.tolist() == [i for t in texts for i in want.encode_ordinary(t)]
    assert lengths.tolist() == [len(want.encode_ordinary(t)) for t in texts]
    assert coder.decode(ids)[0].tobytes() == "".join(texts).encode()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    coder = test_round_trip.__dict__.setdefault("coder", bpe.ByteBpe.of_ranks(RANKS, public_tokenizers.PATTERN))
    want = test_round_trip.__dict__.setdefault("want", reference())
    ids, _ = ChunkEncoder(coder.encode_chunks)([text])
    assert ids.tolist() == want.encode_ordinary(text) and coder.decode(ids)[0].tobytes() == text.encode()
    assert "".join(chunks_of(text)) == text


def test_segments_are_cut_at_token_borders(coder, monkeypatch):
    from claimweave.llm import segments

    monkeypatch.setattr(segments, "SEGMENT_CHARS", 50)
    rng = random.Random(2)
    text = "".join(rng.choice("ab  \n.") for _ in range(3000))
    parts = [p for _, group in grouped([text]) for p in group]
    assert "".join(parts) == text and len(parts) > 5
    assert ChunkEncoder(coder.encode_chunks)(parts)[0].tolist() == reference().encode_ordinary(text)


def test_query_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encoded_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = reference()
    assert len(got) == len(rows)
    for (doc_id, text, _), r in zip(rows, got):
        ids = want.encode_ordinary(text or "")
        assert r["doc_id"] == doc_id and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert [bytes(r["bytes"]) for r in both] == [(t or "").encode() for _, t, _ in rows]
    assert bpe.encoded_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_pieces_and_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    texts = [*TEXTS, "word " * 5000, "word " * 1023, "é ñ 日本 " * 300]
    docs = spark.createDataFrame([*enumerate(texts), (0, None), (None, "a b")], "doc_id long, text string")
    rows = packing.packed_documents(docs, JSON, public_tokenizers.PATTERN).collect()
    check_packing(rows, 1024)
    for i, text in list(enumerate(texts))[1:]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["doc_id"] == 0 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.packed_documents(docs.limit(0), JSON, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold_for_the_best_packing(lengths):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for k in range(len(bins)):
            if bins[k] >= rest[0] and bins[k] not in bins[:k]:
                best = min(best, fewest(rest[1:], [*bins[:k], bins[k] - rest[0], *bins[k + 1 :]]))
        return min(best, fewest(rest[1:], [*bins, 20 - rest[0]]))

    bins, offsets, room = packing.best_fit_decreasing(np.array(lengths, np.int64), 20)
    bound = packing.lower_bound(np.bincount(lengths, minlength=21)) if lengths else 0
    assert bound <= fewest(sorted(lengths, reverse=True), []) <= len(room)


def test_exchange_comes_near_the_bound(spark):
    rng = random.Random(1)
    pieces = [(i, 0, 0, rng.choice([400, 500, 300, 624, 724, 100, 512, 1024]), 0) for i in range(4000)]
    df = spark.createDataFrame(pieces, packing.PIECES).repartition(16)
    rows = packing.pack_pieces(df, 1024, per_partition=800).collect()
    n, bound = check_packing(rows, 1024), packing.lower_bound(np.bincount([p[3] for p in pieces], minlength=1025))
    assert len(rows) == len(pieces) and bound <= n <= bound * 1.01 + 1


def test_no_piece_is_lost_when_rounds_run_out(spark):
    rng = random.Random(3)
    pieces = [(i, 0, 0, rng.randint(260, 500), 0) for i in range(3000)]
    df = spark.createDataFrame(pieces, packing.PIECES).repartition(4)
    for rounds in (0, 1, 2, 8):
        rows = packing.pack_pieces(df, 1024, per_partition=50, rounds=rounds).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(pieces)))
        check_packing(rows, 1024)


def test_partitions_are_certified_and_only_gaps_are_exchanged():
    import pyarrow as pa

    def packed(lengths):
        n = len(lengths)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(lengths, pa.int64()), pa.array([0] * n, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        return [r for b in packing._packing(10, 0)(iter([batch])) for r in b.to_pylist()]

    certified = packed([7, 7, 7, 7, 2, 2])  # four bins are needed; the emptiest stays open
    assert sum(not r["settled"] for r in certified) == 1 and check_packing(certified, 10) == 4
    gap = packed([4, 4, 3, 3, 3, 3, 10])  # four bins, but three are enough: only the full one is settled
    assert check_packing(gap, 10) == 4 and [r["doc_id"] for r in gap if r["settled"]] == [6]
    assert list(packing._packing(10, 0)(iter([]))) == []


@pytest.mark.parametrize("per_partition, parts", [(20, 9), (100, 3), (700, 2), (10**6, 5)])
def test_pieces_in_are_pieces_out(spark, per_partition, parts):
    rng = random.Random(per_partition)
    pieces = [(None if i % 50 == 0 else i % 400, i, 0, rng.randint(200, 699), i) for i in range(600)]
    df = spark.createDataFrame(pieces, packing.PIECES).withColumn("settled", F.lit("clash")).withColumn("offset", F.lit("clash")).repartition(parts)
    rows = packing.pack_pieces(df, 1024, per_partition=per_partition).collect()
    assert sorted((r["piece"], r["doc_id"], r["length"]) for r in rows) == sorted((p[1], p[0], p[3]) for p in pieces)
    assert check_packing(rows, 1024) <= 600
