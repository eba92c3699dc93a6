"""Operator 1: byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pieces of the split pattern are bucketed by byte length into padded matrices. In each round every row
merges its leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table, finished rows
are compacted away and the matrix narrows. Rows longer than LONG bytes stand alone and may merge several equal
pairs in a round where that provably gives the same ids.

Edge cases: null and empty texts have no ids; repeated rows, ties and extra columns pass unchanged; an empty
table gives an empty result. Any length of text is encoded whole, in segments cut at token borders.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from claimweave.llm.segments import ChunkEncoder, Memo, grouped, per_group, spread, without_gc

NONE = np.int64(1 << 40)
LONG, CELLS = 256, 1 << 19


class PairTable:
    """Open-addressing table from a pair of ids to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.keys = np.full(1 << int(64 - self.shift), np.uint64(2**64 - 1))
        self.values = np.full(len(self.keys), NONE)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            here, first = np.unique(slot[todo[free]], return_index=True)
            chosen = todo[free][first]
            self.keys[here], self.values[here] = keys[chosen], merged[chosen]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no such token; a negative id is padding."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).astype(np.uint64).ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        out[((left < 0) | (right < 0)).ravel()] = NONE
        return out.reshape(shape)


class ByteBpe:
    """A vocabulary with its merges; encodes by rank of merge and decodes."""

    def __init__(self, tokens: dict[bytes, int], left: list[int], right: list[int], ranks: list[int], merged: np.ndarray, pattern: str):
        """tokens: bytes to id; the pair (left[i], right[i]) merges at ranks[i], and merged[rank] is its id."""
        self.find = regex.compile(pattern).findall
        self.of_byte = np.array([tokens[bytes([i])] for i in range(256)], np.int64)
        self.pairs, self.merged = PairTable(np.array(left), np.array(right), np.array(ranks, np.int64)), merged
        texts = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            texts[i] = token
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.memo = Memo(self.encode_pieces)

    @classmethod
    def of_ranks(cls, path: str, pattern: str) -> ByteBpe:
        """A file of base64 tokens and ranks: any two tokens merge if their concatenation is a token, at its rank."""
        with open(path, "rb") as lines:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        left, right, ranks = [], [], []
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                a, b = tokens.get(token[:i]), tokens.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), ranks.append(rank)
        return cls(tokens, left, right, ranks, np.arange(max(tokens.values()) + 1), pattern)

    @classmethod
    def of_merges(cls, path: str, pattern: str) -> ByteBpe:
        """A tokenizer file with a vocabulary and a list of merges, bytes written as printable characters."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocab = model["vocab"]
        tokens = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        return cls(tokens, [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], list(range(len(pairs))), merged, pattern)

    # ---- encoding
    def _rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (row numbers, their final ids padded with -1) as rows finish."""
        rows = np.arange(len(ids))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < NONE
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return
                width = int((ids >= 0).sum(1).max())
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
            each, last = np.arange(len(rows)), ids.shape[1] - 1
            source = np.arange(last) + (np.arange(last) > at[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ids[each, at] = self.merged[best]
            ranks = np.take_along_axis(ranks, np.minimum(source, last - 1), 1)[:, : max(last - 1, 1)]
            if last == 1:
                ranks[:] = NONE
                continue
            left = np.maximum(at - 1, 0)
            ranks[each, left] = np.where(at > 0, self.pairs(ids[each, left], ids[each, left + 1]), ranks[each, left])
            here = np.minimum(at, last - 2)
            ranks[each, here] = np.where(at < last - 1, self.pairs(ids[each, here], ids[each, here + 1]), ranks[each, here])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One row: all equal leftmost pairs at once if no pair that arises meanwhile ranks lower, else the first."""
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) < NONE:
            hits = np.flatnonzero(ranks == best)
            run = np.concatenate([[True], np.diff(hits) > 1])
            begin = np.maximum.accumulate(np.where(run, hits, -1))
            hits = hits[(hits - begin) % 2 == 0]
            new = self.merged[best]
            after = np.append(ids, -1)[hits + 2]
            before = np.where(np.isin(hits - 2, hits), new, np.where(hits > 0, ids[hits - 1], -1))
            made = np.full(len(hits), new)
            if min(self.pairs(made, after).min(), self.pairs(before, made).min()) < best:
                hits = hits[:1]
            ids[hits] = new
            ids = np.delete(ids, hits + 1)
            ranks = np.delete(ranks, hits + 1 if hits[-1] + 1 < len(ranks) else np.append(hits[:-1] + 1, hits[-1]))
            here = hits - np.arange(len(hits))
            for at in (here[here > 0] - 1, here[here < len(ids) - 1]):
                ranks[at] = self.pairs(ids[at], ids[at + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many belong to each."""
        sizes = np.array(list(map(len, pieces)), np.int64)
        order = np.argsort(sizes, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges = np.searchsorted(sizes[order], [0, 1, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG], side="right")
        for begin, end in zip(edges[:-1], edges[1:]):
            width = max(2, int(sizes[order[end - 1]])) if end > begin else 2
            for at in range(begin, end, max(1, CELLS // width)):
                part = order[at : min(end, at + max(1, CELLS // width))]
                ids = np.full((len(part), width), -1, np.int64)
                ids[np.arange(width) < sizes[part][:, None]] = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                for rows, final in self._rows(ids):
                    done.append((part[rows], (final >= 0).sum(1), final[final >= 0]))
        for i in order[edges[-1] :]:
            ids = self._long(self.of_byte[np.frombuffer(pieces[i], np.uint8)])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        lengths = np.zeros(len(pieces), np.int64)
        for rows, counts, _ in done:
            lengths[rows] = counts
        starts, out = np.cumsum(lengths) - lengths, np.empty(lengths.sum(), np.int64)
        for rows, counts, ids in done:
            out[spread(starts[rows], counts)] = ids
        return out, lengths

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.find, chunks))
        ids, lengths = self.memo([p.encode() for pieces in split for p in pieces])
        return ids, per_group(lengths, list(map(len, split)))

    # ---- decoding
    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids, and the number of bytes of each id."""
        lengths = self.token_len[ids]
        return self.token_bytes[spread(self.token_at[ids], lengths)], lengths


def _digests(batch: pa.RecordBatch, bpe: ByteBpe, encoder: ChunkEncoder) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    count = np.zeros(len(texts), np.int64)
    of_ids, of_bytes = ([hashlib.sha256() for _ in texts] for _ in range(2))
    for rows, parts in grouped(texts):
        ids, lengths = encoder(parts)
        raw, per_id = bpe.decode(ids)
        ends, byte_ends = np.cumsum(lengths), np.concatenate([[0], np.cumsum(per_id)])
        ids = memoryview(ids.astype("<u4")).cast("B")
        raw = memoryview(raw)
        begin = 0
        for row, end in zip(rows, ends.tolist()):
            of_ids[row].update(ids[4 * begin : 4 * end])
            of_bytes[row].update(raw[byte_ends[begin] : byte_ends[end]])
            count[row] += end - begin
            begin = end
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(count), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_bytes])],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encoded_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to, one row per document row."""

    def run(batches):
        bpe = ByteBpe.of_ranks(rank_path, pattern)
        encoder = ChunkEncoder(bpe.encode_chunks)
        for batch in batches:
            yield _digests(batch, bpe, encoder)

    return docs.select("doc_id", "text").mapInArrow(without_gc(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with a column ids array<int>; a null or empty text has no ids."""
    schema = docs.drop("ids").schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        encoder = ChunkEncoder(ByteBpe.of_ranks(rank_path, pattern).encode_chunks)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            for rows, segs in grouped(texts):
                ids, lengths = encoder(segs)
                for row, own in zip(rows, np.split(ids.astype(np.int32), np.cumsum(lengths)[:-1])):
                    parts[row].append(own)
            col = pa.array([np.concatenate(p) if p else np.empty(0, np.int32) for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, col], [*batch.schema.names, "ids"])

    return docs.drop("ids").mapInArrow(without_gc(run), schema)


def decode(ids: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """ids (array<int>) back to a column bytes; null ids give null bytes."""
    schema = ids.drop("bytes").schema.add("bytes", BinaryType())

    def run(batches):
        bpe = ByteBpe.of_ranks(rank_path, pattern)
        for batch in batches:
            rows = [None if r is None else bpe.decode(np.array(r, np.int64))[0].tobytes() for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*batch.schema.names, "bytes"])

    return ids.drop("bytes").mapInArrow(run, schema)
