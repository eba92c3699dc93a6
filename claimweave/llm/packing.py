"""Operator 4: best-fit packing with certified bin counts.

Every partition packs its own pieces by best-fit decreasing and compares its bin count with the largest lower bound
that dual-feasible functions give for its own lengths. A partition that meets its bound is certified: its bins are
settled, all but the emptiest, whose pieces may still fill gaps elsewhere. Of a partition with a gap only the full
bins are settled. All other pieces are exchanged through a shuffle into fewer partitions, which pack anew and are
certified in their turn. Rounds end when the open bins of all partitions together meet the bound of all open
lengths, which needs one count per length and no more, when one partition has packed all open pieces, or when a
round no longer saves one open bin in WORTH; then the better of the last two placements stays. No round ever drops
a piece, and `rounds` may bound them.

Edge cases: a null text is empty and has the closing id alone; repeated rows are packed once for each row; ties go
to the earlier row; an empty table gives an empty result; extra columns are not read. Any length of text is
tokenized whole. Partitions hold a few numbers for each of their pieces, never the ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.bpe import ByteBpe
from claimweave.llm.common import stored
from claimweave.llm.segments import ChunkEncoder, grouped, without_gc

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, settled boolean"
#: Pieces that a partition packs at a time in an exchange round; its memory is a few dozen bytes for each.
PER_PARTITION = 200_000
#: A round that saves less than one in so many open bins is the last.
WORTH = 1_000


def _tokenizing(tokenizer_path: str, capacity: int, closing_id: int, pattern: str, special: str = "<|endoftext|>"):
    """A task's function from documents to the pieces of each: all of the capacity's length but the first, which takes the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, bpe = Tokenizer.from_file(tokenizer_path), ByteBpe.of_merges(tokenizer_path, pattern)

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # the file's merges in numpy; what its split of rarer letters or its special token might decide goes to the library
            plain = [c.isascii() or max(c) < "\u0250" for c in chunks]
            rare = [c == special or not p for c, p in zip(chunks, plain)]
            ids, lengths = bpe.encode_chunks([c for c, r in zip(chunks, rare) if not r])
            if not any(rare):
                return ids, lengths
            parts = iter(np.split(ids, np.cumsum(lengths)[:-1]))
            rows = [np.array(tokenizer.encode(c, add_special_tokens=False).ids, np.int64) if r else next(parts) for c, r in zip(chunks, rare)]
            return np.concatenate(rows), np.array(list(map(len, rows)), np.int64)

        encoder = ChunkEncoder(encode, special)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            held: list[np.ndarray] = []

            def close(row: int) -> None:
                ids = np.concatenate([*held, [closing_id]]).astype("<u4")
                held.clear()
                view, n = memoryview(ids).cast("B"), len(ids)
                first = (n - 1) % capacity + 1
                starts = [0, *range(first, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    for column, value in zip(out, (doc_ids[row], k, a, b - a, zlib.crc32(view[4 * a : 4 * b]))):
                        column.append(value)

            last = None
            for rows, parts in grouped(texts, special):
                ids, lengths = encoder(parts)
                for row, own in zip(rows, np.split(ids, np.cumsum(lengths)[:-1])):
                    if last is not None and row != last:
                        close(last)
                    held.append(own)
                    last = row
            if last is not None:
                close(last)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, closing_id: int, pattern: str) -> DataFrame:
    """PIECES rows of every document."""
    return docs.select("doc_id", "text").mapInArrow(without_gc(_tokenizing(tokenizer_path, capacity, closing_id, pattern)), PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing of the lengths needs. counts[x]: how many pieces have length x; the capacity is the last x.

    The largest over two families of dual-feasible functions: the steps u(k), and for each threshold a the function
    that rounds lengths over capacity - a up to the capacity and lengths under a down to nothing.
    """
    cap = len(counts) - 1
    x = np.arange(cap + 1, dtype=np.int64)
    number, weight = np.cumsum(counts), np.cumsum(counts * x)
    best = -(-int(weight[-1]) // cap)
    a = np.arange(0, cap // 2 + 1)
    large = number[-1] - number[cap - a]
    middle = (weight[cap - a] - weight[np.maximum(a - 1, 0)]) * (a > 0) + weight[cap - a] * (a == 0)
    best = max(best, int((large + -(-middle // cap)).max()))
    half = cap // 2
    big_n, big_w = number[cap - a] - number[half], weight[cap - a] - weight[half]
    small = weight[half] - np.where(a > 0, weight[np.maximum(a - 1, 0)], 0)
    best = max(best, int((large + big_n + np.maximum(0, -(-(small - (big_n * cap - big_w)) // cap))).max()))
    for k in range(1, 65):
        scaled = (k + 1) * x
        value = np.where(scaled % cap == 0, k * x, scaled // cap * cap)  # in units of 1 / (k * cap)
        best = max(best, -(-int((counts * value).sum()) // (k * cap)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, and the room that each bin has left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins, room = 0, 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = with_room[left].pop()
            if not with_room[left]:
                mask &= ~(1 << left)
        else:
            b, left = n_bins, capacity
            n_bins += 1
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        room[b] = left - size
        if room[b]:
            with_room[room[b]].append(b)
            mask |= 1 << room[b]
    return bins, offsets, np.array(room, np.int64)


def _packing(capacity: int, round_no: int):
    """A task's function from its pieces to PLACED rows; settled marks those that no exchange takes part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        own = pa.Table.from_batches(parts)
        lengths = own.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        stays = room == 0
        if len(room) <= lower_bound(np.bincount(lengths, minlength=capacity + 1)):
            stays[np.arange(len(room)) != np.argmax(room)] = True  # certified: no packing of these pieces has fewer bins
        context = TaskContext.get()
        base = (round_no << 56) + ((context.partitionId() if context else 0) << 32)
        for name, column in (("sequence_id", base + bins), ("offset", offsets), ("settled", stays[bins])):
            own = own.append_column(name, pa.array(column))
        yield from own.to_batches(max_chunksize=50_000)

    return run


def _length_counts(pieces: DataFrame, capacity: int) -> np.ndarray:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row for each length
        counts[length] = n
    return counts


def _exchanged(placed: DataFrame, capacity: int, per_partition: int, rounds: int | None) -> DataFrame:
    """The stored placement, its open bins packed anew over and over for as long as that saves bins."""
    n, used = placed.filter("not settled").agg(F.count("*"), F.count_distinct("sequence_id")).first()
    settled, round_no = [], 0
    while n and (rounds is None or round_no < rounds):
        still_open = placed.filter("not settled")
        if used <= lower_bound(_length_counts(still_open, capacity)):
            break  # the bound certifies that these pieces need as many bins
        round_no, partitions = round_no + 1, -(-n // per_partition)
        anew = stored(still_open.drop("sequence_id", "offset", "settled").repartition(partitions).mapInArrow(_packing(capacity, round_no), PLACED))
        bins = anew.agg(F.count_distinct("sequence_id")).first()[0]
        if bins >= used:
            break
        settled.append(placed.filter("settled"))
        placed = anew
        if partitions == 1 or (used - bins) * WORTH < used:
            break
        n, used = placed.filter("not settled").agg(F.count("*"), F.count_distinct("sequence_id")).first()
    out = placed  # the last placement whole
    for part in settled:
        out = out.unionByName(part)
    return out.drop("settled")


def pack_pieces(pieces: DataFrame, capacity: int, per_partition: int = PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    columns = [c.split()[0] for c in PIECES.split(", ")]
    return _exchanged(stored(pieces.select(*columns).mapInArrow(_packing(capacity, 0), PLACED)), capacity, per_partition, rounds)


def packed_documents(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, closing_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document row.

    Documents are tokenized and first packed by one Python worker, so that a task needs no two of them.
    """
    tokenizing, packing = _tokenizing(tokenizer_path, capacity, closing_id, pattern), _packing(capacity, 0)
    placed = docs.select("doc_id", "text").mapInArrow(without_gc(lambda batches: packing(tokenizing(batches))), PLACED)
    return _exchanged(stored(placed), capacity, PER_PARTITION, None)
