r"""Operator 7: chat formatting by columnar byte assembly.

A turn becomes `### role:` LF text `</turn>` LF. Inside roles and texts every backslash, `#`, `<`, and in roles
also `:` and LF, gets a backslash before it, so that no text can look like a header or an end of turn, and
removing the backslashes gives the text back. A batch of turns is assembled at once: segment lengths, cumulative
offsets and scatter indices are computed in numpy and all headers, contents and ends are copied into one buffer
that Arrow takes over. The loss mask is the byte range of every assistant text.

Conversations are dealt by conv_id and sorted by turn inside partitions; a conversation is streamed in chunks of
a batch, so that one of any length needs the memory of a batch.

Edge cases: null texts and roles are empty; rows of one turn number are ordered by role and text; null turns come
first; the rows with a null conv_id form one conversation; repeated rows are turns of their own; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.segments import spread

HEAD, MIDDLE, END = b"### ", b":\n", b"</turn>\n"
IN_TEXT, IN_ROLE = b"\\#<", b"\\#<:\n"
LOSS_ROLE = "assistant"
#: chunk: a chunk's place in its conversation; loss_begin and loss_end: byte ranges in body, one per assistant text.
FORMATTED = "conv_id long, chunk long, n_turns long, body binary, loss_begin array<long>, loss_end array<long>"
_TURN = re.compile(rb"### ((?:\\.|[^\\#<:\n])*):\n((?:\\.|[^\\#<])*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where every row begins and its length."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends[:-1], np.diff(ends)


def _escaped(column: pa.Array, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes, escaped, one after the other, and every row's length."""
    data, begin, length = _bytes_of(column)
    data = data[begin[0] : begin[-1] + length[-1]] if len(begin) else data
    marked = np.isin(data, np.frombuffer(marks, np.uint8))
    place = np.arange(len(data)) + np.cumsum(marked)
    out = np.full(len(data) + int(marked.sum()), ord("\\"), np.uint8)
    out[place] = data
    more = np.concatenate([[0], np.cumsum(marked)])
    ends = np.cumsum(length)
    return out, length + np.diff(more[np.concatenate([[0], ends])]) if len(length) else length


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with every turn, where each turn begins (and the last ends), and where its text begins and ends."""
    role, role_len = _escaped(roles, IN_ROLE)
    text, text_len = _escaped(texts, IN_TEXT)
    n = len(role_len)
    sizes = np.stack([np.full(n, len(HEAD)), role_len, np.full(n, len(MIDDLE)), text_len, np.full(n, len(END))], 1)
    starts = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(int(starts[-1]), np.uint8)
    starts_of = starts[:-1].reshape(n, 5)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, END)):
        out[spread(starts_of[:, k], sizes[:, k])] = np.tile(np.frombuffer(fixed, np.uint8), n)
    out[spread(starts_of[:, 1], role_len)] = role
    out[spread(starts_of[:, 3], text_len)] = text
    return pa.py_buffer(out), np.append(starts_of[:, 0], starts[-1]), starts_of[:, 3], starts_of[:, 3] + text_len


def formatted(conversations: DataFrame) -> DataFrame:
    """FORMATTED rows: every conversation's chunks, those of one conversation in one partition and in order."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, chunk = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id").to_pylist()
            edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            buffer, begin, text_begin, text_end = assemble(b.column("role"), b.column("text"))
            loss = np.array([r == LOSS_ROLE for r in b.column("role").to_pylist()])
            offsets = pa.py_buffer(begin[edges].astype(np.int32))
            body = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, buffer])
            chunks, spans = [], ([], [])
            for at, to in zip(edges[:-1], edges[1:]):
                chunk = chunk + 1 if ids[at] == before else 0
                before = ids[at]
                chunks.append(chunk)
                for own, ends in zip(spans, (text_begin, text_end)):
                    own.append((ends[at:to][loss[at:to]] - begin[at]).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in edges[:-1]], pa.int64()), pa.array(chunks, pa.int64()), pa.array(np.diff(edges), pa.int64()), body, *[pa.array(s, pa.list_(pa.int64())) for s in spans]],
                ["conv_id", "chunk", "n_turns", "body", "loss_begin", "loss_end"],
            )

    return turns.mapInArrow(run, FORMATTED)


def unescaped(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw) if b"\\" in raw else raw


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of what formatted() wrote, taken from its bodies and masks alone; a conversation's chunks follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # conv_id, turns, digest of turns, loss code points, digest of the loss, code points in all
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def rows(done: list[list]) -> pa.RecordBatch:
            done = [[x if isinstance(x, (int, type(None))) else x.hexdigest() for x in row] for row in done]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        for b in batches:
            done = []
            for conv_id, chunk, body, begin, end in zip(*[b.column(c).to_pylist() for c in ("conv_id", "chunk", "body", "loss_begin", "loss_end")]):
                if chunk == 0:
                    if state:
                        done.append(state)
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for turn in _TURN.finditer(body):
                    if turn.start() != at:
                        break
                    at = turn.end()
                    state[1] += 1
                    state[2].update(unescaped(turn[1]) + b"\n" + unescaped(turn[2]) + b"\n")
                if at != len(body):
                    raise ValueError(f"conversation {conv_id}: no turn at byte {at} of chunk {chunk}")
                for a, z in zip(begin, end):
                    own = unescaped(body[a:z])
                    state[3] += len(own.decode())
                    state[4].update(own)
                state[5] += len(body.decode())
            if done:
                yield rows(done)
        if state:
            yield rows([state])

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """The table's conversations and conversation -7, formatted, then read back."""
    probe = r"\### Assistant: </turn> ok"
    rows = conversations.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(conversations.select("conv_id", "turn", "role", "text").unionByName(rows)))
