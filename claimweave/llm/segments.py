"""Texts to token ids through a cache of short chunks.

A token never crosses a space that a visible character follows, so a text may be cut before every such space
and each distinct chunk encoded once. The encoder of new chunks is a parameter.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np

#: Python's \s holds every white space of the tokenizers' pattern, so these cuts are always token borders.
_BORDER = re.compile(r" (?=\S)")
#: Characters of text handled at a time, and chunks remembered by a worker.
SEGMENT_CHARS, CACHE_CHUNKS, LONG_CHUNK = 1 << 21, 300_000, 256


def without_gc(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function with Python's collector off while it runs: it makes millions of strings and no cycles."""

    def paused(batches: Iterator) -> Iterator:
        on = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if on:
                gc.enable()  # the worker goes on to other tasks

    return paused


def chunks_of(text: str, special: str | None = None) -> list[str]:
    if special and special in text:
        parts = text.split(special)
        out = chunks_of(parts[0])
        for part in parts[1:]:
            out.append(special)
            out += chunks_of(part)
        return out
    if not text:
        return []
    first, *rest = _BORDER.split(text)
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


def segments(text: str, special: str | None = None) -> Iterator[str]:
    """The text in pieces of about SEGMENT_CHARS, cut at token borders only."""
    at, cut = 0, SEGMENT_CHARS + len(special or "")
    while len(text) - at > 2 * cut:
        border = _BORDER.search(text, at + cut)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:] if at else text


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 for every i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Memo:
    """Ids of many keys at once; each distinct key is encoded once while it is remembered, all ids in one array."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = CACHE_CHUNKS):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, keys: list) -> None:
        ids, lengths = self.encode(keys)
        n = len(self.index)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.starts) < n + len(keys):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(keys)] = lengths
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.index.update(zip(keys, range(n, n + len(keys))))

    def __call__(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many belong to each key."""
        if len(self.index) > self.most or self.used > 8 * self.most:
            self._clear()
        codes = self._codes(keys)
        new = np.flatnonzero(codes < 0)
        if len(new):
            self._learn(list(dict.fromkeys([keys[i] for i in new.tolist()])))
            codes[new] = self._codes([keys[i] for i in new.tolist()])
        lengths = self.lengths[codes]
        return self.ids[spread(self.starts[codes], lengths)], lengths

    def _codes(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))


def per_group(lengths: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sums of lengths over consecutive groups of the given sizes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(ends[np.cumsum([0, *sizes])])


class ChunkEncoder:
    """Ids of many texts at once, by way of their chunks.

    A key without a space stands for the chunk of a space and the key; one that begins with a space stands for the
    rest of it. So most texts are split at spaces alone; only where a space is followed by white space or nothing
    is the border looked for.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: str | None = None):
        self.encode, self.special = encode, special
        self.memo = Memo(self._encode_keys)

    def _encode_keys(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode([k[1:] if k[:1] == " " else " " + k for k in keys])

    def _keys(self, text: str) -> list[str]:
        if not self.special or self.special not in text:
            first, *rest = text.split(" ")
            if "" not in rest and not any(map(str.isspace, {k[0] for k in rest})):
                return [" " + first, *rest]
        return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else " " + c for c in chunks_of(text, self.special)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many belong to each text."""
        split = [self._keys(x) for x in texts]
        ids, lengths = self.memo(list(chain.from_iterable(split)))
        return ids, per_group(lengths, list(map(len, split)))


def grouped(texts: list[str | None], special: str | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and segments in groups of about SEGMENT_CHARS characters; a null text is empty."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in segments(text or "", special):
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size >= SEGMENT_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts
