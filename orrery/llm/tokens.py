"""Tokens of many texts at once, as numpy arrays.

Texts are joined as UTF-8 bytes; a token is a run of letters, of digits or of other marks
(bytes from 128 up count as letters).  Hashes come from one running sum over the bytes: a
token's is the difference of two sums, moved to position zero, so nothing is done for each
token in Python.  A text longer than ``SEGMENT_BYTES`` is worked on in parts, which bounds the
memory by the segment and not by the text.  Parts never end inside a token: a run of more
than ``TOKEN_BYTES`` is tokens of that length from its start on, wherever the parts lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEGMENT_BYTES = 1_000_000
TOKEN_BYTES = 4096
SPACE, LETTER, DIGIT, MARK = range(4)
_KIND = np.array([SPACE if b <= 32 or b == 127 else LETTER if b >= 128 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        table = np.full(n, np.uint64(base), np.uint64)
        table[0] = 1
        have = _powers[name] = np.multiply.accumulate(table)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Segment:
    """Tokens of one segment: their text's index, kind, bytes and hash."""

    doc: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of byte ranges, the same wherever the bytes stand."""
        h = (self.sums[end] - self.sums[start]) * _power("inverse", _INVERSE, len(self.sums))[start]
        return mixed(h + np.uint64(salt))

    def where(self, keep: np.ndarray) -> Segment:
        return Segment(self.doc[keep], self.kind[keep], self.start[keep], self.end[keep], self.data, self.sums)


def _parts(blob: bytes) -> Iterator[bytes]:
    at = 0
    while len(blob) - at > SEGMENT_BYTES:
        end = at + SEGMENT_BYTES
        cut = max(blob.rfind(b" ", at, end), blob.rfind(b"\n", at, end))
        if cut <= at:  # no white space: after the last whole token
            kind = _KIND[np.frombuffer(blob, np.uint8, SEGMENT_BYTES, at)]
            edge = np.flatnonzero(kind[1:] != kind[:-1])
            last = int(edge[-1]) + 1 if len(edge) else 0
            cut = at + last + (SEGMENT_BYTES - last) // TOKEN_BYTES * TOKEN_BYTES
        yield blob[at:cut]
        at = cut
    yield blob[at:] if at else blob


def segments(texts: list[str | None]) -> Iterator[Segment]:
    """All tokens of all texts; null texts have none."""
    held, docs, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _parts((text or "").encode()):
            if held and size + len(part) > SEGMENT_BYTES:
                yield _segment(held, docs)
                held, docs, size = [], [], 0
            held.append(part), docs.append(i)
            size += len(part) + 1
    if held:
        yield _segment(held, docs)


def _segment(parts: list[bytes], docs: list[int]) -> Segment:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _KIND[data]
    edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]])
    start, end = edge[:-1], edge[1:]
    real = kind[start] != SPACE
    start, end = start[real], end[real]
    if len(start) and (end - start).max() > TOKEN_BYTES:
        pieces = -(-(end - start) // TOKEN_BYTES)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end = np.repeat(start, pieces) + nth * TOKEN_BYTES, np.repeat(end, pieces)
        end = np.minimum(end, start + TOKEN_BYTES)
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    doc = np.array(docs)[np.searchsorted(first, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _power("forward", _BASE, max(len(data), SEGMENT_BYTES + 64))[: len(data)], out=sums[1:])
    return Segment(doc, kind[start], start, end, data, sums)
