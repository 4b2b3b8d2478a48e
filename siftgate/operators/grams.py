"""Many patterns at once on Arrow text buffers: packed and rolling k-gram hashes, vectorised.

UTF-8 texts are searched as bytes: a pattern's bytes occur only where its characters do.
At every byte the next 1 to ANCHOR bytes are packed into one integer, grown by a byte per
step for all positions of a chunk at once, and tested against a bit table of the patterns'
first bytes; what passes is looked up in a sorted table. A pattern no longer than that is
then found. For a longer one a rolling hash of its whole length, the difference of two
running sums, is looked up, and what passes is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

ANCHOR = 8
# Bytes searched at a time; the work arrays and the hits of a chunk are what a search holds.
CHUNK = 1 << 18
TABLE_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64; a process keeps the longest asked for."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.cumprod(out)  # wraps around at 2^64
    return _POWERS[base][:n]


def _slot(packed: np.ndarray) -> np.ndarray:
    return (packed * _SPREAD) >> np.uint64(64 - TABLE_BITS)


class GramTable:
    """A search table for distinct, non-empty patterns; it is small and pickled to the workers once."""

    def __init__(self, patterns: Sequence[str]):
        coded = [p.encode() for p in patterns]
        self.chars = np.array([len(p) for p in patterns], np.int64)
        self.bytes = np.array([len(c) for c in coded], np.int64)
        self.whole = {c: i for i, c in enumerate(coded)}
        self.steps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(len(c), ANCHOR) for c in coded}):
            firsts: dict[int, int] = {}
            for i, c in enumerate(coded):
                if min(len(c), ANCHOR) == length:
                    firsts.setdefault(int.from_bytes(c[:length], "big"), i)
            keys = np.array(sorted(firsts), np.uint64)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[_slot(keys)] = True
            self.steps[length] = (keys, np.array([firsts[int(k)] for k in keys], np.int64), table)
        # For each length of ANCHOR bytes and more: the patterns' anchors and their hashes.
        by_length: dict[int, list[int]] = {}
        anchors: dict[int, set[int]] = {}
        for c in coded:
            if len(c) >= ANCHOR:
                anchors.setdefault(len(c), set()).add(int.from_bytes(c[:ANCHOR], "big"))
                by_length.setdefault(len(c), []).append(self._hash(c))
        self.longer = {m: (np.array(sorted(anchors[m]), np.uint64), np.array(sorted(by_length[m]), np.uint64)) for m in sorted(anchors)}

    @staticmethod
    def _hash(c: bytes) -> int:
        b = np.frombuffer(c, np.uint8).astype(np.uint64) + np.uint64(1)
        return int((b * _powers(_BASE, len(b))).sum())

    def _chunk(self, raw: np.ndarray, start: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, patterns) of what begins in raw[start : start + n], also across the ends of texts."""
        b = np.zeros(n + ANCHOR, np.uint64)
        part = raw[start : start + n + ANCHOR]
        b[: len(part)] = part
        packed = b[:n].copy()
        for length in range(1, max(self.steps) + 1):
            if length > 1:
                packed <<= np.uint64(8)
                packed |= b[length - 1 : length - 1 + n]
            if length not in self.steps:
                continue
            keys, pattern, table = self.steps[length]
            at = np.flatnonzero(table[_slot(packed)])
            value = packed[at]
            place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = keys[place] == value
            at = at[hit]
            if length < ANCHOR:
                yield at + start, pattern[place[hit]]
                continue
            yield from self._long(raw, start, n, at + start, packed[at])

    def _long(self, raw: np.ndarray, start: int, n: int, at: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is found of the patterns of ANCHOR bytes and more, at places whose first bytes are an anchor."""
        if not len(at):
            return
        b = raw[start : start + n + max(self.longer)].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * _powers(_BASE, len(b)), out=sums[1:])
        back = _powers(_BASE_INVERSE, n)
        for m, (anchors, hashes) in self.longer.items():
            place = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
            some = at[(anchors[place] == anchor) & (at + m <= len(raw))] - start
            rolled = (sums[some + m] - sums[some]) * back[some]
            yield from self._whole(raw, some + start, rolled, m, hashes)

    def _whole(self, raw: np.ndarray, at: np.ndarray, rolled: np.ndarray, m: int, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
        at = at[hashes[place] == rolled]
        found = [self.whole.get(raw[i : i + m].tobytes(), -1) for i in at.tolist()]
        found = np.array(found, np.int64)
        yield at[found >= 0], found[found >= 0]

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pattern, place) of every occurrence, those that begin in one chunk of the texts' bytes at a time.

        Places are code points from 0. Null texts have none.
        """
        texts = texts.cast(pa.large_string()) if not pa.types.is_string(texts.type) else texts
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        if data is None or not len(texts) or not self.steps:
            return
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        valid = texts.is_valid().to_numpy(zero_copy_only=False) if texts.null_count else None
        # Code points of the open text that lie before the chunk.
        open_points = 0
        for start in range(0, len(raw), CHUNK):
            n = min(CHUNK, len(raw) - start)
            found = list(self._chunk(raw, start, n))
            at, pattern = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (np.empty(0, np.int64),) * 2
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + self.bytes[pattern] <= offsets[row + 1]
            if valid is not None:
                inside &= valid[row]
            at, pattern, row = at[inside], pattern[inside], row[inside]
            before = np.zeros(n + 1, np.int64)
            np.cumsum((raw[start : start + n] & 0xC0) != 0x80, out=before[1:])
            begin = offsets[row] - start
            place = before[at - start] - before[np.maximum(begin, 0)] + np.where(begin < 0, open_points, 0)
            if len(at):
                yield row, pattern, place
            last = int(np.searchsorted(offsets, start + n, "right")) - 1  # the text that goes on, if any does
            begin = int(offsets[last]) - start
            open_points = int(before[n] - before[max(begin, 0)]) + (open_points if begin < 0 else 0)

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pattern, place) of every occurrence."""
        found = list(self.parts(texts))
        return tuple(np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(3))

    def firsts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pattern, place) of the first occurrence of each pattern in each text, by row and pattern."""
        found = [_firsts(*part) for part in self.parts(texts)]
        return _firsts(*(np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(3)))


def _firsts(row: np.ndarray, pattern: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((place, pattern, row))
    row, pattern, place = row[order], pattern[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pattern[1:] != pattern[:-1])
    return row[new], pattern[new], place[new]
