"""Vectorised splitting and hashing of many texts at once: numpy passes over the UTF-8 bytes of a batch.

All hashes are 64 bits wide. A span is hashed eight bytes at a time, each step finished by a bit mixer, and sequences of
words are hashed as a tree of mixed pairs; a span of many bytes is hashed by BLAKE2b. None is a polynomial modulo a power of
two, so self-similar texts (Thue-Morse words, say) do not collide. Equal sequences have equal hashes; different ones collide
with a chance of about 2**-64 a pair. Where that is not enough, two hashes of different ``salt`` make 128 bits.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
STEP_BYTES = 4 << 20
#: Longer spans are hashed by BLAKE2b, one call each.
LONG_SPAN = 256

_K = np.uint64(0x9E3779B97F4A7C15)
_SIZES = np.uint64(0x632BE59BD9B4E019)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the sequences a b, from the hashes of a and of b."""
    return mixed(a * _K + b)


def table_of(keep) -> np.ndarray:
    """256 booleans, true for the byte values that ``keep`` accepts."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Everything but tab, line feed, vertical tab, form feed, carriage return and space.
NOT_SPACE = table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII digits, lower-case letters and every byte of a non-ASCII character.
WORD_BYTES = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its texts; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about ``step_bytes``."""
    data, off = text_buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + step_bytes, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``off`` (n+1 word offsets of the texts)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray = NOT_SPACE):
        self.data, self.byte_off = data, off
        n = len(data)
        m = inside[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = m[:-1], m[1:]
        cut = off[(off > 0) & (off < n)]
        before[cut] = False
        after[cut - 1] = False
        self.inside = m
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.off = np.searchsorted(self.start, off)
        self._eights: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def span_hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of byte spans; the length is mixed in."""
        if self._eights is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eights = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
        size = end - start
        out = mixed(size.astype(np.uint64) * _SIZES + np.uint64(salt))
        at = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        place, left, h = start[at], size[at], out[at]
        while len(at):
            h = paired(h, self._eights[place] & _LOW_BYTES[np.minimum(left, 8)])
            more = left > 8
            done = ~more
            out[at[done]] = h[done]
            at, place, left, h = at[more], place[more] + 8, left[more] - 8, h[more]
        for k in np.flatnonzero(size > LONG_SPAN).tolist():
            digest = blake2b(self.data[start[k] : end[k]], digest_size=8, salt=salt.to_bytes(8, "little")).digest()
            out[k] = int.from_bytes(digest, "little")
        return out

    def hashes(self, salt: int = 0) -> np.ndarray:
        return self.span_hash(self.start, self.end, salt)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] for every i (as if one text); len(h)-width+1 values, or none.

    Hashes of 1, 2, 4, ... values are paired up; the powers of two that make up ``width`` are then put together.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if width & size:
            part = power[done : done + n]
            out = part if out is None else paired(out, part)
            done += size
        if 2 * size > width:
            return out
        power = paired(power[:-size], power[size:])
        size *= 2


def whole(off: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each of the windows i of ``rolling``: whether it lies within one text."""
    if n < width:
        return np.zeros(0, bool)
    ends = np.repeat(off[1:], np.diff(off))
    return np.arange(n - width + 1) + width <= ends[: n - width + 1]


def found_twice(keys: np.ndarray) -> np.ndarray:
    """True where the value occurs at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """True where an earlier position has the same value."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    if len(keys):
        out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """n booleans: positions within ``width`` of a true start."""
    at = np.flatnonzero(starts)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
