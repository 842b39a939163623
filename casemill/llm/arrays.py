"""Numpy helpers that run inside Spark tasks: tokens, rolling hashes and packed exchanges.

A text column arrives as Arrow batches.  `slices` cuts a batch into runs of whole documents of a few
MB, so that the arrays made from it stay small whatever the batch size; one document longer than the
limit is a slice of its own and is never cut.  Null texts count as empty.

Hashes have 64 bits and are equal on every machine and in every run.  A word is hashed by its eight-byte
pieces in turn, a window of words or bytes by doubling: from the hashes of its first and last 2**k parts,
each scrambled before they are put together.  So no sum of powers stands behind them that regular texts
could make equal.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE, _LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)
#: Longer words are hashed whole, one by one.
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _give_back() -> None:
    """Lets glibc return large freed arrays to the machine at once: a worker process lives on after its task, and would keep the most it ever held."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 256 << 10)  # arrays from this size on have pages of their own
        libc.mallopt(-1, 256 << 10)
    except (OSError, AttributeError):  # another C library
        pass


_give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return (a ^ (a >> U(32))) * _LEFT + (b ^ (b >> U(29))) * _RIGHT


def _times(k: int) -> np.uint64:
    return U(k * int(_BASE) & (1 << 64) - 1)


def window_hash(x: np.ndarray, k: int, unit: int = 1) -> np.ndarray:
    """Hash of the k parts from each place on, where x[i] is the hash of the `unit` parts from i on; k is unit at least."""
    n = len(x) + unit - k
    if n <= 0:
        return np.zeros(0, U)
    size = unit
    while 2 * size <= k:
        x = pair(x[:-size], x[size:])
        size *= 2
    return mix(pair(x[:n], x[k - size : k - size + n]) + _times(k))


def span_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray, unit: int = 1) -> np.ndarray:
    """window_hash of each [start, end), of `unit` parts at least."""
    n = end - start
    level = np.frexp(n / unit)[1] - 1
    out, size = np.zeros(len(n), U), unit
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            x = pair(x[:-size], x[size:])
            size *= 2
        at = np.flatnonzero(level == k)
        out[at] = mix(pair(x[start[at]], x[end[at] - size]) + n[at].astype(U) * _BASE)
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


@dataclass
class Slice:
    """Whole documents: rows [row0, row1) of the batch, their bytes, and each one's byte offsets."""

    row0: int
    row1: int
    data: np.ndarray
    off: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield Slice(row, last, data[off[row] : off[last]], off[row : last + 1] - off[row])
        row = last


@dataclass
class Tokens:
    """Words of a slice: byte spans, the document of each, and first[d] = index of d's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = self.end - self.start
        out = mix(n.astype(U) * _BASE)
        pieces, left = eights(self.data), np.flatnonzero(n <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            rest = n[left] - at
            piece = pieces[self.start[left] + at]
            piece = np.where(rest < 8, piece & ((U(1) << (U(8) * np.minimum(rest, 7).astype(U))) - U(1)), piece)
            out[left] = mix(out[left] * _LEFT + piece)
            left = left[rest > 8]
            if not len(left):
                break
        for i in np.flatnonzero(n > LONG_WORD):
            out[i] = int.from_bytes(blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def tokens(s: Slice, lower: bool = False) -> Tokens:
    """Maximal runs of bytes other than space and \\x09-\\x0D; no word crosses documents."""
    data = _LOWER[s.data] if lower else s.data
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[s.off] = True
    prev = np.concatenate([[False], word[:-1]]) if len(word) else word
    start = np.flatnonzero(word & (~prev | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(start, s.off)
    return Tokens(data, start, end, np.repeat(np.arange(len(s.off) - 1), np.diff(first)), first)


def byte_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on."""
    if k < 8:
        return mix((eights(data)[: max(len(data) - k + 1, 0)] & ((U(1) << U(8 * k)) - U(1))) + _times(k))
    return window_hash(mix(eights(data)[: max(len(data) - 7, 0)] + _BASE), k, 8)


def sampled_hashes(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each of a few places on, by eight-byte pieces in turn."""
    if k < 8:
        return byte_hashes(data, k)[at]
    pieces, out = eights(data), np.full(len(at), _times(k))
    for j in range(0, k, 8):
        out = pair(out, pieces[at + min(j, k - 8)])
    return mix(out)


def words_window(t: Tokens, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every window of k words inside one document."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - k + 1)
    at = at[t.doc[at] == t.doc[at + k - 1]]
    return at, window_hash(hashes, k)[at]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the n places that lie in any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def by_bucket(hashes: np.ndarray, buckets: int, order: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash and the bounds of each bucket: bucket b holds hashes with top bits b. buckets is a power of two."""
    at = np.argsort(hashes, kind="stable") if order else np.arange(len(hashes))
    shift = U(64 - (buckets.bit_length() - 1))
    top = hashes[at] >> shift if buckets > 1 else np.zeros(len(at), U)
    return at, np.searchsorted(top, np.arange(buckets + 1, dtype=U))


def pack(width: int, values: np.ndarray) -> bytes:
    """The top `width` bytes of each 64-bit value."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(width: int, blob: bytes) -> np.ndarray:
    n = len(blob) // width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(n, width)
    return wide.reshape(-1).view(">u8").astype(U)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the first one and the steps to the next, in as few bytes each as the longest step needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    rest = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[0])
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[1:, : blob[0]] = rest
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=U)


def pack_planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each whole number, all first bytes, then all second ones: high bytes are mostly zeros, which Spark's codecs make small."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_planes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches that are sorted by it; a group may span batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        k = t.column(key).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        for a, b in zip(cut[:-1], cut[1:]):
            yield t.slice(a, b - a)
        held = t.slice(cut[-1])
    if held is not None:
        yield held
