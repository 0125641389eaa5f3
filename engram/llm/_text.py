"""Vectorised word and shingle hashing over the bytes of Arrow string columns.

Word borders come from a byte mask; a word's hash mixes its length and then its bytes, eight at a time, each
through a bijection that is not linear, so a chunk of text costs a few array passes and repetitive words
are as unlikely to collide as any others. Words of more than LONG_WORD bytes, which are rare, take BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GRAM = U64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 64
#: Text bytes handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_SPACE = (~_IS_SPACE).astype(np.uint8).tobytes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so equal inputs and only those give equal outputs."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word; words of up to eight bytes and the same length never share them."""
    size = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))
    h = mix64(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
    h = mix64(h ^ (blocks[start] & _MASK[np.minimum(size, 8)]))
    more = np.flatnonzero(size > 8)
    for k in range(8, LONG_WORD, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        h[more] = mix64(h[more] ^ (blocks[start[more] + k] & _MASK[np.minimum(size[more] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].data, digest_size=8).digest(), "little")
    return h


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about limit bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of some documents, in order: byte span, hash, and each document's first word's index."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n documents + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words_of(raw: np.ndarray, off: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """raw holds the documents' bytes; off are their n+1 offsets in it."""
    if lower:
        raw = np.frombuffer(raw.tobytes().translate(_LOWER.tobytes()), np.uint8)
    n = len(raw)
    edge = np.zeros(n + 2, bool)
    edge[1:-1] = np.frombuffer(raw.tobytes().translate(_NOT_SPACE), bool)
    begins = edge[1:-1] & ~edge[:-2]
    ends = edge[1:-1] & ~edge[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = edge[1:-1][inner]
    ends[inner - 1] = edge[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off).astype(np.int64)
    if not hashed:
        return Words(raw, start, end, np.zeros(0, U64), first)
    return Words(raw, start, end, word_hashes(raw, start, end), first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes; the last k-1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix64(out * _GRAM + h[j : j + n])
    return out


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct k-word shingle hashes, and the n+1 offsets between documents.

    A document with fewer than k words has its whole sequence as the one shingle; without words, none.
    """
    g, sets = grams(w.hash, k), []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            sets.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            sets.append(grams(np.append(w.hash[a:b], U64(b - a)), int(b - a + 1)))
        else:
            sets.append(np.zeros(0, U64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])
