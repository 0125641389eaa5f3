"""Simple-8b: varying counts of integers packed in 64-bit words, coded and decoded with array operations.

A word's top four bits are its selector. Selectors 0 to 13 say how many values of how many bits follow in
the low 60 bits, lowest first; ESCAPE says that the next word holds one value of 64 bits. Values are coded in
blocks of BLOCK, each of which starts a new word, so a block is decoded without those before it.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: count and bits for each selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // n for n in COUNTS)
ESCAPE = 14
_U = np.uint64
_STEPS = np.array([*COUNTS, 1], np.int64)


def _needs(v: np.ndarray) -> np.ndarray:
    """The least width of BITS that holds each value; 255 where none does."""
    widths = sorted(set(BITS))
    if int(v.max(initial=0)) < 1 << 16:
        return _NEEDS_16[v.astype(np.uint16)]
    need = np.full(v.shape, widths[0], np.uint8)
    for low, high in zip(widths, [*widths[1:], 255]):
        need[v >= _U(1 << low)] = high
    return need


def _small_needs() -> np.ndarray:
    need = np.empty(1 << 16, np.uint8)
    for b in sorted(set(BITS), reverse=True):
        need[: 1 << min(b, 16)] = b
    return need


_NEEDS_16 = _small_needs()
#: Blocks coded at once.
_SLAB = 256


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the words of all blocks, and each block's first word with the end added."""
    values = np.ascontiguousarray(values, _U)
    words, offsets = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
    for i in range(0, len(values), _SLAB * BLOCK):
        w, o = _encode_slab(values[i : i + _SLAB * BLOCK])
        words.append(w)
        offsets.append(o[1:] + offsets[-1][-1])
    return np.concatenate(words), np.concatenate(offsets)


def _encode_slab(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, most = len(values), max(COUNTS)
    blocks = -(-n // BLOCK)
    width = BLOCK + most
    v = np.zeros((blocks, width), _U)
    whole = n // BLOCK
    v[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        v[whole, : n - whole * BLOCK] = values[whole * BLOCK :]
    need = _needs(v)
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    span, have = need, 1  # the largest need of have values from each place on
    for s in range(len(COUNTS) - 1, -1, -1):  # from one value a word to sixty: the last that fits is the densest
        c = COUNTS[s]
        while have < c:
            grow = min(have, c - have)
            span = np.maximum(span[:, :-grow], span[:, grow:])
            have += grow
        fits = span[:, :BLOCK] <= BITS[s]
        if not fits.any():
            break
        choice[fits] = s
    step = _STEPS[choice].ravel()
    limit = np.arange(blocks) * BLOCK + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    at = np.arange(blocks) * BLOCK
    mark = np.zeros(blocks * BLOCK, bool)
    while len(at):
        mark[at] = True
        at = at + step[at]
        ok = at < limit
        if not ok.all():
            at, limit = at[ok], limit[ok]
    places = np.flatnonzero(mark)
    lanes = places // BLOCK
    kind = choice.ravel()[places]
    size = 1 + (kind == ESCAPE).astype(np.int64)
    first = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), _U)
    flat = v.ravel()
    source = places + lanes * most
    for s in np.unique(kind):
        pick = np.flatnonzero(kind == s)
        r, to = source[pick], first[pick]
        if s == ESCAPE:
            words[to] = _U(ESCAPE) << _U(60)
            words[to + 1] = flat[r]
            continue
        w = np.full(len(r), _U(int(s)) << _U(60))
        for k in range(COUNTS[s]):
            w |= flat[r + k] << _U(k * BITS[s])
        words[to] = w
    sizes = np.bincount(lanes, weights=size, minlength=blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(sizes)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of consecutive blocks; offsets as encode gives them, relative to words."""
    words = np.asarray(words, _U)
    blocks = len(offsets) - 1
    if not n:
        return np.zeros(0, _U)
    head = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that are an escaped value, not a word of their own
    marks = np.flatnonzero(head >= ESCAPE)
    skip = -1
    for m in marks:  # an escaped value's top bits may look like a mark
        if m != skip:
            raw[m + 1] = True
            skip = m + 1
    own = np.flatnonzero(~raw)
    kind = head[own]
    count = np.array([*COUNTS, 1, 1], np.int64)[kind]
    block = np.searchsorted(offsets, own, "right") - 1
    ends = np.cumsum(count)
    base = np.zeros(blocks, np.int64)
    firsts = np.searchsorted(own, offsets[:-1])
    base[:] = (ends - count)[firsts]
    place = block * BLOCK + (ends - count) - base[block]
    out = np.zeros(blocks * BLOCK + max(COUNTS), _U)
    for s in np.unique(kind):
        pick = kind == s
        w, p = words[own[pick]], place[pick]
        if s >= ESCAPE:
            out[p] = words[own[pick] + 1]
            continue
        mask = _U((1 << BITS[s]) - 1)
        room = (block[pick] + 1) * BLOCK
        for k in range(COUNTS[s]):
            q = p + k
            ok = q < room
            out[q[ok]] = (w[ok] >> _U(k * BITS[s])) & mask
    return out[:n]
