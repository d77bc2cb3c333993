"""numpy kernels over Arrow text: tokens, token hashes, shingles and SuperMinHash.

Texts are read from the Arrow buffers as UTF-8 bytes without a copy a text. All hashes are
64-bit and the same on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_GOLD, _BASE, _STEP = _U(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D, _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = mix64(_LOWER.astype(_U) * _GOLD + _U(1))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, _U(b))
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def pieces(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts' words): runs of bytes that are not ASCII white space, A-Z lower-cased."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cut = off[(off > 0) & (off < n)]
    begins[cut] = word[cut]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p, inv = _powers(n + 1)
    h = np.zeros(n + 1, _U)
    np.cumsum(_VALUE[data] * p[:n], out=h[1:])
    return mix64((h[e] - h[s]) * inv[s] + (e - s).astype(_U)), np.searchsorted(s, off)


def shingles(tok: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; fewer words than ``width`` are one shingle, none give none."""
    n = len(tok)
    roll = np.zeros(max(0, n - width + 1), _U)
    for k in range(width):
        roll = roll * _STEP + tok[k : k + len(roll)]
    roll = mix64(roll + _U(width))
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(roll[a : b - width + 1]))
        elif b > a:
            x = _U(0)
            with np.errstate(over="ignore"):
                for t in tok[a:b]:
                    x = x * _STEP + t
            out.append(mix64(np.array([x]) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl, 2017), one row of m values a set; all ones for an empty set.

    Element e draws, in round j, a uniform r_j and the next position of its own random permutation,
    and offers j + r_j there; a slot keeps the least offer. Ranks of one element never meet in a
    slot, which is what lowers the variance. A set is done after round j once all its slots are
    below j + 1: no later round can lower any. The permutation is not stored: a position is
    traced back through the swaps of earlier rounds, of which most sets need few.
    """
    d = len(sets)
    el = np.concatenate(sets) if d else np.zeros(0, _U)
    doc = np.repeat(np.arange(d), [len(x) for x in sets])
    h = np.full(d * m, ~_U(0))
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(el):
            break
        x = mix64(el + _U(j + 1) * _GOLD if j < 1 else el + np.array(j + 1, _U) * _GOLD)
        at = (_U(j) + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32))).astype(np.int32)
        pos = at
        for t in range(j - 1, -1, -1):
            pos = np.where(pos == swaps[t], t, pos)
        np.minimum.at(h, doc * m + pos, (_U(j) << _U(32)) | (x >> _U(32)))
        done = h.reshape(d, m).max(1) < (_U(j + 1) << _U(32))
        left = ~done[doc]
        el, doc = el[left], doc[left]
        swaps = [s[left] for s in [*swaps, at]]
    return h.reshape(d, m)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` signature values; the band's number is part of the key."""
    d, m = sig.shape
    s = sig.reshape(d, m // rows, rows)
    out = np.zeros(s.shape[:2], _U)
    for k in range(rows):
        out = out * _STEP + s[:, :, k]
    return mix64(mix64(out) + np.arange(m // rows, dtype=_U) * _GOLD)


def set_digest(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed integers."""
    a, b = mix64(x + _GOLD).sum(dtype=_U), mix64(x ^ _STEP).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
