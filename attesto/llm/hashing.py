"""Vectorised 64-bit hashes of words, lines, shingles and byte windows of UTF-8 buffers.

Words and lines are hashed lane by lane through bijections, so no structure of a text makes them collide. Windows of
bytes, for which prefix sums modulo 2**64 serve, may collide by their structure: these hashes only choose places, and
whoever takes them compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(7041)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(2**62, 2**63)) * 2 + 1
_P_INVERSE = pow(_P, -1, 2**64)
_C = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a long text whose sums are in memory at once.
SEGMENT = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(m, p, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums H with H[j] - H[i] = hash of data[i:j] times P**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = (_BYTE[_LOWER] if lower else _BYTE)[data]
    values *= powers(len(data))[0]
    np.cumsum(values, out=out[1:])
    return out


#: Bytes of a span that are mixed in 64-bit lanes, and spans in work at once; what is longer gets a BLAKE2 digest.
LANES, SPANS = 64 * 8, 1 << 16
_MASKS = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
_SEED = np.uint64(_rng.integers(1, 2**63))


def _digest(data: np.ndarray, lower: bool) -> int:
    found = hashlib.blake2b(digest_size=8)
    for a in range(0, len(data), SEGMENT):
        part = data[a : a + SEGMENT]
        found.update((_LOWER[part] if lower else part).tobytes())
    return int.from_bytes(found.digest(), "little")


def _lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Eight bytes at a time, each lane through a bijection: spans of one length up to eight bytes never collide, and longer
    ones as random numbers do. data goes on for 8 bytes after the last span."""
    at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = mix(sizes.astype(np.uint64) + _SEED)
    left = np.flatnonzero(sizes > 0)
    lane = 0
    while len(left):
        rest = sizes[left] - lane
        out[left] = mix(out[left] ^ (at[starts[left] + lane] & _MASKS[np.minimum(rest, 8)]))
        lane += 8
        left = left[rest > 8]
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of data[start:end] of spans in order that don't overlap; SEGMENT bytes or a few are in work at once."""
    out = np.zeros(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right"))), i + SPANS)
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= max(SEGMENT, LANES):
            part = np.zeros(b - a + 8, np.uint8)
            part[: b - a] = _LOWER[data[a:b]] if lower else data[a:b]
            sizes = ends[i:j] - starts[i:j]
            out[i:j] = _lanes(part, starts[i:j] - a, np.where(sizes > LANES, 0, sizes))
            for k in np.flatnonzero(sizes > LANES) + i:
                out[k] = _digest(data[starts[k] : ends[k]], lower)
        else:
            out[i] = _digest(data[a:b], lower)
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the text's number of each."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(data), SEGMENT):
        b = min(len(data), a + SEGMENT)
        inside = ~SPACE[data[max(0, a - 1) : b + 1]]  # with a neighbour on either side
        if a == 0:
            inside = np.concatenate(([False], inside))
        if b == len(data):
            inside = np.append(inside, False)
        own = inside[1:-1]
        before, after = inside[:-2].copy(), inside[2:].copy()
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        before[edges[edges < b - a]] = False
        after[edges[edges > 0] - 1] = False
        starts.append(np.flatnonzero(own & ~before) + a)
        ends.append(np.flatnonzero(own & ~after) + a + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def totals(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places of each text a mask of its bytes marks."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a in range(0, len(mask), SEGMENT):
        at = np.flatnonzero(mask[a : a + SEGMENT]) + a
        out += np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=len(out))
    return out


def combined(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size values that follow each position at."""
    out = np.full(len(at), size, np.uint64)
    for j in range(size):
        out += hashes[at + j] * _C[j]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted hashes; fewer words make one shingle, none the empty set."""
    starts, ends, doc = words(data, offsets)
    hashes = spans(data, starts, ends, lower)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    at = np.arange(max(0, len(doc) - size + 1))
    at = at[doc[at] == doc[at + size - 1]] if len(at) else at
    full = combined(hashes, at, size)
    bounds = np.searchsorted(at, first)
    for i in range(n):
        count = first[i + 1] - first[i]
        if count >= size:
            x = np.sort(full[bounds[i] : bounds[i + 1]])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif count:
            out.append(combined(hashes, first[i : i + 1], int(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
