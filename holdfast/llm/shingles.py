"""Sets of hashed word shingles, computed for many texts at once in numpy.

A-Z is lower-cased and words are runs of bytes other than ASCII white space. A word's hash is a polynomial
over its bytes, read off prefix sums of the whole buffer, then mixed; a shingle's hash combines its words'
hashes in order. Two different shingles share one of the 64-bit hashes with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MULT = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Texts are joined into buffers of about this many bytes.
BUFFER = 1 << 20

with np.errstate(over="ignore"):
    _rng = np.random.Generator(np.random.PCG64(20240607))
    _BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    _BYTE[65:91] = _BYTE[97:123]
    _PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
BYTE_VALUES = _BYTE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= _MULT[0]
    x ^= x >> U(27)
    x *= _MULT[1]
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those for up to twice BUFFER are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * BUFFER), U(base))
        steps[0] = U(1)
        have = np.cumprod(steps)
        if n <= 2 * BUFFER:
            _POWERS[base] = have
    return have[:n]


def _pieces(raw: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about BUFFER bytes that end at white space; only a longer word makes a longer piece."""
    at = 0
    while len(raw) - at > BUFFER:
        end = at + BUFFER
        while end < len(raw) and not space[raw[end]]:
            inner = np.flatnonzero(space[raw[end : end + BUFFER]])
            end = end + int(inner[0]) if len(inner) else min(end + BUFFER, len(raw))
        yield at, end
        at = end
    yield at, len(raw)


def word_hashes(
    buffer: bytes, space: np.ndarray = _SPACE, values: np.ndarray = _BYTE, prefix: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start offset) of each word of a buffer, or of its first ``prefix`` bytes.

    ``space`` says which bytes part words; ``values`` gives each other byte its value.
    """
    raw = np.frombuffer(buffer, np.uint8)
    if len(raw) <= 2 * BUFFER:
        return _word_hashes(raw, space, values, prefix)
    parts = [(a, *_word_hashes(raw[a:b], space, values, prefix)) for a, b in _pieces(raw, space)]
    return np.concatenate([h for _, h, _ in parts]), np.concatenate([a + starts for a, _, starts in parts])


def _word_hashes(
    raw: np.ndarray, space: np.ndarray, values: np.ndarray, prefix: int | None
) -> tuple[np.ndarray, np.ndarray]:
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[raw], out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) > BUFFER:
            yield from _sets(group, width)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from _sets(group, width)


def _sets(group: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, starts = word_hashes(b"\n".join(group))
    edges = np.searchsorted(starts, np.cumsum([0, *(len(g) + 1 for g in group)])).tolist()
    n = len(words) - width + 1
    if n > 0:
        value = words[:n] * _PLACE[0]
        for k in range(1, width):
            value += words[k : n + k] * _PLACE[k]
        value = mix(value)
    for a, b in zip(edges, edges[1:]):
        if b - a >= width:
            yield np.unique(value[a : b - width + 1])
        elif b > a:
            tail = (words[a:b] * _PLACE[32 : 32 + b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mix(tail + U(b - a))
        else:
            yield np.empty(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set, signed as Spark's long."""
    total = mix(tokens ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * U(0x2545F4914F6CDD1D) + U(len(tokens))).view(np.int64)[0])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
