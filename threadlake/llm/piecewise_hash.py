"""Context-triggered piecewise hashes (Kornblum, "Identifying almost identical files", 2006).

A rolling hash over the last seven bytes ends a piece wherever its lowest bits are zero,
so the ends depend on the bytes around them alone and an edit changes only the pieces
it touches.  The number of bits gives the block size, the mean length of a piece: the
smallest one is taken that cuts the whole text into at most 64 pieces, and the
fingerprint holds the signatures of that block size and of its double.  Two fingerprints
with a block size in common are compared by the edit distance of these signatures.

A text that repeats one short phrase has only few different places, so it may end up with
a single piece; such a text is like its exact copies alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes that decide on an end, the smallest block size as a power of two, the most pieces.
WINDOW, LEAST_BITS, PIECES = 7, 2, 64
#: Two of these letters stand for a piece.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_ROLL, _MIX, _BASE = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), 0x5851F42D4C957F2D
_PAIRS = [a + b for a in LETTERS for b in LETTERS]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_ROLLS = _powers(_ROLL, WINDOW)
#: Powers of the base and of its inverse for most texts; longer ones make their own.
_READY = 1 << 17
_UP, _DOWN = _powers(_BASE, _READY), _powers(pow(_BASE, -1, 1 << 64), _READY)


def _ends(content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a piece may end, and up to how many bits it does."""
    rolling = content.copy()
    for back in range(1, min(WINDOW, len(content))):
        rolling[back:] += content[:-back] * _ROLLS[back]
    rolling ^= rolling >> np.uint64(29)
    rolling *= _MIX
    rolling ^= rolling >> np.uint64(32)
    at = np.flatnonzero(rolling & np.uint64((1 << LEAST_BITS) - 1) == 0)
    lowest = rolling[at]
    lowest &= ~lowest + np.uint64(1)
    bits = np.full(len(at), 63, np.int64)
    some = lowest > 0
    bits[some] = np.log2(lowest[some].astype(np.float64)).astype(np.int64)
    return at + 1, bits


def _signature(sums: np.ndarray, down: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate(([0], ends[:-1]))
    pieces = (sums[ends] - sums[starts]) * down[starts]
    pieces ^= pieces >> np.uint64(31)
    pieces *= _MIX
    return "".join([_PAIRS[p] for p in (pieces >> np.uint64(52)).tolist()])


def fingerprint(text: bytes) -> str:
    """``block size:signature:signature of twice the block size`` of a whole text."""
    n = len(text)
    if not n:
        return f"{1 << LEAST_BITS}::"
    # Zero bytes count, too.
    content = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    at, bits = _ends(content)
    inner = at < n
    at, bits = at[inner], bits[inner]
    # Ends of at least k bits, for each k.
    enough = np.cumsum(np.bincount(bits, minlength=66)[::-1])[::-1]
    size = LEAST_BITS + int(np.argmax(enough[LEAST_BITS:] < PIECES))
    up, down = (_UP, _DOWN) if n < _READY else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(content * up[:n], out=sums[1:])
    one, two = (_signature(sums, down, np.append(at[bits >= k], n)) for k in (size, size + 1))
    return f"{1 << size}:{one}:{two}"


def edit_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Fewest insertions, deletions and replacements (Myers' bit vectors)."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    if not a or not b or set(a).isdisjoint(b):
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = mask, 0, len(a)
    for y in b:
        equal = places.get(y, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        more = minus | (~(across | plus) & mask)
        less = plus & across
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
        more = (more << 1 | 1) & mask
        less = (less << 1) & mask
        plus = less | (~(down | more) & mask)
        minus = more & down
    return distance


def _signatures(mark: str) -> dict[int, list[str]]:
    size, one, two = mark.split(":")
    return {
        int(size): [one[i : i + 2] for i in range(0, len(one), 2)],
        2 * int(size): [two[i : i + 2] for i in range(0, len(two), 2)],
    }


def likeness(a: str, b: str) -> float:
    """From 0, nothing in common, to 1, for fingerprints that are equal.

    The greatest part of a signature's pieces that edits leave alone, over the block sizes
    that both have; 0 where they have none.
    """
    if a == b:
        return 1.0
    ours, theirs = _signatures(a), _signatures(b)
    best = 0.0
    for size in ours.keys() & theirs.keys():
        longest = max(len(ours[size]), len(theirs[size]))
        if longest:
            best = max(best, 1 - edit_distance(ours[size], theirs[size]) / longest)
    return best
