"""Runs (maximal repetitions) of a sequence by Lyndon roots.

A run of period p has a Lyndon word of length p as its root, and that word is the
longest Lyndon word which starts where the root does, in one of two orders of the
alphabet: the given one or its reverse (Bannai et al., "The Runs Theorem", 2017).
So the lengths of the longest Lyndon words in both orders name every run.

Those lengths come from the first phase of Baier's suffix sorter ("Linear-time suffix
sorting", 2016).  It groups suffixes by their longest Lyndon prefix and needs no
suffix array: groups are taken from the highest to the lowest; each suffix of a group
points to the nearest suffix on its left that lies in a lower group, and the suffixes
pointed at move into a new group just above their own, whose context is theirs
followed by that of the group taken, as often as they were pointed at.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


def lyndon_lengths(symbols: Sequence[int]) -> list[int]:
    """The length of the longest Lyndon word starting at each place, by Baier grouping."""
    n = len(symbols)
    values = sorted(set(symbols))
    number = {v: g for g, v in enumerate(values)}
    # Suffixes are 1..n; 0 stands left of all and never moves.
    group_of = [-1, *map(number.__getitem__, symbols)]
    members: list[list[int]] = [[] for _ in values]
    for i in range(1, n + 1):
        members[group_of[i]].append(i)
    context = [1] * len(values)
    below = list(range(-1, len(values) - 1))
    above = [*range(1, len(values)), -1]
    # The nearest suffix to the left, itself included, that is still in a group to come.
    left = list(range(n + 1))
    lengths = [0] * (n + 1)

    group = len(values) - 1
    while group >= 0:
        length = context[group]
        taken = [i for i in members[group] if group_of[i] == group]
        members[group] = []
        for i in taken:
            lengths[i] = length
            left[i] = i - 1
        pointed: dict[int, int] = {}
        for i in taken:
            at = i
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            if at:
                pointed[at] = pointed.get(at, 0) + 1
        # The most often pointed at go highest: they are put above their group last.
        moved: dict[tuple[int, int], int] = {}
        order = pointed if len(set(pointed.values())) < 2 else sorted(pointed, key=pointed.__getitem__, reverse=True)
        for i in order:
            old, times = group_of[i], pointed[i]
            new = moved.get((old, times))
            if new is None:
                new = moved[old, times] = len(context)
                context.append(context[old] + times * length)
                members.append([])
                # Directly above the old group, below those with more pointers.
                higher = above[old]
                above.append(higher)
                below.append(old)
                above[old] = new
                if higher >= 0:
                    below[higher] = new
            group_of[i] = new
            members[new].append(i)
        group = below[group]
    return lengths[1:]


def _forward(ids: np.ndarray, a: int, b: int) -> int:
    """How many symbols from ``a`` on equal those from ``b`` on, ``a < b``."""
    done, step = 0, 16
    while b + done < len(ids):
        end = min(b + done + step, len(ids))
        unlike = np.flatnonzero(ids[a + done : a + end - b] != ids[b + done : end])
        if len(unlike):
            return done + int(unlike[0])
        done, step = end - b, step * 2
    return done


def _backward(ids: np.ndarray, a: int, b: int) -> int:
    """How many symbols before ``a`` equal those before ``b``, ``a < b``."""
    done, step = 0, 16
    while a - done > 0:
        size = min(step, a - done)
        unlike = np.flatnonzero(ids[a - done - size : a - done] != ids[b - done - size : b - done])
        if len(unlike):
            return done + size - 1 - int(unlike[-1])
        done, step = done + size, step * 2
    return done


def stretches(ids: np.ndarray, exponent: int, least: int) -> Iterable[tuple[int, int]]:
    """Places ``begin, end`` outside of which no run of the ``exponent`` and least length can be.

    The triples of symbols in such a run occur again a period later, so each of them
    occurs at least ``exponent - 1`` times in the sequence (a shorter count holds for
    short runs of one symbol).  A triple that occurs less often is in no run.
    """
    times = min(exponent - 1, max(least, exponent) - 2)
    if times < 2 or len(ids) < 3:
        return [(0, len(ids))] if len(ids) >= least else []
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    _, triples, counts = np.unique(
        pairs[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True
    )
    often = np.concatenate(([False], counts[triples] >= times, [False]))
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(int(b), int(e) + 2) for b, e in zip(edges[::2], edges[1::2]) if e + 2 - b >= least]


def runs(ids: np.ndarray, exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a length of ``least`` and ``exponent`` periods at least.

    Ordered by start, then period.  ``ids`` are numbers from 0 on, one for each
    distinct symbol; their order has no influence.  ``exponent`` is at least 2.
    """
    found: set[tuple[int, int, int]] = set()
    for begin, stop in stretches(ids, exponent, least):
        part = ids[begin:stop]
        for symbols in (part, -part):
            lengths = np.array(lyndon_lengths(symbols.tolist()), np.int64)
            at = np.flatnonzero(lengths <= len(part) // exponent)
            period = lengths[at]
            # A run holds exponent - 1 whole roots, one behind the other, so these begin alike.
            for k in range(1, exponent - 1):
                next_root = at + k * period
                alike = next_root < len(part)
                there = next_root[alike]
                alike[alike] = (lengths[there] == period[alike]) & (part[there] == part[at[alike]])
                at, period = at[alike], period[alike]
            # Where the last stretch of each period ends: roots inside of it lead to it again.
            reached: dict[int, int] = {}
            for i, p in zip((at + begin).tolist(), period.tolist()):
                if i + p <= reached.get(p, -1):
                    continue
                start = i - _backward(ids, i, i + p)
                end = i + p + _forward(ids, i, i + p)
                reached[p] = end
                if end - start >= max(least, exponent * p):
                    found.add((start, end - start, p))
    return sorted(found, key=lambda run: (run[0], run[2]))
