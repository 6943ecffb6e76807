"""Multikey three-way quicksort of pointers, all open partitions of a round at once."""

from __future__ import annotations

import numpy as np


def frequent_prefixes(keys: list[np.ndarray], weights: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth d: a pointer to every distinct prefix of d + 1 keys whose rows weigh `least` or more
    together, and that weight. keys: one array a depth, keys[d][i] the key of row i; key 0 is an end, which
    is neither counted nor followed beyond the first depth.

    A partition is split by its middle pointer's key at the partition's depth into less, equal and greater.
    The equal part is a prefix: its size is the prefix's count, and it goes on at the next depth. A part that
    weighs less than `least` is abandoned, for no prefix in it can reach that.
    """
    n, flat = len(weights), np.concatenate(keys)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in keys]
    cells = np.arange(n, dtype=np.int64)  # a pointer's key: depth * n + row
    starts, depths = np.zeros(1, np.int64), np.zeros(1, np.int64)
    if not n or int(weights.sum()) < least:
        cells = cells[:0]
    while len(cells):
        sizes = np.diff(starts, append=len(cells))
        of = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        value = flat[cells]
        pivot = value[starts + sizes // 2]
        against = np.repeat(pivot, sizes)
        low, high = value < against, value > against
        parts = [np.flatnonzero(x) for x in (low, ~(low | high), high)]
        part = np.concatenate(parts)
        side = np.repeat(np.arange(3, dtype=np.int32), [len(p) for p in parts])
        code = of[part] * np.int32(3) + side
        order = np.argsort(code, kind="stable")
        cells, code = cells[part[order]], code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sizes = np.diff(starts, append=len(cells))
        sums = np.add.reduceat(weights[cells % n], starts)
        was, equal = code[starts] // 3, code[starts] % 3 == 1
        depth = depths[was]
        keep = (sums >= least) & ~(equal & (pivot[was] == 0) & (depth > 0))
        for d in range(len(keys)):
            at = keep & equal & (depth == d)
            if at.any():
                found[d].append((cells[starts[at]] % n, sums[at]))
        keep &= depth + equal < len(keys)
        cells = (cells + np.repeat(np.where(equal, n, 0), sizes))[np.repeat(keep, sizes)]
        depths, sizes = (depth + equal)[keep], sizes[keep]
        starts = np.cumsum(sizes) - sizes
    empty = (np.empty(0, np.int64), np.empty(0, np.int64))
    return [tuple(np.concatenate(x) for x in zip(*parts)) if parts else empty for parts in found]
