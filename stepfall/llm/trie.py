"""Prefix trees of sorted sets and the search for similar sets in them.

Sets are arrays in one global order, so sets with a common beginning share a path.
A tree is kept as its leaves in depth-first order with the depth each shares with
the one before; walking the leaves in that order visits every branch once.
"""

from __future__ import annotations

import numpy as np

STEP = 64


def overlap_needed(n: int, m: int) -> int:
    """Smallest intersection of sets of these sizes for which 100 * intersection >= 80 * union."""
    return -(-4 * (n + m) // 9)


def lengths_fit(n: int, m: int) -> bool:
    return 5 * min(n, m) >= 4 * max(n, m)


class Trie:
    """``sets`` hold the elements that can be shared at all; ``sizes`` count the whole sets."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.names = order
        self.sets = [sets[i] for i in order]
        self.sizes = [sizes[i] for i in order]
        self.depths = [0] * len(order)
        for i in range(1, len(order)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.depths[i] = int(differ[0]) if len(differ) else n

    def similar(self, probe: np.ndarray, size: int, skip: set[int] | None = None) -> list[int]:
        """Names of the sets similar to ``probe`` (a set of ``size`` elements), but for those in ``skip``.

        ``shared[d]`` is the overlap of the path down to depth d; the part of the path
        in common with the leaf before is not compared again. Below depth d at most
        as many more can be shared as the leaf has left, or the probe has left.
        """
        found: list[int] = []
        padded = np.append(probe, -1)
        shared, passed = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i, (name, items, n) in enumerate(zip(self.names, self.sets, self.sizes, strict=True)):
            at = min(self.depths[i], len(shared) - 1)
            shared, passed = shared[: at + 1], passed[: at + 1]
            if (skip and name in skip) or not lengths_fit(n, size):
                continue
            need = overlap_needed(n, size)
            step = STEP
            while at < len(items) and shared[at] + min(len(items) - at, len(probe) - passed[at]) >= need:
                part = items[at : at + step]
                places = np.searchsorted(probe, part)
                hits = padded[places] == part
                shared = np.concatenate([shared, shared[at] + np.cumsum(hits)])
                passed = np.concatenate([passed, places + hits])
                at += len(part)
                step *= 2
            if at >= len(items) and shared[at] >= need:
                found.append(name)
        return found
