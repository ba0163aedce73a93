"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd

WIDTH = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)``: the distinct shingles of each text, by position of the text and then rising.

    A-Z are lower-cased; words are runs without ASCII white space, which is what
    ``bytes.split`` yields. Texts of fewer than five words are one shingle.
    """
    split = [(text or "").encode("utf-8", "replace").lower().split() for text in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [word for words in split for word in words]
    hashed = pd.util.hash_array(flat, categorize=False)
    doc = np.repeat(np.arange(len(split)), sizes)
    n = max(0, len(hashed) - WIDTH + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        rolled = rolled * _FACTOR + _mixed(hashed[j : j + n])
    inside = doc[:n] == doc[WIDTH - 1 :] if n else np.empty(0, bool)
    docs, hashes = [doc[:n][inside]], [_mixed(rolled[inside])]
    ends = np.cumsum(sizes)
    few = np.flatnonzero((sizes > 0) & (sizes < WIDTH))
    for d in few:
        one = sizes[d : d + 1].astype(np.uint64)
        for j in range(ends[d] - sizes[d], ends[d]):
            one = one * _FACTOR + _mixed(hashed[j : j + 1])
        docs.append(np.array([d]))
        hashes.append(_mixed(one))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[first], value[first]
