"""Order statistics on numpy arrays: rank counts by merging sorted runs."""

from __future__ import annotations

import numpy as np


def codes(values: np.ndarray) -> np.ndarray:
    """Dense ranks; equal values have one, NaN is the largest."""
    return np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _across(points: np.ndarray, there: np.ndarray, asks: np.ndarray, asked: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each index that is asked: the points there are at smaller indices (larger ones if not ``before``) that are less than its ask, and that are equal.

    Indices are cut into runs of 1, 2, 4, ...; at each level the asks of a run are ranked in its sorted sibling, so each
    pair of indices is counted once.
    """
    less, same = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    top = int(max(points.max(initial=0), asks.max(initial=0))) + 1
    at, run = np.arange(len(points)), 1
    while run < len(points):
        block = at // run
        held = np.sort(block[there] * top + points[there])
        wanted = at[asked & (block % 2 == int(before))]
        sibling = (block[wanted] + (-1 if before else 1)) * top
        low = np.searchsorted(held, sibling + asks[wanted])
        less[wanted] += low - np.searchsorted(held, sibling)
        same[wanted] += np.searchsorted(held, sibling + asks[wanted], side="right") - low
        run *= 2
    return less, same


def trailing_counts(before: np.ndarray, own: np.ndarray, before_there: np.ndarray, own_there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value of ``own``, a block of at most n: how many of the last n values, itself included, are less, equal, and there at all.

    ``before`` is the block of n values in front of it, or empty for the first block. Values that are not there count nowhere.
    """
    n, m = len(own), len(before)
    both = codes(np.concatenate((before, own)))
    old, new = both[:m], both[m:]
    less, same = _across(new, own_there, new, own_there, True)
    same, full = same + own_there, np.cumsum(own_there)
    if m:  # of the block before, what stands behind the same place
        asks, asked = np.zeros(m, np.int64), np.zeros(m, dtype=bool)
        asks[:n], asked[:n] = new, own_there
        more, ties = _across(old, before_there, asks, asked, False)
        less, same = less + more[:n], same + ties[:n]
        full = full + before_there.sum() - np.cumsum(before_there)[:n]
    return less, same, full
