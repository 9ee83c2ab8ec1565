"""Suffixes sorted by bucket-pointer refinement, of bytes or of words, inside a task."""

from __future__ import annotations

import numpy as np

#: A pass of refinement moves the pointers after each of so many parts of the buckets.
STEPS = 16


def suffix_order(grams: tuple[np.ndarray, ...], left: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes, sorted, and of each place its bucket pointer: the last slot of its bucket.

    ``grams`` order the suffixes by their first ``depth`` symbols, the last array first; ``left``: symbols
    to the end of the suffix's part. Buckets are refined until they agree in ``width`` symbols or up to
    the end; an end comes before all symbols. A pass sorts each bucket of several suffixes by the
    pointers at the offset that they all agree up to, and moves its pointers at once: the buckets after
    it in the pass are split by these, so they often get deeper than the doubled offset and seldom
    come again. Suffixes in different buckets may thus agree in ``width`` symbols; they are neighbours.
    """
    n = len(left)
    order = np.lexsort(grams) if len(grams) > 1 else np.argsort(grams[0])
    last = np.flatnonzero(np.append(np.any([g[order[1:]] != g[order[:-1]] for g in grams], 0), True)[:n])
    size = np.diff(last, prepend=-1)
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(last, size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while depth < width and len(slots := slots[left[order[slots]] >= depth]):
        heads = np.flatnonzero(np.diff(pointer[order[slots]], prepend=-1))
        cuts = heads[np.searchsorted(heads, np.arange(1, STEPS) * len(slots) // STEPS, "right") - 1]
        rest = []
        for some in np.split(slots, np.unique(cuts)):
            at = order[some]
            later = np.where(left[at] > depth, pointer[np.minimum(at + depth, n - 1)], -1)
            pair = pointer[at] * np.int64(n + 1) + later + 1
            by = np.argsort(pair)
            at, pair = at[by], pair[by]
            order[some] = at
            last = np.flatnonzero(np.append(pair[1:] != pair[:-1], True)[: len(pair)])
            size = np.diff(last, prepend=-1)
            pointer[at] = np.repeat(some[last], size)
            rest.append(some[np.repeat(size > 1, size)])
        slots, depth = np.concatenate(rest), 2 * depth
    return order, pointer
