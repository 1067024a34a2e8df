"""Burrows-Wheeler transform and common prefixes of many short strings, column by column.

Every string gives one symbol in each round, from its last to its first. A round
takes the transform so far as one sequential file, finds the place of each new
suffix by counting the symbols before the place of the last one, and writes the
file anew with the new suffixes in place, their common prefixes with both
neighbours updated. No string is compared with another.
"""

from __future__ import annotations

import numpy as np

END = 0


def column_wise(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, string, length) over all suffixes, empty ones included, in sorted order.

    ``flat`` has the strings' symbols end to end, as numbers from 1 below 65536;
    END closes each string, and ends differ by the string's number. ``lcp`` counts
    symbols shared with the suffix before, ends not counted, and stops at 255.
    """
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes
    flat = np.append(flat, END).astype(np.uint16)
    at = np.arange(n)
    symbol = np.where(sizes > 0, flat[np.maximum(starts + sizes - 1, 0)], END).astype(np.uint16)
    bwt, lcp = symbol.copy(), np.zeros(n, dtype=np.uint8)
    string, length = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.uint8)
    active = np.flatnonzero(sizes > 0)
    for done in range(1, int(sizes.max(initial=0)) + 1):
        old = len(bwt)
        order = np.argsort(bwt, kind="stable")
        ends = old - int(np.count_nonzero(bwt))
        place = np.empty(old, dtype=np.int32)
        place[order] = np.arange(old, dtype=np.int32)
        # The first n places belong to the empty suffixes; END symbols of the transform lead nowhere.
        target = place[at[active]] - ends + n
        # Suffixes whose neighbour before may be new: the new ones and those after them.
        marked = np.zeros(old + 1, dtype=bool)
        marked[place[at[active]]] = True
        marked[place[at[active]] + 1] = True
        marked[:ends] = False
        turned = np.flatnonzero(marked[:old])
        here = order[turned]
        before = order[np.maximum(turned - 1, 0)]
        same = (turned > ends) & (bwt[before] == bwt[here])
        shared = np.zeros(len(turned), dtype=np.uint8)
        if same.any():
            low, high = before[same] + 1, here[same]
            back = np.argsort(-high, kind="stable")
            bounds = np.empty(2 * len(back), dtype=np.int64)
            bounds[0::2], bounds[1::2] = low[back], high[back] + 1
            least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), bounds)[0::2]
            got = np.empty(len(back), dtype=np.uint8)
            got[back] = np.minimum(least, 254) + 1
            shared[same] = got
        total = old + len(active)
        fresh = np.zeros(total, dtype=bool)
        fresh[target] = True
        kept = ~fresh
        following = starts[active] + sizes[active] - 1 - done
        symbol = np.where(sizes[active] > done, flat[np.maximum(following, 0)], END).astype(np.uint16)
        files = []
        for was, new in ((bwt, symbol), (lcp, None), (string, active), (length, done)):
            file = np.empty(total, dtype=was.dtype)
            file[kept] = was
            if new is not None:
                file[target] = new
            files.append(file)
        bwt, lcp, string, length = files
        lcp[turned - ends + n] = shared
        at[active] = target
        active = active[sizes[active] > done]
    return bwt, lcp, string, length


def of_bytes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as ``flat`` and ``sizes``: symbols are bytes plus one."""
    return np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 1, np.array([len(x) for x in strings], dtype=np.int64)


def least_owner(flat: np.ndarray, sizes: np.ndarray, owners: np.ndarray, depth: int) -> np.ndarray:
    """For each string's every start of a run of ``depth`` symbols, end to end: the least owner of a string with that run."""
    _, lcp, string, length = column_wise(flat, sizes)
    group = np.cumsum(lcp < depth) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    deep = np.flatnonzero(length >= depth)
    np.minimum.at(least, group[deep], owners[string[deep]])
    runs = np.maximum(sizes - depth + 1, 0)
    first = np.cumsum(runs) - runs
    out = np.empty(int(runs.sum()), dtype=np.int64)
    out[first[string[deep]] + sizes[string[deep]] - length[deep]] = least[group[deep]]
    return out
