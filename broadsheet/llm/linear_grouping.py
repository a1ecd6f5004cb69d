"""Suffix array by grouping suffixes by their Lyndon prefixes.

Phase one keeps the suffixes in groups, at first by their first symbol, and visits the groups from the greatest down.  The
visited group is final: its suffixes share their longest Lyndon prefix.  Each of its suffixes looks for the nearest suffix
before it that stands in a smaller group, by following the pointers that visited suffixes have left; that suffix's prefix
grows by the visited group's, so it moves up within its own group, the further the more often it was reached.
Phase two emits the order: going up the array, the suffix before an emitted one, and those its pointers lead to, take the
next free place of their groups.  Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np


def suffix_array(text: bytes | np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text``, bytes or symbols numbered densely from 0, in ascending order."""
    n = len(text) + 1  # the empty suffix at the end is the least
    values = np.zeros(n, np.int32)
    values[:-1] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    values[:-1] += 1
    first_order = np.argsort(values, kind="stable")
    counts = np.bincount(values)
    starts = np.cumsum(counts) - counts
    order = first_order.tolist()
    place = np.empty(n, np.int64)
    place[first_order] = np.arange(n)
    place = place.tolist()
    link = starts[values].tolist()
    size = [1] * n
    for s, c in zip(starts.tolist(), counts.tolist()):
        if c:
            size[s] = c
    before = [-1] * n
    end = n
    while end:
        i = order[end - 1]
        start = link[i]
        if end - start == 1:  # most groups hold one suffix
            p = i - 1
            while p >= 0 and link[p] >= start:
                p = before[p]
            if p >= 0:
                before[i] = p
                g = link[p]
                m = size[g]
                if m > 1:
                    m -= 1
                    size[g] = m
                    last = g + m
                    other = order[last]
                    if other != p:
                        at = place[p]
                        order[at] = other
                        place[other] = at
                        order[last] = p
                        place[p] = last
                    link[p] = last
            end = start
            continue
        members = order[start:end]
        members.sort()
        reached = []
        for i in members:
            p = i - 1
            while p >= 0 and link[p] >= start:
                p = before[p]
            if p >= 0:
                before[i] = p
                reached.append(p)
        if len(set(reached)) == len(reached):
            rounds = (reached,)
        else:
            reached.sort()
            often = {}
            for p, hits in groupby(reached):
                often.setdefault(len(list(hits)), []).append(p)
            rounds = [often[times] for times in sorted(often, reverse=True)]
        for reached in rounds:
            # the most often reached go to the far end of their group, as a group of their own
            moved = {}
            for p in reached:
                g = link[p]
                m = size[g] - 1
                size[g] = m
                last = g + m
                other = order[last]
                if other != p:
                    at = place[p]
                    order[at] = other
                    place[other] = at
                    order[last] = p
                    place[p] = last
                if g in moved:
                    moved[g].append(p)
                else:
                    moved[g] = [p]
            for g, ps in moved.items():
                new = g + size[g]
                if new == g:
                    size[g] = len(ps)
                    continue
                size[new] = len(ps)
                for p in ps:
                    link[p] = new
        end = start
    # phase two: link becomes the group's first place, -1 once the suffix is emitted
    free = link
    out = [0] * n
    nxt = list(range(n))
    out[0] = n - 1
    free[n - 1] = -1
    for s in out:
        j = s - 1
        while j >= 0:
            g = free[j]
            if g < 0:
                break
            k = nxt[g]
            out[k] = j
            nxt[g] = k + 1
            free[j] = -1
            j = before[j]
    return np.array(out[1:], np.int64)
