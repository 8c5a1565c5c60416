"""Suffix order by grouping suffixes under their longest Lyndon prefixes.

First phase: suffixes start in groups by first symbol. Groups are taken from the largest down; each suffix of the group looks
up, along pointers, its previous smaller suffix, whose prefix grows by the group's prefix. Suffixes that grow move to new
groups behind the rest of theirs, those with more such followers further back. When all groups are done, each group shares
its longest Lyndon prefix. Second phase: going up through the order, the suffix that ends where a placed suffix starts is the
next of its group, so every group comes out sorted without new names for its members. The second phase takes linear time,
the first too but for putting each group's members in text order, which sorts them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """First phase: (order by group, each suffix's group start in it, each suffix's previous smaller suffix or -1)."""
    n = len(text)
    symbols = np.asarray(text, np.int64)
    by = np.argsort(symbols, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], symbols[by][1:] != symbols[by][:-1]))) if n else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((begins, [n])))
    sizes, groups, places = np.zeros(n + 1, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    sizes[begins] = counts
    groups[by], places[by] = np.repeat(begins, counts), np.arange(n)
    order, place, group, size = by.tolist(), places.tolist(), groups.tolist(), sizes.tolist()
    group.append(-1)  # where pointers end: place -1 lies in a group below all others
    prev = [-1] * n
    end = n
    while end:
        first = group[order[end - 1]]
        if end - first == 1:
            # one suffix: only its previous smaller one grows, and moves to the end of its group
            s = order[first]
            p = s - 1
            while group[p] >= first:
                p = prev[p]
            prev[s] = p
            end = first
            if p >= 0:
                g = group[p]
                m = size[g] - 1
                if m:
                    last = g + m
                    other = order[last]
                    if other != p:
                        k = place[p]
                        order[k], place[other] = other, k
                        order[last], place[p] = p, last
                    size[g], size[last], group[p] = m, 1, last
            continue
        followers: dict[int, int] = {}
        for s in sorted(order[first:end]):  # from left to right: a pointer that ends in this same group goes on to that suffix's own
            p = s - 1
            while group[p] > first:
                p = prev[p]
            if group[p] == first:
                p = prev[p]
            prev[s] = p
            if p in followers:
                followers[p] += 1
            else:
                followers[p] = 1
        end = first
        followers.pop(-1, None)
        by_count: dict[int, list[int]] = {}
        for p, k in followers.items():
            if k in by_count:
                by_count[k].append(p)
            else:
                by_count[k] = [p]
        # those with the most followers leave first and take the last places of what is left of their groups
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[k]:
                g = group[p]
                m = size[g] - 1
                last = g + m
                other = order[last]
                if other != p:
                    at = place[p]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                size[g] = m
                moved[g] = moved.get(g, 0) + 1
            fresh = {g: g + size[g] for g in moved}
            for p in by_count[k]:
                group[p] = fresh[group[p]]
            for g, m in moved.items():
                size[fresh[g]] = m
    group.pop()
    return order, group, prev


def widened(text: np.ndarray, width: int = 8) -> np.ndarray:
    """Ranks of the strings of ``width`` symbols (a power of two) from each place on, as symbols. Suffixes keep their order, and the
    groups that the first phase begins with are small."""
    have = 1
    while have < width:
        pairs = text * (int(text.max(initial=0)) + 1)
        pairs[:-have] += text[have:]
        text = np.unique(pairs, return_inverse=True)[1]
        have *= 2
    return text


def suffix_array(text: Sequence[int]) -> list[int]:
    """Second phase: positions of the suffixes in order. The last symbol must be the smallest and occur once."""
    n = len(text)
    if not n:
        return []
    _, group, prev = lyndon_groups(text)
    free = list(range(n))
    out = [n - 1] * n
    placed = bytearray(n + 1)
    placed[n - 1] = placed[n] = 1  # the last stands for place -1, where pointers end
    for i in range(n):
        p = out[i] - 1
        while not placed[p]:
            g = group[p]
            k = free[g]
            out[k] = p
            free[g] = k + 1
            placed[p] = 1
            p = prev[p]
    return out
