"""Suffix array by Lyndon grouping, for integer sequences."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; the end counts as the least symbol.

    First the suffixes are grouped by their longest Lyndon prefix. Groups are taken from the
    highest down; the members of a group are appended to their previous smaller suffixes
    (the nearest start to the left in a group not yet taken), which move to a new, higher
    group by how many members they got. Then the order inside the groups follows from the
    next smaller suffixes: when a suffix is placed, those that it ends are placed next in
    their groups. Each symbol is handled a constant number of times but for the pointers'
    path compression.
    """
    n = len(text)
    group, members, length = [0] * n, [], []
    for symbol in sorted(set(text)):
        members.append([])
        length.append(1)
    number = {symbol: g for g, symbol in enumerate(sorted(set(text)))}
    for i, symbol in enumerate(text):
        group[i] = g = number[symbol]
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))

    left = list(range(-1, n - 1))  # towards the previous suffix not yet taken
    taken = [False] * n
    finished: list[list[int]] = []
    ends = [0] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            finished.append(own)
            size = length[g]
            for i in own:
                taken[i] = True
                ends[i] = i + size
            got: dict[int, int] = {}
            for i in own:
                p = left[i]
                if p >= 0 and taken[p]:
                    path = [i]
                    while p >= 0 and taken[p]:
                        path.append(p)
                        p = left[p]
                    for j in path:
                        left[j] = p
                if p >= 0:
                    got[p] = got.get(p, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in got.items():
                moved.setdefault((group[p], -times), []).append(p)
            # the most members end highest: insert those first, the others below them
            for (h, times), starts in sorted(moved.items()):
                new = len(members)
                members.append(starts)
                length.append(length[h] - times * size)
                upper = above[h]  # there is one, as the group being taken is higher
                below[upper] = new
                below.append(h)
                above.append(upper)
                above[h] = new
                for p in starts:
                    group[p] = new
        g = below[g]

    finished.reverse()
    slot, at = [0] * n, 0
    where = [0] * len(finished)
    for k, own in enumerate(finished):
        where[k] = at
        at += len(own)
        for i in own:
            slot[i] = k
    ended_by: list[list[int]] = [[] for _ in range(n + 1)]
    for i, end in enumerate(ends):
        ended_by[end].append(i)
    order = [0] * n
    for r in range(-1, n):
        for i in ended_by[n if r < 0 else order[r]]:
            k = slot[i]
            order[where[k]] = i
            where[k] += 1
    return order
