"""Suffix array of a sequence of small integers, by groups of equal Lyndon prefixes.

First all suffixes are grouped by symbol. Groups are visited from the greatest to the least; a visit finds for
each member the nearest suffix to its left that is smaller (not yet visited), and moves those into new groups
behind their old ones, the more members follow them the further back: their prefix grows by the visited
group's. Once every group is visited, suffixes of a group share their Lyndon prefix, and groups are in order.
Then the order within groups follows from left to right: a suffix comes as early as the smaller suffix that
ends its Lyndon prefix. Nothing is renamed and nothing recurses; the work is linear in the length.
"""

from __future__ import annotations


class Groups:
    """Suffix positions by Lyndon prefix: members, the group of each position and its neighbours in order."""

    def __init__(self, text: list[int]):
        symbols = {c: i for i, c in enumerate(sorted(set(text)))}
        self.group = [symbols[c] for c in text]
        self.members: list[list[int]] = [[] for _ in symbols]
        for i, g in enumerate(self.group):
            self.members[g].append(i)
        self.live = [len(m) for m in self.members]
        self.below = list(range(-1, len(symbols) - 1))
        self.above = list(range(1, len(symbols))) + [-1]

    def split(self, old: int, moved: list[int]) -> None:
        """Move some members of a group to a new one right behind it; a whole group may stay where it is."""
        if self.live[old] == len(moved):
            return
        new = len(self.members)
        self.live[old] -= len(moved)
        for i in moved:
            self.group[i] = new
        self.members.append(moved)
        self.live.append(len(moved))
        up = self.above[old]
        self.below.append(old)
        self.above.append(up)
        self.above[old] = new
        if up >= 0:
            self.below[up] = new


def lyndon_groups(text: list[int]) -> tuple[Groups, list[int]]:
    """The final groups and, for every suffix, the nearest suffix to its left of a smaller group (-1: none)."""
    n = len(text)
    groups = Groups(text)
    group, members, live, below = groups.group, groups.members, groups.live, groups.below
    smaller = [-1] * n
    visited = bytearray(n + 1)  # the last cell stands for position -1
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if live[g] != len(own):
            members[g] = own = [i for i in own if group[i] == g]
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while visited[j]:
                j = smaller[j]
            smaller[i] = j
            visited[i] = 1
            if j >= 0 and live[group[j]] > 1:
                groups.split(group[j], [j])
        elif own:
            followers: dict[int, int] = {}
            for i in own:
                j = i - 1
                while visited[j]:
                    j = smaller[j]
                smaller[i] = j
                visited[i] = 1
                followers[j] = followers.get(j, 0) + 1
            followers.pop(-1, None)
            parts: dict[tuple[int, int], list[int]] = {}
            for j, count in followers.items():
                parts.setdefault((count, group[j]), []).append(j)
            for part in sorted(parts, reverse=True):
                groups.split(part[1], parts[part])
        g = below[g]
    return groups, smaller


def suffix_order(text: list[int]) -> list[int]:
    """Start positions of all suffixes of ``text`` in ascending order; a suffix precedes those it is a prefix of."""
    n = len(text)
    groups, smaller = lyndon_groups(text)
    group = groups.group
    free, at, g = [0] * len(groups.members), 0, 0 if n else -1
    while g >= 0:
        free[g] = at
        at += groups.live[g]
        g = groups.above[g]
    out = [-1] * n
    placed = bytearray(n + 1)
    placed[n] = 1  # the last cell stands for position -1
    for i in range(-1, n):
        j = (out[i] if i >= 0 else n) - 1
        while not placed[j]:
            placed[j] = 1
            h = group[j]
            out[free[h]] = j
            free[h] += 1
            j = smaller[j]
    return out
