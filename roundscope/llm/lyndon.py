"""Suffix order of a short symbol sequence by Lyndon-prefix groups."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """Start places of all suffixes, least suffix first; the last symbol must be the only least one.

    First the suffixes are grouped by their longest Lyndon prefix. Groups are taken from the
    greatest down. Once a group is taken, each member's pointer goes to the nearest earlier place
    not taken yet, the previous smaller one; the Lyndon prefix of that place goes on with the
    group's, as often as members point at it, so it moves to a new group just above its old one.
    Then the order within groups is filled from the least suffix up: a placed suffix places, along
    the pointers before it, those whose Lyndon prefix ends where it begins. Each place is moved and
    followed a bounded number of times, nothing is renamed and sorted again.
    """
    n = len(symbols)
    first: dict[int, list[int]] = {}
    for place, symbol in enumerate(symbols):
        if symbol in first:
            first[symbol].append(place)
        else:
            first[symbol] = [place]
    ranked = sorted(first)
    members = [first[s] for s in ranked]
    below = list(range(-1, len(ranked) - 1))
    above = [*range(1, len(ranked)), -1]
    number = {s: g for g, s in enumerate(ranked)}
    group = [number[s] for s in symbols]
    taken = bytearray(n)
    smaller = [-1] * n
    downward: list[int] = []
    at = len(ranked) - 1
    while at >= 0:
        mine = [i for i in members[at] if group[i] == at]
        for i in mine:
            taken[i] = 1
        moves: dict[tuple[int, int], list[int]] = {}
        target, times = -1, 0
        for i in mine:
            j = i - 1
            while j >= 0 and taken[j]:
                j = smaller[j]
            smaller[i] = j
            if j == target:
                times += 1
                continue
            if target >= 0:
                moves.setdefault((times, group[target]), []).append(target)
            target, times = j, 1
        if target >= 0:
            moves.setdefault((times, group[target]), []).append(target)
        for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            places = moves[times, old]
            new = len(members)
            members.append(places)
            top = above[old]
            below.append(old)
            above.append(top)
            above[old] = new
            if top >= 0:
                below[top] = new
            for j in places:
                group[j] = new
        if mine:
            downward.append(at)
            members[at] = mine
        at = below[at]
    # Free slots of the groups, from the least up.
    slot = [0] * len(members)
    filled = 0
    for g in reversed(downward):
        slot[g] = filled
        filled += len(members[g])
    order = [-1] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in order:
        j = i - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[slot[g]] = j
            slot[g] += 1
            j = smaller[j]
    return order
