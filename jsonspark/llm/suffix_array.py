"""Suffix array by grouping: Lyndon-prefix groups in descending order, then one pass that emits their order.

The method of Baier (2016).  The Lyndon prefix of suffix i ends where the next
smaller suffix begins.  Phase one refines groups of suffixes with a common
prefix, beginning with the first characters.  The highest group whose turn has
not come is final: its common prefix u is the Lyndon prefix of its members.  Each
member points to the closest suffix before it that is in a lower group; the
prefix of that one is followed by u, once or several times in a row, so it moves
to a new group just above its own, the higher the more copies of u follow.
Phase two reads the suffixes in ascending order; for each one the suffixes whose
next smaller suffix it is, found along the pointers, are put at the next free
place of their groups.  Both phases are linear and nothing is renamed.

``suffix_array`` sorts one text, symbol by symbol.  ``suffix_arrays`` sorts many
texts in step: every round takes the highest group of each, as numpy arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text) -> list[int]:
    """Starts of all suffixes in ascending order; a shorter suffix is before those it begins.

    ``text`` is bytes or a sequence of small non-negative integers.
    """
    symbols = np.asarray(np.frombuffer(text, np.uint8) if isinstance(text, (bytes, bytearray)) else text, np.int64)
    n = len(symbols)
    if n == 0:
        return []
    by_symbol = np.argsort(symbols, kind="stable")
    order = by_symbol.tolist()  # the suffixes, each group a block
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    place = place.tolist()  # where a suffix stands in order
    ordered = symbols[by_symbol]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    first = np.repeat(heads, np.diff(np.append(heads, n)))
    group = np.empty(n, np.int64)
    group[by_symbol] = first
    group = group.tolist()  # a group is named by the place of its first member
    end = [0] * n  # one past the group's last member, at its first place
    for a, b in zip(heads.tolist(), np.append(heads[1:], n).tolist()):
        end[a] = b
    before = [-1] * n  # the closest suffix on the left that is smaller

    high = n
    while high:
        start = group[order[high - 1]]
        if high - start == 1:  # most groups: one member
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                last = end[g] - 1
                if last != g:  # p leaves for a group of its own, above the rest
                    at = place[p]
                    other = order[last]
                    order[at], place[other] = other, at
                    order[last], place[p] = p, last
                    end[g], group[p], end[last] = last, last, last + 1
            high = start
            continue
        times: dict[int, int] = {}  # copies of u that follow each smaller suffix
        for i in sorted(order[start:high]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, k in times.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):  # the most copies go to the top of what is left of a group
            moved: dict[int, int] = {}
            for p in levels[k]:
                g = group[p]
                last = end[g] - 1 - moved.get(g, 0)
                at = place[p]
                other = order[last]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
                moved[g] = moved.get(g, 0) + 1
            for g, count in moved.items():
                top = end[g]
                if count < top - g:
                    new = top - count
                    end[g], end[new] = new, top
                    for at in range(new, top):
                        group[order[at]] = new
        high = start

    out = [-1] * n
    free = list(range(n))  # next free place of each group, at its first place
    placed = bytearray(n)

    def put(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]

    put(n - 1)  # the empty suffix is smaller than all
    for k in range(n):
        put(out[k] - 1)
    return out


STEP_TEXTS = 24  #: the longest texts, which would keep rounds going for few, are sorted one by one
STEP_SYMBOLS = 400_000  #: sorted in step at a time, so that the arrays stay near the processor


def suffix_arrays(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts that lie end to end, one after the other, as places in ``symbols``.

    Suffixes end where their text ends.  Symbols are small non-negative integers.
    """
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes
    out = np.empty(len(symbols), np.int64)
    longest = np.argsort(-sizes, kind="stable")
    for t in longest[:STEP_TEXTS].tolist():
        a, b = int(begins[t]), int(ends[t])
        out[a:b] = suffix_array(symbols[a:b])
        out[a:b] += a
    rest = longest[STEP_TEXTS:]
    rest = rest[sizes[rest] > 0]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[rest]) // STEP_SYMBOLS)) + 1
    for batch in np.split(rest, cuts) if len(rest) else ():
        inner = _ranges(begins[batch], sizes[batch])
        out[inner] = inner[_in_step(symbols[inner], np.cumsum(sizes[batch]))]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _in_step(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)
    # Every text has a place of its own before its first suffix, in a group below all others.
    suffix = np.arange(len(symbols)) + text + 1
    n = len(symbols) + len(ends)
    key = text * (int(symbols.max()) + 1) + symbols
    by_key = np.argsort(key)
    key = key[by_key]
    order, place, group, end = (np.full(n, -1) for _ in range(4))
    order[suffix] = suffix[by_key]
    place[order[suffix]] = suffix
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stops = np.append(heads[1:], len(key))
    group[order[suffix]] = suffix[np.repeat(heads, stops - heads)]
    end[suffix[heads]] = suffix[stops - 1] + 1
    before = np.full(n, -1)
    moving = np.zeros(n, bool)

    low = suffix[ends - sizes]  # the first place of each text
    last_place = low + sizes
    high = last_place.copy()
    lowest = low
    while len(high):
        start = group[order[high - 1]]
        size = high - start
        if (size == 1).all():
            member, own = order[start], start
            p = _smaller_before(member, own, group, before)
            before[member] = p
            p = p[group[p] >= 0]
            g = group[p]
            last = end[g] - 1
            on = last != g  # p leaves for a group of its own, above the rest
            p, g, last = p[on], g[on], last[on]
            at, other = place[p], order[last]
            order[at] = other
            place[other] = at
            order[last] = p
            place[p] = group[p] = last
            end[g] = last
            end[last] = last + 1
        else:
            own = np.repeat(start, size)
            member = np.sort(order[_ranges(start, size)])  # places of a text lie together, so texts stay in turn
            p = _smaller_before(member, own, group, before)
            before[member] = p
            inside = np.flatnonzero(group[p] == own)  # a copy of u stands before: what is before that one counts
            while len(inside):
                p[inside] = before[p[inside]]
                before[member[inside]] = p[inside]
                inside = inside[group[p[inside]] == own[inside]]
            p = p[group[p] >= 0]
            if len(p):
                _raise(*_counted(p), order, place, group, end, moving)
        on = start > lowest
        high, lowest = start[on], lowest[on]

    # The order of the suffixes: each one puts the suffix before it, and what points to that one, at the next free place.
    out = np.full(n, -1)
    free = np.arange(n)
    waiting = group >= 0
    at, stop = low, last_place
    p = last_place - 1
    while True:
        p = p[waiting[p]]
        while len(p):
            waiting[p] = False
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = before[p]
            p = p[waiting[p]]
        on = at < stop
        at, stop = at[on], stop[on]
        if not len(at):
            break
        p = out[at] - 1
        at = at + 1
    return out[suffix] - text - 1


def _smaller_before(member: np.ndarray, own: np.ndarray, group: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The closest place before each member whose group is not above its own."""
    p = member - 1
    above = np.flatnonzero(group[p] > own)
    while len(above):
        q = before[p[above]]
        p[above] = q
        above = above[group[q] > own[above]]
    return p


def _counted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    p = np.sort(p)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[first], np.diff(np.append(first, len(p)))


def _raise(p, times, order, place, group, end, moving) -> None:
    """Moves each p to a group just above the rest of its own, the higher the more copies follow it."""
    g = group[p]
    by = np.lexsort((times, g))
    p, times, g = p[by], times[by], g[by]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_run = new_group | np.concatenate([[True], times[1:] != times[:-1]])
    firsts = np.flatnonzero(new_group)
    count = np.diff(np.append(firsts, len(g)))
    top = end[g[firsts]]
    target = _ranges(top - count, count)
    floor = np.repeat(top - count, count)
    moving[p] = True
    standing = order[target]
    displaced = standing[~moving[standing]]
    vacated = place[p]
    vacated = vacated[vacated < floor]
    moving[p] = False
    order[vacated] = displaced
    place[displaced] = vacated
    order[target] = p
    place[p] = target
    end[g[firsts]] = top - count
    runs = np.flatnonzero(new_run)
    length = np.diff(np.append(runs, len(g)))
    group[p] = np.repeat(target[runs], length)
    end[target[runs]] = target[runs] + length
