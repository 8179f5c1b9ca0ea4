"""Linear grouping construction of suffix arrays, for many strings side by side.

Suffixes are grouped by their Lyndon prefixes, then ordered inside the groups:

* Grouping.  Suffixes start in one group per first symbol.  Groups are taken in
  descending order; the taken group is final.  For each of its suffixes the previous
  smaller suffix (its parent) is found through pointers that skip everything
  already known to be larger.  A parent's Lyndon prefix goes on with its children's, so
  parents move to new groups right behind their old group, those with more
  children in the taken group behind those with fewer.
* Emission.  Suffixes are visited in ascending order; each visited suffix places all
  suffixes whose next smaller suffix it is (a chain of parent pointers) at the front
  of their groups.  Nothing is renamed and nothing is sorted recursively.

Every string is independent, so step k takes the k-th group (or visits the k-th suffix)
of all strings at once, as array operations; the work stays linear in the total
length, and the number of steps is that of the longest string.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def lyndon_groups(symbols: np.ndarray, base: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, parent) of every suffix.  String b fills [base[b], base[b + 1]); its
    ``bars[b]`` least symbols occur once each, one first and one last among them,
    and cut it into pieces.  A group is named by the first place it takes in its string."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(base) - 1), np.diff(base))
    places = np.lexsort((symbols, owner)).astype(np.int32)   # place -> suffix
    at = np.empty(n, np.int32)                               # suffix -> place
    at[places] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (symbols[places[1:]] != symbols[places[:-1]]) | (owner[places[1:]] != owner[places[:-1]])
    first = np.flatnonzero(new)
    size = np.zeros(n, np.int32)                             # first place of a group -> its size
    size[first] = np.diff(np.append(first, n))
    first_of_last = np.zeros(n, np.int32)                    # last place of a group -> its first
    first_of_last[first + size[first] - 1] = first
    group = np.empty(n, np.int32)
    group[places] = np.repeat(first, size[first])
    parent = np.arange(n, dtype=np.int32) - 1
    del owner, new
    inner = np.ones(n, bool)                                 # suffixes that do not start with a bar
    floor = base[:-1] + bars
    low = np.zeros(n, bool)
    low[spread(base[:-1], bars)] = True
    inner[places[low]] = False
    moving = np.zeros(n, bool)
    top = base[1:] - 1                                       # last place not taken yet, by string
    live = np.flatnonzero(top >= floor)
    while len(live):
        taken = first_of_last[top[live]]
        sizes = size[taken]
        members = places[spread(taken, sizes)]
        rank = np.repeat(taken, sizes)
        # parents: skip what is in this group or above
        link = parent[members]
        todo = np.flatnonzero(group[link] >= rank)
        while len(todo):
            jump = parent[link[todo]]
            link[todo] = jump
            parent[members[todo]] = jump
            todo = todo[group[jump] >= rank[todo]]
        top[live] = taken - 1
        live = live[top[live] >= floor[live]]
        link = link[inner[link]]
        if not len(link):
            continue
        # parents by (group, children): new groups at the end of the old ones
        link.sort()
        edge = np.flatnonzero(np.append(True, link[1:] != link[:-1]))
        parents, children = link[edge], np.diff(np.append(edge, len(link)))
        old = group[parents]
        order = np.lexsort((children, old))
        parents, children, old = parents[order], children[order], old[order]
        edge = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        moved = np.diff(np.append(edge, len(old)))
        heads, held = old[edge], size[old[edge]]
        target = spread(heads + held - moved, moved)
        tail = np.repeat(heads + held - moved, moved)
        # swap: the others give up the places at the end
        moving[parents] = True
        others = places[target]
        others = others[~moving[others]]
        freed = at[parents]
        freed = freed[freed < tail]
        moving[parents] = False
        places[freed], at[others] = others, freed
        places[target], at[parents] = parents, target
        rest = held - moved
        some = rest > 0
        size[heads[some]] = rest[some]
        first_of_last[heads[some] + rest[some] - 1] = heads[some]
        edge = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (children[1:] != children[:-1])))
        count = np.diff(np.append(edge, len(old)))
        names = target[edge]
        size[names] = count
        first_of_last[names + count - 1] = names
        group[parents] = np.repeat(names, count)
    return group, parent


def emit_order(group: np.ndarray, parent: np.ndarray, base: np.ndarray, bars: np.ndarray) -> np.ndarray:
    """The suffixes of every string in ascending order, in the string's own range."""
    n = len(group)
    out = np.empty(n, np.int32)
    inner = group >= np.repeat(base[:-1] + bars, np.diff(base))
    out[group[~inner]] = np.flatnonzero(~inner)
    front = np.arange(n, dtype=np.int32)                     # first place of a group -> its next free place
    stop = np.where(inner, parent, -1)
    lengths = np.diff(base)
    order = np.argsort(-lengths, kind="stable")              # long strings first: the live ones are a prefix
    start, lengths = base[:-1][order], lengths[order]
    live = len(start)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        while live and lengths[live - 1] <= k:
            live -= 1
        visited = out[start[:live] + k]
        place, end = visited - 1, stop[visited]
        keep = (place >= 0) & (place != end)
        place, end = place[keep], end[keep]
        keep = inner[place]
        while True:
            place, end = place[keep], end[keep]
            if not len(place):
                break
            g = group[place]
            slot = front[g]
            out[slot] = place
            front[g] = slot + 1
            place = parent[place]
            keep = inner[place] & (place != end)
    return out


def suffix_arrays(symbols: np.ndarray, base: np.ndarray, bars: np.ndarray) -> np.ndarray:
    group, parent = lyndon_groups(symbols, base, bars)
    return emit_order(group, parent, base, bars)
