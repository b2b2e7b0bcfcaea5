"""A prefix tree over globally ordered integer sets, and the search in it for sets of a given Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m members with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """So many of the first members in any global order meet those of each similar set."""
    return n - -(-percent * n // 100) + 1 if n else 0


def spare(n: int) -> int:
    """Members beyond the first that similar sets must share in prefixes that are longer by so many."""
    return 3 * n // 100


def sketch(members: np.ndarray) -> bytes:
    """Parities of a set's hashes by their low bits, about a bit a member: two sets' sketches differ in no more bits than the sets in members."""
    width = max(64, 1 << max(len(members) - 1, 0).bit_length())
    counts = np.bincount((members & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(raw: bytes, width: int) -> np.ndarray:
    """A sketch at a smaller width: parities whose places are equal there fall together."""
    out = np.frombuffer(raw, np.uint64)
    while len(out) * 64 > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def may_link(sketches: list[bytes], sizes: list[int], percent: int) -> list[int]:
    """Per set the number of its part: sets whose sketches allow a link are in one part. Every pair is looked at, a row of sketches at a time."""
    width = 8 * min(map(len, sketches))
    rows, n = np.stack([_folded(s, width) for s in sketches]), np.array(sizes, np.int64)
    groups = Groups(len(sizes))
    for i in range(len(sizes) - 1):
        apart = np.bitwise_count(rows[i + 1 :] ^ rows[i]).sum(1, dtype=np.int64)
        both = n[i + 1 :] + n[i]
        need = -(-percent * both // (100 + percent))
        near = np.flatnonzero((apart <= both - 2 * need) & (np.minimum(n[i + 1 :], n[i]) >= need))
        for j in near.tolist():
            groups.join(i, i + 1 + j)
    return [groups.root(i) for i in range(len(sizes))]


class PrefixTree:
    """Sets that begin alike share nodes; a node holds a run of members, the sets that end there, and the bounds of all set sizes below it."""

    def __init__(self, sets: list[np.ndarray]):
        """sets: each ascending, without repeats, over 0 .. universe-1."""
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        common = [0] * len(order)
        for k in range(1, len(order)):
            a, b = sets[order[k - 1]], sets[order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[k] = int(differ[0]) if len(differ) else n
        #: Per node: run, sets that end there, children, least and most size below.
        self.nodes: list[tuple[np.ndarray, list[int], list[int], int, int]] = []
        self.roots: list[int] = []
        todo = [(0, len(order), 0, self.roots)] if order else []
        while todo:
            lo, hi, depth, into = todo.pop()
            starts = [lo, *(k for k in range(lo + 1, hi) if common[k] <= depth), hi]
            for a, b in zip(starts, starts[1:]):
                if len(sets[order[a]]) == depth:  # ends above; such a set is the first of its part
                    a += 1
                    if a == b:
                        continue
                shared = min(common[a + 1 : b], default=len(sets[order[a]]))
                own = [order[k] for k in range(a, b) if len(sets[order[k]]) == shared]
                sizes = [len(sets[order[k]]) for k in range(a, b)]
                below: list[int] = []
                into.append(len(self.nodes))
                self.nodes.append((sets[order[a]][depth:shared], own, below, min(sizes), max(sizes)))
                if len(own) < b - a:
                    todo.append((a, b, shared, below))

    def similar(self, probe: np.ndarray, universe: int, percent: int, skip) -> list[int]:
        """Indexes of all sets with Jaccard similarity of at least percent / 100 to the probe, but for those that skip(index) names."""
        has = np.zeros(universe + 1, np.int32)
        has[probe] = 1
        upto = np.cumsum(has)  # members of the probe up to each rank
        n, found = len(probe), []
        todo = [(r, 0, 0) for r in self.roots]
        while todo:
            node, overlap, depth = todo.pop()
            run, own, below, least, most = self.nodes[node]
            if least * percent > n * 100 or most * 100 < percent * n:
                continue
            overlap += int(has[run].sum())
            depth += len(run)
            left = n - int(upto[run[-1]]) if len(run) else n
            # The bound grows slower than the need with the size of the other set, so the least size that can hold decides.
            if overlap + min(left, most - depth) < overlap_needed(n, max(least, -(-percent * n // 100)), percent):
                continue
            for i in own:
                if overlap >= overlap_needed(n, len(self.sets[i]), percent) and not skip(i):
                    found.append(i)
            todo += [(c, overlap, depth) for c in below]
        return found


class Groups:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(sets: list[np.ndarray], probes: list[bool], percent: int, place: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that connect the sets just as all pairs of similar sets do.

    sets: members as hashes; the first set is the head. probes: which sets are compared with all others (those that the
    head reaches need no comparison among themselves). place: the members' places in the global order, where ties go by
    hash.
    """
    universe, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(universe), np.int64)
    rank[np.argsort(place(universe), kind="stable")] = np.arange(len(universe))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(p) for p in np.split(rank[inverse], cuts)]
    groups, out, tree = Groups(len(sets)), [], PrefixTree(ranked)
    for i in range(len(ranked)):
        if i == 0 or (probes[i] and groups.root(i) != 0):
            for j in tree.similar(ranked[i], len(universe), percent, lambda j: groups.root(i) == groups.root(j)):
                if groups.join(i, j):
                    out.append((i, j))
    return out
