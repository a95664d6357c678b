"""Sequential kernels that run inside one task on a bounded number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _places(src: np.ndarray, dst: np.ndarray) -> tuple[int, list[int], list[int]]:
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return len(ids), place[: len(src)].tolist(), place[len(src) :].tolist()


def labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of all vertices and the least id in the component of each."""
    ids = np.unique(np.concatenate([src, dst]))
    n, a, b = _places(src, dst)
    parent = list(range(n))
    for x, y in zip(a, b, strict=True):
        x, y = find(parent, x), find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return ids, ids[[find(parent, i) for i in range(n)]] if n else ids


def spanning_rows(src: np.ndarray, dst: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the edges of the minimum spanning forest, for edges taken in the order `rank` (positions)."""
    n, a, b = _places(src, dst)
    parent, keep = list(range(n)), []
    for i in rank.tolist():
        x, y = find(parent, a[i]), find(parent, b[i])
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
            if len(keep) == n - 1:
                break
    return np.array(keep, np.int64)


def merge_parents(src: np.ndarray, dst: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each edge of a forest the position of its parent in the dendrogram (itself for a root)."""
    n, a, b = _places(src, dst)
    parent, last = list(range(n)), [-1] * n
    up = np.arange(len(src))
    for i in rank.tolist():
        x, y = find(parent, a[i]), find(parent, b[i])
        if x == y:
            raise ValueError("the edges have a cycle; take a spanning forest first")
        for r in (x, y):
            if last[r] >= 0:
                up[last[r]] = i
        root = min(x, y)
        parent[max(x, y)] = root
        last[root] = i
    return up


def heights(up: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Merge edges on the longest chain from a leaf up to each edge, itself included."""
    out = np.ones(len(up), np.int64)
    for i in rank.tolist():
        if up[i] != i:
            out[up[i]] = max(out[up[i]], out[i] + 1)
    return out


def nearest_greater(weights: np.ndarray) -> np.ndarray:
    """For a sequence, the position of the lesser of the nearest greater elements on both sides (ties go by position); itself for the greatest."""
    n = len(weights)
    w = weights.tolist()
    left, right, stack = [-1] * n, [-1] * n, []
    for i in range(n):
        while stack and w[stack[-1]] <= w[i]:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    out = np.arange(n)
    for i in range(n):
        found = [j for j in (left[i], right[i]) if j >= 0]
        if found:
            out[i] = min(found, key=lambda j: (w[j], j))
    return out


#: Up to so many vertices a matrix tells which edges there are.
MATRIX_VERTICES = 4096
#: So many candidates for the third vertex are looked at together.
CANDIDATES = 1 << 21


class Triangles:
    """Edges (u, v), numbered in this order, some alive: their triangles. `of` yields e, f, g by numbers, e among the edges asked for."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
        self.n, self.m = len(ids), len(src)
        self.u, self.v = place[: self.m], place[self.m :]
        self.matrix = self.n <= MATRIX_VERTICES and self.m > self.n * self.n // 64
        if self.matrix:
            self.number = np.zeros((self.n, self.n), np.int32)
            self.number[self.u, self.v] = self.number[self.v, self.u] = np.arange(self.m)
            self.there = np.zeros((self.n, self.n), bool)
            self.there[self.u, self.v] = self.there[self.v, self.u] = True
        else:
            self.alive = np.ones(self.m, bool)
            self._pack()

    def _pack(self) -> None:
        """Sorted lists of neighbours over the edges alive: keys are vertex * n + neighbour."""
        e = np.flatnonzero(self.alive)
        key = np.concatenate([self.u[e] * self.n + self.v[e], self.v[e] * self.n + self.u[e]])
        order = np.argsort(key)
        self.key, self.edge = key[order], np.concatenate([e, e])[order].astype(np.int32)
        self.near, self.packed, self.dead = (self.key % max(self.n, 1)).astype(np.int32), len(e), 0
        self.start = np.searchsorted(self.key, np.arange(self.n + 1) * self.n)
        self.degree = np.diff(self.start)

    def remove(self, e: np.ndarray) -> None:
        if self.matrix:
            self.there[self.u[e], self.v[e]] = self.there[self.v[e], self.u[e]] = False
            return
        self.alive[e] = False
        self.dead += len(e)
        if 2 * self.dead > self.packed:
            self._pack()

    def _rows(self, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges a few at a time, and where both ends have a neighbour, by the matrix."""
        step = max(1, CANDIDATES // max(self.n, 1))
        for i in range(0, len(edges), step):
            e = edges[i : i + step]
            yield e, self.there[self.u[e]] & self.there[self.v[e]]

    def _listed(self, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position of the edge asked for, and places in the lists of the other two edges: the list of one end, looked up at the other end."""
        swap = self.degree[self.u[edges]] > self.degree[self.v[edges]]
        x, y = np.where(swap, self.v[edges], self.u[edges]), np.where(swap, self.u[edges], self.v[edges])
        total = np.cumsum(self.degree[x])
        cuts = np.searchsorted(total, np.arange(CANDIDATES, total[-1] if len(total) else 0, CANDIDATES))
        for part in np.split(np.arange(len(edges)), np.unique(cuts)):
            many = self.degree[x[part]]
            row = np.repeat(part, many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.start[x[row]]
            found = self.alive[self.edge[at]]
            row, at = row[found], at[found]
            wanted = y[row] * self.n + self.near[at]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = (self.key[place] == wanted) & self.alive[self.edge[place]]
            yield row[found], at[found], place[found]

    def of(self, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.matrix:
            for e, both in self._rows(edges):
                row, w = np.divmod(np.flatnonzero(both), self.n)
                yield e[row], self.number[self.u[e[row]], w], self.number[self.v[e[row]], w]
        else:
            for row, at, place in self._listed(edges):
                yield edges[row], self.edge[at], self.edge[place]

    def counts(self, edges: np.ndarray) -> np.ndarray:
        """How many triangles each of these edges has."""
        if self.matrix:
            return np.concatenate([np.empty(0, np.int64), *[np.count_nonzero(both, axis=1) for _, both in self._rows(edges)]]).astype(np.int64)
        out = np.zeros(len(edges), np.int64)
        for row, _, _ in self._listed(edges):
            if len(row):
                out[row[0] : row[-1] + 1] += np.bincount(row - row[0])
        return out


#: Rows of bits may take so many bytes.
BITS_BYTES = 1 << 28
#: So many words of such rows are looked at together.
WORDS = 1 << 16
#: Steps between levels, in turn, at first, while bounds still are supports.
STEPS = (16, 4)
#: Where less than this share of the edges falls, the edges of their triangles are sought, else all are looked at.
FEW_FALL = 1 / 16


class Bits:
    """The neighbours of vertices 0 to n - 1 as rows of bits, for those edges that were set."""

    def __init__(self, n: int):
        self.words = -(-n // 64)
        self.flat = np.zeros(n * self.words, np.uint64)
        self.rows = self.flat.reshape(n, self.words)
        self.step = max(1, WORDS // max(self.words, 1))

    def _place(self, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return row * self.words + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64)

    def set(self, u: np.ndarray, v: np.ndarray) -> None:
        """Edges that are not set, each once."""
        np.add.at(self.flat, *self._place(u, v))
        np.add.at(self.flat, *self._place(v, u))

    def unset(self, u: np.ndarray, v: np.ndarray) -> None:
        np.subtract.at(self.flat, *self._place(u, v))
        np.subtract.at(self.flat, *self._place(v, u))

    def has(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which bits v of rows u are set."""
        at, bit = self._place(u, v)
        return (self.flat[at] & bit) != 0

    def _both(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        both = self.rows.take(u, 0)
        both &= self.rows.take(v, 0)
        return both

    def counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many neighbours u[i] and v[i] have in common."""
        out = np.zeros(len(u), np.int64)
        for i in range(0, len(u), self.step):
            out[i : i + self.step] = np.bitwise_count(self._both(u[i : i + self.step], v[i : i + self.step])).sum(1, dtype=np.uint32)
        return out

    def mark(self, marks: Bits, u: np.ndarray, v: np.ndarray) -> None:
        """Set in marks the other two edges of all triangles of edges (u, v), each in one direction."""
        for x, y in ((u, v), (v, u)):
            order = np.argsort(x)
            for i in range(0, len(x), self.step):
                part = order[i : i + self.step]
                first = np.flatnonzero(np.diff(x[part], prepend=-1))
                marks.rows[x[part][first]] |= np.bitwise_or.reduceat(self._both(x[part], y[part]), first, axis=0)


class Bounds:
    """Edges (u, v) between vertices 0 to n - 1, some own, with bounds k of their levels from above."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, k: np.ndarray, own: np.ndarray):
        self.n, self.u, self.v, self.k, self.own = n, u, v, k, own
        # Common bits cost n / 64 words an edge; sparse graphs have their neighbours looked up.
        self.dense = n * n // 8 <= BITS_BYTES and len(u) > n * n // 2000

    def counts(self) -> np.ndarray:
        """Triangles of each own edge; 0 for the others."""
        e, out = np.flatnonzero(self.own), np.zeros(len(self.u), np.int64)
        if self.dense:
            bits = Bits(self.n)
            bits.set(self.u, self.v)
            out[e] = bits.counts(self.u[e], self.v[e])
        else:
            out[e] = Triangles(self.u, self.v).counts(e)
        return out

    def _touched(self, bits: Bits, sank: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Edges of the pool with a triangle, by the bits, that has one of those that sank."""
        bits.mark(self.marks, self.u[sank], self.v[sank])
        u, v = self.u[pool], self.v[pool]
        found = pool[self.marks.has(u, v) | self.marks.has(v, u)]
        self.marks.rows[self.u[sank]] = self.marks.rows[self.v[sank]] = 0
        return found

    def _moved(self, was: np.ndarray) -> np.ndarray:
        """Own edges that may have lost triangles at their bound since bounds were `was`."""
        sank = np.flatnonzero(was > self.k)
        low, high = np.full(self.n, np.iinfo(np.int64).max), np.full(self.n, -1)
        for x in (self.u[sank], self.v[sank]):
            np.minimum.at(low, x, self.k[sank])
            np.maximum.at(high, x, was[sank])
        # Some edge of a vertex passed the bound.
        passed = lambda x: (low[x] < self.k) & (self.k <= high[x])
        look = self.own & (passed(self.u) | passed(self.v))
        if 0 < len(sank) < FEW_FALL * len(self.u):
            bits, live = Bits(self.n), np.flatnonzero(was > self.k[sank].min())
            bits.set(self.u[live], self.v[live])
            found = self._touched(bits, sank, np.flatnonzero(look))
            look[:] = False
            look[found] = True
        return look

    def _sweep(self, look: np.ndarray, step: int) -> None:
        """Down the levels, by step: of the own edges to look at, those with too few triangles among the edges bounded by a level
        or more sink below it."""
        bits, group = Bits(self.n), self.k // step
        order = np.argsort(-group.astype(np.int16) if group.max(initial=0) < 1 << 15 else -group, kind="stable")
        parts = {int(group[p[0]]): p for p in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)}
        levels, at, falls = list(parts), 0, order[:0]
        level, last = levels[0], int(group[look].min())
        while level > 0 and (level >= last or len(falls)):
            here = parts.get(level, order[:0])
            at += len(here) > 0
            bits.set(self.u[here], self.v[here])
            bits.set(self.u[falls], self.v[falls])
            pool, tried, found = np.concatenate([falls, here[self.own[here]]]), np.concatenate([falls, here[look[here]]]), [order[:0]]
            while len(tried):
                few = tried[bits.counts(self.u[tried], self.v[tried]) < level * step]
                self.k[few] = level * step - 1
                pool = pool[self.k[pool] >= level * step]
                found.append(few)
                # Of many, what they touch is left to the next sweep.
                tried = self._touched(bits, few, pool) if 0 < len(few) < FEW_FALL * len(pool) else few[:0]
                bits.unset(self.u[few], self.v[few])
            falls = np.concatenate(found)
            level = level - 1 if len(falls) or at == len(levels) else levels[at]

    def sink(self, low: int, was: np.ndarray, turn: int, whole: bool) -> np.ndarray:
        """Bounds of all edges after own ones sank while the others stay; those up to low are levels. was: the bounds of the turn before.

        Turn 0 goes down in steps, turn 1 looks at each own edge, others at what may have moved. A turn ends when many sank at once,
        as then others' edges sink too; if whole (all edges are own), when no more do.
        """
        if not self.dense:
            moved = turn < 2 or (was > self.k).any()
            return np.where(self.own & (self.k > low), peel_levels(self.u, self.v, low, self.k, self.own)[1], self.k) if moved else self.k
        self.marks, live = Bits(self.n), self.own & (self.k > low)
        for step in STEPS if turn == 0 else ():
            if live.any():
                self._sweep(live, step)
        if turn == 0 and not whole:
            return self.k
        look = live if turn < 2 else self._moved(was) & live
        while look.any():
            before = self.k.copy()
            self._sweep(look, 1)
            if not whole and np.count_nonzero(before > self.k) > FEW_FALL * np.count_nonzero(live):
                break
            look = self._moved(before) & live
        return self.k


def levels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Supports of all edges and levels at which peeling takes them: bounds that sink in dense graphs, else edges one after the other."""
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    graph = Bounds(len(ids), place[: len(src)], place[len(src) :], np.zeros(len(src), np.int64), np.ones(len(src), bool))
    if not graph.dense:
        return peel_levels(src, dst)
    support = graph.counts()
    graph.k = support.copy()
    return support, graph.sink(0, support, 0, True)


def peel_levels(src: np.ndarray, dst: np.ndarray, level: int = 0, bound: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Supports of the own edges (default: all) and levels at which peeling takes them, from `level` on.

    An own edge falls when so few of its triangles are left, or at its bound; the others fall at their bounds.
    """
    graph = Triangles(src, dst)
    own = np.ones(graph.m, bool) if own is None else own
    support = np.zeros(graph.m, np.int64)
    support[own] = graph.counts(np.flatnonzero(own))
    most = np.iinfo(np.int64).max
    bound = np.full(graph.m, most) if bound is None else bound
    left, levels, todo, falling = np.where(own, support, most), np.zeros(graph.m, np.int64), np.ones(graph.m, bool), np.zeros(graph.m, bool)
    wait, k, falls = np.count_nonzero(own), level, np.empty(0, np.int64)
    while wait:
        if not len(falls):
            least = np.minimum(left, bound)
            k = max(k, int(least[todo].min()))
            falls = np.flatnonzero(todo & (least <= k))
        levels[falls], todo[falls], falling[falls] = k, False, True
        wait -= np.count_nonzero(own[falls])
        hit = []
        for e, f, g in graph.of(falls) if wait else ():
            # A triangle that loses several edges at once counts by the first of them.
            first = ~((falling[f] & (f < e)) | (falling[g] & (g < e)))
            f, g = f[first], g[first]
            less = np.concatenate([f[todo[f] & own[f]], g[todo[g] & own[g]]])
            np.subtract.at(left, less, 1)
            hit.append(less[left[less] <= k])
        falling[falls] = False
        graph.remove(falls)
        falls = np.unique(np.concatenate(hit)) if hit else falls[:0]
    return support, levels
