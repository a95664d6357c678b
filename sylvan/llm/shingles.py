"""Word shingles as sets of 64-bit hashes, the global orders of all shingles, and the join of sets that fit in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity NUMERATOR / DENOMINATOR
ORDERS = 3
#: Shingles in a run, and the least set that has runs.
RUN, RUN_LEAST = 3, 12
#: Bytes of text hashed at a time.
CHUNK = 1 << 18
U = np.uint64
_POWER, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * _MULTIPLIERS[0]
    x = (x ^ (x >> U(27))) * _MULTIPLIERS[1]
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * _POWER)
_powers = {"n": 0, "up": np.zeros(0, U), "down": np.zeros(0, U)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, CHUNK + (1 << 12))
        for k, base in (("up", _POWER), ("down", _INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.cumprod(x)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word, A-Z lower-cased. Hashes are differences of one polynomial over all bytes."""
    b = np.frombuffer(data, np.uint8)
    b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * _MULTIPLIERS[2]), starts


def _set_of(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text, from the hashes of its words."""
    n = len(words)
    if n < WORDS:
        return mix((words * _MULTIPLIERS[:n]).sum(keepdims=True) + U(n)) if n else words
    x = words[: n - WORDS + 1] * _MULTIPLIERS[0]
    for k in range(1, WORDS):
        x = x + words[k : n - WORDS + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mix(x + U(WORDS)))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The set of each text in turn. Texts are hashed in chunks, longer ones in pieces that end between words."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        words, starts = _word_hashes(b"\n".join(held))
        at = np.cumsum([0, *(len(x) + 1 for x in held)])
        cuts = np.searchsorted(starts, at)
        for k in range(len(held)):
            yield _set_of(words[cuts[k] : cuts[k + 1]])

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if size + len(data) > CHUNK and held:
            yield from flush()
            held, size = [], 0
        if len(data) > CHUNK:
            parts, start = [], 0
            while start < len(data):
                stop = start + CHUNK
                if stop < len(data):
                    cut = max(data.rfind(c, start, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                    if cut < 0:
                        after = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := data.find(c, stop)) >= 0]
                        cut = min(after, default=len(data) - 1)
                    stop = cut + 1
                parts.append(_word_hashes(data[start:stop])[0])
                start = stop
            yield _set_of(np.concatenate(parts))
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from flush()


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    n = U(len(shingles))
    pair = np.array([mix(shingles * _MULTIPLIERS[3]).sum(), mix(shingles ^ _MULTIPLIERS[4]).sum()]) + n
    return tuple(mix(pair).view(np.int64).tolist())


class Orders:
    """The global orders: by the class of frequency, then by a hash of the order's own (a bijection, so no two shingles tie)."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens = tokens
        self.level = np.minimum(np.log2(counts + 1), 62).astype(np.int8)

    def first(self, shingles: np.ndarray, order: int, size: int) -> np.ndarray:
        """The first shingles of a set, in the order."""
        key = mix(shingles ^ _MULTIPLIERS[order])
        if len(self.tokens):
            at = np.searchsorted(self.tokens, shingles)
            at[at == len(self.tokens)] = 0
            known = self.tokens[at] == shingles
            if known.any():
                return shingles[np.lexsort((key, np.where(known, self.level[at], 0)))[:size]]
        if size < len(key):
            low = np.argpartition(key, size - 1)[:size]
            return shingles[low[np.argsort(key[low])]]
        return shingles[np.argsort(key)]

    def prefix(self, shingles: np.ndarray, order: int) -> np.ndarray:
        """Of two similar sets, the prefixes have a shingle in common."""
        n = len(shingles)
        return self.first(shingles, order, n - -(-NUMERATOR * n // DENOMINATOR) + 1)

    def runs(self, shingles: np.ndarray, order: int) -> np.ndarray:
        """Hashes of every RUN shingles that follow each other in the order, of which two similar sets have one in common.

        At most d = n / 5 shingles of a set of n are missing in a similar set, and few enough of the other's are missing in it
        that the first RUN * (d + 1) hold RUN shingles that both have and that nothing parts in either. That needs nine
        shared shingles; small sets give single shingles, those of sizes between give both.
        """
        n = len(shingles)
        out = [shingles[:0]]
        if n < RUN_LEAST * DENOMINATOR // NUMERATOR + 1:
            out.append(self.prefix(shingles, order))
        if n >= RUN_LEAST:
            own = self.first(shingles, order, RUN * (n * (DENOMINATOR - NUMERATOR) // DENOMINATOR + 1))
            x = own[: len(own) - RUN + 1] * _MULTIPLIERS[0]
            for k in range(1, RUN):
                x = x + own[k : len(own) - RUN + 1 + k] * _MULTIPLIERS[k]
            out.append(mix(x))
        return np.concatenate(out)


def similar_sizes(a, b):
    return NUMERATOR * np.maximum(a, b) <= DENOMINATOR * np.minimum(a, b)


def linked(a: np.ndarray, b: np.ndarray, orders: Orders) -> bool:
    """Whether two sets are similar enough: the prefixes in every order first, then the sets."""
    if not similar_sizes(len(a), len(b)):
        return False
    for k in range(ORDERS):
        if not len(np.intersect1d(orders.prefix(a, k), orders.prefix(b, k), assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


class Postings:
    """The rows that hold a token, for the tokens of some rows."""

    def __init__(self, tokens: list[np.ndarray], rows: np.ndarray):
        token, row = np.concatenate(tokens), np.repeat(rows, [len(t) for t in tokens])
        order = np.argsort(token, kind="stable")
        self.token, self.row = token[order], row[order]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.token, tokens), np.searchsorted(self.token, tokens, "right")
        count = high - low
        ends = np.cumsum(count)
        return self.row[np.repeat(low - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Neighbours:
    """Finds the sets among some rows that are similar to a given one.

    A candidate shares a token of the prefixes in every order: the filters are intersected before a set is compared.
    """

    def __init__(self, sets: list[np.ndarray], prefixes: list[list[np.ndarray]], rows: np.ndarray):
        self.sets, self.prefixes, self.count = sets, prefixes, len(rows)
        self.sizes = np.array([len(s) for s in sets])
        self.postings = [Postings([own[r] for r in rows.tolist()], rows) for own in prefixes]

    def similar(self, x: int, among: np.ndarray) -> np.ndarray:
        """The rows that are similar to row x, of those that the mask holds."""
        left = among & similar_sizes(self.sizes, self.sizes[x])
        for own, postings in zip(self.prefixes, self.postings, strict=True):
            seen = np.zeros(len(left), bool)
            seen[postings.of(own[x])] = True
            left &= seen
        rows = np.flatnonzero(left)
        if not len(rows):
            return rows
        one, sizes = self.sets[x], self.sizes[rows]
        tokens = np.concatenate([self.sets[r] for r in rows.tolist()])
        at = np.minimum(np.searchsorted(one, tokens), len(one) - 1)
        both = np.add.reduceat(one[at] == tokens, np.cumsum(sizes) - sizes, dtype=np.int64)
        return rows[DENOMINATOR * both >= NUMERATOR * (len(one) + sizes - both)]


def prefixes_of(sets: list[np.ndarray], orders: Orders) -> list[list[np.ndarray]]:
    return [[orders.prefix(s, k) for s in sets] for k in range(ORDERS)]


def links_within(sets: list[np.ndarray], orders: Orders) -> list[tuple[int, int]]:
    """Links that span the components of the sets: every set reached is compared with those not reached yet."""
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        return [(0, 1)] if linked(*sets, orders) else []
    prefixes = prefixes_of(sets, orders)
    free = np.ones(len(sets), bool)
    near = Neighbours(sets, prefixes, np.arange(len(sets)))
    out: list[tuple[int, int]] = []
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        reached = [first]
        while reached:
            x, left = reached.pop(), int(free.sum())
            if not left:
                return out
            if 2 * left < near.count:
                near = Neighbours(sets, prefixes, np.flatnonzero(free))
            found = near.similar(x, free)
            free[found] = False
            out += [(x, y) for y in found.tolist()]
            reached += found.tolist()
    return out


def links_between(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, orders: Orders) -> list[tuple[int, int]]:
    """Links from rows in left to rows in right that join different components (of the given ones and the links before)."""
    out: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return out
    component, among = component.copy(), np.zeros(len(sets), bool)
    among[right] = True
    near = Neighbours(sets, prefixes_of(sets, orders), right)
    for x in left.tolist():
        for y in near.similar(x, among & (component != component[x])).tolist():
            if component[y] != component[x]:
                component[component == component[y]] = component[x]
                out.append((x, y))
    return out
