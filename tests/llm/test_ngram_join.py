import random
import re

import numpy as np
import pytest

from sylvan.llm import ngram_join, shingles
from sylvan.llm.ngram_join import component_table, keep_one
from sylvan.llm.shingles import shingle_sets, signature
from sylvan.operators.local import labels


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(pairs):
    sets = [brute_set(t) for _, t in pairs]
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def words(r, n):
    return [r.choice("abcdefghijklmnop") + str(r.randint(0, 999)) for _ in range(n)]


def edited(r, base, edits):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = "new" + str(r.randint(0, 10**6))
    return " ".join(w)


def make(seed):
    """Near copies around the limit, chains, a shared passage, exact copies, short texts."""
    r = random.Random(seed)
    texts, passage = [], " ".join(words(r, 60))
    for _ in range(4):
        base = words(r, r.randint(60, 150))
        texts += [edited(r, base, r.randint(0, 5)) for _ in range(14)]
    chain = words(r, 120)
    for k in range(12):
        chain = chain[4:] + words(r, 4)
        texts.append(" ".join(chain))
    texts += [f"{passage} {' '.join(words(r, n))}" for n in (3, 5, 8, 10, 12, 40, 80) for _ in range(6)]
    texts += [passage.upper(), passage, "one two", "One  TWO", "a b c d", "a b c d e", "a b c d e f", "b c d e f", None, "", " \n", "x"]
    r.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (5, "entirely another text of a repeated id here"), (7000, "v " * 5000), (7001, " ".join(words(r, 30000)))]


def test_components_are_those_of_all_pairs(docs_of):
    pairs = make(8)
    got = sorted(map(tuple, component_table(docs_of(pairs)).collect()), key=repr)
    assert got == brute(pairs)


@pytest.mark.parametrize("block", [2000, 8000])
def test_components_by_blocks(docs_of, monkeypatch, block):
    """Cells over the bound are refined, joined in blocks, and across blocks."""
    calls = []
    across = ngram_join._links_across
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(ngram_join, "_links_across", lambda *a: calls.append(1) or across(*a))
    pairs = make(9)
    got = sorted(map(tuple, component_table(docs_of(pairs)).collect()), key=repr)
    assert got == brute(pairs) and calls


def test_links_of_a_task_span_the_components_of_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(1, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[r.integers(0, 60, r.integers(0, 9))] = r.integers(1, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(own[: r.integers(45, 61)]))
    orders = shingles.Orders(np.sort(base)[:30], np.arange(30.0) + 4)
    linked = [(i, j) for i in range(60) for j in range(i) if 5 * len(a := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(a))]
    found = shingles.links_within(sets, orders)
    left, right = np.arange(0, 60, 2), np.arange(1, 60, 2)
    halves = [(left[i], left[j]) for i, j in shingles.links_within([sets[k] for k in left], orders)]
    halves += [(right[i], right[j]) for i, j in shingles.links_within([sets[k] for k in right], orders)]
    halves += shingles.links_between(sets, np.arange(60), left, right, orders)

    def parts(pairs):
        a, b = np.array(pairs).T
        return [x.tolist() for x in labels(np.concatenate([a, np.arange(60)]), np.concatenate([b, np.arange(60)]))]

    assert parts(linked) == parts(found) == parts(halves)
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in linked}


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK", 64)
    r = random.Random(2)
    texts = ["", None, "z" * 300, " ".join(words(r, 200)), "a\tb\nc\x0bd\x0ce\rf", "y" * 200 + " " + "Q " * 90, "ÄÖ é " * 40]
    small = list(shingle_sets(texts))
    monkeypatch.setattr(shingles, "CHUNK", 1 << 20)
    for t, a, b in zip(texts, small, shingle_sets(texts), strict=True):
        assert (a == b).all() and len(a) == len(brute_set(t))
    assert signature(small[3]) != signature(small[4])


def test_keep_one(docs_of):
    pairs = make(3)
    docs = docs_of(pairs)
    out = keep_one(docs)
    assert out.columns == docs.columns
    want = {i for _, _, i in brute(pairs) if i is not None}
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == want
    assert keep_one(docs_of([])).collect() == [] and component_table(docs_of([])).collect() == []


def test_repeated_ids_keep_each_component(docs_of):
    """Two unlinked texts under one doc_id are two components; both stay."""
    text, other = " ".join(map(str, range(40))), " ".join(map(str, range(100, 150)))
    docs = docs_of([(1, text), (1, other), (2, text), (3, None), (4, None), (None, "x y z"), (None, "x  y z")])
    kept = sorted([(r.doc_id, r.text) for r in keep_one(docs).collect()], key=repr)
    assert sorted(kept, key=repr) == sorted([(1, text), (1, other), (3, None), (4, None), kept[-1]], key=repr) and kept[-1][0] is None


def test_one_group_holds_most_rows(docs_of):
    """Near copies around the limit, most of all rows, in a number that pairs of rows would show."""
    r = random.Random(11)
    base = words(r, 60)
    pairs = [(k, edited(r, base, r.randint(0, 4))) for k in range(500)] + [(500 + k, " ".join(words(r, 30))) for k in range(100)]
    assert sorted(map(tuple, component_table(docs_of(pairs)).collect()), key=repr) == brute(pairs)


def test_similar_sets_share_prefixes_and_runs():
    """Of sets at the limit of similarity every order's prefixes and runs have an element in common."""
    r = np.random.default_rng(1)
    for n in [*range(4, 60), 333]:
        for _ in range(12):
            shared = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            own, other = r.multinomial(len(shared) // 4, [0.5, 0.5])
            a = np.unique(np.concatenate([shared, r.integers(0, 1 << 62, own).astype(np.uint64)]))
            b = np.unique(np.concatenate([shared, r.integers(0, 1 << 62, other).astype(np.uint64)]))
            assert 5 * len(shared) >= 4 * len(np.union1d(a, b))
            orders = shingles.Orders(np.sort(shared[::3]), r.integers(4, 99, len(shared[::3])).astype(float))
            for k in range(shingles.ORDERS):
                assert len(np.intersect1d(orders.prefix(a, k), orders.prefix(b, k)))
                assert len(np.intersect1d(orders.runs(a, k), orders.runs(b, k)))
