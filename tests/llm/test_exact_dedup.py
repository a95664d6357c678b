import hashlib
import re

from sylvan.llm.exact_dedup import CuckooFilter, build_index, delete_digests, digests, exact_dedup, groups_of, keep_first


def brute(pairs):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs]
    out = []
    for (i, _), n in zip(pairs, norm, strict=True):
        ids = [j for (j, _), m in zip(pairs, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


PAIRS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (8, ""), (None, "a b"), (None, "only"), (3, "a b"), (11, "é x"), (12, "é x"), (13, "w " * 50_000)]


def test_against_brute_force(docs_of):
    got = [tuple(r) for r in exact_dedup(docs_of(PAIRS)).collect()]
    assert sorted(got, key=repr) == brute(PAIRS)
    assert exact_dedup(docs_of([])).collect() == []


def test_keep_first_keeps_columns(docs_of):
    docs = docs_of(PAIRS)
    out = keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "only"), (3, "a\tb"), (3, "a b"), (7, None), (9, "a b "), (11, "é x"), (12, "é x"), (13, "w " * 50_000)]


def test_hot_group(docs_of):
    pairs = [(i, "same text" if i % 3 else f"t{i}") for i in range(6000)]
    rows = exact_dedup(docs_of(pairs), bucket_rows=500).collect()
    assert len(rows) == 6000 and sum(r.kept for r in rows) == 2001
    assert {r.group_size for r in rows} == {1, 4000}


def test_filter_resizes_deletes_and_never_misses():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    f = CuckooFilter(2)
    for i, k in enumerate(keys):
        f.insert(k, keys[:i])
    assert all(k in f for k in keys) and f.cells >= 512
    for k in keys[:1500]:
        f.delete(k)
    assert all(k in f for k in keys[1500:]) and sum(k in f for k in keys[:1500]) < 30
    again = CuckooFilter.from_bytes(f.cells, f.to_bytes())
    assert all(k in again for k in keys[1500:])


def test_deletion_from_the_index(docs_of):
    hashed = digests(docs_of([(1, "a"), (2, "a"), (3, "b"), (4, "c")]))
    index = build_index(hashed, 2)
    left = delete_digests(index, hashed.where("doc_id = 3"), 2)
    assert sorted((r.keep_id, r.group_size) for r in groups_of(left).collect()) == [(1, 2), (4, 1)]
