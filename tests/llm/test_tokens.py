import random
import re
import time
import zlib

import numpy as np
import pytest

from sylvan.llm import packing, sentencepiece_nbest, token_counts
from sylvan.llm.token_counts import LongestMatch

TEXTS = ["", " ", "hello  world", "Straße ▁ é́ \U0001f600\n\ttabs", "a" * 300, "the and of the in!! 123", "  lead", "x ▁▁ y▁", "\x1f odd \x85 space　wide"]


def greedy(word, starts, on):
    out, at, own = 0, 0, starts
    while at < len(word):
        n = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in own), default=0)
        if not n:
            return 0
        out, at, own = out + 1, at + n, on
    return out


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_greedy(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abc") for _ in range(r.randint(1, n)))
    starts, on = {word(5) for _ in range(6)}, {word(6) for _ in range(8)}
    automaton = LongestMatch(starts, on)
    for _ in range(300):
        w = word(14)
        assert automaton.count(w) == greedy(w, starts, on), (w, starts, on)


def test_counts_of_documents(docs_of):
    starts, on = map(set, token_counts.byte_level_pieces(token_counts.vocabulary_path()))
    pairs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "abc"), (3, "abc")]
    got = sorted(map(tuple, token_counts.token_counts(docs_of(pairs)).collect()), key=repr)
    want = []
    for i, t in pairs:
        cuts = [greedy(w, starts, on) for w in re.findall(r"\w+|[^\w\s]", t or "")]
        want.append((i, len(cuts), sum(c or 1 for c in cuts), cuts.count(0)))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(docs_of([])).collect() == []


def every_score(own, whole, n):
    """The n best scores of all segmentations, by dynamic programming over sorted lists of scores."""
    best = [[0]] + [[] for _ in whole]
    longest = max(map(len, own.scores))
    for j in range(1, len(whole) + 1):
        found = []
        for i in range(max(0, j - longest), j):
            s = own.scores.get(whole[i:j], sentencepiece_nbest.BYTE_SCORE * len(own.spelled(whole[i])) if j == i + 1 else None)
            found += [] if s is None else [s + b for b in best[i]]
        best[j] = sorted(found, reverse=True)[:n]
    return [s / sentencepiece_nbest.SCALE for s in best[-1]]


ODD = ["the theme in others, it is", "a" * 90, "日本語テキスト 日本", "e\nf\nthe\n\n\tof", "x, y. (the) ...", "é̀ x", "0123 4567", "in of", "the  on", "a▁b ▁▁", "zq 7"]


@pytest.mark.parametrize("seed", range(4))
def test_nbest_is_that_of_all_paths(seed):
    own = sentencepiece_nbest.pieces_of(sentencepiece_nbest.vocabulary_path())
    r = random.Random(seed)
    texts = ODD if not seed else ["".join(r.choices("ateinor  ,.\n▁日", k=r.randint(1, 60))) for _ in range(25)]
    for text in texts:
        whole = "▁" + text.replace("▁", sentencepiece_nbest.OWN_MARK).replace(" ", "▁")
        for n in (1, 4, 7):
            got = own.nbest(text, n)
            assert [s for s, _ in got] == every_score(own, whole, n), text
            assert len({ids for _, ids in got}) == len(got)
            assert all(own.decode(ids) == text for _, ids in got)


def test_long_texts_of_any_kind_take_linear_time():
    own = sentencepiece_nbest.pieces_of(sentencepiece_nbest.vocabulary_path())
    r = random.Random(1)
    letters = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    lines = "\n".join("the quick brown fox jumps".split() * 5_000)
    for text in (letters, "a" * 20_000, lines, "中文字符測試" * 4_000, "\t" * 20_000, "&%" * 10_000):
        start = time.process_time()
        found = own.nbest(text)
        assert time.process_time() - start < 20
        assert len(found) == len({ids for _, ids in found}) and all(own.decode(ids) == text for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_round_trip(docs_of):
    pairs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (50, "w " * 3000)]
    docs = docs_of(pairs)
    encoded = sentencepiece_nbest.encode(docs, n=3)
    for rank in (0, 1):
        back = {r.doc_id: r.text for r in sentencepiece_nbest.decode(encoded.where(f"rank = {rank}")).collect()}
        assert all(back[i] == t for i, t in pairs if i in back) and len(back) >= len(pairs) - 2 * rank
    rows = {r.doc_id: r for r in sentencepiece_nbest.nbest_segmentations(docs).collect()}
    first = {r.doc_id: r for r in encoded.where("rank = 0").collect()}
    for i, r in rows.items():
        assert r.n_pieces == len(first[i].ids) and r.ids_crc32 == zlib.crc32(np.array(first[i].ids, "<u4").tobytes())
        assert r.scores == sorted(r.scores, reverse=True) and r.nbest_crc32[0] == r.ids_crc32 and len(r.nbest_crc32) == len(r.scores)
        assert r.decoded_crc32 == zlib.crc32((dict(pairs)[i] or "").encode())
    assert sentencepiece_nbest.nbest_segmentations(docs_of([])).collect() == []


def test_ids_word_by_word_are_the_tokenizers():
    own = packing.WordIds(packing.vocabulary_path())
    r = random.Random(3)
    odd = [chr(c) for c in [*range(0x21, 0x250), 0x3A3, 0x301, 0x130, 0xA0, 0x2028, 0x1F600]]
    spaced = [chr(c) for c in range(0x21, 0x250)] + [*" \n\t\x0b\x0c\r'"] * 20
    texts = [*TEXTS, *("".join(r.choices(odd, k=30)) for _ in range(300)), "it's we'll I'D <|endoftext|>"]
    texts += ["".join(r.choices(spaced, k=40)) for _ in range(600)] + ["".join(r.choices("aBé' ²½_9\n-", k=40)) for _ in range(300)]
    assert all(own.text(t) == own.encode(t) for t in texts)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    r = np.random.default_rng(1)
    lengths = r.integers(1, 400, 500)
    bins, offsets = packing.best_fit(lengths, 1000, 6, 250_000, (1, 1, 1), rule)
    for b in range(bins.max() + 1):
        own = bins == b
        assert lengths[own].sum() <= 1000 and own.sum() <= 6 and (lengths[own] ** 2).sum() <= 250_000
        order = np.argsort(offsets[own])
        assert (offsets[own][order] == np.concatenate(([0], np.cumsum(lengths[own][order])[:-1]))).all()


def test_packing_of_documents(docs_of):
    r = random.Random(4)
    pairs = [(i, "word " * r.randint(0, 900)) for i in range(300)] + [(900, None), (901, ""), (902, "long text " * 6000), (5, "again"), (5, "again"), (None, "no id")]
    out = packing.pack(packing.pieces(docs_of(pairs), packing.vocabulary_path()), group_pieces=100).toPandas()
    own = packing.WordIds(packing.vocabulary_path())
    want = []
    for i, t in pairs:
        ids = own.encode(t or "") + (1).to_bytes(4, "little")
        want += [(-1 if i is None else i, k // 16384, k // 4, len(ids[k : k + 16384]) // 4, zlib.crc32(ids[k : k + 16384])) for k in range(0, len(ids), 16384)]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int).to_numpy().tolist())) == sorted(want)
    for _, own_rows in out.groupby("sequence_id"):
        own_rows = own_rows.sort_values("offset")
        assert own_rows.offset.tolist() == [0, *own_rows.length.cumsum().tolist()[:-1]] and own_rows.length.sum() <= 4096
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 3
    assert packing.pack_documents(docs_of([])).collect() == []


def test_rounds_go_on_until_one_group_is_left(spark):
    rows = [(i, 0, 0, 1365, i) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), group_pieces=4).toPandas()
    assert sorted(out.doc_id) == list(range(3000)) and out.groupby("sequence_id").length.sum().max() <= 4096
    assert out.sequence_id.nunique() == 1000
