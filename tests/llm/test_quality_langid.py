import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sylvan.llm import langid, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts(r, n):
    good = lambda: " ".join("".join(r.choices("abcdefghijklm", k=r.randint(2, 9))) + r.choice(["", ".", "\n"]) for _ in range(r.randint(30, 200)))
    return [good() for _ in range(n)]


def mcd(x, alpha=quality.ALPHA, steps=quality.STEPS):
    """The same estimate in numpy: medians and quartiles, two starts, concentration steps on distance cells."""
    n, floors = len(x), np.array(list(quality.STATS.values()), float)
    share = lambda a, s: np.sort(a)[int(np.ceil(len(a) * s)) - 1]
    mid = np.array([share(c, 0.5) for c in x.T])
    iqr = np.maximum(floors, [share(c, 0.75) - share(c, 0.25) for c in x.T])
    y = x - mid
    estimate = lambda m, s: (m, s + np.diag(floors**2))
    clip = np.clip(y, -np.ceil(1.5 * iqr), np.ceil(1.5 * iqr))
    starts = [estimate(np.zeros(5), np.diag((iqr / 1.349) ** 2)), estimate(clip.mean(0), np.cov(clip.T, bias=True))]
    cells = lambda e: np.floor(64 * np.log(distance(y, e) + 1e-6))
    distance = lambda y, e: np.einsum("ij,jk,ik->i", y - e[0], np.linalg.inv(e[1]), y - e[0])
    for _ in range(steps):
        following = []
        for e in starts:
            c = cells(e)
            held = y[c <= share(c, alpha)]
            following.append(estimate(held.mean(0), np.cov(held.T, bias=True)))
        starts = following
    best = min(starts, key=lambda e: np.linalg.slogdet(e[1])[1])
    cut = np.exp((share(cells(best), alpha) + 1) / 64) / quality.ALPHA_QUANTILE
    return distance(y, best) / cut


def test_verdicts_against_brute_force(spark):
    r = random.Random(8)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts(r, 150))]
    rows += [(1000 + i, t.replace(" ", "### ") if i < 5 else t, "en", None) for i, t in enumerate(texts(r, 90))]
    rows += [(2000 + i, t, "fr", f"s{i % 4}") for i, t in enumerate(texts(r, 80))] + [(3000 + i, t, None, "x") for i, t in enumerate(texts(r, 7))]
    line = "a line that comes again and again in this text"
    rows += [(4000, None, "en", "a"), (4001, "", "en", "a"), (4002, f"{line}\n" * 9, "en", "a"), (None, "w " * 30_000, "en", "a"), (5, "repeated id " * 3, "en", "a"), (4003, "#" * 5000 + " x" * 30, "en", "a")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, lang string, source string, _x0 string").repartition(3)
    got = quality.quality_verdicts(df).collect()
    assert len(got) == len(rows)
    found = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got), key=repr)
    assert found == sorted(((i, *base(t)) for i, t, _, _ in rows), key=repr)
    groups = {}
    for i, t, lang, source in rows:
        b = base(t)
        if not b[5]:
            key = ("en", source) if lang == "en" else (lang or "few",)
            lines = len([x for x in t.split("\n") if WORD.search(x)])
            v = [np.log(1 + b[0]), np.log(b[1] / b[0]), np.sqrt(b[2] / b[1]), np.sqrt(b[3] / lines), np.sqrt(b[4] / b[0])]
            groups.setdefault(key, []).append((i, np.floor(np.array(v) * 1000 + 0.5)))
    by_id = {x.doc_id: x for x in got if not x.base_failed}
    for key, own in groups.items():
        if len(own) < quality.LEAST:
            assert all(by_id[i].kept and by_id[i].distance is None for i, _ in own), key
            continue
        want = mcd(np.array([v for _, v in own]))
        for (i, _), d in zip(own, want, strict=True):
            assert by_id[i].distance == pytest.approx(d, rel=1e-6), (key, i)
            assert by_id[i].kept == (d <= quality.CUTOFF)
    assert not any(by_id[1000 + i].kept for i in range(5)) and sum(x.kept for x in by_id.values()) > 0.9 * len(by_id)
    assert quality.quality_verdicts(df.limit(0)).collect() == []


def test_kernel_is_the_definition():
    model = langid.fit([langid.grams(t) for t in ("one two three", "un deux trois", "two one", "trois un")], ["en", "fr", "en", "fr"], landmarks=4)
    sets = lambda t: {f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    chosen = ["one two three", "un deux trois", "two one", "trois un"]
    for t in ("one deux", "three trois"):
        got = model.kernel([langid.grams(t.upper())])[0]
        want = [len(sets(t) & sets(c)) / np.sqrt(len(sets(t)) * len(sets(c))) for c in chosen]
        assert got == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy_and_blank_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 -- !!", "en", "s", 0), (None, "The thing", None, None, None)], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(more)).collect()}
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [i for i in langs if got[i].held_out]
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (10**6, 10**6 + 1)) and None in got
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels(docs_of):
    assert {r.lang_pred for r in langid.identify(docs_of([(1, "abc"), (2, "def"), (3, "x")], lang=None)).collect()} == {"und"}
    assert langid.identify(docs_of([])).collect() == []


def test_long_text_in_pieces(monkeypatch):
    text = "ab cd éf " * 50
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "PIECE", 16)
    assert (langid.grams(text) == whole).all()


@pytest.mark.parametrize("kind", ["exact", "near"])
def test_copies_do_not_take_a_group_over(spark, kind):
    r = random.Random(11)
    own, copied = texts(r, 120), " ".join(texts(r, 1))
    rows, none = [(i, t, "en", "0") for i, t in enumerate(own)], len(own)
    for percent in (60, 76, 90):
        rows += [(i, t, "en", str(percent)) for i, t in enumerate(own)]
        for k in range(none * percent // (100 - percent)):
            rows.append((1000 + k, copied + (" and" * r.randint(0, 2) + " w" + "x" * r.randint(0, 6) if kind == "near" else ""), "en", str(percent)))
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).where("not base_failed").toPandas()
    lost = got[~got.kept].groupby("source").doc_id.apply(lambda ids: (ids < 1000).sum()).to_dict()
    kept = {s: (g.kept[g.doc_id >= 1000]).all() for s, g in got.groupby("source")}
    assert all(lost.get(str(p), 0) <= lost.get("0", 0) + 2 for p in (60, 76, 90)), lost
    assert all(kept.values())


def test_repeated_lines_or_passages_alone_reject(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklm", k=6))
    short = [f"{word()} {word()} {word()}" for _ in range(15)]
    again = r.sample(short, 15) + r.sample(short, 15)
    heading = ["abcabc defdef", *(" ".join(word() for _ in range(14)) for _ in range(5)), "abcabc defdef"]
    words = texts(r, 1)[0].replace("\n", "").split() + texts(r, 1)[0].replace("\n", "").split()
    n = len(words) * 28 // 172  # 2 n of n + len(words) words
    rows = [(i, t, "en", "a") for i, t in enumerate(texts(r, 200))] + [(1000, "\n".join(again), "en", "a"), (1001, "\n".join(heading), "en", "a"), (1002, " ".join(words + words[:n]), "en", "a")]
    got = {x.doc_id: x for x in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert 2 * got[1000].n_dup_lines == 30 and got[1001].n_dup_lines == 1 and got[1002].n_dup_lines == 0
    assert not any(got[i].base_failed for i in (1000, 1001, 1002))
    assert [got[i].kept for i in (1000, 1001, 1002)] == [False, True, False]


def test_few_short_texts_do_not_stand_for_a_language(docs_of):
    docs = docs_of([(i, f"{'xyz zyx ' * 1100}{i}") for i in range(6)] + [(9, "123"), (10, "short one")], lang="xx").unionByName(docs_of([(20 + i, f"une {i}") for i in range(3)], lang="fr"))
    model = langid.train(docs)
    assert model.languages == ["fr", "xx"]
    assert model.predict(["zyx xyz zyx"])[0] == ["xx"]


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i) * 9} abc", f"l{i}") for i in range(520)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), landmarks=16)
    assert len(model.languages) == 520


def test_with_all_landmarks_it_is_kernel_ridge_regression():
    """With every text as a landmark the Nystrom solution is that of the whole kernel matrix."""
    r = random.Random(3)
    texts_of = {"a": "stone water river mountain", "b": "pierre eau fleuve montagne", "c": "stein wasser fluss berg"}
    labels = [x for x in texts_of for _ in range(7)]
    learned = [" ".join(r.choices(texts_of[x].split(), k=5)) + f" {chr(97 + i)}" for i, x in enumerate(labels)]
    sets = [langid.grams(t) for t in learned]
    model = langid.fit(sets, labels, landmarks=len(sets))
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    whole = np.array([[kernel(a, b) for b in sets] for a in sets])
    for c, lang in enumerate(model.languages):
        y = np.array([1.0 if x == lang else -1.0 for x in labels])
        weight = np.where(y > 0, 0.5 / labels.count(lang), 0.5 / (len(labels) - labels.count(lang))) * len(labels)
        alpha = np.linalg.solve(whole + langid.RIDGE * len(labels) * np.diag(1 / weight), y)
        for t in ("stone eau fluss", "river berg berg", "montagne"):
            want = sum(a * kernel(langid.grams(t), s) for a, s in zip(alpha, sets, strict=True))
            names, scores = model.predict([t])
            got = (model.kernel([langid.grams(t)]) @ model.weights)[0]
            assert got[c] == pytest.approx(want, abs=2e-3)
            assert names == [model.languages[int(got.argmax())]] and scores[0] == pytest.approx(min(1, max(0, (got.max() + 1) / 2)))


def test_ties_go_to_the_first_language():
    sets = [langid.grams("same text")] * 2
    model = langid.fit(sets, ["y", "x"])
    assert model.predict(["same text", "other"])[0] == ["x", "x"]


def test_the_sample_is_bounded_in_characters(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 10)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 5000)
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda sets, labels, landmarks=0: fitted.append(labels))
    docs = docs_of([(i, f"{'word ' * 400}{i}") for i in range(40)] + [(100, "same text") for _ in range(50)], lang="xx")
    langid.train(docs.unionByName(docs_of([(i, "z" * 9000 + " " + "y" * i) for i in range(3)], lang="long")))
    assert fitted[0].count("long") == 1 and 1 <= fitted[0].count("xx") <= 4


def test_a_very_long_text_through_the_query(docs_of):
    pairs = [(i, "the river and the stone") for i in range(9)] + [(50, "river stone the " * 80_000)]
    rows = {r.doc_id: r for r in langid.identify(docs_of(pairs)).collect()}
    assert rows[50].lang_pred == "en" and rows[50].score > 0.5
