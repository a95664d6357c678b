"""What Python workers hold, and that they give it back."""

import subprocess
import sys

import numpy as np
import pandas as pd
import pyarrow as pa

from sylvan.llm import common, langid, ngram_join, shingles

TEXTS = [f"some words of text {i} and {i * i} more {'abcdefgh'[i % 8]} of them here" for i in range(200)]

HELD = """
import re
from sylvan.llm.common import give_back
def held():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
parts = [bytes(1 + i % 7000) for i in range(30_000)]
parts = parts[::300]  # what stays keeps the heap from shrinking at its end
before = held()
give_back()
print(before, held())
"""


def test_freed_memory_goes_back():
    before, after = map(int, subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout.split())
    assert before - after > 50


class Table:
    """Takes the place of a DataFrame and catches the function that its workers would run."""

    def __init__(self):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def groupBy(self, *keys):
        return self

    def mapInPandas(self, run, schema):
        return run

    applyInPandas = mapInPandas


def test_workers_give_back_when_a_task_is_done(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append(1))
    orders = shingles.Orders(np.zeros(0, np.uint64), np.zeros(0))
    run = ngram_join.run_index(Table(), ngram_join._sets_of_texts, orders, 0, 1)
    batches = [pd.DataFrame({"text": TEXTS}), pd.DataFrame({"text": TEXTS})]
    index = pd.concat(list(run(iter(batches))))
    assert len(index) and len(said) == 1
    ngram_join.chains(Table())((0,), index)
    assert len(said) == 2


def test_n_grams_of_few_texts_are_held_at_once(monkeypatch):
    model = langid.fit([langid.grams(t) for t in TEXTS[:20]], ["a", "b"] * 10)
    whole = model.kernel([langid.grams(t) for t in TEXTS]) @ model.weights
    most, kernel = [], langid.Model.kernel
    monkeypatch.setattr(langid.Model, "kernel", lambda self, texts: most.append(len(texts)) or kernel(self, texts))
    names, scores = model.predict(TEXTS[:100] + [None, "12"] + TEXTS[100:])
    assert max(most) == langid.BATCH and sum(most) == len(TEXTS)
    assert names[100:102] == ["und", "und"] and scores[100:102] == [0.0, 0.0]
    assert names[:100] + names[102:] == [model.languages[k] for k in whole.argmax(1)]
    np.testing.assert_allclose(scores[:100] + scores[102:], np.clip((whole.max(1) + 1) / 2, 0, 1), rtol=1e-6)


def test_the_draw_starts_no_workers_of_another_kind(spark, docs_of, monkeypatch):
    docs = docs_of(enumerate(TEXTS)).unionByName(docs_of(enumerate(TEXTS, 1000), lang="xx"))
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or create(self, data, *a, **k))
    assert langid.train(docs).languages == ["en", "xx"] and made == [pa.Table, pa.Table]
