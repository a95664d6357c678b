"""Token counts with a linear longest-match automaton.

A word is cut greedily: the longest vocabulary piece that starts it, then the longest continuation piece, and so on; a word
that can't be cut to its end is one unknown token. A trie over the pieces has, for each node, a failure link to the node
at which matching goes on when the next character has no branch, and the number of pieces that are thereby complete. One
pass over a word's characters gives the number of its pieces; the pieces themselves are never built.

A byte-level vocabulary file is read as word pieces: its pieces behind a space start words, the others go on; pieces that aren't
whole characters are left out.

Cases: a null or empty text has no words and no tokens; a very long word or text takes time in proportion to its length; there
are no ties, as the longest piece is taken; repeated rows count each; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words: runs of word characters, and other visible characters one by one.
WORDS = re.compile(r"\w+|[^\w\s]")
#: Words whose counts a worker remembers, and the longest that it does.
MEMORY, WORD = 500_000, 64
COUNTS = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"


class LongestMatch:
    """The automaton of a vocabulary: pieces that start a word, and pieces that go on (without their mark)."""

    START, ON = 0, 1  # the two roots

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, words in ((self.START, starts), (self.ON, continuations)):
            for word in words:
                at = root
                for c in word:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = to
                piece[at] = at > self.ON
        #: For each node: where to go on (-1: nowhere), and how many pieces end by doing so.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        todo = deque((self.START, self.ON))
        while todo:
            up = todo.popleft()
            for c, v in self.next[up].items():
                if piece[v]:
                    self.fail[v], self.popped[v] = self.ON, 1
                else:
                    at, count = self.fail[up], self.popped[up]
                    while at >= 0 and c not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.popped[v] = self.next[at][c], count
                todo.append(v)

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it can't be cut."""
        nodes, fail, popped = self.next, self.fail, self.popped
        at, count = self.START, 0
        for c in word:
            to = nodes[at].get(c)
            while to is None:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = nodes[at].get(c)
            at = to
        while at != self.ON:
            count += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return count


class Counts(dict):
    """Words to pieces, an unknown word as 1 + UNKNOWN, so that one sum gives both totals."""

    UNKNOWN = 1 << 40

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word) or 1 + self.UNKNOWN
        if len(word) <= WORD:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = n
        return n


def byte_level_pieces(path: str) -> tuple[list[str], list[str]]:
    """Starts (pieces behind a space) and continuations of a byte-level vocabulary file; pieces that aren't text are left out."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    to_byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    starts, on = [], []
    for token in json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]:
        try:
            text = bytes(to_byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text[:1] == " " and text[1:] and not re.search(r"\s", text[1:]):
            starts.append(text[1:])
        elif text and not re.search(r"\s", text):
            on.append(text)
    return starts, on


_counts: dict[str, Counts] = {}


def counter_of(path: str) -> Counts:
    """One for each worker process and vocabulary."""
    if path not in _counts:
        _counts[path] = Counts(LongestMatch(*byte_level_pieces(path)))
    return _counts[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words as one each) and n_unknown of the whole text of every row."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = counter_of(path)
        for pdf in batches:
            words = [WORDS.findall(t) if t else [] for t in pdf.text]
            sums = [sum(map(counts.__getitem__, w)) for w in words]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_words": [len(w) for w in words], "n_tokens": [s % Counts.UNKNOWN for s in sums], "n_unknown": [s // Counts.UNKNOWN for s in sums]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, COUNTS)
