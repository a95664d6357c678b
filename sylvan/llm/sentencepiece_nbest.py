"""SentencePiece encoding and decoding with n-best segmentation.

Spaces become ▁, one is put in front, and a segmentation is a path through the lattice of vocabulary pieces. Pieces score
the logarithm of a Zipf law over their place in the vocabulary file, as whole multiples of 1 / SCALE, so that sums and ties are
exact. A forward Viterbi pass gives the best score of every prefix; these are exact heuristics for an A-star search backward
from the end, which pops complete paths from the best to the n-th. Partial paths are kept as links to the path behind them; a
position is expanded n times at most, as no path among the n best has a suffix beyond the n-th best of its position.

Where two neighbouring characters stand together in no piece, the lattice falls apart: it is searched chunk by chunk, and a
worker remembers short chunks. The n best paths of a text differ from the best one in its n - 1 chunks of smallest loss at
most, so only combinations of these chunks' n best paths are ranked. Characters without a piece, and a ▁ in the text itself,
are spelled in byte pieces.

Cases: a null text is empty; an empty text has no pieces and one path of score 0; a text with fewer paths than n gives what it
has; of paths of equal score the one found first, with the longest pieces at the end, comes first; a very long text needs time
and memory in proportion to its length, with or without spaces; repeated rows count each; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, NBEST = "▁", 4
#: Stands for a ▁ of the text, which has to be spelled in bytes; no valid text has it.
OWN_MARK = "\udfff"
#: Scores are multiples of 1 / SCALE. A byte piece scores below any other.
SCALE = 1 << 24
BYTE_SCORE = -20 * SCALE
#: A loss beyond any other, of chunks with a single path.
NEVER = 1 << 60
#: Characters of the chunks that a worker remembers, and the longest chunk that it keeps the n best of.
MEMORY, CHUNK = 6_000_000, 64
PATHS = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, scores array<double>, nbest_crc32 array<bigint>, decoded_crc32 bigint"


class Known(dict):
    """Chunks to numbers, under which the ids of the best path, its score and what the second best loses are kept."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.held = 0
        self.ids: list[bytes] = []
        self.score, self.loss = array("q"), array("q")
        self.nbest: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def __missing__(self, chunk: str) -> int:
        parts = self.pieces.parts(chunk)
        if len(parts) == 1:
            score, loss, ids = self.pieces.best_path(chunk)
        else:
            numbers = list(map(self.__getitem__, parts))
            score, loss = sum(self.score[k] for k in numbers), min(self.loss[k] for k in numbers)
            ids = b"".join([self.ids[k] for k in numbers])
        self[chunk] = number = len(self.ids)
        self.ids.append(ids)
        self.score.append(score)
        self.loss.append(loss)
        self.held += len(chunk)
        return number

    def best(self, chunk: str, n: int) -> list[tuple[int, bytes]]:
        """Scores and ids of the n best paths of a chunk."""
        found = self.nbest.get((chunk, n))
        if found is None:
            found = self.pieces.combined(self.pieces.parts(chunk), n)
            if len(chunk) <= CHUNK:
                self.nbest[chunk, n] = found
        return found


class Pieces:
    """Pieces of a vocabulary file with ids and scores."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)
        self.ids = {p.id_to_piece(i): i for i in range(p.get_piece_size()) if not special(i)}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        first = min(self.ids.values(), default=0)
        self.scores = {x: round(-math.log(i - first + 2) * SCALE) for x, i in self.ids.items()}
        self.matches, self.single = ahocorasick.Automaton(), {x for x in self.ids if len(x) == 1}
        for x, score in self.scores.items():
            self.matches.add_word(x, (len(x), score, self.ids[x]))
        self.matches.make_automaton()
        #: Neighbours within pieces; between any others the lattice falls apart.
        self.pairs = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}
        if any(x[1] == MARK and x[0] != MARK for x in self.pairs):
            raise ValueError("a piece has a space behind another character; its lattice can't be taken in chunks")
        # Characters that pieces join, directly or through others, make a class; runs of a class with the spaces before them are
        # chunks, and other characters are chunks one by one.
        group = {c: {c} for x in self.pairs for c in x if c != MARK}
        for x in self.pairs:
            if x[0] != MARK and group[x[0]] is not group[x[1]]:
                both = group[x[0]] | group[x[1]]
                group |= dict.fromkeys(both, both)
        classes = sorted({"".join(map(re.escape, sorted(g))) for g in group.values()})
        self.chunks = re.compile("|".join([*(f"{MARK}*[{c}]+" for c in classes), f"{MARK}+", "."]), re.DOTALL)
        self.plain = {i: x.replace(MARK, " ").encode("utf-8", "surrogatepass") for x, i in self.ids.items()}
        self.plain |= {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.known = Known(self)

    def spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if char == OWN_MARK else char).encode("utf-8", "surrogatepass")]

    def parts(self, chunk: str) -> list[str]:
        """A chunk cut between all characters that no piece has together."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in pairs]
        return [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def lattice(self, chunk: str) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
        """The edges (start, end, score, id or -1 for bytes) by end, the best score of each prefix, and the last edge of its best path."""
        n = len(chunk)
        found = self.matches.iter(chunk)
        if not self.single.issuperset(chunk):  # characters that are spelled in bytes
            spelled = [(i, (1, BYTE_SCORE * len(self.spelled(c)), -1)) for i, c in enumerate(chunk) if c not in self.single]
            found = sorted([*found, *spelled], key=lambda x: (x[0], -x[1][0]))
        edges: list[tuple[int, int, int, int]] = []
        best, last = [-NEVER] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for k, (end, (size, s, own)) in enumerate(found):
            end += 1
            i = end - size
            edges.append((i, end, s, own))
            s += best[i]
            if s > best[end]:
                best[end], last[end] = s, k
        return edges, best, last

    def best_path(self, chunk: str) -> tuple[int, int, bytes]:
        """Score of the best path, what the second best loses, and the ids of the best: the first that a search would pop."""
        edges, best, last = self.lattice(chunk)
        at, own, ids = len(chunk), [], []
        while at:
            own.append(last[at])
            i, _, _, piece = edges[last[at]]
            ids += [piece] if piece >= 0 else self.spelled(chunk[i])[::-1]
            at = i
        ids = array("I", ids[::-1]).tobytes()
        if len(own) == len(edges):
            return best[-1], NEVER, ids
        # Any other path has an edge that the best one hasn't.
        rest, second, on_path = [-NEVER] * len(chunk) + [0], -NEVER, set(own)
        for k in range(len(edges) - 1, -1, -1):
            i, j, s, _ = edges[k]
            s += rest[j]
            if s > rest[i]:
                rest[i] = s
            s += best[i]
            if s > second and k not in on_path:
                second = s
        return best[-1], best[-1] - second if second > -NEVER // 2 else NEVER, ids

    def paths(self, chunk: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best paths: score and cut positions, best first. Of equal partial paths the one nearest to the start goes on."""
        edges, best, _ = self.lattice(chunk)
        ends: list[list[tuple[int, int]]] = [[] for _ in best]
        for i, j, s, _ in edges:
            ends[j].append((i, s))
        at, behind = [len(chunk)], [-1]  # of each partial path its start, and the path that it goes on from
        heap, expanded = [(-best[-1], len(chunk), 0, 0)], [0] * (len(chunk) + 1)
        out: list[tuple[int, list[int]]] = []
        while heap and len(out) < n:
            _, here, path, done = heapq.heappop(heap)
            if here == 0:
                cuts = []
                while path >= 0:
                    cuts.append(at[path])
                    path = behind[path]
                out.append((done, cuts))
                continue
            if expanded[here] == n:
                continue
            expanded[here] += 1
            for i, s in ends[here]:
                heapq.heappush(heap, (-(best[i] + s + done), i, len(at), done + s))
                at.append(i)
                behind.append(path)
        return out

    def ids_of(self, chunk: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = self.ids.get(chunk[i:j])
            out += [own] if own is not None else self.spelled(chunk[i:j])
        return out

    def combined(self, parts: list[str], n: int) -> list[tuple[int, bytes]]:
        """Scores and ids of the n best paths through parts that the lattice falls apart into."""
        if len(parts) == 1:
            return [(s, array("I", self.ids_of(parts[0], cuts)).tobytes()) for s, cuts in self.paths(parts[0], n)]
        numbers = list(map(self.known.__getitem__, parts))
        return self._ranked(parts, [self.known.ids[k] for k in numbers], *self._known_arrays(numbers), n)

    def _known_arrays(self, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        at = np.array(numbers, np.int64)
        return np.frombuffer(known.score, np.int64)[at], np.frombuffer(known.loss, np.int64)[at]

    def _ranked(self, chunks: list[str], ids: list[bytes], score: np.ndarray, loss: np.ndarray, n: int) -> list[tuple[int, bytes]]:
        if len(loss) > 4 * n:  # ties at the border go to the first
            at = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1])
            picked = at[np.argsort(loss[at], kind="stable")][: n - 1].tolist()
        else:
            picked = np.argsort(loss, kind="stable")[: n - 1].tolist()
        picked = [k for k in picked if loss[k] < NEVER]
        choices = [self.known.best(chunks[k], n) for k in picked]
        lost = [[c[0][0] - s for s, _ in c] for c in choices]
        total = int(score.sum())
        ranked = sorted((sum(own[y] for own, y in zip(lost, pick, strict=True)), pick) for pick in product(*map(range, map(len, choices))))
        out = []
        for less, pick in ranked[:n]:
            own = ids
            if less or any(pick):
                own = ids.copy()
                for k, c, y in zip(picked, choices, pick, strict=True):
                    own[k] = c[y][1]
            out.append((total - less, b"".join(own)))
        return out

    def encode(self, text: str) -> list[str]:
        """The chunks of a text."""
        return self.chunks.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []

    def nbest(self, text: str, n: int = NBEST) -> list[tuple[float, bytes]]:
        """Scores and ids of the n best segmentations of a text."""
        chunks, known = self.encode(text), self.known
        if not chunks:
            return [(0.0, b"")]
        if known.held >= MEMORY:
            known.forget()
        numbers = list(map(known.__getitem__, chunks))
        found = self._ranked(chunks, list(map(known.ids.__getitem__, numbers)), *self._known_arrays(numbers), n)
        return [(s / SCALE, ids) for s, ids in found]

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        return self._bytes_of(ids).decode("utf-8", "surrogatepass")

    def _bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.plain.__getitem__, array("I", ids)))[1:]


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One for each worker process and vocabulary."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def nbest_segmentations(docs: DataFrame, vocabulary: str | None = None, n: int = NBEST) -> DataFrame:
    """doc_id, n_pieces and ids_crc32 (of the best ids as unsigned 32-bit numbers), scores and ids_crc32 of the n best
    segmentations, and the crc32 of the text that the best ids decode to (in UTF-8)."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces_of(path)
        for pdf in batches:
            found = [own.nbest(t or "", n) for t in pdf.text]
            crcs = [[zlib.crc32(ids) for _, ids in f] for f in found]
            out = {"doc_id": pdf.doc_id.astype("Int64"), "n_pieces": [len(f[0][1]) // 4 for f in found], "ids_crc32": [c[0] for c in crcs]}
            out |= {"scores": [[s for s, _ in f] for f in found], "nbest_crc32": crcs}
            yield pd.DataFrame(out | {"decoded_crc32": [zlib.crc32(own._bytes_of(f[0][1])) for f in found]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, PATHS)


def encode(docs: DataFrame, vocabulary: str | None = None, n: int = NBEST) -> DataFrame:
    """doc_id, rank (0: best), score and ids of the n best segmentations of every row's text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces_of(path)
        for pdf in batches:
            rows = [(i, k, s, np.frombuffer(ids, "<u4").astype(int).tolist()) for i, t in zip(pdf.doc_id.astype("Int64"), pdf.text, strict=True) for k, (s, ids) in enumerate(own.nbest(t or "", n))]
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "ids"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with the text of ids."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces_of(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "text": [own.decode(np.array(x, "<u4").tobytes()) for x in pdf.ids]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, text string")
