"""Best-fit packing of documents into sequences.

Documents are tokenized and closed with an end id; those over the token capacity are cut into full pieces and a rest. Bins
(sequences) have three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are taken from
the longest to the shortest; each goes into the open bin that takes it under every constraint and either leaves the
smallest weighted norm of residual capacities (`norm`) or has the largest weighted dot product of its needs with the bin's
residual capacities (`dot`). Pieces are dealt to groups of GROUP_PIECES by their position in a written table, so a group
fits a task whatever repeats; bins that a group could not fill are opened again and their pieces packed in a further round
with those of the other groups, until one group holds all that is left or a round lowers the number of the bins that it
opened by less than the share 1 - SHRINK.

In the registered query documents and attention cost have the capacities that tokens imply (4096 documents, 4096 squared), so
tokens alone bind there; callers set tighter ones.

Cases: a null text is empty, and a document of one end id; a very long text is cut into full pieces and a rest; of pieces that
tie in length the lesser (doc_id, piece, digest) is placed first, of bins that tie in their score the first opened is taken; null and repeated doc_ids make a piece each like any other row;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import materialize

from .common import sparing, sparing_groups

TOKENS, END_ID, GROUP_PIECES, FILL, SHRINK = 4096, 1, 20_000, 0.995, 0.98
#: Weights of tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 0.01, 0.01)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BINS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _group bigint, _bin int, offset bigint, _fill bigint"
#: White space for str.split() that the tokenizer takes for text.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters that the tokenizer's normalizer changes by lower-casing alone, each by itself: no marks that could combine.
PLAIN = "\x21-\x7e\xa1-\u012f\u0131-\u024f"
PLAIN_WORD, PLAIN_TEXT = re.compile(f"[{PLAIN}]+"), re.compile(f"[ \t\n\x0b\x0c\r{PLAIN}]*")
#: The split that the pattern in the vocabulary file describes, within PLAIN.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Units (parts of words) and odd words whose ids a worker remembers, and the longest that it does.
MEMORY, UNIT = 400_000, 64


def _plain_split() -> re.Pattern:
    """SPLIT for re, over lower-case text of PLAIN and white space: letters and numbers are listed by their categories."""
    known = sorted({x for c in range(0x250) if PLAIN_WORD.match(chr(c)) for x in chr(c).lower()})
    letters, numbers = ("".join(c for c in known if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


class Units(dict):
    """The ids of a unit as little-endian bytes, from the tokenizer's model, found once."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.bytes = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def __missing__(self, unit: str) -> bytes:
        level = unit if unit.isascii() else "".join([self.bytes[b] for b in unit.encode()])
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(level)])
        if len(unit) <= UNIT:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = ids
        return ids


class WordIds(dict):
    """The ids of a text. A tokenizer that splits at white space gives them word by word, and one that splits words by SPLIT unit
    by unit: texts of plain Latin letters go to its model directly, in units found once; its normalizer only lower-cases these.
    Words with other characters go through the whole tokenizer, and are remembered here; so do texts with odd spaces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        file = json.loads(open(path, encoding="utf-8").read())
        kinds = tuple([x["type"] for x in (file[k] or {}).get(many, [])] for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        known = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        known = known and file["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        self.split, self.units = _plain_split() if known else None, Units(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, self.split.findall(text.lower())))

    def __missing__(self, word: str) -> bytes:
        if self.split is not None and PLAIN_WORD.fullmatch(word):
            return self.plain(word)
        ids = self.encode(word)
        if len(word) <= UNIT:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if self.split is not None and PLAIN_TEXT.fullmatch(text):
            return self.plain(text)
        return self.encode(text) if ODD_SPACE.search(text) else b"".join(map(self.__getitem__, text.split()))


_words: dict[str, WordIds] = {}


def tokenizer_of(path: str) -> WordIds:
    """One for each worker process and vocabulary."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str, tokens: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every row of docs."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end, step = tokenizer_of(vocabulary), np.array([END_ID], "<u4").tobytes(), 4 * tokens
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id.astype("Int64"), pdf.text, strict=True):
                ids = (words.text(text) if text else b"") + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(sparing(cut), PIECES)


def best_fit(lengths: np.ndarray, tokens: int, most_docs: int, most_cost: int, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there. Bins' residuals are kept as shares of the capacities."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int32), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    caps = np.array([tokens, most_docs, most_cost], float)
    left = np.zeros((n, 3))  # in units, exact in doubles
    w = np.array(weights, float) / caps**2
    used, live, low = 0, np.zeros(0, np.int64), int(lengths.min())
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        fits = live[(left[live] >= need).all(axis=1)]
        if len(fits):
            if rule == "dot":
                score = -(left[fits] * need) @ w
            else:
                score = ((left[fits] - need) ** 2) @ w
            b = fits[int(score.argmin())]
        else:
            b, used = used, used + 1
            left[b] = caps
            live = np.append(live, b)
        bins[i], offsets[i] = b, tokens - int(left[b, 0])
        left[b] -= need
        if left[b, 0] < low or left[b, 1] < 1 or left[b, 2] < low * low:
            live = live[live != b]
    return bins, offsets


def pack(parts: DataFrame, tokens: int = TOKENS, most_docs: int | None = None, most_cost: int | None = None, weights=WEIGHTS, rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """parts (of pieces()) with sequence_id and offset. A capacity of None is one that tokens alone can't exceed."""
    docs_cap, cost_cap = most_docs or tokens, most_cost or tokens * tokens

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(pdf.length.to_numpy(), tokens, docs_cap, cost_cap, weights, rule)
        held = np.bincount(bins, weights=pdf.length.to_numpy())
        return pdf.assign(_bin=bins, offset=offsets, _fill=held[bins].astype("int64"))[[x.split()[0] for x in BINS.split(", ")]]

    parts, done, base = materialize(parts, "pieces"), [], 0
    opened = None
    while True:
        groups = max(1, -(-parts.count() // group_pieces))
        dealt = parts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = materialize(dealt.groupBy("_group").applyInPandas(sparing_groups(fill), BINS), "bins")
        last = groups == 1
        if not last:
            bins, left = packed.select("_group", "_bin", "_fill").distinct().agg(F.count("*"), F.count(F.when(F.col("_fill") < FILL * tokens, 1))).first()
            last, opened = opened is not None and bins > SHRINK * opened, left
        stay = packed if last else packed.where(F.col("_fill") >= FILL * tokens)
        done.append(stay.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(base) + F.col("_group") * (1 << 20) + F.col("_bin")).cast("bigint").alias("sequence_id"), "offset"))
        if last:
            break
        parts, base = packed.where(F.col("_fill") < FILL * tokens).select(parts.columns), base + groups * (1 << 20)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, tokens: int = TOKENS, **capacities) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces of docs."""
    return pack(pieces(docs, vocabulary or vocabulary_path(), tokens), tokens, **capacities)
