"""Language identification with string kernels.

Texts are compared by the blended-spectrum presence kernel: the number of distinct character n-grams (n from 1 to ORDER)
that two texts share, normalised by the geometric mean of their own numbers. LANDMARKS texts of a bounded labelled sample
span a Nyström approximation of the kernel, in which one-versus-rest kernel ridge regression is solved. Prediction needs
the presence vectors of a batch of texts times the landmarks' presence matrix, times one small matrix.

Training reads a sample of at most SAMPLE texts and SAMPLE_BYTES characters (one text at least) per language, drawn by hash from
labelled rows with letters; where a language has SAMPLE texts of at most SAMPLE_CHARS characters, from these only. Their
n-grams are made where the texts are; the driver gets the n-grams. Everything else reads whole texts. Letters are
lower-cased and runs of other characters count as one space, so that numbers and markup weigh nothing.

Cases: a null text or one without letters is `und` with score 0; a very long text is taken in pieces; of languages that tie in
their scores the first by name is named; without labelled rows every text is `und`; rows repeat in
the result as in the input; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sparing

ORDER, LANDMARKS, SAMPLE, SAMPLE_CHARS, SAMPLE_BYTES, RIDGE = 3, 128, 256, 8192, 4 << 20, 1e-3
#: The score from which a language counts as found: half-way between a ridge target of -1 and 1.
LEAST = 0.5
#: Characters worked on at a time; a longer text is taken in overlapping pieces and its n-grams united.
PIECE = 1 << 18
#: Texts whose n-grams are held and compared with the landmarks at a time.
BATCH = 64
OUT = "doc_id bigint, lang_pred string, score double"
#: Runs of anything but letters and combining marks.
NO_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """Sorted distinct n-grams of a text for n from 1 to order, as numbers (21 bits a character, so exact up to 3)."""
    text = f" {NO_LETTERS.sub(' ', text.lower()).strip()} "
    out = []
    for start in range(0, len(text), PIECE):
        chars = np.frombuffer(text[start : start + PIECE + order - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes, made = chars, [chars]
        for n in range(1, order):
            codes = (codes[:-1] << np.uint64(21)) | chars[n:]
            made.append(codes)
        out.append(np.unique(np.concatenate(made)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """vocabulary: sorted n-grams of the landmarks; presence: n-grams x landmarks; own: n-grams of each landmark; weights: landmarks x languages."""

    languages: list[str]
    vocabulary: np.ndarray
    presence: np.ndarray
    own: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of n-gram sets with the landmarks, as batched products of presence vectors."""
        out = np.zeros((len(texts), self.presence.shape[1]), np.float32)
        for start in range(0, len(texts), BATCH):
            some = texts[start : start + BATCH]
            block = np.zeros((len(some), len(self.vocabulary)), np.float32)
            for i, g in enumerate(some):
                at = np.searchsorted(self.vocabulary, g)
                at[at == len(self.vocabulary)] = 0
                block[i, at[self.vocabulary[at] == g]] = 1
            sizes = np.array([max(1, len(g)) for g in some], np.float32)
            out[start : start + BATCH] = (block @ self.presence) / np.sqrt(sizes[:, None] * self.own[None, :])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if rows:
            parts = [self.kernel([grams(texts[i]) for i in rows[k : k + BATCH]]) for k in range(0, len(rows), BATCH)]
            f = np.concatenate(parts) @ self.weights
            for i, k, s in zip(rows, f.argmax(1).tolist(), f.max(1).tolist(), strict=True):
                names[i], scores[i] = self.languages[k], float(min(1.0, max(0.0, (s + 1) / 2)))
        return names, scores


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From n-grams of texts: Nyström features of the kernel with landmarks taken in turn from the languages, then ridge regression for each language."""
    languages = sorted(set(labels))
    if not languages:
        none = np.zeros((0, 0), np.float32)
        return Model([], np.zeros(0, np.uint64), none, np.zeros(0, np.float32), none)
    turn = pd.Series(labels).groupby(pd.Series(labels)).cumcount()
    chosen = sorted(range(len(sets)), key=lambda i: (turn[i], labels[i]))[: max(landmarks, len(languages))]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    presence = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        presence[np.searchsorted(vocabulary, sets[i]), k] = 1
    own = np.array([max(1, len(sets[i])) for i in chosen], np.float32)
    model = Model(languages, vocabulary, presence, own, np.zeros((0, 0), np.float32))
    k = model.kernel(sets).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # landmarks' kernel to the power -1/2
    phi = k @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language counts as much as the others taken together, whatever its share of the sample.
    counts = np.array([labels.count(x) for x in languages], float)
    weights = np.zeros((phi.shape[1], len(languages)))
    for c in range(len(languages)):
        w = np.where(y[:, c] > 0, 0.5 / counts[c], 0.5 / max(1.0, len(labels) - counts[c]))[:, None] * len(labels)
        ridged = phi.T @ (w * phi) + ridge * len(labels) * np.eye(phi.shape[1])
        weights[:, c] = np.linalg.solve(ridged, phi.T @ (w[:, 0] * y[:, c]))
    model.weights = (root @ weights).astype(np.float32)
    return model


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf[[has_letter(t) for t in pdf.text]]
        yield pdf[["lang", "_u"]].assign(grams=[grams(t).tobytes() for t in pdf.text])


def train(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model from rows with text, lang and doc_id; only these two teach, doc_id only seeds the draw."""
    draw = F.pmod(F.xxhash64(F.lit(6), F.col("doc_id").cast("string"), "text"), F.lit(1 << 40))
    rows = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.length("text").alias("_len"), draw.alias("_u"))
    short = F.col("_len") <= SAMPLE_CHARS
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(short, 1)).alias("n_short")).toPandas()
    if not len(counts):
        return fit([], [])
    # Twice the sample is drawn from texts that are short enough (from all where a language has too few such), then cut to it.
    # Texts stay where they are: first the draws and lengths, then the n-grams of those that the bounds let in.
    whole = counts.n_short < sample
    below = [int(min(1.0, 2.0 * sample / n) * (1 << 40)) + 1 for n in counts.n.where(whole, counts.n_short)]
    spark = labelled.sparkSession
    # From Arrow tables: pandas frames would go through Python workers of another kind, which then stay.
    rates = pa.Table.from_pandas(counts.assign(_any=whole, _below=below)[["lang", "_any", "_below"]], preserve_index=False)
    rates = spark.createDataFrame(rates, "lang string, _any boolean, _below bigint")
    drawn = rows.join(F.broadcast(rates), "lang").where((short | F.col("_any")) & (F.col("_u") < F.col("_below"))).drop("_any", "_below")
    places = drawn.select("lang", "_u", "_len").distinct().toPandas().sort_values(["lang", "_u", "_len"]).groupby("lang").head(sample)
    fits = places.groupby("lang")._len.cumsum() <= SAMPLE_BYTES
    least = places.sort_values(["lang", "_len", "_u"]).groupby("lang").head(1).index
    places = places[fits | places.index.isin(least)]
    places = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(places, preserve_index=False), "lang string, _u bigint, _len int"))
    picked = drawn.join(places, ["lang", "_u", "_len"], "left_semi").dropDuplicates(["lang", "_u"]).select("lang", "_u", "text")
    picked = picked.mapInPandas(sparing(_grams), "lang string, _u bigint, grams binary").toPandas()
    picked = picked.sort_values(["lang", "_u", "grams"]).groupby("lang").head(sample)
    return fit([np.frombuffer(g, np.uint64) for g in picked.grams], picked.lang.tolist(), landmarks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores = shared.value.predict(pdf.text.where(pdf.text.notna(), None).tolist())
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "lang_pred": names, "score": scores})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(sparing(run), OUT)


def _fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows of docs that aren't held out."""
    model = train(docs.where(_fold() != 1))
    return predict(docs, model).select("doc_id", (_fold() == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs whose language is found with a score of at least `least`, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(_fold() != 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(sparing(run), docs.schema)
