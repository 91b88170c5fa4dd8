"""Quality classifier: Naive Bayes features under a linear hinge loss (Wang and Manning, 2012).

A document's features are indicators of n-grams: words, and shapes of one to three
words in a row, where a shape keeps runs of capitals, small letters and digits as one
mark each, keeps punctuation, and notes that a word repeats the one before. Each
indicator is scaled by the log ratio of its counts in the two classes; on the scaled
and normalised vectors a linear model with hinge loss is fitted by dual coordinate
descent.

The classifier is fitted on a bounded sample of labelled rows (`sample` rows at most,
those of the smallest digests of their ids): the labels of the sample are small enough
to be sent to every task, so no text is shuffled. Scores are computed for every row.

Defined results: null text is empty and is scored by the bias alone; labels with null
ids or null quality are not used, repeated labels count once with the larger quality;
repeated rows are scored each; without labels of both classes every score is the share
of label 1 (0.5 without labels); a null id is not held out; an empty table gives no
rows; extra columns are ignored; very long texts are read whole. A labelled id that repeats
counts once in the fit. Ids, languages, sources and labels enter no score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, map_texts

#: Hashed features, and the bound on labelled rows that the fit uses.
BUCKETS = 1 << 18
SAMPLE = 8000
#: Bytes of words, and of runs of shapes, that a task remembers.
WORDS = 16 << 20
FOLDS, HELD_OUT = 3, 1
SMOOTHING, COST, EPOCHS, STEEPNESS = 1.0, 1.0, 12, 4.0
RUNS = re.compile(r"[^\W\d_]+|\d+")


def held_out(id_col: str):
    """crc32 of the id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def shape(word: str) -> str:
    """Letters and digits by runs: X for capitals, Xx for a capital first, x, 0; punctuation stays."""

    if word.isalpha():
        return run_mark(word)
    return RUNS.sub(lambda m: run_mark(m[0]), word)


def run_mark(run: str) -> str:
    if run[0].isdigit():
        return "0"
    if len(run) > 1 and run.isupper():
        return "X"
    return "Xx" if run[0].isupper() else "x"


class Features:
    """The hashed indicators of a text; the memory of words seen is bounded by their bytes."""

    def __init__(self) -> None:
        self.words, self.grams = Remembered(WORDS), Remembered(WORDS)

    def word(self, w: str) -> tuple[int, str]:
        marks = shape(w)
        return self.words.keep(w, (zlib.crc32(b"w" + w.lower().encode("utf-8")) % BUCKETS, marks), 2 * len(w) + 2 * len(marks) + 120)

    def gram(self, g: tuple) -> int:
        return self.grams.keep(g, zlib.crc32("s".join(map(str, g)).encode("utf-8")) % BUCKETS, sum(map(len, g)) + 150)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int32)
        known, make = self.words.get, self.word
        seen = [known(w) or make(w) for w in words]
        shapes = [s for _, s in seen]
        shapes = [s + "=" if w == before else s for s, w, before in zip(shapes, words, [None, *words], strict=False)]
        found = {b for b, _ in seen}
        grams, gram = self.grams.get, self.gram
        for n in (1, 2, 3):
            for g in set(zip(*(shapes[i:] for i in range(n)), strict=False)):
                bucket = grams(g)
                found.add(gram(g) if bucket is None else bucket)
        return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    constant: float | None = None

    def margin(self, index: np.ndarray) -> float:
        scaled = self.ratio[index]
        norm = float(np.sqrt(scaled @ scaled))
        return self.bias + (float(scaled @ self.weight[index]) / norm if norm else 0.0)

    def score(self, index: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(STEEPNESS * self.margin(index), -500, 500))))


def log_ratio(documents: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each indicator in class 1 over that in class 0."""
    counts = [np.full(BUCKETS, SMOOTHING) for _ in range(2)]
    for index, y in zip(documents, good, strict=True):
        counts[int(y)][index] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(documents: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss, by coordinate descent on its dual in seeded order."""
    values = []
    for index in documents:
        scaled = ratio[index]
        norm = np.sqrt(scaled @ scaled)
        values.append(scaled / norm if norm else scaled)
    sign = np.where(good, 1.0, -1.0)
    alpha, weight, bias = np.zeros(len(documents)), np.zeros(len(ratio)), 0.0
    squares = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(documents)):
            index, x = documents[i], values[i]
            gradient = sign[i] * (weight[index] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[index] += step * x
                bias += step
                alpha[i] = new
    return weight, bias


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows that are not held out."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    usable = usable.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64(F.col("id")), "id").limit(sample)
    # at most `sample` pairs of numbers: bounded, so every task may hold them
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    indexed = map_texts(
        rows.select(F.struct("id", "y").alias("key"), "text"), "key", "text", lambda: (lambda f: lambda text: (np.sort(f(text)),))(Features()), "found array<int>"
    )
    # one row an id, however often it repeats: the smallest by its indicators, taken before the shuffle
    got = indexed.groupBy("key").agg(F.min("found").alias("found")).select("key.id", "key.y", "found").toArrow()
    ids = got["id"].to_pylist()
    found = [np.asarray(x.as_py(), dtype=np.int32) for x in got["found"]]
    # one order whatever the partitions: the descent depends on it
    order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
    found, good = [found[i] for i in order], got["y"].to_numpy()[order] > 0
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(0), np.zeros(0), 0.0, float(good.mean()) if len(good) else 0.5)
    ratio = log_ratio(found, good)
    return Model(ratio, *dual_descent(found, good, ratio))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row; the model is two arrays of BUCKETS numbers."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        features, fitted = Features(), shared.value
        return lambda text: (fitted.score(features(text)),)

    out = map_texts(df, id_col, text_col, make, "score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without the rows predicted 0; the columns stay as they are, also in an empty table."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), model.value
        for b in batches:
            keep = [fitted.score(features(t.as_py() or "")) >= 0.5 for t in b.column(text_col)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
