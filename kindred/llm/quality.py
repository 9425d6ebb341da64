"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text gives STATISTICS, transformed to be nearer to normal (logarithms of sizes, square roots of shares). Each class
has its mean and its covariance, shrunk towards the pooled one and its diagonal. A text's score is the logistic function
of the difference of the log-densities, with the classes' shares as priors; the Mahalanobis distances come from the
inverse Cholesky factors, which are computed once, with the model.

Learning uses LABELLED rows at most; scoring reads every whole text once.

Cases: null and empty texts have all statistics at zero and are scored as such. With no labelled row the score is 0.5
for all, with one class only its own side of it. Repeated rows get equal scores. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.words import SPACED, buffers, sliced
from kindred.llm.samples import free_names, at_most, held_out, known_labels, texts_of

LABELLED = 20_000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
#: Shrinkage of a class's covariance towards the pooled one, and of the result towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
STATISTICS = ["words", "word_length", "longest_word", "capitals", "digits", "symbols", "bars", "cries", "stops", "non_ascii", "lines", "distinct_words", "repeated_triples", "repeated_lines", "short_words"]

_SETS = [bytes(range(65, 91)), b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?", bytes(range(128, 256)), b"\n"]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    data, at = buffers(column)
    masks = np.zeros((len(_SETS), 256), bool)
    for i, s in enumerate(_SETS):
        masks[i, list(s)] = True
    out = np.zeros((len(at) - 1, len(STATISTICS)))
    for lo, hi, w in sliced(column, SPACED, False):
        raw, rows = data[at[lo] : at[hi]], hi - lo
        n = np.diff(w.first).astype(float)
        size = np.maximum(np.diff(at[lo : hi + 1]), 1).astype(float)
        many = np.maximum(n, 1)
        shares = [np.diff(np.concatenate([[0], np.cumsum(m[raw])])[at[lo : hi + 1] - at[lo]]) for m in masks]
        length = (w.end - w.start).astype(float)
        row = w.row_of()
        longest = np.zeros(rows)
        np.maximum.at(longest, row, length)
        chars = np.bincount(row, weights=length, minlength=rows)
        short = np.bincount(row, weights=length <= 3, minlength=rows)
        triples, inside = w.grams(3), w.inside(3)
        distinct, again = np.zeros(rows), np.zeros(rows)
        for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            distinct[r] = len(np.unique(w.hash[a:b]))
            if b - a >= 3:
                again[r] = 1 - len(np.unique(triples[a : b - 2])) / (b - a - 2)
        lines = [raw[x:y].tobytes().split(b"\n") for x, y in zip(at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo])]
        dup = [1 - len(set(x)) / len(x) for x in lines]
        caps, digits, symbols, bars, cries, stops, beyond, breaks = shares
        out[lo:hi] = np.stack(
            [np.log1p(n), np.log1p(chars / many), np.log1p(longest), np.sqrt(caps / size), np.sqrt(digits / size), np.sqrt(symbols / size), np.sqrt(bars / many), np.sqrt(cries / many), np.sqrt(stops / many), np.sqrt(beyond / size), np.sqrt(breaks / many), distinct / many, np.sqrt(again), np.sqrt(dup), np.sqrt(short / many)],
            1,
        )
    return out


class Discriminant:
    """The classes' means, inverse Cholesky factors, log-determinants and log-priors."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.fixed = None
        if len(y) < 2 or y.min() == y.max():
            self.fixed = 0.5 if not len(y) else (0.25 if y.max() == 0 else 0.75)
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        groups = [x[y == k] for k in (0, 1)]
        centers = [g.mean(0) for g in groups]
        spreads = [(g - c).T @ (g - c) / max(1, len(g) - 1) for g, c in zip(groups, centers, strict=True)]
        pooled = sum(s * len(g) for s, g in zip(spreads, groups, strict=True)) / len(x)
        self.parts = []
        for g, c, s in zip(groups, centers, spreads, strict=True):
            s = (1 - TO_POOLED) * s + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.parts.append((c, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(len(g) / len(x))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        x = (x - self.mean) / self.scale
        clean = [k - 0.5 * (((x - c) @ f.T) ** 2).sum(1) for c, f, k in self.parts]
        return 1 / (1 + np.exp(np.clip(clean[0] - clean[1], -40, 40)))


def _measured(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Discriminant:
    ids = at_most(known_labels(labels, "quality", FOLDS, HELD_OUT), LABELLED, 3)
    rows = texts_of(docs, ids).select("y", "text").mapInArrow(_measured, "y int, x array<double>").collect()
    rows = sorted((r.y, tuple(r.x)) for r in rows)
    return Discriminant(np.array([x for _, x in rows]).reshape(len(rows), len(STATISTICS)), np.array([y for y, _ in rows]))


def _scored_of(model, text_at: int):
    def run(batches):
        for batch in batches:
            score = model.value.scores(statistics(batch.column(text_at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _score, the probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    n = len(docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(n)))
    fields = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in plain.columns)
    return plain.mapInArrow(_scored_of(model, docs.columns.index("text")), f"{fields}, c{n} double").toDF(*docs.columns, *free_names(docs.columns, ["_score"]))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
