"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over a text's distinct words and beginnings of words, hashed to FEATURES places, is trained in numpy
on confirmed toxic texts and on texts taken without their labels. It uses the features that are the most
over-represented in the positives, MOST at most. With the class prior p, the risk of calling toxic text clean is
estimated from the positives, and the risk of calling clean text toxic as

    max(0, mean over unlabelled of loss(-g) - p * mean over positives of loss(-g))

whose correction below zero keeps the model from fitting the unlabelled texts too well. The loss is logistic, so the
score is the estimated probability of being toxic. The prior is the share of toxic rows among the labels learnt from.

Learning uses POSITIVES and UNLABELLED texts at most; scoring reads every whole text once.

Cases: null and empty texts have no word and get the score of the bias alone. With no positive or no unlabelled text the
score is the prior for all. Repeated rows get equal scores. Other columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.words import ALNUM, sliced
from kindred.llm.samples import free_names, at_most, held_out, known_labels, texts_of

FEATURES = 1 << 20
#: Bounds of the two samples.
POSITIVES, UNLABELLED = 8_000, 16_000
#: A feature counts with so many documents and such a z-score at least; no more than MOST do.
LEAST_DOCS, LEAST_Z, MOST = 5, 3.5, 1024
#: Bytes of a word's beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3


def features(column: pa.Array):
    """First row, number of rows, and for all words of a slice (rows, places) of one kind of feature after the other."""
    for lo, hi, w in sliced(column, ALNUM, True):
        row, kinds = w.row_of(), []
        size = w.end - w.start
        kinds.append((row, w.hash >> np.uint64(44)))
        for k in BEGINNINGS:
            at = np.flatnonzero(size > k)
            kinds.append((row[at], w.beginnings(at, k) >> np.uint64(44)))
        yield lo, hi - lo, [(r, p.astype(np.int64)) for r, p in kinds]


def _distinct(rows: int, kinds, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place), of the places with a weight."""
    keep = [(r[m], p[m]) for r, p in kinds for m in [slice(None) if weight is None else weight[p] != 0]]
    both = np.unique(np.concatenate([r * FEATURES + p for r, p in keep]))
    return both // FEATURES, both % FEATURES


def _counted(batches):
    """For each class the number of texts with each feature."""
    counts, seen = np.zeros((2, FEATURES), np.uint32), [0, 0]
    for batch in batches:
        y = batch.column(0).to_numpy()
        for lo, n, kinds in features(batch.column(1)):
            row, place = _distinct(n, kinds)
            for k in (0, 1):
                counts[k] += np.bincount(place[y[lo + row] == k], minlength=FEATURES).astype(np.uint32)
        for k in (0, 1):
            seen[k] += int((y == k).sum())
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts])], ["n", "counts"])


def _featured_of(chosen):
    def run(batches):
        for batch in batches:
            out = []
            for _, n, kinds in features(batch.column(1)):
                row, place = _distinct(n, kinds, chosen.value)
                out += [x.astype(np.int32).tobytes() for x in np.split(place, np.searchsorted(row, np.arange(1, n)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "x"])

    return run


def choose(counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """1 at the places of the features to use, by the z-score of their shares in both samples."""
    share = counts / np.maximum(seen, 1)[:, None]
    mean = counts.sum(0) / max(1, seen.sum())
    z = (share[1] - share[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / max(seen[0], 1) + 1 / max(seen[1], 1)))
    z[counts.sum(0) < LEAST_DOCS] = 0
    out = np.zeros(counts.shape[1], np.float32)
    best = np.argsort(-z, kind="stable")[:MOST]
    out[best[z[best] >= LEAST_Z]] = 1
    return out


class Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.concatenate(rows) if rows else np.zeros(0, np.int32)

    def part(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        row = np.repeat(np.arange(len(at)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row, self.places[np.repeat(self.begins[at], sizes) + within]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The direction to leave, for each positive's and each unlabelled text's g: the gradient of the whole risk, or, where
    the risk of calling clean text toxic is below zero, the negative gradient of that part alone, which steps back."""
    sp, su = _sigmoid(gp), _sigmoid(gu)
    # the loss of clean text called toxic is log(1 + exp(g)), and its slope is sigmoid(g)
    if np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() >= 0:
        return prior * (sp - 1 - sp) / len(gp), su / len(gu)
    return prior * sp / len(gp), -su / len(gu)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 12, batch: int = 512, rate: float = 0.05, shrink: float = 3e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier that minimizes the non-negative risk, by Adam with shrinkage of small weights."""
    rng = np.random.default_rng(seed)
    p, u = Rows(positive), Rows(unlabelled)
    w, bias = np.zeros(FEATURES + 1), np.log(prior / (1 - prior))
    w[-1] = bias
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, len(unlabelled) // batch)
    per = max(1, min(len(positive), batch // 2))
    for _ in range(max(epochs, -(-150 // steps))):
        us = np.array_split(rng.permutation(len(unlabelled)), steps)
        for at_u in us:
            at_p = rng.choice(len(positive), per, replace=False)
            rp, cp = p.part(at_p)
            ru, cu = u.part(at_u)
            gp = w[-1] + np.bincount(rp, weights=w[cp], minlength=len(at_p))
            gu = w[-1] + np.bincount(ru, weights=w[cu], minlength=len(at_u))
            dp, du = slopes(gp, gu, prior)
            grad = np.bincount(cp, weights=dp[rp], minlength=FEATURES + 1) + np.bincount(cu, weights=du[ru], minlength=FEATURES + 1)
            grad[-1] = dp.sum() + du.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * shrink, 0)
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    known = known_labels(labels, "toxic", FOLDS, HELD_OUT)
    share = known.agg(F.avg("y")).first()[0]
    prior = min(max(share or 0.0, 1e-4), 1 - 1e-4)
    positive = at_most(known.where("y = 1"), POSITIVES, 1)
    open_ids = docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("y")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    both = positive.union(at_most(open_ids, UNLABELLED, 2))
    sample, spark = texts_of(docs, both).select("y", "text").coalesce(8), docs.sparkSession
    counts, seen = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for i, r in enumerate(sample.mapInArrow(_counted, "n long, counts binary").toLocalIterator()):
        seen[i % 2] += r.n
        counts[i % 2] += np.frombuffer(zlib.decompress(r.counts), np.uint32)
    chosen = spark.sparkContext.broadcast(choose(counts, seen))
    rows = sample.mapInArrow(_featured_of(chosen), "y int, x binary").collect()
    rows = sorted((r.y, bytes(r.x)) for r in rows)  # the same order at each run
    groups = [[np.frombuffer(x, np.int32) for y, x in rows if y == k] for k in (1, 0)]
    if not all(groups):
        return np.zeros(FEATURES, np.float32), float(np.log(prior / (1 - prior)))
    return fit(*groups, prior)


def _scored_of(model, text_at: int):
    def run(batches):
        for batch in batches:
            w, bias = model.value
            score = np.full(len(batch), bias)
            for lo, n, kinds in features(batch.column(text_at)):
                row, place = _distinct(n, kinds, w)
                score[lo : lo + n] += np.bincount(row, weights=w[place], minlength=n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(score))], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _score, the probability that the text is toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    n = len(docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(n)))
    fields = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in plain.columns)
    return plain.mapInArrow(_scored_of(model, docs.columns.index("text")), f"{fields}, c{n} double").toDF(*docs.columns, *free_names(docs.columns, ["_score"]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
