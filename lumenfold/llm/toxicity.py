"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; the document's is their noisy-or,
1 - prod(1 - p). Only document labels train it: the gradient of the noisy-or's likelihood shares a document's blame among its
sentences. The sentence scores then say where the offence is.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_worker, small_batches, table, training_sample

SENTENCE = re.compile(r"[^.!?\n]+")
BUCKETS = 1 << 18
MEMO = 400_000


def word_features(word: str) -> list[int]:
    """Hash buckets of the bare lower-case word and of its first four and five letters. None for a word without letters or digits."""
    bare = re.sub(r"[\W_]+", "", word.lower())
    if not bare:
        return []
    names = ["w" + bare] + [f"p{n}{bare[:n]}" for n in (4, 5) if len(bare) > n]
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


class Bags:
    """A labelled sample as arrays: (row, column) of each feature in each sentence, and each sentence's document."""

    def __init__(self, sample: list[tuple[str, int]], least_docs: int):
        self.labels = np.array([y for _, y in sample], dtype=np.float64)
        memo: dict[str, list[int]] = {}
        features, doc_of = [], []
        for d, (text, _) in enumerate(sample):
            for s in SENTENCE.findall(text):
                ids = []
                for w in s.split():
                    if w not in memo:
                        memo[w] = word_features(w)
                    ids += memo[w]
                if ids:
                    features.append(np.unique(np.array(ids, dtype=np.int64)))
                    doc_of.append(d)
        self.docs, self.sentences = np.array(doc_of, dtype=np.int64), len(features)
        sizes = np.array([len(f) for f in features], dtype=np.int64)
        flat = np.concatenate(features) if features else np.zeros(0, np.int64)
        seen = np.bincount(np.unique(np.repeat(self.docs, sizes) * BUCKETS + flat) % BUCKETS, minlength=BUCKETS)
        self.kept = np.flatnonzero(seen >= least_docs)
        place = np.full(BUCKETS, -1)
        place[self.kept] = np.arange(len(self.kept))
        known = place[flat] >= 0
        self.cols, self.rows = place[flat][known], np.repeat(np.arange(len(sizes)), sizes)[known]
        ones = self.labels.sum()
        self.share = np.where(self.labels == 1, 0.5 / max(ones, 1), 0.5 / max(len(self.labels) - ones, 1))

    def clean(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """(sentences' scores, documents' chances of having no toxic sentence)."""
        z = np.clip(bias + np.bincount(self.rows, weights[self.cols], self.sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        return p, np.exp(np.bincount(self.docs, np.log1p(-p * (1 - 1e-12)), len(self.labels)))

    def loss(self, weights: np.ndarray, bias: float) -> float:
        """Mean log loss of the noisy-or; both labels count half."""
        clean = self.clean(weights, bias)[1]
        return float((-np.log(np.maximum(np.where(self.labels == 1, 1 - clean, clean), 1e-9)) * self.share).sum())

    def gradient(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """The loss's derivatives: a document's blame falls on its sentences by their scores."""
        p, clean = self.clean(weights, bias)
        blame = np.where(self.labels == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * self.share
        g = blame[self.docs] * p
        return np.bincount(self.cols, g[self.rows], len(self.kept)), float(g.sum())


#: Regularisation that `cross_validated` chose among 0.1, 0.3, 1 and 0.2, 0.5, 1 on learning rows alone (1,852 of sf0.1; its mean loss there is 0.138).
DECAY, SPARSE = 0.1, 0.5


def train(sample: list[tuple[str, int]], *, rounds: int = 150, rate: float = 0.1, decay: float = DECAY, sparse: float = SPARSE, least_docs: int = 4) -> dict:
    """Weights of the sentence model, by Adam on the mean noisy-or log loss. Features in fewer than least_docs documents weigh nothing."""
    labels = [y for _, y in sample]
    if not 0 < sum(labels) < len(labels):
        return {"bias": -6.0, "weights": {}}
    bags = Bags(sample, least_docs)
    weights, bias, penalty = np.zeros(len(bags.kept)), -4.0, bags.share.mean()
    moments = [np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)]
    for step in range(1, rounds + 1):
        of_weights, of_bias = bags.gradient(weights, bias)
        grad = np.append(of_weights + penalty * (decay * weights + sparse * np.sign(weights)), of_bias)
        moments[0] += 0.1 * (grad - moments[0])
        moments[1] += 0.01 * (grad * grad - moments[1])
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    large = np.flatnonzero(np.abs(weights) > 1e-3)
    return {"bias": float(bias), "weights": dict(zip(bags.kept[large].tolist(), weights[large].tolist()))}


def cross_validated(sample: list[tuple[str, int]], settings: list[dict], folds: int = 4) -> list[float]:
    """Mean log loss (both labels count half) of each of settings on the folds that did not teach it. A text's fold depends on the text alone, so copies
    share it. sample is to hold learning rows only."""
    fold = [zlib.crc32(t.encode("utf-8", "replace")) % folds for t, _ in sample]
    out = []
    for chosen in settings:
        losses = []
        for k in range(folds):
            model = train([r for r, f in zip(sample, fold) if f != k], **chosen)
            weights, own = Weights(model), [r for r, f in zip(sample, fold) if f == k]
            losses += [(y, -math.log(min(max(s if y else 1 - s, 1e-9), 1.0))) for t, y in own for s in [score_sentences(t, model["bias"], weights)[0]]]
        out.append(sum(sum(x for y, x in losses if y == label) / max(1, sum(y == label for y, _ in losses)) for label in (0, 1)) / 2)
    return out


class Weights(dict):
    """Word as written -> its weight; bounded."""

    def __init__(self, model: dict):
        super().__init__()
        self.of = model["weights"]

    def __missing__(self, word: str) -> float:
        w = sum(self.of.get(i, 0.0) for i in word_features(word))
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = w
        return w


def score_sentences(text: str | None, bias: float, weights: dict) -> tuple[float, list[tuple[float, int, int]]]:
    """(document's score, [(sentence's score, start, end)]) with offsets in code points."""
    out, clean = [], 0.0
    for m in SENTENCE.finditer(text or ""):
        words = set(m.group().split())
        if words:
            z = min(max(bias + sum(map(weights.__getitem__, words)), -30.0), 30.0)
            p = 1 / (1 + math.exp(-z))
            out.append((p, m.start(), m.end()))
            clean += math.log1p(-min(p, 1 - 1e-12))
    return 0.0 - math.expm1(clean), out


def toxicity(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, sentences, offending, worst_start, worst_end, worst_score for every row.

    offending counts sentences that alone reach the threshold; worst_* locate the highest-scoring
    sentence, the first of equals. A text without words (null, empty, punctuation) scores 0 and has null worst_*. Texts are scored whole;
    repeated rows give repeated rows. A model from labels of one class only, or none, scores all near 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dict(model))  # at most BUCKETS weights

    def run(batches):
        weights, bias = per_worker(shared, Weights), shared.value["bias"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                score, found = score_sentences(text, bias, weights)
                worst = max(found, key=lambda s: s[0], default=(None, None, None))
                rows.append((doc_id, score, len(found), sum(s[0] >= threshold for s in found), worst[1], worst[2], worst[0]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            names = ["doc_id", "score", "sentences", "offending", "worst_start", "worst_end", "worst_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, score double, sentences long, offending long, worst_start long, worst_end long, worst_score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op3(spark, sf_dir, per_class: int = 1500):
    """Trains on at most per_class labelled documents of either class that are not held out; scores all."""
    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(docs, table(spark, sf_dir, "labels"), "toxic", per_class))
    out = toxicity(docs, model)
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentences", "offending", "worst_start", "worst_end", "worst_score",
    )
