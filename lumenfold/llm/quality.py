"""Quality by nearest-neighbour voting in latent-semantic space.

A text's terms are the shapes of its words, its short words, and how it repeats itself. Terms are hashed, weighted by tf-idf and
projected on the leading singular vectors of a bounded labelled sample. The labelled vectors are broadcast; every document's cosine
to each of them is computed exactly, in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_worker, small_batches, table, training_sample

TERMS = 1024
DIMS = 48
MEMO = 400_000


def term(word: str) -> int:
    """The bucket of a word's term: short words stand for themselves, others for their shape, such as 'Aa,' or 'a##'."""
    if len(word) <= 3 and word.isalpha():
        name = "w" + word.lower()
    else:
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        name = "s" + re.sub(r"(.)\1+", r"\1\1", shape)
    return zlib.crc32(name.encode("utf-8", "replace")) % (TERMS - 64)


class Terms(dict):
    """Word -> bucket; bounded."""

    def __missing__(self, word: str) -> int:
        t = term(word)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = t
        return t


def counts(text: str | None, terms: Terms) -> np.ndarray:
    """Damped shares of a text's terms. The last 64 buckets: repetition of the word before, of earlier words, and the text's length."""
    words = (text or "").split()
    out = np.zeros(TERMS, dtype=np.float32)
    n = len(words)
    if n:
        tf = np.bincount(np.fromiter(map(terms.__getitem__, words), dtype=np.int64, count=n), minlength=TERMS)
        out[:] = np.sqrt(tf / n)
        again = sum(map(eq, words[1:], words)) / n
        different = math.log(len(set(words)) + 1) / math.log(n + 1)
        out[TERMS - 64 + min(15, int(again * 16))] = 0.5 if again >= 1 / 16 else 0.1
        out[TERMS - 48 + min(31, int(different * 32))] = 0.3
    out[TERMS - 16 + min(15, n.bit_length())] = 0.1
    return out


def fit(sample: list[tuple[str, int]], neighbours: int = 15) -> dict:
    """The projection, and the labelled vectors and labels that vote, all in whole numbers (see `projected`)."""
    terms = Terms()
    x = np.array([counts(t, terms) for t, _ in sample], dtype=np.float64).reshape(-1, TERMS)
    y = np.array([label for _, label in sample], dtype=np.float64)
    idf = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)) + 1
    w = x * idf
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    vectors = np.linalg.eigh(w.T @ w)[1] if len(x) else np.eye(TERMS)
    basis = np.rint(idf[:, None] * vectors[:, ::-1][:, :DIMS] * SCALE)
    return {"basis": basis, "vectors": projected(x, basis), "labels": y, "neighbours": neighbours}


#: Shares and the basis are held as multiples of 1 / SCALE, unit vectors as multiples of 1 / UNIT. All products and their sums are whole numbers
#: below 2**53, so a block's products are exact whatever the block's size and the order of summation.
SCALE, UNIT = 1 << 18, 1 << 20


def projected(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of counts x, times UNIT, in whole numbers. A row without terms is zero."""
    v = np.rint(x.astype(np.float64) * SCALE) @ basis
    square = np.zeros(len(v))
    for d in range(v.shape[1]):
        square += v[:, d] * v[:, d]
    return np.rint(v / np.maximum(np.sqrt(square), 1.0)[:, None] * UNIT)


def vote(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores of the rows of counts x: exact cosines with every labelled vector, in one block. Of equally near texts the earlier in the sample
    votes. A row's score depends on no other row."""
    vectors, labels = model["vectors"], model["labels"]
    n = len(labels)
    if not n:
        return np.full(len(x), 0.5)
    k = min(model["neighbours"], n)
    cosines = (projected(x, model["basis"]) @ vectors.T).astype(np.int64)
    order = cosines * n + np.arange(n - 1, -1, -1)  # no two alike: the cosine, then the place
    near = np.argpartition(order, n - k, axis=1)[:, n - k :]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(order, near, axis=1), axis=1), axis=1)
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1) / float(UNIT) ** 2, 1e-3)
    weight *= weight
    weight *= weight
    total, good = np.zeros(len(x)), np.zeros(len(x))
    for j in range(k):
        total += weight[:, j]
        good += weight[:, j] * labels[near[:, j]]
    return np.clip(good / total, 0, 1)


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row; 1 is good. Null and empty texts score by the votes of the nearest (shortest) texts. Without labels all score 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dict(model))  # TERMS x DIMS, and DIMS numbers a labelled text of the bounded sample

    def run(batches):
        model, terms = per_worker(shared, lambda m: (m, Terms()))
        for batch in batches:
            x = np.array([counts(t, terms) for t in batch.column(1).to_pylist()], dtype=np.float32).reshape(-1, TERMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vote(x, model))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """docs whose texts score at least threshold, columns as they are. Only texts go to Python, only verdicts come back."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dict(model))

    @F.arrow_udf("boolean")
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, terms = per_worker(shared, lambda m: (m, Terms()))
        for texts in columns:
            yield pa.array(vote(np.array([counts(t, terms) for t in texts.to_pylist()], dtype=np.float32).reshape(-1, TERMS), model) >= threshold)

    return docs.where(good("text"))


def trained(spark, docs: DataFrame, sf_dir: str, per_class: int = 1500) -> dict:
    """Learns from at most per_class labelled documents of either class that are not held out."""
    return fit(training_sample(docs, table(spark, sf_dir, "labels"), "quality", per_class))


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = quality(docs, trained(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
