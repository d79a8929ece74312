"""Joins by words, each against a plain search, on both of their ways."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import evaluate, gates, split


def tables(spark, seed=4):
    r = random.Random(seed)
    words = "alpha beta gamma delta é1 zeta eta x".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(0, 40)) + r.choice(["", "\nline", ".", "  "])) for i in range(60)] + [(100, None), (101, "")]
    items = [(i, rows[i][1][r.randint(0, 5) : r.randint(8, 90)] if i % 3 else text(r.randint(1, 12))) for i in range(40)] + [(50, "a"), (51, ""), (52, "beta gamma"), (53, "..")]
    return rows, items, spark.createDataFrame(rows, "row long, text string"), spark.createDataFrame(items, "item long, text string")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contains_join_matches_search(spark, monkeypatch, limit):
    monkeypatch.setattr(gates, "BROADCAST_ROWS", limit)
    rows, items, left, right = tables(spark)
    got = {(r["item"], r["row"]) for r in gates.contains_join(left, "row", right.withColumnRenamed("text", "probe"), "item").collect()}
    assert got == {(i, k) for i, p in items for k, t in rows if p and t and p in t} and got


@pytest.mark.parametrize("limit", [500_000, 0])
def test_ngram_overlap_matches_sets(spark, monkeypatch, limit):
    import re

    monkeypatch.setattr(gates, "BROADCAST_ROWS", limit)
    rows, items, left, right = tables(spark, 5)
    words = lambda t: re.findall("[a-z0-9à-ÿ]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for i, p in items:
        w = words(p)
        n = min(4, len(w))
        for k, t in rows:
            common = len(grams(w, n) & grams(words(t), n)) if n else 0
            if common:
                want[k, i] = (common, round(common / len(grams(w, n)), 6))
    got = {(r["row"], r["item"]): (r["shared"], r["overlap"]) for r in gates.ngram_overlap(left, "row", right, "item", 4).collect()}
    assert got == want and got
    assert gates.ngram_overlap(left, "row", right.where("false"), "item", 4).count() == 0


def test_bucket_rank_matches_sort(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.getrandbits(60) if i % 10 else 7) for i in range(500)]
    got = {x["i"]: (x["rank"], x["size"]) for x in split.bucket_rank(spark.createDataFrame(rows, "i long, s string, h long"), ["s"], "h", ["i"]).collect()}
    want = {}
    for s in ("a", "b", None):
        own = sorted((h, i) for i, t, h in rows if t == s)
        want |= {i: (k, len(own)) for k, (_, i) in enumerate(own, 1)}
    assert got == want


def test_auc_matches_pairs(spark):
    r = random.Random(3)
    rows = [(r.choice([r.random(), 0.5, 0.25, -1e6]), r.random() < 0.4) for _ in range(400)]
    got = evaluate.auc_ap(spark.createDataFrame(rows, "s double, y boolean"), F.col("y"), "s").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert abs(got["auc"] - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-6
    one = evaluate.auc_ap(spark.createDataFrame([(1.0, True), (1.0, False)], "s double, y boolean"), F.col("y"), "s").first()
    assert one["auc"] == 0.5 and evaluate.auc_ap(spark.createDataFrame([], "s double, y boolean"), F.col("y"), "s").first()["auc"] is None
