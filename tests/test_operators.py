import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import curate, decide, evaluate, graph, loadlog, ml, relational, similarity, split
from lumenfold.streaming import jobs


def test_components_of_random_graphs(spark):
    for seed, n, m in ((1, 60, 50), (2, 200, 120), (3, 30, 200)):
        r = random.Random(seed)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)]
        root = {x: x for e in edges for x in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        df = spark.createDataFrame([*edges, (5, None)], "src long, dst long")
        got = {x["node"]: x["root"] for x in graph.connected_components(df).collect()}
        assert got == {x: find(x) for x in root}
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.connected_components(empty).count() == 0


def test_declared_merges(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, cat string")
    merges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 9)], "left_id long, right_id long")
    got = {(r[0], r[1]): r[2] for r in graph.declared_merges(merges, nodes, "cat").collect()}
    assert got == {(1, 2): "repeated", (2, 1): "repeated", (1, 3): "spans_strata", (1, 9): "unknown_id"}


@pytest.mark.parametrize("num, den", [(3, 5), (4, 5), (1, 2)])
def test_similar_pairs_loses_none(spark, num, den):
    r = random.Random(7)
    sets = [(i, [str(x) for x in r.sample(range(30), r.randint(1, 12))]) for i in range(120)] + [(500, []), (501, None)]
    sets += [(200 + i, s[1][:-1] + ["zz"]) for i, s in enumerate(sets[:40])]
    got = {(x["a"], x["b"]): (x["shared"], x["united"]) for x in similarity.similar_pairs(spark.createDataFrame(sets, "id long, t array<string>"), "id", "t", num, den).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(sorted((i, set(t)) for i, t in sets if t), 2):
        if den * len(a & b) >= num * len(a | b):
            want[i, j] = (len(a & b), len(a | b))
    assert got == want


def test_water_fill():
    assert split.water_fill([("a", 1), ("b", 1)], 5, 3) == {"a": 3, "b": 2}
    assert split.water_fill([("a", 90), ("b", 5), ("c", 5)], 20, 12) == {"a": 12, "b": 4, "c": 4}
    with pytest.raises(ValueError):
        split.water_fill([("a", 1)], 5, 3)


def test_greedy_pick(spark):
    import hashlib

    rows = [("x", f"g{i}", 3 + i % 5) for i in range(25)]
    got = {r["g"]: r["picked"] for r in split.greedy_pick(spark.createDataFrame(rows, "s string, g string, n long"), "s", "g", "n", 0.2).collect()}
    total = sum(n for _, _, n in rows)
    taken, want = 0, {}
    for _, g, n in sorted(rows, key=lambda r: int(hashlib.sha256(r[1].encode()).hexdigest()[:15], 16)):
        want[g] = abs(taken + n - total * 0.2) < abs(taken - total * 0.2)
        taken += n * want[g]
    assert got == want


def test_weighted_choice(spark):
    got = [r[0] for r in spark.range(10).select(split.weighted_choice(F.col("id"), [("a", 1), ("b", 3)])).collect()]
    assert got == ["a", "b", "b", "b"] * 2 + ["a", "b"]


def test_excluded_row_claims_nothing(spark):
    rows = spark.createDataFrame([(1, "x", True), (2, "x", False), (3, "x", False), (4, "y", False)], "id long, v string, bad boolean")
    denied = spark.createDataFrame([("y",)], "_v string")
    got = {r["id"]: r["exclusion_reason"] for r in curate.exclusion_pipeline(rows, F.when(F.col("bad"), "bad"), F.col("v"), denied, ["id"]).collect()}
    assert got == {1: "bad", 2: None, 3: "duplicate_value", 4: "oracle_collision"}


def test_cells_and_views(spark):
    rows = spark.createDataFrame([("BLOCK", "BLOCK", True), ("ALLOW", "ALLOW", True), ("BLOCK", "BLOCK", False), ("ALLOW", "ALLOW", False)], "y string, d string, ok boolean")
    got = {r["view"]: (r["tp"], r["tn"], r["fp"], r["fn"]) for r in evaluate.three_views(rows, "y", "d", "ok").collect()}
    assert got == {"principal": (1, 1, 1, 1), "parseable_only": (1, 1, 0, 0), "runtime": (2, 1, 1, 0)}
    empty = evaluate.metrics(rows.where("false").withColumn("c", F.lit("TP")), F.col("c"), []).first()
    assert empty["accuracy"] is None and empty["mcc"] is None


def test_published_confusion(spark):
    from lumenfold.functions.stats import confusion

    m = confusion(F.lit(185), F.lit(3), F.lit(297), F.lit(93))
    row = spark.range(1).select(*[c.alias(k) for k, c in m.items()]).first()
    assert (round(row["precision_block"], 3), round(row["recall_block"], 4), round(row["fpr"], 3), round(row["f1_block"], 3)) == (0.984, 0.6655, 0.010, 0.794)


def test_nearest_rank(spark):
    d = spark.range(1, 5)
    assert d.agg(loadlog.rank_percentile("id", 0.5)).first()[0] == 2
    assert spark.range(1, 101).agg(loadlog.rank_percentile("id", 0.95)).first()[0] == 95


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k long, t long, v string")
    assert {tuple(r) for r in relational.asof(left, right, ["k"], "t", ["v"]).collect()} == {(1, 5, "a"), (1, 10, "b"), (2, 1, None)}
    points, spans = spark.range(50).withColumnRenamed("id", "x"), spark.createDataFrame([("p", 3, 27), ("q", 40, 41)], "n string, a long, b long")
    assert {(r["x"], r["n"]) for r in relational.range_join(points, "x", spans, "a", "b", 10).collect()} == {(i, "p") for i in range(3, 27)} | {(40, "q")}
    big = spark.range(100).select((F.col("id") % 3).alias("k"))
    assert relational.salted_join(big, spark.range(3).withColumnRenamed("id", "k"), "k", 4).count() == 100


def test_cascade_fails_closed(spark):
    rows = spark.createDataFrame([(True, 0.9, True, "ALLOW"), (None, 0.9, True, "ALLOW"), (False, 0.9, False, "ALLOW"), (True, 0.1, True, "BLOCK"), (True, 0.1, None, "ALLOW")], "ok boolean, p double, fok boolean, d string")
    applied, stage = decide.request_cascade(F.lit(False), F.lit(False), F.lit(False), F.col("ok"), F.col("p"), 0.5, F.col("fok"), F.col("d"))
    assert [tuple(r) for r in rows.select(applied, stage).collect()] == [("DENY", "model"), ("FORWARD", "final"), ("DENY", "final_invalid"), ("DENY", "final"), ("DENY", "final_invalid")]


def test_token_bucket_batch_stream_and_loop(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = {r["event_id"]: r["granted"] for r in jobs.token_bucket_batch(events, 1 / 14400, 3.0).collect()}
    by_user = {}
    for r in events.collect():
        by_user.setdefault(r["user_id"], []).append((r["ts"], r["event_id"]))
    want = {}
    for rows in by_user.values():
        tokens, last = 3.0, None
        for ts, i in sorted(rows):
            tokens = tokens if last is None else min(3.0, tokens + (ts - last).total_seconds() / 14400)
            last = ts
            want[i] = tokens >= 1
            tokens -= want[i]
    assert batch == want
    stream = jobs.run_available(jobs.token_bucket_stream(jobs.events_stream(spark, sf_dir), 1 / 14400, 3.0), "bucket", "append")
    assert {r["event_id"]: r["granted"] for r in stream.collect()} == want


def test_stream_windows_and_single_outcomes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert jobs.run_available(jobs.one_outcome(jobs.events_stream(spark, sf_dir), "event_id"), "once", "append").count() == n
    closed = jobs.run_available(jobs.closed_windows(jobs.events_stream(spark, sf_dir)), "windows", "append")
    assert 0 < closed.agg(F.sum("n")).first()[0] <= n


def test_admission():
    assert jobs.admit([0, 0, 0, 0, 0, 10], 1, 2, 5.0) == ["served", "queued", "queued", "refused", "refused", "queued"]


def test_schedule_repeats(spark):
    a, b = (jobs.schedule(spark, 5, 20, "s").collect() for _ in range(2))
    assert a == b and 60 < len(a) < 140


def test_ml(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.rand(3) * 0.5).alias("x"), F.lit("c").alias("c"))
    for family in ml.FAMILIES:
        out = ml.fit_score(rows, rows, family, ["x"], ["c"])
        assert out.where("(p > 0.5) = (y = 1)").count() > 190
    for method in ("native", "sigmoid", "isotonic"):
        assert ml.calibrate(out, method, F.col("id")).count() == 200
    moved = ml.permuted(rows, "x", "id", "s")
    assert moved.agg(F.round(F.sum("x"), 6)).first() == rows.agg(F.round(F.sum("x"), 6)).first()
    texts = rows.select("y", F.when(F.col("y") == 1, "good morning all").otherwise("bad evening none").alias("t"))
    assert ml.char_tfidf_probe(texts, texts, "t", 100).where("(p > 0.5) = (y = 1)").count() == 200


def test_calibration_is_out_of_fold(spark):
    """A fold's own labels don't move its calibrated values; every row is calibrated once."""
    rows = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("double").alias("y"), ((F.col("id") * 37 % 100) / 100).alias("p"))
    own = ml.fold(F.col("id"), 5, "cal")
    flipped = rows.withColumn("y", F.when(own == 2, 1 - F.col("y")).otherwise(F.col("y")))
    for method in ("sigmoid", "isotonic"):
        one, two = ({r["id"]: round(r["calibrated"], 9) for r in ml.calibrate(d, method, F.col("id")).where(own == 2).collect()} for d in (rows, flipped))
        assert one == two and one
        assert ml.calibrate(rows, method, F.col("id")).select("id").distinct().count() == 300


def test_importance_finds_the_field_that_matters(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.rand(3) * 0.5).alias("x"), F.rand(5).alias("z"))
    model = ml.fit(rows, "logistic", ["x", "z"], [])
    found = dict(ml.permutation_importance(model, rows, ["x", "z"], "id", "s", lambda d: evaluate.auc_ap(d, F.col("y") == 1, "p").first()["auc"]))
    assert found["x"] > 0.3 and abs(found["z"]) < 0.05


def test_winner(spark):
    c = spark.createDataFrame([("a", 0.9, 0.0, 5.0), ("b", 0.89, -0.01, 1.0), ("c", 0.5, 0.2, 0.1)], "name string, score double, low double, cost double")
    assert ml.winner(c).first()["winner"] == "b"
