"""Evaluation of decisions: validated joins, confusion views, slices, pairs, ranking, calibration, intervals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import hash60
from ..functions.stats import confusion, mcnemar_exact, ratio


def cell(label: Column, decision: Column) -> Column:
    """TP, TN, FP or FN with BLOCK positive; a decision that is neither BLOCK nor ALLOW is an error in the true class."""
    return (
        F.when((label == "BLOCK") & (decision == "BLOCK"), "TP").when(label == "BLOCK", "FN").when((label == "ALLOW") & (decision == "ALLOW"), "TN").when(label == "ALLOW", "FP")
    )


def prediction_problems(cases: DataFrame, predictions: DataFrame, row_id: str, digest: str) -> DataFrame:
    """(row_id, problem): missing, extra, duplicate or changed predictions; none means that the join is 1:1 and faithful."""
    counts = predictions.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n"), F.min(digest).alias("_d"))
    both = cases.select(row_id, F.col(digest).alias("_c"), F.lit(1).alias("_in")).join(counts, row_id, "full_outer")
    problem = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_in").isNull(), "extra").when(F.col("_n") > 1, "duplicate").when(~F.col("_c").eqNullSafe(F.col("_d")), "changed")
    )
    return both.select(row_id, problem.alias("problem")).where("problem is not null")


def counts(cells: Column) -> list[Column]:
    return [F.count_if(cells == c).alias(c.lower()) for c in ("TP", "FP", "TN", "FN")]


def metrics(rows: DataFrame, cells: Column, by: list[str], digits: int = 6) -> DataFrame:
    """Confusion counts and every derived metric, by group; undefined ratios are null."""
    table = rows.groupBy(*by).agg(*counts(cells))
    derived = confusion(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return table.select(*by, "tp", "fp", "tn", "fn", *[F.round(v, digits).alias(k) for k, v in derived.items()])


def three_views(rows: DataFrame, label: str, decision: str, valid: str) -> DataFrame:
    """principal (invalid = error), parseable_only (invalid left out) and runtime (invalid fails closed, to BLOCK) in one pass."""
    d, y = F.when(F.col(valid), F.col(decision)), F.col(label)
    views = {"principal": cell(y, F.coalesce(d, F.lit("INVALID"))), "parseable_only": F.when(F.col(valid), cell(y, d)), "runtime": cell(y, F.coalesce(d, F.lit("BLOCK")))}
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("view"), c.alias("cell")) for n, c in views.items()])).alias("_x"))
    return metrics(long.select("_x.*"), F.col("cell"), ["view"])


def slices(rows: DataFrame, cells: Column, fields: list[str]) -> DataFrame:
    """Metrics by each of several fields, one scan by grouping sets; a null value is 'unknown'."""
    base = rows.select(cells.alias("cell"), *[F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in fields])
    sets = base.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.grouping_id().alias("_g"), *counts(F.col("cell")))
    width = len(fields)
    which = {((1 << width) - 1) ^ (1 << (width - 1 - i)): f for i, f in enumerate(fields)}
    field = F.lit(None).cast("string")
    for g, f in which.items():
        field = F.when(F.col("_g") == g, f).otherwise(field)
    named = sets.select(field.alias("field"), F.coalesce(*[F.col(f) for f in fields]).alias("value"), "tp", "fp", "tn", "fn")
    derived = confusion(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return named.select("*", *[F.round(derived[k], 6).alias(k) for k in ("precision_block", "recall_block", "fpr", "f1_block")])


def paired(rows: DataFrame, first: Column, second: Column, by: list[str]) -> DataFrame:
    """Discordance of two yes/no columns; a null on either side is an invalid pair: left out, counted. With McNemar's exact p."""
    ok = first.isNotNull() & second.isNotNull()
    table = rows.groupBy(*by).agg(
        F.count_if(ok & first & second).alias("both"), F.count_if(ok & first & ~second).alias("first_only"),
        F.count_if(ok & ~first & second).alias("second_only"), F.count_if(ok & ~first & ~second).alias("neither"), F.count_if(~ok).alias("invalid"),
    )
    return table.withColumn("p_value", F.round(mcnemar_exact(F.col("first_only"), F.col("second_only")), 6))


def holm(tests: DataFrame, key: str, p: str) -> DataFrame:
    """Step-down adjusted p: the running maximum of (m - rank) * p, at most 1. A small table of tests."""
    w = Window.partitionBy()
    order = w.orderBy(p, key)
    ranked = tests.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(order))
    step = ranked.withColumn("_s", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    return step.select(key, p, F.round(F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("p_holm"))


def auc_ap(rows: DataFrame, label: Column, score: str) -> DataFrame:
    """AUC (ties count half) and average precision (tied scores move together). Rows are counted by distinct score before the running sums, and these run in
    about sqrt(n) stretches of the score's range, whose totals come first: no window holds all scores."""
    by_score = rows.groupBy(F.col(score).cast("double").alias("_s")).agg(F.count_if(label).alias("_p"), F.count_if(~label).alias("_n"))
    n, low, high = by_score.agg(F.count("_s"), F.min("_s"), F.max("_s")).first()
    stretches = max(1, math.isqrt(n or 0))
    place = F.width_bucket("_s", F.lit(low or 0.0), F.lit(high), F.lit(stretches)) if high is not None and high > low else F.lit(1)
    dealt = by_score.withColumn("_b", place.cast("long"))
    totals = dealt.groupBy("_b").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"))
    over = Window.partitionBy().orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    above = totals.select("_b", (F.sum("_bp").over(over) - F.col("_bp")).alias("_ap0"), (F.sum("_bn").over(over) - F.col("_bn")).alias("_an0"))
    down = Window.partitionBy("_b").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(above, "_b").select("_p", "_n", (F.col("_ap0") + F.sum("_p").over(down)).alias("_cp"), (F.col("_an0") + F.sum("_n").over(down)).alias("_cn"))
    p, n, cp, cn = (F.col(c) for c in ("_p", "_n", "_cp", "_cn"))
    sums = run.agg(F.sum(p).alias("_P"), F.sum(n).alias("_N"), F.sum(n * (cp - p) + 0.5 * p * n).alias("_u"), F.sum(p * (cp / (cp + cn))).alias("_ap"))
    auc = ratio(F.col("_u"), F.col("_P").cast("double") * F.col("_N"))
    return sums.select(F.col("_P").alias("positives"), F.col("_N").alias("negatives"), F.round(auc, 6).alias("auc"), F.round(ratio(F.col("_ap"), F.col("_P")), 6).alias("average_precision"))


def calibration(rows: DataFrame, label: Column, p: Column, bins: int = 10) -> DataFrame:
    """Reliability table by equal bins, the top one closed: n, mean p, observed rate, gap."""
    b = rows.select(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long").alias("bin"), p.alias("p"), label.cast("int").alias("y"))
    t = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("m"), F.avg("y").alias("r"))
    return t.select("bin", "n", F.round("m", 6).alias("mean_p"), F.round("r", 6).alias("rate"), F.round(F.abs(F.col("m") - F.col("r")), 6).alias("gap"))


def calibration_errors(rows: DataFrame, label: Column, p: Column, bins: int = 10, eps: float = 1e-15) -> DataFrame:
    """Brier score, log loss, ECE and MCE."""
    y, q = label.cast("double"), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    b = rows.select(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin"), p.alias("p"), y.alias("y"), ((p - y) * (p - y)).alias("s"), (-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("l"))
    t = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("g"), F.sum("s").alias("s"), F.sum("l").alias("l"))
    n = F.sum("n")
    return t.agg(n.alias("n"), F.round(F.sum("s") / n, 6).alias("brier"), F.round(F.sum("l") / n, 6).alias("log_loss"), F.round(F.sum(F.col("g") * F.col("n")) / n, 6).alias("ece"), F.round(F.max("g"), 6).alias("mce"))


def threshold_grid(rows: DataFrame, label: Column, p: Column, thresholds: list[float]) -> DataFrame:
    """Counts and rates at each threshold, in one aggregation over exploded thresholds (a short fixed list)."""
    base = rows.select(label.alias("y"), p.alias("p"), F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    t = base.groupBy("threshold").agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("y") & (F.col("p") >= F.col("threshold"))), ("fp", ~F.col("y") & (F.col("p") >= F.col("threshold"))), ("tn", ~F.col("y") & (F.col("p") < F.col("threshold"))), ("fn", F.col("y") & (F.col("p") < F.col("threshold"))))])
    return t.select("*", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"))


def cluster_bootstrap(rows: DataFrame, cluster: str, numerator: Column, reps: int, seed: str) -> DataFrame:
    """2.5, 50 and 97.5 percentiles (nearest rank) of a rate, resampling whole clusters with replacement. Draws come from hashes of
    (seed, rep, draw), so every engine draws the same. Rows are summed by cluster first: the resampling works on clusters."""
    sums = rows.groupBy(cluster).agg(F.sum(numerator.cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    numbered = sums.select((F.row_number().over(Window.partitionBy().orderBy(cluster)) - 1).cast("long").alias("i"), "k", "n")
    m = numbered.count()
    draws = rows.sparkSession.range(reps * m).select(F.expr(f"id div {m}").alias("rep"), F.expr(f"id % {m}").alias("d"))
    i = F.pmod(hash60(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("d").cast("string"))), F.lit(m))
    rates = draws.withColumn("i", i).join(numbered, "i").groupBy("rep").agg((F.sum("k") / F.sum("n")).alias("rate"))
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by rate)")
    return rates.agg(F.lit(m).cast("long").alias("clusters"), F.count(F.lit(1)).alias("reps"), F.round(q(0.025), 6).alias("low"), F.round(q(0.5), 6).alias("median"), F.round(q(0.975), 6).alias("high"))


def multiclass(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined, and the support."""
    cells = rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    tp = cells.where(F.col(label) == F.col(predicted)).select(F.col(label).alias("class"), F.col("n").alias("tp"))
    s = cells.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"))
    p = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted"))
    j = s.join(p, "class", "full_outer").join(tp, "class", "left").na.fill(0)
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    pr, rc = zero(F.col("tp"), F.col("predicted")), zero(F.col("tp"), F.col("support"))
    return j.select("class", "support", "predicted", "tp", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(zero(2 * F.col("tp"), F.col("predicted") + F.col("support")), 6).alias("f1"))


def suppress(bins: DataFrame, key: str, n: str, k: int = 10) -> DataFrame:
    """k-rule: bins under k are hidden, and then the smallest shown ones until the hidden pool is empty or k. A small table of bins."""
    order = Window.partitionBy().orderBy(n, key)
    upto = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    small = F.sum(F.when(F.col(n) < k, F.col(n)).otherwise(0)).over(Window.partitionBy())
    before = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hide = (F.col(n) < k) | ((small > 0) & (before < k))
    return bins.withColumn("_u", upto).withColumn("hidden", hide).select(key, F.when(~F.col("hidden"), F.col(n)).alias(n), "hidden")


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95 % bounds by bisection on the binomial tail, for tables of results."""
    import math



    def tail(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    def solve(f):
        low, high = 0.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    rows = []
    for a, b in zip(k, n):
        rows.append((0.0 if a == 0 else solve(lambda p: tail(a, b, p) < 0.025), 1.0 if a == b else solve(lambda p: tail(a + 1, b, p) < 0.975)) if b else (0.0, 1.0))
    return pd.DataFrame(rows, columns=["low", "high"])
