"""Request-log analytics: percentiles, accounting, saturation, streaks, drift, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def rank_percentile(value: str, p: float) -> Column:
    """Nearest rank: no interpolation."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def linear_percentile(value: str, p: float) -> Column:
    return F.expr(f"percentile({value}, {p})")


def distribution(rows: DataFrame, value: str, by: list[str], digits: int = 6) -> DataFrame:
    """n, mean, nearest-rank p50/p95/p99, extremes, both standard deviations, and a flag for fewer than 100 rows."""
    r = lambda c, n: F.round(c, digits).alias(n)
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), r(F.avg(value), "mean"), *[r(rank_percentile(value, p), n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))],
        r(F.min(value), "min"), r(F.max(value), "max"), r(F.stddev_pop(value), "std_pop"), r(F.stddev_samp(value), "std_samp"), (F.count(value) < 100).alias("low_confidence"),
    )


def accounting(rows: DataFrame, by: list[str], ok: Column, answered: Column, at: str, window_s: float) -> DataFrame:
    """offered, answered, useful; rates over the window or the observed span, whichever is longer; saturated if not all offered were useful to 95 %."""
    span = F.greatest(F.lit(float(window_s)), (F.max(F.unix_micros(F.col(at).cast("timestamp"))) - F.min(F.unix_micros(F.col(at).cast("timestamp")))) / 1e6)
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("offered"), F.count_if(answered).alias("answered"), F.count_if(ok).alias("useful"), span.alias("_s"))
    return sums.select(
        *by, "offered", "answered", "useful", F.round(F.col("offered") / F.col("_s"), 6).alias("offered_rate"), F.round(F.col("useful") / F.col("_s"), 6).alias("goodput"),
        (F.col("useful") * 20 < F.col("offered") * 19).alias("saturated"),
    )


def islands(rows: DataFrame, by: list[str], order: list[str], good: Column) -> DataFrame:
    """Runs of consecutive good rows: rows with island (bad rows seen before) and good."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("good", good).withColumn("island", F.sum((~F.col("good")).cast("int")).over(w))


def first_streak(rows: DataFrame, by: list[str], at: str, order: list[str], good: Column, length: int) -> DataFrame:
    """When each group's first run of at least `length` good rows begins; null if there is none."""
    runs = islands(rows, by, order, good).where("good").groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("start"))
    return rows.select(*by).distinct().join(runs.where(F.col("n") >= length).groupBy(*by).agg(F.min("start").alias("recovered_at")), by, "left")


def drift_thirds(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Median of the first third (n div 3 rows) and of the last, and their ratio; the remainder in the middle belongs to neither."""
    part = Window.partitionBy(*by)
    ranked = rows.select(*by, value, F.row_number().over(part.orderBy(*order)).alias("r"), F.count(F.lit(1)).over(part).alias("n"))
    k = F.expr("n div 3")
    tag = F.when(F.col("r") <= k, "first").when(F.col("r") > F.col("n") - k, "last")
    med = lambda which: F.expr(f"percentile(case when third = '{which}' then {value} end, 0.5)")
    out = ranked.withColumn("third", tag).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), med("first").alias("_a"), med("last").alias("_b"))
    return out.select(*by, "n", F.round("_a", 6).alias("first_median"), F.round("_b", 6).alias("last_median"), F.round(ratio(F.col("_b"), F.col("_a")), 6).alias("drift"))


def reconcile(sent: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Multisets by key: counts on both sides, lost = sent - received, unknown = received - sent, matched = their minimum."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((sent, "sent"), (received, "received")))
    both = a.join(b, key, "full_outer").na.fill(0, ["sent", "received"])
    zero = F.lit(0).cast("long")
    return both.select(
        key, "sent", "received", F.greatest(F.col("sent") - F.col("received"), zero).alias("lost"), F.greatest(F.col("received") - F.col("sent"), zero).alias("unknown"),
        F.least("sent", "received").alias("matched"),
    )


def deltas(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Change of value since the group's sample before; a drop is a restart and gives no row."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("delta", F.col(value) - before).where("delta >= 0")


def cumulative_histogram(rows: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """Rows at or below each edge, and in all ('+Inf'), as counters keep them: one conditional count an edge."""
    sums = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)], F.count(value).alias("_inf"))
    cells = [F.struct(F.lit(str(e)).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n"))]
    return sums.select(*by, F.inline(F.array(*cells)))


def phases(rows: DataFrame, at: str, spans: DataFrame, closed: bool = False) -> DataFrame:
    """rows with the phase of [begin, end) (or [begin, end]) in which they were scheduled; a few spans, broadcast after a check of their number."""
    if spans.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 phases: join on a bucket of time first")
    upper = (F.col(at) <= F.col("end")) if closed else (F.col(at) < F.col("end"))
    return rows.join(F.broadcast(spans), (F.col(at) >= F.col("begin")) & upper)


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Across runs: extremes, mean, median and range as a percentage of the mean."""
    a = rows.groupBy(*by).agg(F.count(value).alias("runs"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("m"), linear_percentile(value, 0.5).alias("d"))
    pct = 100 * F.try_divide(F.col("hi") - F.col("lo"), F.col("m"))
    return a.select(*by, "runs", *[F.round(c, 6).alias(n) for c, n in (("lo", "min"), ("hi", "max"), ("m", "mean"), ("d", "median"))], F.round(pct, 6).alias("spread_pct"))


def compare(before: DataFrame, after: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Percent change by key with a verdict: both sides' gaps and zero baselines have their own status."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    pct = 100 * (F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0))
    status = (
        F.when(F.col("before").isNull(), "baseline_missing").when(F.col("after").isNull(), "candidate_missing").when(F.col("before") == 0, "baseline_zero")
        .when(pct > tolerance, "regressed").when(pct < -tolerance, "improved").otherwise("unchanged")
    )
    return j.select(key, F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(pct, 6).alias("change_pct"), status.alias("status"))


def merged_counters(rows: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Counters summed by key, partial and final ones alike: the sum knows no order."""
    return rows.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in counters])
