"""Reason ledgers, deduplication, caps, balance, waterfalls. Nothing is dropped silently: excluded rows keep their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Column, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """rows with copy (1 for the first of its key by order), keeper (the first's first order column) and copies."""
    part = Window.partitionBy(*(scope or []), key)
    w = part.orderBy(*order)
    return rows.select(
        "*",
        F.row_number().over(w).cast("long").alias("copy"),
        F.first(order[0]).over(w).alias("keeper"),
        F.count(F.lit(1)).over(part).alias("copies"),
    )


def keep_one(rows: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """One row a key: the smallest by order, with the columns of carry. A partially aggregated min_by: a hot key needs no window."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in carry])


def reason_ledger(rows: DataFrame, reason: Column, by: list[str]) -> DataFrame:
    """Counts of rows by reason; they add up to the input."""
    return rows.withColumn("reason", reason).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def exclusion_pipeline(rows: DataFrame, reason: Column, value: Column, denied: DataFrame, order: list[str]) -> DataFrame:
    """rows with status and exclusion_reason: the reason; else duplicate_value if an earlier surviving row has the value; else oracle_collision
    if denied (one column, _v) has it. A row that is excluded by reason doesn't claim its value. order must tell rows apart: rows alike in it both survive."""
    named = rows.withColumn("_reason", reason).withColumn("_v", value).withColumn("_o", F.struct(*order))
    first = named.where("_reason is null").groupBy("_v").agg(F.min("_o").alias("_first"))  # a partial minimum: a value that a third of all rows have is no task's burden
    hits = denied.select("_v").where("_v is not null").distinct().withColumn("_denied", F.lit(True))
    joined = named.join(first.select(F.col("_v").alias("_w"), "_first"), F.col("_v").eqNullSafe(F.col("_w")), "left").join(hits, "_v", "left")
    why = F.coalesce("_reason", F.when(F.col("_o") > F.col("_first"), "duplicate_value"), F.when(F.col("_denied"), "oracle_collision"))
    out = joined.withColumn("exclusion_reason", why).withColumn("status", F.when(why.isNull(), "ACCEPTED").otherwise("EXCLUDED"))
    return out.drop("_reason", "_v", "_w", "_o", "_first", "_denied")


def waterfall(rows: DataFrame, steps: list[tuple[str, Column]], key: str) -> DataFrame:
    """A row a step: rows and distinct keys that pass it and all before it. One pass: the steps are conditional counts."""
    passed, aggs = F.lit(True), []
    for name, holds in steps:
        passed = passed & F.coalesce(holds, F.lit(False))
        aggs += [F.count_if(passed).alias(f"{name}_rows"), F.count_distinct(F.when(passed, F.col(key))).alias(f"{name}_keys")]
    one = rows.agg(*aggs)
    parts = [F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias("name"), F.col(f"{n}_rows").alias("rows"), F.col(f"{n}_keys").alias("keys")) for i, (n, _) in enumerate(steps)]
    return one.select(F.inline(F.array(*parts)))


def group_cap(rows: DataFrame, group: list[str], order: list[str], cap: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def round_robin_cap(rows: DataFrame, source: str, group: str, order: list[str], quota: int) -> DataFrame:
    """Breadth first: the first of every group, then the second, until a source has quota rows. Adds depth and taken (place in the source). Both ranks are cut
    where they are made, so that tasks hold only quota rows a group, and groups' quotas a source, before and after the shuffle."""
    depth = F.row_number().over(Window.partitionBy(source, group).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(source).orderBy("depth", group, *order))
    shallow = rows.withColumn("depth", depth).where(F.col("depth") <= quota).withColumn("taken", place).where(F.col("taken") <= quota)
    return shallow.withColumns({c: F.col(c).cast("long") for c in ("depth", "taken")})


def class_balance(rows: DataFrame, stratum: str, label: str, h: str, ties: list[str]) -> DataFrame:
    """Of each stratum as many rows of either of two classes (0, 1) as the rarer has, by the 60-bit hash h."""
    from .split import bucket_rank

    sizes = rows.groupBy(stratum).agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_q"))
    return bucket_rank(rows, [stratum, label], h, ties).join(sizes, stratum).where(F.col("rank") <= F.col("_q")).drop("rank", "size", "_q")


def collisions(rows: DataFrame, key: str, scope: str) -> DataFrame:
    """Keys seen in two scopes or more, with the scopes; nothing is removed."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(scope)).alias("scopes")).where(F.size("scopes") > 1)


def diagnostics(rows: DataFrame, row_id: str, rules: list[tuple[str, Column]], examples: int) -> DataFrame:
    """(code, row_id): every rule a row breaks, the first `examples` rows of each code."""
    codes = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules]), lambda c: c.isNotNull())
    found = rows.select(row_id, F.explode(codes).alias("code"))
    return group_cap(found, ["code"], [row_id], examples).select("code", row_id)


def batches(rows: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """rows with batch: consecutive runs of size within by."""
    return rows.withColumn("batch", F.expr(f"(row_number() over (partition by {', '.join(by)} order by {', '.join(order)}) - 1) div {size}"))
