"""Deterministic splits, samples and apportionment: by hashes of ids, never by row order or random state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash60


def bucket_rank(rows: DataFrame, strata: list[str], h: str, ties: list[str]) -> DataFrame:
    """rows with rank (from 1, by the 60-bit hash h, then ties) and size of their stratum. Ranks come from prefix sums over about sqrt(n) buckets of the hash, so no
    window holds a stratum, only a bucket of it."""
    buckets = max(1, math.isqrt(rows.count()))
    dealt = rows.withColumn("_b", F.shiftright(F.shiftright(h, 30) * F.lit(buckets), 30))
    counts = dealt.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    part = Window.partitionBy(*strata)
    upto = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_b").alias("_bb"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(part).alias("size"))
    same = F.col("_b") == F.col("_bb")
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy(h, *ties))
    return dealt.join(sums, same).withColumn("rank", (F.col("_before") + inside).cast("long")).select(*rows.columns, "rank", "size")


def hash_rank(rows: DataFrame, row_id: str, strata: list[str], salt: str) -> DataFrame:
    """rows with rank (from 1, by hash, then id) and size of their stratum."""
    h = hash60(F.concat(F.lit(salt + "|"), *[x for s in strata for x in (F.coalesce(F.col(s).cast("string"), F.lit("")), F.lit("|"))], F.col(row_id).cast("string")))
    return bucket_rank(rows.withColumn("_h", h), strata, "_h", [row_id]).drop("_h")


def rank_cuts(rank: Column, size: Column) -> Column:
    """test, val, train: under three rows all train; else about 20 and 10 in a hundred, rounded, one at least."""
    test = F.greatest(F.lit(1), F.floor((20 * size + 50) / 100))
    val = F.greatest(F.lit(1), F.floor((10 * size + 50) / 100))
    return F.when(size < 3, "train").when(rank <= test, "test").when(rank <= test + val, "val").otherwise("train")


def apportion(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, weight, quota): floors of total * weight / sum, the rest by largest remainder, ties by key. Integer arithmetic. A small table of cells."""
    every = F.sum(weight).over(Window.partitionBy())
    shares = weights.select(key, F.col(weight).cast("long").alias(weight), every.cast("long").alias("_w"))
    floors = shares.withColumn("_f", F.expr(f"({total} * {weight}) div _w")).withColumn("_rem", F.expr(f"({total} * {weight}) % _w"))
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    more = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rem"), key)) <= left
    return floors.select(key, weight, (F.col("_f") + more.cast("long")).alias("quota"))


def stratified_sample(rows: DataFrame, row_id: str, strata: list[str], quota: int, salt: str) -> DataFrame:
    return hash_rank(rows, row_id, strata, salt).where(F.col("rank") <= quota)


def sample_bucket(row_id: Column, salt: str, rate: float) -> Column:
    """Whether an id is in the audit sample: its salted hash, as a share of 2**60, is below rate. The same in batch and stream."""
    return hash60(F.concat(F.lit(salt + "|"), row_id.cast("string"))) < int(rate * (1 << 60))


def water_fill(cells: list[tuple[str, int]], total: int, cap: int) -> dict[str, int]:
    """Deals total over a few cells in proportion to weight, none above cap; what a full cell can't take goes to the others. Driver-side, tiny."""
    if cap * len(cells) < total:
        raise ValueError(f"{len(cells)} cells of at most {cap} can't hold {total}")
    out, open_, left = dict.fromkeys((k for k, _ in cells), 0), dict(cells), total
    while left:
        weight = sum(open_.values()) or len(open_)
        shares = {k: left * (w if sum(open_.values()) else 1) for k, w in open_.items()}
        given = {k: s // weight for k, s in shares.items()}
        for k in sorted(open_, key=lambda k: (-(shares[k] % weight), k))[: left - sum(given.values())]:
            given[k] += 1
        full = [k for k in open_ if out[k] + given[k] >= cap]
        if not full:
            for k, n in given.items():
                out[k] += n
            return out
        for k in full:
            left -= cap - out[k]
            out[k] = cap
            del open_[k]
    return out


def greedy_pick(groups: DataFrame, stratum: str, group: str, size: str, target: float) -> DataFrame:
    """(stratum, group, picked): groups by hash order, each taken if that brings the stratum's sum nearer to target * its total. A fold
    over the sorted groups of a stratum: order-dependent by definition, so a stratum's list of groups must fit in a task."""
    h = hash60(F.col(group).cast("string"))
    lists = groups.groupBy(stratum).agg(
        F.sum(size).cast("double").alias("_total"), F.array_sort(F.collect_list(F.struct(h.alias("h"), F.col(group).alias("g"), F.col(size).cast("double").alias("n")))).alias("_l")
    )
    goal = F.col("_total") * target
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<g:string,picked:boolean>>").alias("out"))

    def step(a, x):
        take = F.abs(a["sum"] + x["n"] - goal) < F.abs(a["sum"] - goal)
        row = F.struct(x["g"].cast("string").alias("g"), take.alias("picked"))
        return F.struct((a["sum"] + F.when(take, x["n"]).otherwise(0.0)).alias("sum"), F.concat(a["out"], F.array(row)).alias("out"))

    folded = lists.select(stratum, F.aggregate("_l", start, step)["out"].alias("_o"))
    return folded.select(stratum, F.explode("_o").alias("_x")).select(stratum, F.col("_x.g").alias(group), F.col("_x.picked").alias("picked"))


def weighted_choice(draw: Column, cells: list[tuple[str, int]]) -> Column:
    """The cell whose stretch of integer weights holds draw modulo their sum."""
    total, upto, out = sum(w for _, w in cells), 0, None
    d = F.pmod(draw, F.lit(total))
    for name, w in cells:
        upto += w
        out = F.when(d < upto, name) if out is None else out.when(d < upto, name)
    return out


def assign_families(family: DataFrame, category: str, size: str, salt: str, reserve: float = 0.08, least: int = 30) -> DataFrame:
    """Families to test, val, train by rank cuts within their category; in categories of at least `least` families the last ranks are held in reserve."""
    ranked = hash_rank(family, "family", [category], salt)
    held = F.when(F.col("size") >= least, F.floor(F.col("size") * reserve)).otherwise(F.lit(0))
    cut = rank_cuts(F.col("rank"), F.col("size") - held)
    return ranked.withColumn("split", F.when(F.col("rank") > F.col("size") - held, "reserve").otherwise(cut))
