"""Ordered decisions: rule tables, staged cascades, outcomes of sequences, pair dispositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_reason


def rule_match(rows: DataFrame, row_id: str, subject: Column, rules: DataFrame, limit: int = 10_000) -> DataFrame:
    """(row_id, rule_id): the first rule, by priority, whose literal prefix the subject has; null if none. Closed world. Rules are broadcast
    behind a check of their number."""
    if rules.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rules: block them on a prefix first")
    named = rows.select(row_id, subject.alias("_s"))
    hit = named.join(F.broadcast(rules.select("rule_id", "priority", "prefix")), F.startswith("_s", "prefix"))
    first = hit.groupBy(row_id).agg(F.min_by("rule_id", F.struct("priority", "rule_id")).alias("rule_id"))
    return rows.select(row_id).join(first, row_id, "left")


def cascade(stages: list[tuple[str, Column, Column]], last: tuple[str, Column]) -> tuple[Column, Column]:
    """(applied, stage): each stage is (name, holds, applied) in order; what none decides goes to the last. A stage whose condition is
    null does not decide."""
    applied, stage = last[1], F.lit(last[0])
    for name, holds, value in reversed(stages):
        h = F.coalesce(holds, F.lit(False))
        applied, stage = F.when(h, value).otherwise(applied), F.when(h, F.lit(name)).otherwise(stage)
    return applied, stage


def request_cascade(rejected: Column, guarded: Column, fast: Column, model_ok: Column, p_block: Column, threshold: float, final_ok: Column, final: Column) -> tuple[Column, Column]:
    """protocol, guard, fast path, first model (defers when not OK), final classifier; anything invalid fails closed to DENY."""
    return cascade(
        [
            ("protocol", rejected, F.lit("DENY")),
            ("guard", guarded, F.lit("DENY")),
            ("fast_path", fast, F.lit("FORWARD")),
            ("model", model_ok & (p_block >= threshold), F.lit("DENY")),
            ("final_invalid", ~F.coalesce(final_ok, F.lit(False)), F.lit("DENY")),
        ],
        ("final", F.when(final == "BLOCK", "DENY").otherwise("FORWARD")),
    )


def sequence_outcome(rows: DataFrame, by: list[str], persisted: Column, unknown: Column, prevented: Column, delivered: Column) -> DataFrame:
    """One outcome a sequence: PERSISTED, UNKNOWN, PREVENTED_AT_ATTACK, DELIVERY_BLOCKED or ABSENT, the first that any of its rows shows."""
    flags = {n: F.coalesce(F.bool_or(c), F.lit(False)) for n, c in (("PERSISTED", persisted), ("UNKNOWN", unknown), ("PREVENTED_AT_ATTACK", prevented), ("DELIVERY_BLOCKED", ~delivered))}
    return rows.groupBy(*by).agg(first_reason(list(flags.items()), "ABSENT").alias("outcome"), F.count(F.lit(1)).alias("steps"))


def pair_disposition(rows: DataFrame, pair: str, included: Column, order: str) -> DataFrame:
    """Both members included: kept; a member excluded: excluded, its sibling withheld. Pairs have two rows: incomplete ones are named."""
    w = Window.partitionBy(pair)
    n, k = F.count(F.lit(1)).over(w), F.sum(included.cast("int")).over(w)
    kind = F.when(n != 2, "incomplete").when(k == 2, "kept").when(included, "withheld_sibling").otherwise("excluded")
    return rows.withColumn("disposition", kind)


def reviewer_verdict(human: Column, adjudicated: Column, first: Column, second: Column) -> Column:
    """The human's, else the adjudicated, else what both reviewers say, else VERIFIABLE with PROBABLY_CORRECT is PROBABLY_CORRECT, else PENDING. Blank is absent."""
    h, a = (F.nullif(F.trim(c), F.lit("")) for c in (human, adjudicated))
    mild = F.array_sort(F.array(first, second)) == F.array(F.lit("PROBABLY_CORRECT"), F.lit("VERIFIABLE"))
    return F.coalesce(h, a, F.when(first == second, first), F.when(mild, "PROBABLY_CORRECT"), F.lit("PENDING"))


def nearest(left: DataFrame, left_id: str, value: str, bins: DataFrame, limit: int = 10_000) -> DataFrame:
    """(left_id, bin): the bin nearest to value, the smaller of equals. Bins (one column, bin) are broadcast behind a check of their number and folded over:
    rows aren't multiplied."""
    found = [r[0] for r in bins.select("bin").distinct().orderBy("bin").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} bins")
    best = F.array_min(F.transform(F.array(*[F.lit(b) for b in found]), lambda b: F.struct(F.abs(b - F.col(value)).alias("d"), b.alias("bin"))))
    return left.select(left_id, best["bin"].alias("bin"))


def alignment(rows: DataFrame, meta: DataFrame, index: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(index, code): line-aligned sidecars: a side missing is META_NOT_ALIGNED and nothing else is said of that row; else every rule it breaks. Columns of
    meta are prefixed m_."""
    m = meta.select(*[F.col(c).alias(f"m_{c}") for c in meta.columns])
    both = rows.join(m, F.col(index) == F.col(f"m_{index}"), "full_outer")
    missing = F.col(index).isNull() | F.col(f"m_{index}").isNull()
    codes = F.when(missing, F.array(F.lit("META_NOT_ALIGNED"))).otherwise(F.filter(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(c)) for c, b in rules]), lambda x: x.isNotNull()))
    return both.select(F.coalesce(index, f"m_{index}").alias(index), F.explode(codes).alias("code"))


def ordered_match(flows: DataFrame, results: DataFrame, by: str, order: str) -> DataFrame:
    """k-th flow to k-th result of a group, after the leading flows that the results are fewer by (warm-up) are skipped."""
    part = Window.partitionBy(by)
    f = flows.withColumn("_k", F.row_number().over(part.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(part))
    r = results.withColumn("_k", F.row_number().over(part.orderBy(order))).withColumn("_m", F.count(F.lit(1)).over(part))
    f = f.select(by, F.col(order).alias("flow"), "_k", "_n")
    r = r.select(by, F.col(order).alias("result"), "_k", "_m")
    sizes = r.select(by, "_m").distinct()
    shifted = f.join(sizes, by).withColumn("_k", F.col("_k") - F.greatest(F.col("_n") - F.col("_m"), F.lit(0))).drop("_m")
    return shifted.join(r, [by, "_k"]).select(by, "flow", "result")


def wire_sections(line: Column) -> Column:
    """key=value tokens of a line as a map; a token without '=' has a null value."""
    return F.str_to_map(line, F.lit(" "), F.lit("="))


def fast_path(method: Column, path: Column, query: Column, policy: list[tuple[str, str, str, str, str | None]]) -> tuple[Column, Column]:
    """(rule, outcome) of a closed-world policy: rules are (name, method or '*', 'exact' or 'prefix', path, part that the query must hold or None), first
    match. outcome is FORWARD, or why no rule fits: method (no rule takes it), or no_rule."""
    fits = lambda kind, p: path == p if kind == "exact" else path.startswith(p)
    rules = [(n, (F.lit(True) if m == "*" else method == m) & fits(kind, p) & (F.lit(True) if part is None else F.contains(query, F.lit(part)))) for n, m, kind, p, part in policy]
    rule = first_reason([(n, F.coalesce(holds, F.lit(False))) for n, holds in rules])
    taken = method.isin(*{m for _, m, *_ in policy if m != "*"})
    return rule, F.when(rule.isNotNull(), "FORWARD").when(~F.coalesce(taken, F.lit(False)), "method").otherwise("no_rule")


def mode_at(at: Column, switches: list[tuple[str, str]]) -> Column:
    """The mode in force at a time: that of the last switch (time, mode) at or before it; null before the first. A short list of an operator's switches."""
    out = F.lit(None).cast("string")
    for time, mode in sorted(switches):
        out = F.when(at >= F.to_timestamp_ntz(F.lit(time)), F.lit(mode)).otherwise(out)
    return out
