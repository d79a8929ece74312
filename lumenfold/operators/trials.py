"""Trials of a firewall and its layers: classes, effects, attribution, paths compared, labels combined. Each decision is a Column or a plain aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_reason


#: The stages that can decide, the rule-set arm, and the layers before the gateway.
MODEL, SECOND, GUARD, RULES, BEFORE = "v5", "model2", "request_guard", "crs", ("front", "unattributed")


def trial_class(arm: Column, layer: Column, complete: Column, canonical: Column, status: Column, decision: Column, applied: Column, stage: Column, other: Column, guard: Column, received: Column) -> Column:
    """CONTROL, INFRA_ERROR, OUT_OF_SCOPE, MODEL_INVALID, BLOCK or ALLOW of one trial row.

    status and decision are the model's (both null if it was not asked), other is the second model's decision where its status is OK, guard the
    request guard's status. A denial counts as a block only if the stage that decided says so itself.
    """
    asked = status.isNotNull() | decision.isNotNull()
    invalid = asked & (~status.eqNullSafe(F.lit("ok")) | ~F.coalesce(decision.isin("ALLOW", "BLOCK"), F.lit(False)))
    deny = applied.eqNullSafe(F.lit("DENY"))
    is_ = lambda c, v: c.eqNullSafe(F.lit(v))
    return first_reason(
        [
            ("CONTROL", is_(arm, "direct")),
            ("INFRA_ERROR", F.coalesce(layer.isin(*BEFORE), F.lit(False)) | ~F.coalesce(complete, F.lit(False))),
            ("OUT_OF_SCOPE", canonical.isNotNull() & (canonical != "ACCEPT")),
            ("MODEL_INVALID", invalid),
            ("BLOCK", deny & is_(arm, RULES) & is_(layer, RULES)),
            ("BLOCK", deny & is_(stage, MODEL) & is_(decision, "BLOCK")),
            ("BLOCK", deny & is_(stage, SECOND) & is_(other, "BLOCK")),
            ("BLOCK", deny & is_(stage, GUARD) & is_(guard, "MATCH")),
            ("INFRA_ERROR", deny & is_(stage, GUARD)),
            ("OUT_OF_SCOPE", deny),
            ("ALLOW", is_(applied, "FORWARD") & F.coalesce(received, F.lit(False))),
        ],
        "INFRA_ERROR",
    )


def primary_cell(result: Column, label: Column, role: Column) -> Column:
    """The confusion cell of a trial's class; null for setup rows and for labels that are neither ALLOW nor BLOCK."""
    block = label == "BLOCK"
    cell = (
        F.when(result == "BLOCK", F.when(block, "TP").otherwise("FP")).when(result == "ALLOW", F.when(block, "FN").otherwise("TN"))
        .when(result == "MODEL_INVALID", F.when(block, "FN").otherwise("FP")).otherwise(F.when(block, "UNCLASSIFIED_ATTACK").otherwise("UNCLASSIFIED_BENIGN"))
    )
    setup = F.coalesce(role.isin("observe", "setup"), F.lit(False))
    return F.when(~setup & label.isin("ALLOW", "BLOCK"), cell)


def effect(kind: Column, value: Column, error: Column, body: Column, status: Column, location: Column) -> Column:
    """Whether an answer shows an attack's effect: its body holds or hashes to the value, its status is the value, or its location begins with it. Null
    without an oracle or after an error; a missing body or location is empty."""
    text, place = F.coalesce(body, F.lit("")), F.coalesce(location, F.lit(""))
    found = (
        F.when(kind == "body_contains", F.instr(text, value) > 0).when(kind == "body_sha256", F.sha2(text, 256) == value).when(kind == "status", F.coalesce(status.cast("string") == value, F.lit(False)))
        .when(kind == "location_prefix", place.startswith(value))
    )
    return F.when(kind.isNotNull() & error.isNull(), found)


def answering_layer(front_reached: Column, received: Column, applied: Column, client_status: Column) -> Column:
    """Which layer made the answer that a client saw. front_reached is null where no front was in the way."""
    return first_reason(
        [("front", front_reached.eqNullSafe(F.lit(False))), ("upstream", F.coalesce(received, F.lit(0)) > 0), ("firewall", applied.eqNullSafe(F.lit("DENY"))), ("no_answer", client_status.isNull())], "gateway_protocol"
    )


def path_differences(rows: DataFrame, step: str, path: str, observed: str, layer: str, base: str, firewall: str) -> DataFrame:
    """(step, path, base_observed, observed): answers that differ from the base path's, where the firewall forwarded. A step that a path or the base lacks is skipped."""
    plain = rows.where(F.col(path) == base).select(step, F.col(observed).alias("base_observed"))
    other = rows.where((F.col(path) != base) & ~F.col(layer).eqNullSafe(F.lit(firewall)))
    return other.join(plain, step).where(~F.col(observed).eqNullSafe(F.col("base_observed"))).select(step, path, "base_observed", observed)


def path_summary(rows: DataFrame, path: str, layer: str, passed: Column, calls: str) -> DataFrame:
    """A row a path: requests, those that passed, counts by answering layer (a map) and the model's calls. Layers are counted before they are gathered."""
    cells = rows.groupBy(path, layer).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("p"), F.sum(calls).alias("c"))
    by_layer = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(layer, F.lit("none")).alias("key"), F.col("n").alias("value")))))
    return cells.groupBy(path).agg(F.sum("n").alias("requests"), F.sum("p").alias("passed"), by_layer.alias("by_layer"), F.sum("c").alias("calls"))


def combined_labels(leaves: DataFrame, row_id: str, exclusions: list[str], policies: list[str]) -> DataFrame:
    """(row_id, label, status, reason) of rows from their leaves (label, status, reason, place): the first exclusion in the given order, else the attack
    leaf, else ALLOW by the first policy in the given precedence if a leaf needs one, else the first leaf's. Two attack leaves: problem 'two_attacks';
    an exclusion that the order lacks: 'unknown_exclusion'. One partially aggregated minimum of a rank."""
    at = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int")
    excluded, policy = F.col("status") == "EXCLUDED", F.col("status") == "POLICY_DEFINED"
    rank = F.when(excluded, at(F.col("reason"), exclusions)).when(F.col("label") == "BLOCK", 1000).when(policy, 2000 + at(F.col("reason"), policies)).otherwise(9000)
    best = F.min(F.struct(rank.alias("rank"), F.col("place").alias("place"), F.col("label").alias("label"), F.col("status").alias("status"), F.col("reason").alias("reason"))).alias("b")
    known = F.col("reason").isin(*exclusions)
    out = leaves.groupBy(row_id).agg(best, F.count_if((F.col("label") == "BLOCK") & ~excluded).alias("attacks"), F.count_if(excluded & ~F.coalesce(known, F.lit(False))).alias("strange"), F.count_if(excluded).alias("gone"))
    problem = F.when(F.col("strange") > 0, "unknown_exclusion").when((F.col("gone") == 0) & (F.col("attacks") > 1), "two_attacks")
    return out.select(row_id, F.when(~F.coalesce(F.col("b.status") == "EXCLUDED", F.lit(False)), F.col("b.label")).alias("label"), F.col("b.status").alias("status"), F.col("b.reason").alias("reason"), problem.alias("problem"))


def survives(rows: DataFrame, value: str, keys: DataFrame, key: str, long_keys: list[str], signatures: list[tuple[str, str]], least: int) -> DataFrame:
    """rows with verdict: null if a benign value survives, else exact_canonical_key, contains_attack_payload_ge_L:<length> of the first long key (sorted,
    `least` characters or more), or signature:<id>. keys is a table (key) of any size; long keys and signatures are short lists."""
    listed = keys.select(F.sha2(key, 256).alias("_h")).distinct().withColumn("_hit", F.lit(True))
    contained = [(f"contains_attack_payload_ge_L:{len(k)}", F.contains(F.col(value), F.lit(k))) for k in sorted(long_keys) if len(k) >= least]
    rules = [("exact_canonical_key", F.coalesce("_hit", F.lit(False))), *contained, *[(f"signature:{n}", F.col(value).rlike(p)) for n, p in signatures]]
    return rows.withColumn("_h", F.sha2(value, 256)).join(listed, "_h", "left").withColumn("verdict", first_reason(rules)).drop("_h", "_hit")


def four_layers(decision: Column, applied: Column, status: Column, received: Column, same_bytes: Column) -> dict[str, Column]:
    """Whether the action follows the decision, the status the action, and the reception the action."""
    forward, deny = applied.eqNullSafe(F.lit("FORWARD")), applied.eqNullSafe(F.lit("DENY"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return {
        "action_follows_decision": no((decision == "ALLOW") & forward) | no((decision == "BLOCK") & deny),
        "status_follows_action": no(forward & (status == 200)) | no(deny & status.isin(400, 403, 503)),
        "reception_follows_action": F.when(forward, no((received == 1) & same_bytes)).otherwise(no(received == 0)),
    }


def layer_agreement(rows: DataFrame, cohort: str, reference: str, decision: str, applied: str, status: str, received: str, same_bytes: str, canonical_equal: str, census_equal: str) -> DataFrame:
    """A row a cohort: cases, confusion of decisions with the reference (no decision apart), rows in which each layer follows the one before, canonical
    texts that came back equal of those that reached the model, and census answers that agree of those compared."""
    d, block = F.col(decision), F.col(reference) == "BLOCK"
    cell = F.when(d.isNull(), "NO_DECISION").when(block, F.when(d == "BLOCK", "TP").otherwise("FN")).otherwise(F.when(d == "BLOCK", "FP").otherwise("TN"))
    follows = four_layers(d, F.col(applied), F.col(status), F.col(received), F.col(same_bytes))
    return rows.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("cases"), *[F.count_if(cell == c).alias(c.lower()) for c in ("TP", "TN", "FP", "FN", "NO_DECISION")], *[F.count_if(c).alias(n) for n, c in follows.items()],
        F.count(canonical_equal).alias("reached"), F.count_if(F.col(canonical_equal)).alias("canonical_equal"), F.count(census_equal).alias("compared"), F.count_if(F.col(census_equal)).alias("census_equal"),
    )


def reason_accuracy(rows: DataFrame, label: Column, decision: Column, same_reason: Column, by: list[str], least: int = 30) -> DataFrame:
    """Of correct blocks, the share with the right reason; support is OK, INSUFFICIENT (under `least` blocks to find) or NOT_EVALUABLE (none)."""
    right = (label == "BLOCK") & (decision == "BLOCK")
    t = rows.groupBy(*by).agg(F.count_if(label == "BLOCK").alias("blocks"), F.count_if(right).alias("found"), F.count_if(right & same_reason).alias("right_reason"))
    support = F.when(F.col("blocks") == 0, "NOT_EVALUABLE").when(F.col("blocks") < least, "INSUFFICIENT").otherwise("OK")
    return t.select(*by, "blocks", "found", "right_reason", F.round(F.when(F.col("found") > 0, F.col("right_reason") / F.col("found")), 6).alias("reason_accuracy"), support.alias("support"))


def cases_by_wire(lines: DataFrame, wire: str, cases: DataFrame, case_id: str, case_wire: str) -> DataFrame:
    """lines with the case id whose wire hashes alike, the least of several; a line that no case sent stays, with null."""
    known = cases.select(F.sha2(case_wire, 256).alias("_h"), case_id).groupBy("_h").agg(F.min(case_id).alias(case_id))
    return lines.withColumn("_h", F.sha2(wire, 256)).join(known, "_h", "left").drop("_h")
