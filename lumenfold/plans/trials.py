"""Trials, effects, layers and labels over rows derived from events, documents and conversations by arithmetic that the SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import protocol, stats, text
from ..functions.keys import plain_key
from ..operators import curate, decide, evaluate, loadlog, ml, trials
from .forms import quoted, values, values_sql
from .registry import LABELLED, PLAIN, L, R, query


def pick(i: str, names: list) -> F:
    """The name at place i modulo their number; None is null."""
    return F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (F.expr(i) % len(names) + 1).cast("int"))


def pick_sql(i: str, names: list) -> str:
    return f"([{', '.join('NULL' if n is None else quoted(str(n)) for n in names)}])[(({i}) % {len(names)} + 1)::INT]"


#: Columns of a trial row: (name, expression of an event's id, values).
TRIAL = [
    ("arm", "event_id", ["guarded", "crs", "direct", "guarded", "v5"]), ("layer", "event_id div 5", ["v5", "crs", "front", None, "upstream", "unattributed", "v5"]), ("complete", "event_id div 3", ["true", "true", "true", "false", "true", None]),
    ("canonical", "event_id div 7", ["ACCEPT", None, "REJECT", "ACCEPT"]), ("status", "event_id div 2", ["ok", None, "ok", "timeout", "ok"]), ("decision", "event_id div 11", ["BLOCK", "ALLOW", None, "OTHER", "BLOCK"]),
    ("applied", "event_id div 4", ["DENY", "FORWARD", "DENY", None]), ("stage", "event_id div 6", ["v5", "model2", "request_guard", None]), ("other", "event_id div 9", ["BLOCK", "ALLOW", None]), ("guard", "event_id div 8", ["MATCH", "MISS"]),
    ("received", "event_id div 10", ["true", "false", None]), ("label", "event_id div 12", ["BLOCK", "ALLOW", "NONE"]), ("role", "event_id div 13", [None, "observe", "attack", "setup"]),
]
TRIAL_SQL = "(SELECT event_id, " + ", ".join(f"{pick_sql(i.replace('div', '//'), v)}{'::BOOLEAN' if n in ('complete', 'received') else ''} AS {n}" for n, i, v in TRIAL) + " FROM events)"
CLASS = """CASE WHEN arm = 'direct' THEN 'CONTROL' WHEN layer IN ('front', 'unattributed') OR complete IS DISTINCT FROM true THEN 'INFRA_ERROR' WHEN canonical <> 'ACCEPT' THEN 'OUT_OF_SCOPE'
  WHEN (status IS NOT NULL OR decision IS NOT NULL) AND (status IS DISTINCT FROM 'ok' OR decision IS NULL OR decision NOT IN ('ALLOW', 'BLOCK')) THEN 'MODEL_INVALID'
  WHEN applied = 'DENY' THEN CASE WHEN arm = 'crs' AND layer = 'crs' THEN 'BLOCK' WHEN stage = 'v5' AND decision = 'BLOCK' THEN 'BLOCK' WHEN stage = 'model2' AND other = 'BLOCK' THEN 'BLOCK' WHEN stage = 'request_guard' THEN CASE WHEN guard = 'MATCH' THEN 'BLOCK' ELSE 'INFRA_ERROR' END ELSE 'OUT_OF_SCOPE' END
  WHEN applied = 'FORWARD' AND received THEN 'ALLOW' ELSE 'INFRA_ERROR' END"""


def trial_rows(t):
    e = t("events")
    return e.select("event_id", *[pick(i, v).cast("boolean" if n in ("complete", "received") else "string").alias(n) for n, i, v in TRIAL])


@query("trial_classes", f"""
SELECT event_id, class, CASE WHEN label IN ('ALLOW', 'BLOCK') AND (role IS NULL OR role NOT IN ('observe', 'setup')) THEN CASE class WHEN 'BLOCK' THEN CASE label WHEN 'BLOCK' THEN 'TP' ELSE 'FP' END WHEN 'ALLOW' THEN CASE label WHEN 'BLOCK' THEN 'FN' ELSE 'TN' END
  WHEN 'MODEL_INVALID' THEN CASE label WHEN 'BLOCK' THEN 'FN' ELSE 'FP' END ELSE CASE label WHEN 'BLOCK' THEN 'UNCLASSIFIED_ATTACK' ELSE 'UNCLASSIFIED_BENIGN' END END END AS cell FROM (SELECT *, {CLASS} AS class FROM {TRIAL_SQL})""")
def trial_classes(t):
    """The class and the confusion cell of every trial row."""
    names = [n for n, _, _ in TRIAL[:11]]
    rows = trial_rows(t).withColumn("class", trials.trial_class(*[F.col(n) for n in names]))
    return rows.select("event_id", "class", trials.primary_cell(F.col("class"), F.col("label"), F.col("role")).alias("cell"))


@query("effect_oracle", """
WITH e AS (SELECT event_id, event_type AS body, (200 + event_id % 3)::INT AS status, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '/go/' || event_type END AS location, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error,
  CASE event_id % 6 WHEN 0 THEN 'body_contains' WHEN 1 THEN 'body_sha256' WHEN 2 THEN 'status' WHEN 3 THEN 'location_prefix' WHEN 4 THEN 'location_prefix' END AS kind,
  CASE event_id % 6 WHEN 0 THEN 'li' WHEN 1 THEN sha256('click') WHEN 2 THEN '200' WHEN 3 THEN '/go/v' WHEN 4 THEN '' END AS value FROM events)
SELECT event_id, CASE WHEN kind IS NOT NULL AND error IS NULL THEN CASE kind WHEN 'body_contains' THEN contains(body, value) WHEN 'body_sha256' THEN sha256(body) = value WHEN 'status' THEN status::VARCHAR = value WHEN 'location_prefix' THEN starts_with(coalesce(location, ''), value) END END AS effect FROM e""")
def effect_oracle(t):
    i = F.col("event_id")
    kind = F.when(i % 6 == 0, "body_contains").when(i % 6 == 1, "body_sha256").when(i % 6 == 2, "status").when(i % 6 < 5, "location_prefix")
    value = F.when(i % 6 == 0, "li").when(i % 6 == 1, F.sha2(F.lit("click"), 256)).when(i % 6 == 2, "200").when(i % 6 == 3, "/go/v").when(i % 6 == 4, "")
    location = F.when(i % 4 != 0, F.concat(F.lit("/go/"), "event_type"))
    return t("events").select("event_id", trials.effect(kind, value, F.when(i % 11 == 0, "timeout"), F.col("event_type"), (200 + i % 3).cast("int"), location).alias("effect"))


#: Steps and paths of requests, from events.
STEP = "(SELECT event_id, event_id // 4 AS step, (['direct', 'tls_h1', 'tls_h2', 'tls_h1'])[(event_id % 4 + 1)::INT] AS path, CASE WHEN event_id % 10 = 3 THEN 'firewall' ELSE 'application' END AS layer, (200 + 100 * (event_id % 9 = 2)::INT)::VARCHAR AS observed, event_id % 5 <> 0 AS passed, event_id % 3 AS calls FROM events)"


def step_rows(t):
    i = F.col("event_id")
    path = F.element_at(F.array(*[F.lit(p) for p in ("direct", "tls_h1", "tls_h2", "tls_h1")]), (i % 4 + 1).cast("int"))
    return t("events").select(
        "event_id", F.expr("event_id div 4").alias("step"), path.alias("path"), F.when(i % 10 == 3, "firewall").otherwise("application").alias("layer"), F.when(i % 9 == 2, "300").otherwise("200").alias("observed"), (i % 5 != 0).alias("passed"), (i % 3).alias("calls")
    )


@query("cross_path_equality", f"SELECT o.step, o.path, d.observed AS base_observed, o.observed FROM {STEP} o JOIN {STEP} d ON d.step = o.step AND d.path = 'direct' WHERE o.path <> 'direct' AND o.layer <> 'firewall' AND o.observed IS DISTINCT FROM d.observed")
def cross_path_equality(t):
    """Answers that differ from the direct path's where the firewall forwarded."""
    return trials.path_differences(step_rows(t), "step", "path", "observed", "layer", "direct", "firewall")


@query("path_summary", f"""
WITH c AS (SELECT path, layer, count(*) AS n, count(*) FILTER (WHERE passed) AS p, sum(calls) AS c FROM {STEP} GROUP BY ALL)
SELECT path, sum(n)::BIGINT AS requests, sum(p)::BIGINT AS passed, string_agg(layer || '=' || n, ',' ORDER BY layer) AS by_layer, sum(c)::BIGINT AS calls FROM c GROUP BY path""")
def path_summary(t):
    out = trials.path_summary(step_rows(t), "path", "layer", F.col("passed"), "calls")
    return out.withColumn("by_layer", F.array_join(F.transform(F.map_entries("by_layer"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("layer_attribution", """
SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 'front' WHEN event_id % 4 > 1 THEN 'upstream' WHEN event_id % 7 < 3 THEN 'firewall' WHEN event_id % 2 = 0 THEN 'no_answer' ELSE 'gateway_protocol' END AS layer FROM events""")
def layer_attribution(t):
    """Which layer answered: the front, the application behind, the firewall, nobody, or the gateway's own protocol."""
    i = F.col("event_id")
    reached = F.when(i % 5 == 0, i % 3 != 0)
    return t("events").select("event_id", trials.answering_layer(reached, F.when(i % 4 > 1, i % 4), F.when(i % 7 < 3, "DENY").otherwise("FORWARD"), F.when(i % 2 == 1, F.lit(200))).alias("layer"))


EXCLUSIONS, POLICIES = ["out_of_scope", "ambiguous", "no_context"], ["POL-A", "POL-B"]
LEAF = """(SELECT conv_id, turn AS place, CASE WHEN (conv_id * 7 + turn) % 13 = 0 OR (conv_id + turn) % 3 = 0 THEN 'ALLOW' WHEN turn = 1 AND conv_id % 4 = 1 THEN 'BLOCK' WHEN turn = 2 AND conv_id % 12 = 1 THEN 'BLOCK' ELSE 'ALLOW' END AS label,
  CASE WHEN (conv_id * 7 + turn) % 13 = 0 THEN 'EXCLUDED' WHEN (conv_id + turn) % 3 = 0 THEN 'POLICY_DEFINED' ELSE 'VERIFIED' END AS status,
  CASE WHEN (conv_id * 7 + turn) % 13 = 0 THEN (['no_context', 'ambiguous', 'out_of_scope', 'strange'])[((conv_id + turn) % 4 + 1)::INT] WHEN (conv_id + turn) % 3 = 0 THEN (['POL-B', 'POL-A'])[((conv_id + turn) % 2 + 1)::INT] END AS reason FROM conversations)"""


@query("label_combination", f"""
WITH k AS (SELECT *, CASE WHEN status = 'EXCLUDED' THEN list_position({EXCLUSIONS}, reason) WHEN label = 'BLOCK' THEN 1000 WHEN status = 'POLICY_DEFINED' THEN 2000 + list_position({POLICIES}, reason) ELSE 9000 END AS rank FROM {LEAF}),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank NULLS FIRST, place) AS first FROM k),
g AS (SELECT conv_id, count(*) FILTER (WHERE status = 'EXCLUDED' AND reason NOT IN ('out_of_scope', 'ambiguous', 'no_context')) AS strange, count(*) FILTER (WHERE status = 'EXCLUDED') AS gone, count(*) FILTER (WHERE label = 'BLOCK' AND status <> 'EXCLUDED') AS attacks FROM k GROUP BY conv_id)
SELECT conv_id, CASE WHEN status <> 'EXCLUDED' THEN label END AS label, status, reason, CASE WHEN strange > 0 THEN 'unknown_exclusion' WHEN gone = 0 AND attacks > 1 THEN 'two_attacks' END AS problem FROM r JOIN g USING (conv_id) WHERE first = 1""")
def label_combination(t):
    """Rows' labels from their leaves' (here: conversations from turns)."""
    a = F.expr("(conv_id * 7 + turn) % 13 = 0")
    p = F.expr("(conv_id + turn) % 3 = 0")
    label = F.when(a | p, "ALLOW").when(F.expr("(turn = 1 and conv_id % 4 = 1) or (turn = 2 and conv_id % 12 = 1)"), "BLOCK").otherwise("ALLOW")
    reason = F.when(a, pick("conv_id + turn", ["no_context", "ambiguous", "out_of_scope", "strange"])).when(p, pick("conv_id + turn", ["POL-B", "POL-A"]))
    leaves = t("conversations").select("conv_id", F.col("turn").alias("place"), label.alias("label"), F.when(a, "EXCLUDED").when(p, "POLICY_DEFINED").otherwise("VERIFIED").alias("status"), reason.alias("reason"))
    return trials.combined_labels(leaves, "conv_id", EXCLUSIONS, POLICIES)


LONG = ["gnu general public license", "apache license", "mit"]
SIGNATURES = [("assignment", "(password|token) ?="), ("shout", "[a-z]{4,}!!")]


@query("benign_oracle", f"""
SELECT doc_id, CASE WHEN key IN (SELECT {PLAIN} FROM benchmark) THEN 'exact_canonical_key' {" ".join(f"WHEN contains(key, '{k}') THEN 'contains_attack_payload_ge_L:{len(k)}'" for k in sorted(LONG) if len(k) >= 10)}
  {" ".join(f"WHEN regexp_matches(key, '{p}') THEN 'signature:{n}'" for n, p in SIGNATURES)} END AS verdict FROM (SELECT doc_id, {PLAIN} AS key FROM documents)""")
def benign_oracle(t):
    """Which benign values an oracle of attack keys, long keys and signatures leaves alive, and why not the others."""
    rows = t("documents").select("doc_id", plain_key(F.col("text")).alias("key"))
    known = t("benchmark").select(plain_key(F.col("text")).alias("k"))
    return trials.survives(rows, "key", known, "k", LONG, SIGNATURES, 10).select("doc_id", "verdict")


AGREE = """(SELECT event_id, event_type AS cohort, CASE WHEN event_id % 2 = 0 THEN 'BLOCK' ELSE 'ALLOW' END AS reference, (['BLOCK', 'ALLOW', 'ALLOW', NULL, 'BLOCK'])[(event_id % 5 + 1)::INT] AS decision, (['DENY', 'FORWARD', 'FORWARD', 'DENY'])[(event_id // 2 % 4 + 1)::INT] AS applied,
  ([403, 200, 502, NULL])[(event_id // 3 % 4 + 1)::INT] AS status, event_id % 3 AS received, event_id % 7 <> 0 AS same_bytes, CASE WHEN event_id % 4 > 0 THEN event_id % 9 > 0 END AS canonical_equal, CASE WHEN event_id % 5 > 1 THEN event_id % 8 > 1 END AS census_equal FROM events)"""


@query("layer_agreement", f"""
SELECT cohort, count(*)::BIGINT AS cases, count(*) FILTER (WHERE decision = 'BLOCK' AND reference = 'BLOCK')::BIGINT AS tp, count(*) FILTER (WHERE decision = 'ALLOW' AND reference = 'ALLOW')::BIGINT AS tn, count(*) FILTER (WHERE decision = 'BLOCK' AND reference = 'ALLOW')::BIGINT AS fp,
  count(*) FILTER (WHERE decision = 'ALLOW' AND reference = 'BLOCK')::BIGINT AS fn, count(*) FILTER (WHERE decision IS NULL)::BIGINT AS no_decision, count(*) FILTER (WHERE (decision = 'ALLOW' AND applied = 'FORWARD') OR (decision = 'BLOCK' AND applied = 'DENY'))::BIGINT AS action_follows_decision,
  count(*) FILTER (WHERE (applied = 'FORWARD' AND status = 200) OR (applied = 'DENY' AND status IN (400, 403, 503)))::BIGINT AS status_follows_action, count(*) FILTER (WHERE CASE WHEN applied = 'FORWARD' THEN received = 1 AND same_bytes ELSE received = 0 END)::BIGINT AS reception_follows_action,
  count(canonical_equal)::BIGINT AS reached, count(*) FILTER (WHERE canonical_equal)::BIGINT AS canonical_equal, count(census_equal)::BIGINT AS compared, count(*) FILTER (WHERE census_equal)::BIGINT AS census_equal FROM {AGREE} GROUP BY cohort""")
def layer_agreement(t):
    """Decision, action, status and reception held against one another, by cohort."""
    i = F.col("event_id")
    rows = t("events").select(
        F.col("event_type").alias("cohort"), F.when(i % 2 == 0, "BLOCK").otherwise("ALLOW").alias("reference"), pick("event_id", ["BLOCK", "ALLOW", "ALLOW", None, "BLOCK"]).alias("decision"), pick("event_id div 2", ["DENY", "FORWARD", "FORWARD", "DENY"]).alias("applied"),
        pick("event_id div 3", [403, 200, 502, None]).cast("int").alias("status"), (i % 3).alias("received"), (i % 7 != 0).alias("same_bytes"), F.when(i % 4 > 0, i % 9 > 0).alias("canonical_equal"), F.when(i % 5 > 1, i % 8 > 1).alias("census_equal"),
    )
    return trials.layer_agreement(rows, *rows.columns)


@query("reason_accuracy", f"""
SELECT lang, count(*) FILTER (WHERE y)::BIGINT AS blocks, count(*) FILTER (WHERE y AND d)::BIGINT AS found, count(*) FILTER (WHERE y AND d AND s)::BIGINT AS right_reason, round(CASE WHEN count(*) FILTER (WHERE y AND d) > 0 THEN count(*) FILTER (WHERE y AND d AND s)::DOUBLE / count(*) FILTER (WHERE y AND d) END, 6) AS reason_accuracy,
  CASE WHEN count(*) FILTER (WHERE y) = 0 THEN 'NOT_EVALUABLE' WHEN count(*) FILTER (WHERE y) < 30 THEN 'INSUFFICIENT' ELSE 'OK' END AS support FROM (SELECT lang, toxic = 1 AS y, doc_id % 3 > 0 AS d, doc_id % 5 > 1 AS s FROM {LABELLED}) GROUP BY lang""")
def reason_accuracy(t):
    rows = t("documents").join(t("labels"), "doc_id")
    y, d = F.when(F.col("toxic") == 1, "BLOCK").otherwise("ALLOW"), F.when(F.col("doc_id") % 3 > 0, "BLOCK").otherwise("ALLOW")
    return trials.reason_accuracy(rows, y, d, F.col("doc_id") % 5 > 1, ["lang"])


@query("cases_by_wire", """
WITH c AS (SELECT sha256(text) AS h, min(item_id) AS item_id FROM benchmark GROUP BY 1), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, item_id, count(*)::BIGINT AS n FROM l LEFT JOIN c ON c.h = sha256(l.line) GROUP BY ALL""")
def cases_by_wire(t):
    """The case of each line by its hash; lines that no case sent are kept."""
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return trials.cases_by_wire(lines, "line", t("benchmark"), "item_id", "text").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("counter_merge", "SELECT event_type, count(*)::BIGINT AS n, sum(event_id % 4)::BIGINT AS refused FROM events GROUP BY event_type")
def counter_merge(t):
    """Partial counters (one a day and type) and final ones, merged by key: sums, whatever the order."""
    partial = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 4).alias("refused"))
    return loadlog.merged_counters(partial, ["event_type"], ["n", "refused"])


CONFIG = [("2024-01-01 00:00:00", "v5"), ("2024-01-05 12:00:00", "rollback"), ("2024-01-09 00:00:00", "v5"), ("2024-01-20 06:00:00", "observe")]


@query("mode_switches", f"""
WITH c AS (SELECT a::TIMESTAMP AS at, mode FROM {values_sql(CONFIG, 'a, mode')})
SELECT event_id, mode, mode = 'v5' AS authoritative FROM events e ASOF LEFT JOIN c ON e.ts >= c.at""")
def mode_switches(t):
    """The mode in force at each request: that of the last switch before it. A stream reads its switch anew for each micro-batch (`streaming.jobs.switched`)."""
    mode = decide.mode_at(F.col("ts"), CONFIG)
    return t("events").select("event_id", mode.alias("mode"), (mode == "v5").alias("authoritative"))


CANDIDATES = [("a", "0.90", "0.0", "5.0"), ("b", "0.89", "-0.01", "1.0"), ("c", "0.5", "0.2", "0.1"), ("d", "0.88", "-0.02", "1.0")]


@query("winner_rule", f"""
WITH c AS (SELECT name, score::DOUBLE AS score, low::DOUBLE AS low, cost::DOUBLE AS cost FROM {values_sql(CANDIDATES, 'name, score, low, cost')})
SELECT (SELECT name FROM c WHERE low <= 0 ORDER BY cost, score DESC, name LIMIT 1) AS winner, (SELECT string_agg(name, ',' ORDER BY name) FROM c WHERE low <= 0) AS tied""")
def winner_rule(t):
    c = values(t, CANDIDATES, "name string, score string, low string, cost string").select("name", *[F.col(x).cast("double").alias(x) for x in ("score", "low", "cost")])
    return ml.winner(c).withColumn("tied", F.array_join("tied", ","))


@query("rule_of_three", "SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE length(text) = 0)::BIGINT AS errors, round(CASE WHEN count(*) FILTER (WHERE length(text) = 0) = 0 AND count(*) > 3 THEN 3.0 / count(*) END, 6) AS bound FROM documents GROUP BY source")
def rule_of_three(t):
    g = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") == 0).alias("errors"))
    return g.select("source", "n", "errors", R(stats.rule_of_three(F.col("errors"), F.col("n"))).alias("bound"))


WEIGHTS, SCALES, BIAS = {"n_chars": 0.7, "lines": -0.4}, {"n_chars": 1000.0, "lines": 10.0}, -0.25


@query("portable_score", "SELECT doc_id, round(1 / (1 + exp(-(-0.25 + (length(text) - length(replace(text, chr(10), ''))) / 10.0 * -0.4 + n_chars / 1000.0 * 0.7))), 6) AS p FROM documents")
def portable_score(t):
    rows = t("documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"))
    return rows.select("doc_id", R(ml.logistic_score(WEIGHTS, SCALES, BIAS)).alias("p"))


@query("header_guard", """
SELECT page_id, m = 'POST' AND regexp_matches(url, '(?i)utm_source|page=2') AS refused FROM (SELECT page_id, url, upper((['get', 'post', 'Post'])[(page_id % 3 + 1)::INT]) AS m FROM pages)""")
def header_guard(t):
    headers = F.array(F.struct(F.lit("host").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("referer").alias("name"), F.col("url").alias("value")))
    return t("pages").select("page_id", protocol.header_guard(pick("page_id", ["get", "post", "Post"]), headers, "(?i)utm_source|page=2").alias("refused"))


@query("reject_ladder", """
SELECT page_id, CASE WHEN length(html) > 65536 THEN 'R6_TOO_LARGE' WHEN page_id % 11 = 0 THEN 'R5_CONTROL' WHEN page_id % 13 = 0 THEN 'R4_HEADERS' WHEN page_id % 7 = 0 THEN 'R7_BODY' WHEN page_id % 5 = 1 THEN 'R1_METHOD' WHEN page_id % 17 = 3 THEN 'R2_TARGET' WHEN page_id % 5 = 2 THEN 'CONNECT' WHEN page_id % 3 = 0 THEN 'R3_FORM' END AS reject FROM pages""")
def reject_ladder(t):
    """The first rule that a canonical request breaks; size, then controls, headers, body, method and target, form."""
    i = F.col("page_id")
    target = F.when(i % 17 == 3, "").when(i % 3 == 0, "rel/x").otherwise(F.col("url"))
    return t("pages").select("page_id", protocol.reject_ladder(F.length("html"), i % 11 == 0, pick("page_id", ["GET", "get", "CONNECT", "PUT", "POST"]), target, i % 13 != 0, i % 7 != 0).alias("reject"))


NAMES = [(n,) for n in ("Anna", "anna", "Anna Maria Lopez", "Mr. X2", "a@b", "Tom (actor)", "Jean-Luc", "O’Neil", "", None, "Given name", "Ana:", "x" * 41, "Zoë", "Á" * 3, "J;K", "Li")]


@query("name_reasons", f"""
SELECT n, CASE WHEN coalesce(n, '') = '' THEN 'empty' WHEN regexp_matches(n, '[\\x00-\\x1F\\x7F]') THEN 'control_char' WHEN regexp_matches(n, '\\d') THEN 'contains_digit' WHEN regexp_matches(n, '[()\\[\\]{{}}]') THEN 'parenthesis_or_disambiguation' WHEN regexp_matches(n, '(?i)@|://|\\bwww\\.') THEN 'at_or_url' WHEN contains(n, ':') THEN 'contains_colon'
  WHEN regexp_matches(n, '[^\\p{{L}}\\p{{M}}''’ʼ\\-‐‑. ]') THEN 'non_name_char' WHEN length(n) > 40 THEN 'too_long' WHEN regexp_matches(n, '(?i)\\bnames?\\b') THEN 'descriptive_label' WHEN NOT regexp_matches(n, '^\\p{{Lu}}') THEN 'not_capitalised'
  WHEN len(regexp_split_to_array(trim(n), ' +')) >= 2 AND len(list_filter(regexp_split_to_array(trim(n), ' +'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 2 THEN 'looks_like_full_name' ELSE 'accepted' END AS reason FROM {values_sql(NAMES, 'n')}""")
def name_reasons(t):
    return values(t, NAMES, "n string").select("n", text.name_reason(F.col("n")).alias("reason"))


@query("pii_flags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in (("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"), ("phone", "\\+[0-9][0-9 ().-]{7,}[0-9]"), ("long_number", "[0-9]{6,}"))) + "], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def pii_flags(t):
    """All kinds of personal data in a text, not only the first."""
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("phone", r"\+[0-9][0-9 ().-]{7,}[0-9]"), ("long_number", "[0-9]{6,}"))
    return t("documents").select("doc_id", F.array_join(text.all_flags([(n, F.col("text").rlike(p)) for n, p in kinds]), ",").alias("flags"))


@query("keep_exact_first", """
SELECT doc_id, row_number() OVER w AS copy, first_value(doc_id) OVER w AS keeper, count(*) OVER (PARTITION BY lang, text) AS copies FROM documents WINDOW w AS (PARTITION BY lang, text ORDER BY doc_id)""")
def keep_exact_first(t):
    """The first of equal texts in each language (here in place of splits), its copies numbered. Texts are hashed before they are shuffled."""
    rows = t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return curate.first_wins(rows, F.col("h"), ["doc_id"], ["lang"]).select("doc_id", "copy", "keeper", "copies")


FAST = [("static", "GET", "exact", "/en/1", None), ("pages", "GET", "prefix", "/fr/", "utm"), ("any_es", "*", "prefix", "/es/", None)]


@query("fast_path_policy", """
WITH p AS (SELECT page_id, (['GET', 'POST'])[(page_id % 2 + 1)::INT] AS m, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, CASE WHEN m = 'GET' AND path = '/en/1' THEN 'static' WHEN m = 'GET' AND starts_with(path, '/fr/') AND contains(q, 'utm') THEN 'pages' WHEN starts_with(path, '/es/') THEN 'any_es' END AS rule,
  CASE WHEN m = 'GET' AND path = '/en/1' OR m = 'GET' AND starts_with(path, '/fr/') AND contains(q, 'utm') OR starts_with(path, '/es/') THEN 'FORWARD' WHEN m <> 'GET' THEN 'method' ELSE 'no_rule' END AS outcome FROM p""")
def fast_path_policy(t):
    """A closed-world policy: the first rule whose method, path and required query part fit forwards; else the reason why none does."""
    p = t("pages").select("page_id", pick("page_id", ["GET", "POST"]).alias("m"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("q"))
    rule, outcome = decide.fast_path(F.col("m"), F.col("path"), F.col("q"), FAST)
    return p.select("page_id", rule.alias("rule"), outcome.alias("outcome"))


@query("clopper_pearson", None)
def clopper_pearson(t):
    """Exact bounds of error shares by source; tests hold them to the binomial tails."""
    g = t("documents").groupBy("source").agg(F.count_if(F.length("text") < 500).alias("k"), F.count(F.lit(1)).alias("n"))
    x = evaluate.clopper_pearson(L("k"), L("n"))
    return g.select("source", "k", "n", F.round(x["low"], 6).alias("low"), F.round(x["high"], 6).alias("high"))
