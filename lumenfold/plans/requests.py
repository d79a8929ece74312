"""Features, values and decisions over pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import decide, gates
from .registry import LABELLED, L, R, h60, query

URL_SQL = r"""(SELECT page_id, url, html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages)"""


def url_columns(t):
    e = lambda p: F.regexp_extract("url", p, 1)
    return t("pages").select(
        "page_id", "url", "html", e(r"^([a-z]+)://").alias("scheme"), e(r"^[a-z]+://([^/?#]*)").alias("host"), e(r"^[a-z]+://[^/?#]*([^?#]*)").alias("path"), e(r"\?([^#]*)").alias("query")
    )


@query("url_parts", f"SELECT page_id, scheme, host, path, query, array_to_string(string_split(host, '.')[-2:], '.') AS site FROM {URL_SQL}")
def url_parts(t):
    return url_columns(t).select("page_id", "scheme", "host", "path", "query", F.substring_index("host", ".", -2).alias("site"))


def n_chars(s, cs):
    return f"(length({s}) - length(translate({s}, '{cs.replace(chr(39), chr(39) * 2)}', '')))::BIGINT"


PATH, QRY = "regexp_extract(url, '^([^?]*)', 1)", r"regexp_extract(url, '\?(.*)$', 1)"
S = f"({PATH} || {QRY})"
FEATURES = {
    "path_length": f"length({PATH})::BIGINT", "query_length": f"length({QRY})::BIGINT",
    "query_param_count": f"len(list_filter(string_split({QRY}, '&'), lambda x: x <> ''))::BIGINT",
    "alnum_ratio": f"round(len(regexp_extract_all({S}, '[A-Za-z0-9]'))::DOUBLE / length({S}), 6)",
    "symbol_count": f"len(regexp_extract_all({S}, '[!-/:-@\\[-`{{-~]'))::BIGINT",
    "non_ascii_count": f"len(regexp_extract_all({S}, '[^\\x00-\\x7F]'))::BIGINT",
    "percent_encoded_count": f"(len(regexp_extract_all({PATH}, '%[0-9A-Fa-f]{{2}}')) + len(regexp_extract_all({QRY}, '%[0-9A-Fa-f]{{2}}')))::BIGINT",
    "path_depth": f"len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))::BIGINT",
} | {f"{k}_count": n_chars(S, v) for k, v in text.SYMBOLS.items()}


@query("request_features_pages", "SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM pages")
def request_features_pages(t):
    """The SQL-expressible part of the 34 request features, of 'GET url HTTP/1.1'."""
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\n\n"))
    f = text.request_features(t("pages"), request, ["page_id"])
    return f.select("page_id", *[(R(k) if k == "alnum_ratio" else F.col(k)).alias(k) for k in FEATURES])


@query("request_features_all", None)
def request_features_all(t):
    """All 34 features of each turn sent as a JSON body. Tests hold them to hand-written cases."""
    body = F.to_json(F.struct("role", "text"))
    request = F.concat(F.lit("POST /c/"), F.col("conv_id"), F.lit("?turn="), F.col("turn"), F.lit(" HTTP/1.1\ncontent-type: application/json\n\n"), body)
    return text.request_features(t("conversations"), request, ["conv_id", "turn"])


@query("char_entropy", """
WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark), g AS (SELECT item_id, c, count(*)::DOUBLE AS n FROM c GROUP BY ALL), p AS (SELECT item_id, n / sum(n) OVER (PARTITION BY item_id) AS p FROM g)
SELECT item_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY item_id""")
def char_entropy(t):
    return t("benchmark").select("item_id", R(text.entropy(F.col("text"))).alias("entropy"))


@query("longest_run", """
WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents), s AS (SELECT doc_id, c, list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]) AS s FROM c)
SELECT doc_id, coalesce(list_max(list_transform(s, lambda x, i: CASE WHEN i < len(s) THEN s[i + 1] ELSE len(c) + 1 END - x)), 0)::BIGINT AS longest_run FROM s""")
def longest_run(t):
    """Longest run of one character; needs a back-reference, which RE2 lacks. Tests hold it to a loop."""
    return t("documents").select("doc_id", text.longest_run(F.col("text")).alias("longest_run"))


KINDS = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{n}'" for n, p in text.VALUE_KINDS) + " ELSE 'text' END"


@query("value_kinds", f"""
WITH v AS (SELECT 'props' AS origin, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT 'query', unnest(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END)) FROM {URL_SQL})
SELECT origin, {KINDS} AS kind, count(*)::BIGINT AS n FROM v GROUP BY ALL""")
def value_kinds(t):
    a = t("events").select(F.lit("props").alias("origin"), F.get_json_object("props", "$.k").alias("v"))
    pairs = F.filter(F.split("query", "&"), lambda x: x != "")
    value = lambda x: F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))
    b = url_columns(t).select(F.lit("query").alias("origin"), F.explode(F.transform(pairs, value)).alias("v"))
    return a.unionByName(b).groupBy("origin", text.value_kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("json_props_profile", "SELECT event_type, count(*) FILTER (WHERE json_valid(props))::BIGINT AS valid, count(*)::BIGINT AS n, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean_k, max(json_extract_string(props, '$.k')::BIGINT) AS max_k FROM events GROUP BY event_type")
def json_props_profile(t):
    k = F.get_json_object("props", "$.k")
    valid = F.count_if(F.from_json("props", "map<string,string>").isNotNull())
    return t("events").groupBy("event_type").agg(valid.alias("valid"), F.count(F.lit(1)).alias("n"), R(F.avg(k.cast("double"))).alias("mean_k"), F.max(k.cast("long")).alias("max_k"))


MARKS = [("pipe", r"\|"), ("shout", r"!!"), ("email", r"@"), ("digit", r"[0-9]"), ("newline", r"\n"), ("license", r"(?i)licen[cs]e")]
MARK_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in MARKS) + "], lambda x: x IS NOT NULL)"


@query("marker_support", f"""
WITH m AS (SELECT unnest({MARK_SQL}) AS marker, toxic, sha256(text) AS h, source, lang FROM {LABELLED})
SELECT marker, toxic::BIGINT AS toxic, count(*)::BIGINT AS n_rows, count(DISTINCT h)::BIGINT AS texts, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS langs, CASE WHEN count(DISTINCT h) >= 30 THEN 'SUPPORTED' ELSE 'SCARCE' END AS support FROM m GROUP BY marker, toxic""")
def marker_support(t):
    flags = text.all_flags([(n, F.col("text").rlike(p)) for n, p in MARKS])
    rows = t("documents").join(t("labels"), "doc_id").select(F.explode(flags).alias("marker"), L("toxic").alias("toxic"), F.xxhash64("text").alias("h"), "source", "lang")
    g = rows.groupBy("marker", "toxic").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("texts"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))
    return g.withColumn("support", F.when(F.col("texts") >= 30, "SUPPORTED").otherwise("SCARCE"))


@query("html_tag_counts", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{x}[ >]'))::BIGINT AS n_{x}" for x in ("a", "p", "li", "script", "div")) + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{n}' END" for n, p in text.MARKERS) + "], lambda x: x IS NOT NULL), ',') AS markers FROM pages")
def html_tag_counts(t):
    tags = [L(F.regexp_count("html", F.lit(f"<{x}[ >]"))).alias(f"n_{x}") for x in ("a", "p", "li", "script", "div")]
    return t("pages").select("page_id", *tags, F.array_join(text.markers(F.col("html")), ",").alias("markers"))


@query("url_value_classes", None)
def url_value_classes(t):
    """Classes of link targets and page urls in navigation. Numeric hosts need a function that SQL lacks: tests hold it to hand-written cases."""
    links = t("pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("v")).unionByName(t("pages").select(F.col("url").alias("v")))
    return links.groupBy(text.url_class(F.col("v")).alias("url_class")).agg(F.count(F.lit(1)).alias("n"))


@query("canonical_exact", None)
def canonical_exact(t):
    """Exact canonical and family keys of urls, counted; tests hold the functions to hand-written cases."""
    k = t("pages").select(keys.canonical_key("url").alias("k"))
    return k.groupBy(keys.family_key("k").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("canonical"))


RULE_ROWS = [("r1", 1, "https://m."), ("r2", 2, "https://www."), ("r3", 3, "https://"), ("r4", 0, "http://blog.")]


@query("fast_path_rules", "WITH r(rule_id, priority, prefix) AS (VALUES " + ", ".join(str(r) for r in RULE_ROWS) + ") SELECT p.page_id, min_by(r.rule_id, r.priority) AS rule_id FROM pages p LEFT JOIN r ON starts_with(p.url, r.prefix) GROUP BY p.page_id")
def fast_path_rules(t):
    pages = t("pages")
    rules = pages.sparkSession.createDataFrame(RULE_ROWS, "rule_id string, priority int, prefix string")
    return decide.rule_match(pages, "page_id", F.col("url"), rules)


CASC = {"rejected": "event_type = 'error'", "guarded": "user_id % 17 = 0", "fast": "value < 5", "ok": "event_id % 5 <> 0", "p": "value / 100", "fok": "event_id % 9 <> 0", "block": "event_type = 'logout' OR event_type = 'purchase'"}


@query("cascade_decision", f"""
SELECT stage, applied, count(*)::BIGINT AS n FROM (SELECT CASE WHEN {CASC['rejected']} THEN 'protocol' WHEN {CASC['guarded']} THEN 'guard' WHEN {CASC['fast']} THEN 'fast_path' WHEN {CASC['ok']} AND {CASC['p']} >= 0.5 THEN 'model' WHEN NOT ({CASC['fok']}) THEN 'final_invalid' ELSE 'final' END AS stage,
 CASE WHEN {CASC['rejected']} OR {CASC['guarded']} THEN 'DENY' WHEN {CASC['fast']} THEN 'FORWARD' WHEN ({CASC['ok']} AND {CASC['p']} >= 0.5) OR NOT ({CASC['fok']}) THEN 'DENY' WHEN {CASC['block']} THEN 'DENY' ELSE 'FORWARD' END AS applied FROM events) GROUP BY ALL""")
def cascade_decision(t):
    e = {k: F.expr(v) for k, v in CASC.items()}
    applied, stage = decide.request_cascade(e["rejected"], e["guarded"], e["fast"], e["ok"], e["p"], 0.5, e["fok"], F.when(e["block"], "BLOCK").otherwise("ALLOW"))
    return t("events").groupBy(stage.alias("stage"), applied.alias("applied")).agg(F.count(F.lit(1)).alias("n"))


@query("counterfactual_calls_avoided", """
SELECT event_type, count(*)::BIGINT AS calls, count(*) FILTER (WHERE value / 100 >= 0.5)::BIGINT AS avoided, round(count(*) FILTER (WHERE value / 100 >= 0.5)::DOUBLE / count(*), 6) AS share,
  count(*) FILTER (WHERE (value / 100 >= 0.5) <> (event_type = 'error'))::BIGINT AS changed FROM events GROUP BY event_type""")
def counterfactual_calls_avoided(t):
    """What a first-stage threshold would have decided, against what was decided."""
    early = F.col("value") / 100 >= 0.5
    return t("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(early).alias("avoided"), R(F.count_if(early) / F.count(F.lit(1))).alias("share"), F.count_if(early != (F.col("event_type") == "error")).alias("changed")
    )


@query("session_complete", """
WITH s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, count(*)::BIGINT AS turns, bool_and(text IS NOT NULL AND text <> '') AS all_texts, bool_and(prev IS NULL OR prev <> role) AS alternates, max(turn) - min(turn) + 1 = count(*) AS gapless FROM s GROUP BY conv_id""")
def session_complete(t):
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t("conversations").withColumn("prev", prev)
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.bool_and(F.col("text").isNotNull() & (F.col("text") != "")).alias("all_texts"), F.bool_and(F.col("prev").isNull() | (F.col("prev") != F.col("role"))).alias("alternates"),
        (F.max("turn") - F.min("turn") + 1 == F.count(F.lit(1))).alias("gapless"),
    )


@query("sequence_outcome", """
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 95) THEN 'PERSISTED' WHEN bool_or(event_type = 'purchase' AND value IS NULL) THEN 'UNKNOWN' WHEN bool_or(event_type = 'error' AND value > 90) THEN 'PREVENTED_AT_ATTACK' WHEN bool_or(NOT (event_type <> 'error')) THEN 'DELIVERY_BLOCKED' ELSE 'ABSENT' END AS outcome, count(*)::BIGINT AS steps FROM events GROUP BY user_id""")
def sequence_outcome(t):
    e = F.expr
    return decide.sequence_outcome(t("events"), ["user_id"], e("event_type = 'purchase' and value > 95"), e("event_type = 'purchase' and value is null"), e("event_type = 'error' and value > 90"), e("event_type <> 'error'"))


@query("pair_disposition", """
WITH r AS (SELECT item_id, item_id // 2 AS pair, length(text) >= 150 AS inc FROM benchmark), w AS (SELECT *, count(*) OVER (PARTITION BY pair) AS n, sum(inc::INT) OVER (PARTITION BY pair) AS k FROM r)
SELECT item_id, pair::BIGINT AS pair, CASE WHEN n <> 2 THEN 'incomplete' WHEN k = 2 THEN 'kept' WHEN inc THEN 'withheld_sibling' ELSE 'excluded' END AS disposition FROM w""")
def pair_disposition(t):
    rows = t("benchmark").select("item_id", F.expr("item_id div 2").alias("pair"), (F.length("text") >= 150).alias("inc"))
    return decide.pair_disposition(rows, "pair", F.col("inc"), "item_id").drop("inc")


@query("nearest_length_bin", """
WITH b(bin) AS (VALUES (100), (500), (1000), (2000), (5000), (10000)), r AS (SELECT doc_id, bin, row_number() OVER (PARTITION BY doc_id ORDER BY abs(bin - n_chars), bin) AS k FROM documents, b)
SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n FROM r WHERE k = 1 GROUP BY bin""")
def nearest_length_bin(t):
    d = t("documents")
    bins = d.sparkSession.createDataFrame([(b,) for b in (100, 500, 1000, 2000, 5000, 10000)], "bin long")
    return decide.nearest(d, "doc_id", "n_chars", bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("row_alignment", """
WITH a AS (SELECT doc_id AS i, sha256(text) AS h, lang FROM documents), m AS (SELECT doc_id AS i, sha256(CASE WHEN doc_id % 40 = 0 THEN '' ELSE text END) AS h, CASE WHEN doc_id % 33 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 29 <> 0),
j AS (SELECT coalesce(a.i, m.i) AS i, a.i IS NULL OR m.i IS NULL AS miss, a.h AS ah, m.h AS mh, a.lang AS al, m.lang AS ml FROM a FULL JOIN m ON a.i = m.i)
SELECT i AS row_index, 'META_NOT_ALIGNED' AS code FROM j WHERE miss UNION ALL SELECT i, 'ROW_TEXT_HASH' FROM j WHERE NOT miss AND ah <> mh UNION ALL SELECT i, 'ROW_LANG' FROM j WHERE NOT miss AND al <> ml""")
def row_alignment(t):
    d = t("documents")
    a = d.select(F.col("doc_id").alias("row_index"), F.sha2("text", 256).alias("h"), "lang")
    m = d.where("doc_id % 29 <> 0").select(
        F.col("doc_id").alias("row_index"), F.sha2(F.when(F.col("doc_id") % 40 == 0, "").otherwise(F.col("text")), 256).alias("h"), F.when(F.col("doc_id") % 33 == 0, "xx").otherwise(F.col("lang")).alias("lang")
    )
    return decide.alignment(a, m, "row_index", [("ROW_TEXT_HASH", F.col("h") != F.col("m_h")), ("ROW_LANG", F.col("lang") != F.col("m_lang"))])


@query("ordered_match", """
WITH f AS (SELECT user_id, event_id AS flow, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, event_id AS result, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'click')
SELECT f.user_id, f.flow, r.result FROM f JOIN (SELECT DISTINCT user_id, m FROM r) s USING (user_id) JOIN r ON r.user_id = f.user_id AND r.k = f.k - greatest(f.n - s.m, 0)""")
def ordered_match(t):
    e = t("events")
    return decide.ordered_match(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "event_id")


@query("gate_summary", f"""
SELECT 'duplicate_ids' AS "check", count(*) = 0 AS ok, count(*)::BIGINT AS violations, 'doc_id' AS detail FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'fk_labels', count(*) = 0, count(*)::BIGINT, 'labels.doc_id' FROM (SELECT l.doc_id FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL)
UNION ALL SELECT 'length_matches', count(*) = 0, count(*)::BIGINT, 'n_chars' FROM (SELECT doc_id FROM documents WHERE length(text) <> n_chars)
UNION ALL SELECT 'exact_copies', count(*) = 0, count(*)::BIGINT, 'text' FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def gate_summary(t):
    d, l = t("documents"), t("labels")
    parts = [
        gates.check("duplicate_ids", d.groupBy("doc_id").count().where("count > 1"), "doc_id"),
        gates.check("fk_labels", l.join(d, "doc_id", "left_anti"), "labels.doc_id"),
        gates.check("length_matches", d.where("char_length(text) <> n_chars"), "n_chars"),
        gates.check("exact_copies", d.groupBy(F.sha2("text", 256).alias("h")).count().where("count > 1"), "text"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("reviewer_verdicts", f"""
WITH r AS (SELECT doc_id, CASE {h60("'a|' || doc_id::VARCHAR")} % 4 WHEN 0 THEN 'VERIFIABLE' WHEN 1 THEN 'PROBABLY_CORRECT' WHEN 2 THEN 'UNCERTAIN' ELSE 'INCORRECT' END AS a1, CASE {h60("'b|' || doc_id::VARCHAR")} % 4 WHEN 0 THEN 'VERIFIABLE' WHEN 1 THEN 'PROBABLY_CORRECT' WHEN 2 THEN 'UNCERTAIN' ELSE 'INCORRECT' END AS a2,
  CASE WHEN doc_id % 10 = 0 THEN 'UNCERTAIN' ELSE ' ' END AS adj, CASE WHEN doc_id % 25 = 0 THEN 'VERIFIABLE' END AS human FROM documents)
SELECT verdict, count(*)::BIGINT AS n FROM (SELECT coalesce(nullif(trim(human), ''), nullif(trim(adj), ''), CASE WHEN a1 = a2 THEN a1 END, CASE WHEN least(a1, a2) = 'PROBABLY_CORRECT' AND greatest(a1, a2) = 'VERIFIABLE' THEN 'PROBABLY_CORRECT' END, 'PENDING') AS verdict FROM r) GROUP BY verdict""")
def reviewer_verdicts(t):
    say = lambda s: F.element_at(F.array(*map(F.lit, ("VERIFIABLE", "PROBABLY_CORRECT", "UNCERTAIN", "INCORRECT"))), (keys.hash60(F.concat(F.lit(s + "|"), F.col("doc_id").cast("string"))) % 4 + 1).cast("int"))
    v = decide.reviewer_verdict(F.when(F.col("doc_id") % 25 == 0, "VERIFIABLE"), F.when(F.col("doc_id") % 10 == 0, "UNCERTAIN").otherwise(" "), say("a"), say("b"))
    return t("documents").groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
