"""Tables of records: counts, shares, dispositions and outcomes that need no operator of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import protocol
from ..functions.stats import wilson
from ..functions.text import first_reason
from .evaluation import BASE, HALF, W, base
from .registry import LABELLED, L, R, h60, query

CATS = [("urls", "http"), ("licence", "licen"), ("secret", "password="), ("table", " | "), ("shout", "!!")]


@query("keyword_categories", "SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{w}') OR contains(lower(replace(text, '%20', ' ')), '{w}') THEN '{n}'" for n, w in CATS) + " ELSE 'other' END AS category, lang, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def keyword_categories(t):
    """First keyword rule that the lower-cased raw text or its decoded form matches."""
    raw, dec = F.lower("text"), F.lower(F.replace("text", F.lit("%20"), F.lit(" ")))
    kind = first_reason([(n, raw.contains(w) | dec.contains(w)) for n, w in CATS], "other")
    return t("documents").groupBy(kind.alias("category"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("keyword_census", "SELECT hits, count(*)::BIGINT AS n FROM (SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{n}' END" for n, w in CATS) + "], lambda x: x IS NOT NULL), ' + ') AS hits FROM documents) GROUP BY hits ORDER BY n DESC, hits LIMIT 12")
def keyword_census(t):
    """The twelve commonest combinations of all matching rules (a top-k report)."""
    hits = F.array_join(F.filter(F.array(*[F.when(F.lower("text").contains(w), F.lit(n)) for n, w in CATS]), lambda x: x.isNotNull()), " + ")
    return t("documents").groupBy(hits.alias("hits")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hits").limit(12)


OUT = "CASE event_id % 5 WHEN 0 THEN ' block | Too Fast.' WHEN 1 THEN 'ALLOW|' WHEN 2 THEN 'maybe | x' WHEN 3 THEN 'ALLOW' ELSE 'BLOCK | high value' END"


@query("output_parse", f"""
SELECT decision, reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN d IN ('ALLOW', 'BLOCK') THEN d END AS decision, nullif(rtrim(regexp_replace(lower(trim(r)), '\\.+$', '')), '') AS reason FROM (
  SELECT upper(trim(split_part(o, '|', 1))) AS d, CASE WHEN contains(o, '|') THEN substr(o, instr(o, '|') + 1) END AS r FROM (SELECT {OUT} AS o FROM events))) GROUP BY ALL""")
def output_parse(t):
    d, r = protocol.output_decision(F.expr(OUT))
    return t("events").groupBy(d.alias("decision"), r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("decoder_path", """
SELECT path, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'no_service' WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 'verified_with_fallback' WHEN event_id % 5 = 0 THEN 'verified' WHEN event_id % 3 = 0 THEN 'fallback' WHEN user_id % 2 = 0 THEN 'plain' ELSE 'unknown' END AS path FROM events) GROUP BY path""")
def decoder_path(t):
    """Classes of two flags and a token count, any of them null."""
    none = F.col("event_id") % 7 == 0
    verified, fallback = F.when(~none, F.col("event_id") % 5 == 0), F.when(~none, F.col("event_id") % 3 == 0)
    tokens = F.when(F.col("user_id") % 2 == 0, 1)
    yes = F.lit(True)
    kind = first_reason([("no_service", verified.isNull() & fallback.isNull()), ("verified_with_fallback", verified.eqNullSafe(yes) & fallback.eqNullSafe(yes)), ("verified", verified.eqNullSafe(yes)), ("fallback", fallback.eqNullSafe(yes)), ("plain", tokens.isNotNull())], "unknown")
    return t("events").groupBy(kind.alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("size_bands", """
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY sha256(text))
SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' ELSE '>200' END AS band, count(*)::BIGINT AS groups, sum(n)::BIGINT AS rows FROM g GROUP BY 1""")
def size_bands(t):
    g = t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    band = first_reason([("1", n == 1), ("2", n == 2), ("3-5", n <= 5), ("6-10", n <= 10), ("11-50", n <= 50), ("51-200", n <= 200)], ">200")
    return g.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("groups"), L(F.sum("n")).alias("rows"))


@query("selective_metrics", f"""
WITH b AS (SELECT lang, label, CASE WHEN score >= 0.8 THEN 'BLOCK' WHEN score <= 0.2 THEN 'ALLOW' ELSE 'DEFER' END AS d FROM {BASE})
SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (WHERE d = 'BLOCK')::BIGINT AS early, round(count(*) FILTER (WHERE d = 'BLOCK' AND label = 'ALLOW')::DOUBLE / nullif(count(*) FILTER (WHERE label = 'ALLOW'), 0), 6) AS early_fp_rate,
  round(count(*) FILTER (WHERE d = 'BLOCK' AND label = 'BLOCK')::DOUBLE / nullif(count(*) FILTER (WHERE d = 'BLOCK'), 0), 6) AS early_precision, round(count(*) FILTER (WHERE d = 'DEFER')::DOUBLE / count(*), 6) AS defer_rate FROM b GROUP BY lang""")
def selective_metrics(t):
    b = base(t).withColumn("d", F.when(F.col("score") >= 0.8, "BLOCK").when(F.col("score") <= 0.2, "ALLOW").otherwise("DEFER"))
    early, bad = F.col("d") == "BLOCK", F.col("label") == "BLOCK"
    n = F.count_if
    return b.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), n(early).alias("early"), R(F.try_divide(n(early & ~bad), n(~bad))).alias("early_fp_rate"), R(F.try_divide(n(early & bad), n(early))).alias("early_precision"),
        R(n(F.col("d") == "DEFER") / F.count(F.lit(1))).alias("defer_rate"),
    )


@query("category_gate", f"""
WITH c AS (SELECT source, count(*) FILTER (WHERE label = 'BLOCK')::BIGINT AS k, count(*)::BIGINT AS n, count(*) FILTER (WHERE r2 IS NULL)::BIGINT AS p FROM {BASE} GROUP BY source)
SELECT source, k, n, round(least({W} + {HALF}, 1), 6) AS upper, CASE WHEN 5 * p > n THEN 'PENDING' WHEN least({W} + {HALF}, 1) <= 0.35 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def category_gate(t):
    c = base(t).groupBy("source").agg(F.count_if(F.col("label") == "BLOCK").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("r2").isNull()).alias("p"))
    upper = wilson(F.col("k"), F.col("n"))[1]
    return c.select("source", "k", "n", R(upper).alias("upper"), F.when(5 * F.col("p") > F.col("n"), "PENDING").when(upper <= 0.35, "PASS").otherwise("FAIL").alias("verdict"))


@query("effect_classes", f"""
WITH c AS (SELECT source, count(*) FILTER (WHERE r1 AND NOT r2) AS a, count(*) FILTER (WHERE NOT r1 AND r2) AS b, count(*) FILTER (WHERE r1 IS NOT NULL AND r2 IS NOT NULL) AS n FROM {BASE} GROUP BY source)
SELECT source, a::BIGINT AS lost, b::BIGINT AS won, CASE WHEN n = 0 OR a + b = 0 THEN 'NO_EFFECT' WHEN 10 * abs(a - b) >= 2 * n THEN 'STRONG' WHEN 20 * abs(a - b) >= 2 * n THEN 'MODERATE' ELSE 'WEAK' END AS effect FROM c""")
def effect_classes(t):
    """Net discordance as a share of valid pairs, by integers."""
    a, b, n = (F.col(x) for x in ("lost", "won", "n"))
    c = base(t).groupBy("source").agg(F.count_if(F.col("r1") & ~F.col("r2")).alias("lost"), F.count_if(~F.col("r1") & F.col("r2")).alias("won"), F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("n"))
    kind = first_reason([("NO_EFFECT", (n == 0) | (a + b == 0)), ("STRONG", 10 * F.abs(a - b) >= 2 * n), ("MODERATE", 20 * F.abs(a - b) >= 2 * n)], "WEAK")
    return c.select("source", "lost", "won", kind.alias("effect"))


FL = {"short": "n_chars < 500", "hot_source": "source = 'src0'", "english": "lang = 'en'"}


@query("overlap_flags", " UNION ALL ".join(f"SELECT '{n}' AS flag, toxic::BIGINT AS toxic, count(*) FILTER (WHERE {p})::BIGINT AS n FROM {LABELLED} GROUP BY toxic" for n, p in FL.items()))
def overlap_flags(t):
    g = t("documents").join(t("labels"), "doc_id").groupBy(L("toxic").alias("toxic")).agg(*[F.count_if(F.expr(p)).alias(n) for n, p in FL.items()])
    return g.unpivot(["toxic"], list(FL), "flag", "n").select("flag", "toxic", "n")


@query("unit_mixes", f"""
WITH u AS (SELECT (n_chars // 200) || '/' || lang AS unit, array_to_string(list_sort(list(DISTINCT toxic::VARCHAR)), ',') AS labels, array_to_string(list_sort(list(DISTINCT quality::VARCHAR)), ',') AS decisions, count(*) AS n FROM {LABELLED} GROUP BY 1)
SELECT labels, decisions, count(*)::BIGINT AS units, sum(n)::BIGINT AS rows FROM u GROUP BY ALL""")
def unit_mixes(t):
    """Per distinct unit the mix of labels and of decisions; then the mixes counted."""
    rows = t("documents").join(t("labels"), "doc_id").withColumn("unit", F.concat_ws("/", F.expr("n_chars div 200").cast("string"), "lang"))
    mix = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    u = rows.groupBy("unit").agg(mix("toxic").alias("labels"), mix("quality").alias("decisions"), F.count(F.lit(1)).alias("n"))
    return u.groupBy("labels", "decisions").agg(F.count(F.lit(1)).alias("units"), L(F.sum("n")).alias("rows"))


@query("feature_means", f"SELECT toxic::BIGINT AS toxic, count(*)::BIGINT AS n, count(*) FILTER (WHERE contains(text, '@'))::BIGINT AS with_at, round(avg(n_chars), 6) AS mean_chars FROM {LABELLED} GROUP BY toxic")
def feature_means(t):
    return t("documents").join(t("labels"), "doc_id").groupBy(L("toxic").alias("toxic")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", F.lit("@"))).alias("with_at"), R(F.avg("n_chars")).alias("mean_chars"))


@query("ladder_join", """
WITH a AS (SELECT user_id AS rate, count(*)::BIGINT AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS rate, count(*)::BIGINT AS n FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1)
SELECT a.rate, a.n AS first, b.n AS second, b.n - a.n AS gain FROM a JOIN b USING (rate)""")
def ladder_join(t):
    """Only the levels that both ladders ran."""
    e = t("events")
    a = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("rate")).agg(F.count(F.lit(1)).alias("first"))
    b = e.where("event_type = 'view' and user_id % 3 <> 0").groupBy(F.col("user_id").alias("rate")).agg(F.count(F.lit(1)).alias("second"))
    return a.join(b, "rate").withColumn("gain", F.col("second") - F.col("first"))


@query("pair_families", """
WITH r AS (SELECT item_id, item_id // 2 AS pair, CASE WHEN item_id % 2 = 0 THEN 'f' || (length(text) % 7) END AS family FROM benchmark)
SELECT item_id, pair::BIGINT AS pair, max(family) OVER (PARTITION BY pair) AS family FROM r""")
def pair_families(t):
    """The twin inherits its pair's family."""
    rows = t("benchmark").select("item_id", F.expr("item_id div 2").alias("pair"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("f"), (F.length("text") % 7).cast("string"))).alias("family"))
    return rows.withColumn("family", F.max("family").over(Window.partitionBy("pair")))


@query("component_ownership", """
WITH c AS (SELECT doc_id, lang || substr(source, 4) AS comp FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'x' || substr(source, 4) FROM documents WHERE doc_id % 8 = 0),
o AS (SELECT doc_id, count(*) AS n, min(comp) AS comp FROM c GROUP BY doc_id)
SELECT verdict, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o.n IS NULL THEN 'no_owner' WHEN o.n > 1 THEN 'several_owners' WHEN o.comp <> d.lang || substr(d.source, 4) THEN 'content_mismatch' ELSE 'bound' END AS verdict FROM documents d LEFT JOIN o USING (doc_id)) GROUP BY verdict""")
def component_ownership(t):
    """Each record has exactly one owner that agrees with it; the first failing rule names the rejection."""
    d = t("documents").select("doc_id", "lang", "source")
    own = lambda p: F.concat(p, F.expr("substr(source, 4)"))
    claims = d.where("doc_id % 3 <> 0").select("doc_id", own(F.col("lang")).alias("comp")).unionByName(d.where("doc_id % 8 = 0").select("doc_id", own(F.lit("x")).alias("comp")))
    o = claims.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("comp"))
    kind = first_reason([("no_owner", F.col("n").isNull()), ("several_owners", F.col("n") > 1), ("content_mismatch", F.col("comp") != own(F.col("lang")))], "bound")
    return d.join(o, "doc_id", "left").groupBy(kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("generate_until_quota", f"""
WITH a AS (SELECT lang, i, CASE {h60("lang || '|' || i::VARCHAR")} % 10 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'incomplete' ELSE 'complete' END AS outcome FROM (SELECT DISTINCT lang FROM documents), range(60) r(i)),
c AS (SELECT *, count(*) FILTER (WHERE outcome = 'complete') OVER (PARTITION BY lang ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM a)
SELECT lang, outcome, count(*)::BIGINT AS n FROM c WHERE done < 40 GROUP BY ALL""")
def generate_until_quota(t):
    """Attempts by index until the quota is full; a changed target leaves earlier attempts as they are."""
    from ..functions.keys import hash60

    langs = t("documents").select("lang").distinct()
    a = langs.select("lang", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    h = hash60(F.concat_ws("|", "lang", F.col("i").cast("string"))) % 10
    a = a.withColumn("outcome", F.when(h == 0, "abandoned").when(h == 1, "incomplete").otherwise("complete"))
    done = F.coalesce(F.sum((F.col("outcome") == "complete").cast("int")).over(Window.partitionBy("lang").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return a.withColumn("done", done).where("done < 40").groupBy("lang", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("quota_plan", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s(split, most) AS (VALUES ('train', 8), ('val', 2), ('test', 3))
SELECT split, source, lang, least(most, n)::BIGINT AS quota FROM s, c WHERE n >= 2 AND NOT (split = 'val' AND lang = 'es')""")
def quota_plan(t):
    """A cell for each split, source and category that is eligible. Splits are three literal rows."""
    c = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    splits = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(m).cast("long").alias("most")) for s, m in (("train", 8), ("val", 2), ("test", 3))])
    cells = c.select("*", F.inline(splits)).where("n >= 2 and not (split = 'val' and lang = 'es')")
    return cells.select("split", "source", "lang", F.least("most", "n").alias("quota"))


@query("training_schedule", "SELECT lang, greatest(ceil(ceil(n / 8) / 4), 1)::BIGINT * 3 AS steps, floor(greatest(ceil(ceil(n / 8) / 4), 1) * 3 * 0.1::DOUBLE)::BIGINT AS warmup FROM (SELECT lang, count(*)::DOUBLE AS n FROM documents GROUP BY lang)")
def training_schedule(t):
    c = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    steps, warmup = protocol.training_steps(F.col("n"), 8, 4, 3, 0.1)
    return c.select("lang", steps.alias("steps"), warmup.alias("warmup"))


@query("label_census", f"""
SELECT lang, coalesce(quality::VARCHAR, '—') AS quality, coalesce(toxic::VARCHAR, '—') AS toxic, (d.doc_id % 5 = 0) AS held, count(*)::BIGINT AS n, count(*) FILTER (WHERE (l.quality IS NULL) <> (l.toxic IS NULL))::BIGINT AS violations FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def label_census(t):
    """Counts by every key, '—' for null, and violations of an if-and-only-if between two fields."""
    j = t("documents").join(t("labels"), "doc_id", "left")
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    rows = j.select("lang", dash("quality"), dash("toxic"), (F.col("doc_id") % 5 == 0).alias("held"), (F.col("quality").isNull() != F.col("toxic").isNull()).alias("bad"))
    return rows.groupBy("lang", "quality", "toxic", "held").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("violations"))


@query("encoding_signals", """
WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN url || '%2527' WHEN 1 THEN url || '%00%u0041' WHEN 2 THEN url || '%c0%ae' ELSE url END AS u FROM pages)
SELECT array_to_string(list_filter([CASE WHEN page_has THEN 'multi_encoding' END, CASE WHEN contains(u, '%00') THEN 'null_byte' END, CASE WHEN regexp_matches(u, '(?i)%c[01]%[89ab][0-9a-f]') THEN 'overlong_utf8' END, CASE WHEN regexp_matches(u, '(?i)%u[0-9a-f]{4}') THEN 'percent_u' END], lambda x: x IS NOT NULL), ',') AS signals, count(*)::BIGINT AS n
FROM (SELECT u, coalesce(regexp_matches(TRY(url_decode(u)), '%[0-9A-Fa-f]{2}'), false) AS page_has FROM p) GROUP BY 1""")
def encoding_signals(t):
    """Encodings that hide characters, in urls with some planted; tests hold the function to hand-written cases."""
    planted = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("%2527"))).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("%00%u0041"))).when(F.col("page_id") % 4 == 2, F.concat("url", F.lit("%c0%ae"))).otherwise(F.col("url"))
    return t("pages").groupBy(F.array_join(protocol.encoding_signals(planted), ",").alias("signals")).agg(F.count(F.lit(1)).alias("n"))


@query("flow_assembly", """
SELECT user_id, count(*)::BIGINT AS lines, min(event_id) AS opened, max_by(event_type, event_id) AS last_type, round(max_by(value, event_id), 6) AS last_value FROM events GROUP BY user_id""")
def flow_assembly(t):
    """Lines of one tag assembled: the first opens, of later ones the last wins."""
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"), F.min("event_id").alias("opened"), F.max_by("event_type", "event_id").alias("last_type"), R(F.max_by("value", "event_id")).alias("last_value"))


@query("census_differences", """
WITH a AS (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1), b AS (SELECT source, count(*)::BIGINT AS n FROM documents WHERE doc_id % 50 <> 7 GROUP BY 1)
SELECT a.source, a.n AS first, b.n AS second FROM a JOIN b USING (source) WHERE a.n IS DISTINCT FROM b.n""")
def census_differences(t):
    """Keys on both sides whose counts differ, null-safe."""
    d = t("documents")
    c = d.groupBy("source").agg(F.count(F.lit(1)).alias("first"), F.count_if(F.col("doc_id") % 50 != 7).alias("second"))
    return c.where((F.col("second") > 0) & ~F.col("first").eqNullSafe(F.col("second")))


@query("peak_of_peaks", """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL) SELECT event_type, max(n)::BIGINT AS busiest_day, round(max(peak), 6) AS peak, round(avg(peak), 6) AS mean_peak FROM d GROUP BY event_type""")
def peak_of_peaks(t):
    """The largest of the runs' peaks, beside (never instead of it) their mean."""
    d = t("events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return d.groupBy("event_type").agg(F.max("n").alias("busiest_day"), R(F.max("peak")).alias("peak"), R(F.avg("peak")).alias("mean_peak"))
