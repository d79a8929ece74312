"""Splits, deduplication, ledgers, gates, samples and components over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import curate, gates, graph, similarity, split
from ..storage import materialize
from .registry import KEYED, LABELLED, PLAIN, L, R, h60, query, split_sql

SALT = "v1"


def masked_sql(x: str) -> str:
    """masked_key of a canonical key: digit runs as 0, four or more of a letter as three, no blanks."""
    x = f"regexp_replace({x}, '[0-9]+', '0', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{{4,}}', '{c * 3}', 'g')"
    return f"replace({x}, ' ', '')"


MASKED = masked_sql(PLAIN)
TITLE = r"trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[ \t\r\n\f\x0B]+', ' ', 'g'))"
SPLIT = split_sql("key", SALT)


def keyed(t):
    return t("documents").withColumn("key", keys.plain_key(F.col("text")))


def labelled(t):
    return t("documents").join(t("labels"), "doc_id")


def with_split(t):
    return keyed(t).withColumn("split", keys.split_of(F.col("key"), SALT))


@query("split_leakage_gate", f"""
WITH s AS (SELECT doc_id, text, key, {split_sql("doc_id::VARCHAR", "id")} AS split FROM {KEYED})
SELECT 'exact' AS check_name, a.split AS split, count(*)::BIGINT AS n_rows, count(DISTINCT a.text)::BIGINT AS n_keys,
  count(*) FILTER (WHERE a.text IN (SELECT text FROM s WHERE split = 'train'))::BIGINT AS leaked, round(count(*) FILTER (WHERE a.text IN (SELECT text FROM s WHERE split = 'train'))::DOUBLE / count(*), 6) AS leakage_rate
FROM s a WHERE a.split <> 'train' GROUP BY ALL
UNION ALL
SELECT 'canonical', a.split, count(*)::BIGINT, count(DISTINCT a.key)::BIGINT, count(*) FILTER (WHERE a.key IN (SELECT key FROM s WHERE split = 'train'))::BIGINT,
  round(count(*) FILTER (WHERE a.key IN (SELECT key FROM s WHERE split = 'train'))::DOUBLE / count(*), 6)
FROM s a WHERE a.split <> 'train' GROUP BY ALL""")
def split_leakage_gate(t):
    """Rows of test and val whose text, or canonical key, is also in train, when rows are split by id."""
    rows = keyed(t).select(keys.split_of(F.col("doc_id").cast("string"), "id").alias("split"), F.sha2("text", 256).alias("text"), F.sha2("key", 256).alias("key"))
    rows = materialize(rows)  # texts are scanned once; what is read again is three short columns
    out = [gates.leakage(rows, c, "split", "train").select(F.lit(n).alias("check_name"), "*") for n, c in (("exact", "text"), ("canonical", "key"))]
    return out[0].unionByName(out[1])


@query("bucket_split_counts", f"SELECT {SPLIT} AS split, lang, count(*)::BIGINT AS n, count(DISTINCT key)::BIGINT AS n_keys FROM {KEYED} GROUP BY ALL")
def bucket_split_counts(t):
    return with_split(t).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


RANKED = f"SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {h60("'cut|' || lang || '|' || doc_id::VARCHAR")}, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS size FROM documents"


@query("hash_rank_cuts", f"""
SELECT doc_id, lang, rank::BIGINT AS rank, CASE WHEN size < 3 THEN 'train' WHEN rank <= greatest(1, (20 * size + 50) // 100) THEN 'test'
  WHEN rank <= greatest(1, (20 * size + 50) // 100) + greatest(1, (10 * size + 50) // 100) THEN 'val' ELSE 'train' END AS split FROM ({RANKED})""")
def hash_rank_cuts(t):
    ranked = split.hash_rank(t("documents").select("doc_id", "lang"), "doc_id", ["lang"], "cut")
    return ranked.select("doc_id", "lang", "rank", split.rank_cuts(F.col("rank"), F.col("size")).alias("split"))


@query("exact_dedup_first_wins", "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies, min_by(source, doc_id) AS source FROM documents GROUP BY text")
def exact_dedup_first_wins(t):
    rows = t("documents").withColumn("h", F.sha2("text", 256))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min_by("source", "doc_id").alias("source")).drop("h")


@query("canonical_dedup_ledger", f"""
WITH r AS (SELECT lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS e, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS c FROM {KEYED})
SELECT lang, CASE WHEN e > 1 THEN 'exact_duplicate' WHEN c > 1 THEN 'canonical_duplicate' ELSE 'accepted' END AS reason, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def canonical_dedup_ledger(t):
    """Accepted, exact duplicate or canonical duplicate; the reasons add up. Keepers come from partial minima, not windows over texts."""
    rows = materialize(keyed(t).select("doc_id", "lang", F.sha2("text", 256).alias("e"), F.sha2("key", 256).alias("c")))
    first_e = rows.groupBy("e").agg(F.min("doc_id").alias("me"))
    first_c = rows.groupBy("c").agg(F.min("doc_id").alias("mc"))
    reason = F.when(F.col("doc_id") != F.col("me"), "exact_duplicate").when(F.col("doc_id") != F.col("mc"), "canonical_duplicate").otherwise("accepted")
    return curate.reason_ledger(rows.join(first_e, "e").join(first_c, "c"), reason, ["lang"])


@query("dedup_precedence", f"""
WITH r AS (SELECT doc_id, source, key, substr(source, 4)::INT AS p FROM {KEYED})
SELECT doc_id, source, first_value(doc_id) OVER w AS representative, first_value(source) OVER w AS rep_source, (row_number() OVER w > 1) AS excluded FROM r
WINDOW w AS (PARTITION BY key ORDER BY p, doc_id)""")
def dedup_precedence(t):
    """Every row with the representative of its key: of the source of highest precedence, then the smallest id."""
    rows = materialize(keyed(t).select("doc_id", "source", F.sha2("key", 256).alias("h"), F.expr("cast(substr(source, 4) as int)").alias("p")))
    best = curate.keep_one(rows, ["h"], ["p", "doc_id"], ["doc_id", "source"]).select("h", F.col("doc_id").alias("representative"), F.col("source").alias("rep_source"))
    return rows.join(best, "h").select("doc_id", "source", "representative", "rep_source", (F.col("doc_id") != F.col("representative")).alias("excluded"))


def _ladder(rules, otherwise):
    q = lambda p: p.replace("'", "''")
    return "CASE " + " ".join(f"WHEN {r if r.startswith('(') and ' ' in r and r.endswith(')') else f"regexp_matches(text, '{q(r)}')"} THEN '{n}'" for n, r in rules) + f" ELSE '{otherwise}' END"


PROSE_SQL = _ladder([("empty", "(coalesce(text, '') = '')"), text.PROSE[0], ("too_short", "(length(text) < 100 )"), ("too_long", "(length(text) > 20000 )"), *text.PROSE[1:]], "accepted")


@query("quality_reason_ledger", f"SELECT lang, {PROSE_SQL} AS reason, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def quality_reason_ledger(t):
    return curate.reason_ledger(t("documents"), text.prose_reason(F.col("text"), 100, 20000), ["lang"])


#: Structural flags of documents.
FLAGS = [("table_like", r" \| "), ("shouting", r"[A-Z]{4,}!!"), ("symbol_suffix", r"[#$%&*]{3}"), ("license_line", r"(?i)licen[cs]e"), ("secret_like", r"AKIA[A-Z0-9]{16}|password="), ("many_lines", r"(?s)\n.*\n.*\n.*\n")]
FLAG_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FLAGS) + "], lambda x: x IS NOT NULL)"


@query("structural_flags", f"SELECT flag, lang, count(*)::BIGINT AS n FROM (SELECT lang, unnest({FLAG_SQL}) AS flag FROM documents) GROUP BY ALL")
def structural_flags(t):
    """Every rule that fires on a text, counted."""
    flags = text.all_flags([(n, F.col("text").rlike(p)) for n, p in FLAGS])
    return t("documents").select("lang", F.explode(flags).alias("flag")).groupBy("flag", "lang").agg(F.count(F.lit(1)).alias("n"))


#: Kinds of personal data.
PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("ipv4", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"), ("phone", r"\+[0-9][0-9 ().-]{7,}[0-9]"), ("card", r"\b[0-9]{4}([ -]?[0-9]{4}){3}\b"), ("long_number", r"[0-9]{6,}")]


@query("pii_reason_counts", f"SELECT source, {_ladder(PII, 'none')} AS reason, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def pii_reason_counts(t):
    return curate.reason_ledger(t("documents"), text.first_reason([(n, F.col("text").rlike(p)) for n, p in PII], "none"), ["source"])


WATER = [("has_text", "length(text) > 0"), ("long_enough", "length(text) >= 200"), ("not_table", "instr(text, ' | ') = 0"), ("english", "lang = 'en'")]


@query("waterfall_distinct", "WITH k AS (SELECT *, sha256(text) AS h FROM documents) " + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS step, '{n}' AS name, count(*)::BIGINT AS rows, count(DISTINCT h)::BIGINT AS keys FROM k WHERE {' AND '.join(p for _, p in WATER[: i + 1])}" for i, (n, _) in enumerate(WATER)))
def waterfall_distinct(t):
    return curate.waterfall(t("documents").withColumn("h", F.sha2("text", 256)), [(n, F.expr(p)) for n, p in WATER], "h")


@query("pipeline_accepted_excluded", f"""
WITH n AS (SELECT doc_id, text, CASE WHEN length(text) < 200 THEN 'too_short' WHEN instr(text, ' | ') > 0 THEN 'table_like' END AS r FROM documents),
k AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY text, r IS NULL ORDER BY doc_id) END AS rk FROM n)
SELECT doc_id, coalesce(r, CASE WHEN rk > 1 THEN 'duplicate_value' END, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'fr') THEN 'oracle_collision' END) AS exclusion_reason,
  CASE WHEN coalesce(r, CASE WHEN rk > 1 THEN 'duplicate_value' END, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'fr') THEN 'oracle_collision' END) IS NULL THEN 'ACCEPTED' ELSE 'EXCLUDED' END AS status FROM k""")
def pipeline_accepted_excluded(t):
    """Reason, then duplicate among survivors, then collision with a denied set (here: the French texts)."""
    docs = t("documents")
    rows = docs.select("doc_id", "text", F.sha2("text", 256).alias("h"))
    reason = text.first_reason([("too_short", F.length("text") < 200), ("table_like", F.instr("text", " | ") > 0)])
    denied = docs.where("lang = 'fr'").select(F.sha2("text", 256).alias("_v"))
    return curate.exclusion_pipeline(rows, reason, F.col("h"), denied, ["doc_id"]).select("doc_id", "exclusion_reason", "status")


@query("label_consistency", f"""
WITH k AS (SELECT sha256(key) AS h, toxic, {SPLIT} AS split FROM (SELECT *, {PLAIN} AS key FROM {LABELLED})),
g AS (SELECT h, count(DISTINCT toxic) AS c, count(DISTINCT split) AS s, count(*) AS n FROM k GROUP BY h)
SELECT count(*)::BIGINT AS n_keys, count(*) FILTER (WHERE c > 1)::BIGINT AS conflicts, count(*) FILTER (WHERE c > 1 AND s > 1)::BIGINT AS across_splits, coalesce(sum(n) FILTER (WHERE c > 1), 0)::BIGINT AS conflict_rows FROM g""")
def label_consistency(t):
    rows = labelled(t).withColumn("key", keys.plain_key(F.col("text"))).withColumn("split", keys.split_of(F.col("key"), SALT))
    return gates.label_consistency(rows.withColumn("h", F.sha2("key", 256)), "h", "toxic", "split")


@query("group_disjointness", f"""
SELECT splits, count(*)::BIGINT AS n_keys FROM (SELECT array_to_string(list_sort(list(DISTINCT {split_sql("doc_id::VARCHAR", "id")})), ',') AS splits FROM {KEYED} GROUP BY source, lang) GROUP BY splits""")
def group_disjointness(t):
    """Splits that share an identity (source, lang), when rows are split by id."""
    rows = t("documents").withColumn("split", keys.split_of(F.col("doc_id").cast("string"), "id"))
    return gates.identity_splits(rows, ["source", "lang"], "split")


@query("contamination_exact", """
WITH b AS (SELECT DISTINCT sha256(text) AS h FROM benchmark), d AS (SELECT doc_id, regexp_split_to_table(text, '\n') AS line FROM documents)
SELECT doc_id, count(*)::BIGINT AS hits FROM d WHERE sha256(line) IN (SELECT h FROM b) GROUP BY doc_id""")
def contamination_exact(t):
    """Documents with a line that is a whole benchmark item."""
    items = t("benchmark").select(F.sha2("text", 256).alias("h")).distinct()
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2("line", 256).alias("h"))
    return lines.join(items, "h", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query("contamination_substring", "SELECT b.item_id, d.doc_id FROM (SELECT item_id, text AS probe FROM benchmark WHERE length(text) > 0) b JOIN documents d ON contains(d.text, b.probe)")
def contamination_substring(t):
    """Documents that hold a whole item, of any length but 0."""
    probes = t("benchmark").where(F.length("text") > 0).select("item_id", F.col("text").alias("probe"))
    return gates.contains_join(t("documents").select("doc_id", "text"), "doc_id", probes, "item_id")


@query("contamination_ngram", """
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> '') AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(ws), 8) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 8) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 8) - 1], ' '))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
v AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g FROM v, (SELECT DISTINCT k FROM b) WHERE len(ws) >= k)
SELECT d.doc_id, b.item_id, count(*)::BIGINT AS shared, round(count(*)::DOUBLE / any_value(n.n), 6) AS overlap FROM d JOIN b USING (k, g) JOIN n USING (item_id) GROUP BY ALL""")
def contamination_ngram(t):
    """Share of an item's distinct 8-word n-grams that a document holds; a shorter item is one gram."""
    return gates.ngram_overlap(t("documents"), "doc_id", t("benchmark"), "item_id", 8)


@query("shortcut_scores", f"""
WITH r AS (SELECT 'lang' AS field, lang AS v, toxic FROM {LABELLED} UNION ALL SELECT 'source', source, toxic FROM {LABELLED} UNION ALL SELECT 'length_band', least(n_chars // 500, 9)::VARCHAR, toxic FROM {LABELLED}),
c AS (SELECT field, v, greatest(count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic = 1)) AS m, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS n0 FROM r GROUP BY ALL)
SELECT field, sum(n)::BIGINT AS n, round(sum(m)::DOUBLE / sum(n), 6) AS score, round((sum(m) - greatest(sum(n0), sum(n) - sum(n0)))::DOUBLE / sum(n), 6) AS margin,
  (sum(m)::DOUBLE / sum(n) >= 0.9 AND (sum(m) - greatest(sum(n0), sum(n) - sum(n0)))::DOUBLE / sum(n) >= 0.1) AS blocks FROM c GROUP BY field""")
def shortcut_scores(t):
    """How well one field alone predicts the label: sum of majority counts over rows, and its margin over the majority class."""
    rows = labelled(t).withColumn("length_band", F.least(F.expr("n_chars div 500"), F.lit(9)).cast("string"))
    return gates.shortcut_scores(rows, ["lang", "source", "length_band"], "toxic", 0.9, 0.1)


@query("lookup_baseline", f"""
WITH s AS (SELECT lang, source, toxic, {split_sql("doc_id::VARCHAR", "id")} AS split FROM {LABELLED}),
f AS (SELECT source AS v, toxic AS y, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, toxic) AS r FROM s WHERE split = 'train' GROUP BY source, toxic),
g AS (SELECT toxic AS y FROM s WHERE split = 'train' GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1)
SELECT split, count(*)::BIGINT AS n, count(*) FILTER (WHERE coalesce(f.y, (SELECT y FROM g)) = toxic)::BIGINT AS correct,
  round(count(*) FILTER (WHERE coalesce(f.y, (SELECT y FROM g)) = toxic)::DOUBLE / count(*), 6) AS accuracy FROM s LEFT JOIN f ON f.v = s.source AND f.r = 1 WHERE split <> 'train' GROUP BY split""")
def lookup_baseline(t):
    """A value's majority label on train, applied to the other splits; unseen values take the global majority."""
    rows = labelled(t).withColumn("split", keys.split_of(F.col("doc_id").cast("string"), "id"))
    return gates.lookup_baseline(rows, "source", "toxic", "split", "train")


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> ''))"


@query("token_purity", f"""
WITH r AS (SELECT toxic, {TOKENS} AS ts FROM {LABELLED}), n AS (SELECT count(*) AS n FROM r), e AS (SELECT toxic, unnest(ts) AS token FROM r),
c AS (SELECT token, count(*) AS df, count(*) FILTER (WHERE toxic = 1) AS df1 FROM e GROUP BY token)
SELECT token, df::BIGINT AS df, round(greatest(df1, df - df1)::DOUBLE / df, 6) AS purity, (greatest(df1, df - df1)::DOUBLE / df >= 0.95) AS blocks FROM c, n WHERE df * 100 >= n.n AND df >= 2""")
def token_purity(t):
    """Tokens in 1 % of the labelled texts or more, by the share of their documents in one class."""
    return gates.token_purity(labelled(t), "text", "toxic", 0.01, 0.95)


MASKED_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(CASE WHEN length(text) >= 40 THEN ' VALUE ' || substr(text, 21) END), '[^a-z0-9à-ÿ]+'), lambda x: x <> ''))"


@query("token_purity_masked", f"""
WITH r AS (SELECT toxic, {MASKED_TOKENS} AS ts FROM {LABELLED}), n AS (SELECT count(*) AS n FROM r), e AS (SELECT toxic, unnest(ts) AS token FROM r),
c AS (SELECT token, count(*) AS df, count(*) FILTER (WHERE toxic = 1) AS df1 FROM e GROUP BY token)
SELECT token, df::BIGINT AS df, round(greatest(df1, df - df1)::DOUBLE / df, 6) AS purity, (greatest(df1, df - df1)::DOUBLE / df >= 0.95) AS blocks FROM c, n WHERE df * 100 >= n.n AND df >= 2""")
def token_purity_masked(t):
    """The same with a span masked in every text (here the first twenty characters; of texts under forty the span is out of place, and they count nothing)."""
    span = F.when(F.length("text") >= 40, F.array(F.struct(F.lit(0).alias("a"), F.lit(20).alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(1 << 30).alias("b"))))
    return gates.token_purity(labelled(t).withColumn("spans", span), "text", "toxic", 0.01, 0.95, "spans")


@query("element_dominance", "SELECT source, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share, CASE WHEN count(*)::DOUBLE / (SELECT count(*) FROM documents) > 0.03 THEN 'block' WHEN count(*)::DOUBLE / (SELECT count(*) FROM documents) > 0.01 THEN 'warn' ELSE 'ok' END AS verdict FROM documents GROUP BY source")
def element_dominance(t):
    return gates.dominance(t("documents"), "source", 0.01, 0.03)


@query("category_imbalance", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n::BIGINT AS n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, round(n::DOUBLE / max(n) OVER (), 6) AS ratio FROM c")
def category_imbalance(t):
    counts = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.select("lang", "n", R(F.col("n") / F.sum("n").over(every)).alias("share"), R(F.col("n") / F.max("n").over(every)).alias("ratio"))


@query("manifest_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*)::BIGINT AS rows, sum({h60(k)})::VARCHAR AS digest FROM {n}" for n, k in (("documents", "doc_id::VARCHAR || '|' || coalesce(text, '')"), ("labels", "doc_id::VARCHAR || '|' || quality || '|' || toxic"), ("benchmark", "item_id::VARCHAR || '|' || text"), ("pages", "page_id::VARCHAR || '|' || url"))))
def manifest_counts(t):
    """Rows and an order-free digest (the sum of 60-bit row hashes) of each table: aggregates partially, unlike a hash of sorted rows."""
    parts = []
    for name, row in (("documents", "doc_id || '|' || coalesce(text, '')"), ("labels", "doc_id || '|' || quality || '|' || toxic"), ("benchmark", "item_id || '|' || text"), ("pages", "page_id || '|' || url")):
        parts.append(gates.digest(t(name), F.expr(row), name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("stratified_sample", f"""
SELECT doc_id, lang, source, rank FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {h60("'s1|' || lang || '|' || source || '|' || doc_id::VARCHAR")}, doc_id)::BIGINT AS rank FROM documents) WHERE rank <= 3""")
def stratified_sample(t):
    return split.stratified_sample(t("documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 3, "s1").drop("size")


@query("largest_remainder", """
WITH c AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang), w AS (SELECT sum(n)::BIGINT AS w FROM c),
f AS (SELECT lang, n, (100 * n) // w AS f, (100 * n) % w AS r FROM c, w)
SELECT lang, n, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def largest_remainder(t):
    return split.apportion(t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 100)


RR = f"(SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {h60('doc_id::VARCHAR')}, doc_id) AS depth FROM documents)"


@query("round_robin_cap", f"SELECT doc_id, source, lang, depth::BIGINT AS depth, taken FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY depth, lang, {h60('doc_id::VARCHAR')}, doc_id)::BIGINT AS taken FROM {RR} WHERE depth <= 7) WHERE taken <= 7")
def round_robin_cap(t):
    rows = t("documents").select("doc_id", "source", "lang", keys.hash60(F.col("doc_id").cast("string")).alias("h"))
    return curate.round_robin_cap(rows, "source", "lang", ["h", "doc_id"], 7).drop("h")


@query("class_balance", f"""
WITH r AS (SELECT doc_id, lang, toxic, row_number() OVER (PARTITION BY lang, toxic ORDER BY {h60('doc_id::VARCHAR')}, doc_id) AS r FROM {LABELLED}),
q AS (SELECT lang, least(count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic = 1)) AS q FROM r GROUP BY lang)
SELECT doc_id, lang, toxic FROM r JOIN q USING (lang) WHERE r.r <= q.q""")
def class_balance(t):
    rows = labelled(t).select("doc_id", "lang", "toxic", keys.hash60(F.col("doc_id").cast("string")).alias("h"))
    return curate.class_balance(rows, "lang", "toxic", "h", ["doc_id"]).drop("h")


@query("cluster_share_class", f"""
WITH c AS (SELECT {SPLIT} AS split, source, count(*) AS n FROM {KEYED} GROUP BY ALL)
SELECT split, source, n::BIGINT AS n, (sum(n) OVER (PARTITION BY split))::BIGINT AS total, CASE WHEN 20 * n > 2 * sum(n) OVER (PARTITION BY split) THEN 'dominant' WHEN 20 * n > sum(n) OVER (PARTITION BY split) THEN 'large' ELSE 'small' END AS size_class FROM c""")
def cluster_share_class(t):
    """Shares as integers: n/total > 1/10 is dominant, > 1/20 large, by cross-multiplication."""
    counts = with_split(t).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))
    kind = F.when(20 * F.col("n") > 2 * F.col("total"), "dominant").when(20 * F.col("n") > F.col("total"), "large").otherwise("small")
    return counts.withColumn("total", total).withColumn("size_class", kind)


WORDS5 = """
WITH k AS (SELECT min(doc_id) AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents GROUP BY trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))),
g AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS t FROM k WHERE len(w) > 0),
e AS (SELECT id, unnest(t) AS x, len(t) AS n FROM g),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS united FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
s AS (SELECT a, b, shared::BIGINT AS shared, united::BIGINT AS united FROM p WHERE 5 * shared >= 4 * united)"""


def word_sets(t):
    """(id, t): distinct five-word shingles of distinct canonical texts; the whole sequence of fewer words; texts without words have none."""
    one = keyed(t).groupBy("key").agg(F.min("doc_id").alias("id"))
    words = F.filter(F.split("key", " "), lambda w: w != "")
    gram = lambda w: lambda i: F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(5)])
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), gram(w))
    return one.select("id", keys.bind(words, lambda w: F.when(F.size(w) >= 5, F.array_distinct(grams(w))).when(F.size(w) > 0, F.array(F.array_join(w, " ")))).alias("t"))


@query("near_dup_pairs", WORDS5 + " SELECT * FROM s")
def near_dup_pairs(t):
    """All pairs of distinct canonical texts with Jaccard of five-word shingles of 4/5 or more."""
    return similarity.similar_pairs(word_sets(t), "id", "t", 4, 5)


@query("near_dup_components", WORDS5.replace("WITH k", "WITH RECURSIVE k") + """,
w AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a)
SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a""")
def near_dup_components(t):
    """Components of the near-duplicate pairs: proposed merges, never applied."""
    pairs = materialize(similarity.similar_pairs(word_sets(t), "id", "t", 4, 5))
    return graph.connected_components(pairs, "a", "b").select(F.col("node").alias("doc_id"), F.col("root").alias("component"))


@query("near_dup_items", """
WITH d AS (SELECT regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS k, min(item_id) AS id FROM benchmark GROUP BY 1),
g AS (SELECT id, list_distinct(list_transform(range(1, length(k) - 2), lambda i: substr(k, i, 4))) AS t FROM d WHERE length(k) >= 4),
e AS (SELECT id, unnest(t) AS x, len(t) AS n FROM g),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS united FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, shared::BIGINT AS shared, united::BIGINT AS united FROM p WHERE 5 * shared >= 2 * united""")
def near_dup_items(t):
    """All pairs of items with Jaccard of code-point 4-grams of 2/5 or more, exact by integers."""
    k = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    one = t("benchmark").select("item_id", k.alias("k")).groupBy("k").agg(F.min("item_id").alias("id"))
    return similarity.similar_pairs(one.select("id", keys.shingles(F.col("k"), 4).alias("t")), "id", "t", 2, 5)


@query("multi_key_components", f"""
WITH RECURSIVE k AS (SELECT doc_id, 'f' || sha256({MASKED}) AS x FROM documents UNION SELECT doc_id, 't' || {TITLE} FROM documents WHERE {TITLE} <> ''),
s AS (SELECT x, min(doc_id) AS m FROM k GROUP BY x), e AS (SELECT DISTINCT k.doc_id AS a, s.m AS b FROM k JOIN s USING (x)),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a)
SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a""")
def multi_key_components(t):
    """Documents of one family (canonical text with numbers and long runs masked), or with one title (their whole first line), hang together."""
    title = keys.plain_key(F.substring_index("text", "\n", 1))
    rows = t("documents").select("doc_id", F.xxhash64(keys.masked_key(F.col("text"))).alias("family"), F.nullif(title, F.lit("")).alias("title"))
    rows = materialize(rows.select("doc_id", "family", F.sha2("title", 256).alias("title")))
    return graph.multi_key_components(rows, "doc_id", ["family", "title"])


@query("family_table", f"""
SELECT sha256({MASKED}) AS family, count(*)::BIGINT AS members, array_to_string(list_sort(list(DISTINCT lang)), ',') AS lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS source
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def family_table(t):
    rows = t("documents").select("lang", "source", F.sha2(keys.masked_key(F.col("text")), 256).alias("family"))
    out = graph.families(rows, "family", ["lang", "source"]).where("members > 1")
    return out.withColumns({c: F.array_join(c, ",") for c in ("lang", "source")})


@query("component_split", f"""
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {MASKED}) AS c FROM documents)
SELECT {split_sql("c::VARCHAR", "comp")} AS split, count(*)::BIGINT AS n, count(DISTINCT c)::BIGINT AS components FROM f GROUP BY 1""")
def component_split(t):
    """Whole components go to one split."""
    rows = t("documents").select("doc_id", F.sha2(keys.masked_key(F.col("text")), 256).alias("family"))
    sizes = rows.groupBy("family").agg(F.min("doc_id").alias("c"), F.count(F.lit(1)).alias("n"))
    placed = sizes.withColumn("split", keys.split_of(F.col("c").cast("string"), "comp"))
    return placed.groupBy("split").agg(F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).alias("components"))


@query("scope_collisions", f"SELECT sha256({PLAIN}) AS key, array_to_string(list_sort(list(DISTINCT lang)), ',') AS scopes FROM documents GROUP BY {PLAIN} HAVING count(DISTINCT lang) > 1")
def scope_collisions(t):
    rows = keyed(t).withColumn("key", F.sha2("key", 256))
    return curate.collisions(rows, "key", "lang").withColumn("scopes", F.array_join("scopes", ","))


DIAG = [("EMPTY", "coalesce(text, '') = ''"), ("SHORT", "length(text) < 100"), ("LENGTH_MISMATCH", "length(text) <> n_chars"), ("LANG_UNKNOWN", "lang NOT IN ('en', 'fr', 'de')")]


@query("row_diagnostics", "SELECT code, doc_id FROM (SELECT code, doc_id, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, doc_id FROM documents WHERE {p}" for c, p in DIAG) + ")) WHERE r <= 5")
def row_diagnostics(t):
    return curate.diagnostics(t("documents"), "doc_id", [(c, F.expr(p)) for c, p in DIAG], 5)


@query("greedy_validation_pick", None)
def greedy_validation_pick(t):
    groups = t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return split.greedy_pick(groups, "lang", "source", "n", 0.15)


@query("family_reserve_split", f"""
WITH g AS (SELECT sha256({MASKED}) AS family, min(lang) AS lang, count(*)::BIGINT AS n FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {h60("'fam|' || lang || '|' || family")}, family) AS rank, count(*) OVER (PARTITION BY lang) AS size FROM g),
h AS (SELECT *, CASE WHEN size >= 30 THEN floor(size * 0.08::DOUBLE)::BIGINT ELSE 0 END AS held FROM r)
SELECT family, lang, n, CASE WHEN rank > size - held THEN 'reserve' WHEN size - held < 3 THEN 'train' WHEN rank <= greatest(1, (20 * (size - held) + 50) // 100) THEN 'test'
  WHEN rank <= greatest(1, (20 * (size - held) + 50) // 100) + greatest(1, (10 * (size - held) + 50) // 100) THEN 'val' ELSE 'train' END AS split FROM h""")
def family_reserve_split(t):
    rows = t("documents").select("lang", F.sha2(keys.masked_key(F.col("text")), 256).alias("family"))
    fam = rows.groupBy("family").agg(F.min("lang").alias("lang"), F.count(F.lit(1)).alias("n"))
    return split.assign_families(fam, "lang", "size", "fam").select("family", "lang", "n", "split")
