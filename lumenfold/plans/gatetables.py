"""Gate tables: label invariants, split gates, the integrity gate and the freeze precheck, over labelled documents with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import gates, split
from .registry import LABELLED, PLAIN, h60, query, split_sql
from .trials import pick, pick_sql

STATUSES, EXCLUSIONS, POLICIES, REASONS = ["VERIFIED", "POLICY_DEFINED", "EXCLUDED"], ["AMBIGUOUS", "OUT_OF_SCOPE"], ["POL-A", "POL-B"], ["sql", "xss"]
#: Metadata columns: (name, expression, values by its value). What can't go together is what the invariants find.
META = [
    ("label", "doc_id", ["BLOCK", "ALLOW", "BLOCK", None]), ("label_status", "doc_id div 3", ["VERIFIED", "POLICY_DEFINED", "EXCLUDED", "ODD", None]), ("exclusion_reason", "doc_id div 5", [None, "AMBIGUOUS", "STRANGE", None]),
    ("policy_id", "doc_id div 7", [None, "POL-A", "POL-X"]), ("attack_category", "doc_id div 2", ["SQL", None, "XSS", ""]), ("payload_family_id", "doc_id div 11", ["f1", None, "f2"]), ("payload_record_id", "doc_id div 13", [None, "r1"]),
    ("reason_string", "doc_id div 17", ["sql", "xss", "odd"]), ("output", "doc_id div 19", ["BLOCK | sql", "ALLOW", "BLOCK | xss", None]),
]
META_SQL = "(SELECT doc_id, lang, " + ", ".join(f"{pick_sql(i.replace('div', '//'), v)} AS {n}" for n, i, v in META) + " FROM documents)"


def meta(t):
    return t("documents").select("doc_id", "lang", *[pick(i, v).alias(n) for n, i, v in META])


def one_of(c, names):
    return f"coalesce({c} IN ({', '.join(repr(n) for n in names)}), false)"


BROKEN = {
    "M-1": [f"NOT {one_of('label_status', STATUSES)}", "label IS NULL AND label_status IS DISTINCT FROM 'EXCLUDED'"],
    "M-2": [f"((exclusion_reason IS NOT NULL) <> (label_status IS NOT DISTINCT FROM 'EXCLUDED')) OR (exclusion_reason IS NOT NULL AND NOT {one_of('exclusion_reason', EXCLUSIONS)})"],
    "M-3": [f"((policy_id IS NOT NULL) <> (label_status IS NOT DISTINCT FROM 'POLICY_DEFINED')) OR (policy_id IS NOT NULL AND NOT {one_of('policy_id', POLICIES)})"],
    "M-4": ["label_status IS NOT DISTINCT FROM 'EXCLUDED'"],
    "M-5": ["label = 'BLOCK' AND (coalesce(attack_category, '') = '' OR coalesce(payload_family_id, '') = '')", "label = 'ALLOW' AND payload_family_id IS NOT NULL"],
    "M-6": ["label = 'ALLOW' AND payload_record_id IS NOT NULL"],
    "M-7": [f"label = 'BLOCK' AND (output IS DISTINCT FROM 'BLOCK | ' || reason_string OR NOT {one_of('reason_string', REASONS)})", "label = 'ALLOW' AND output IS DISTINCT FROM 'ALLOW'"],
}
SLICE_M4 = f"label_status IS DISTINCT FROM 'EXCLUDED' OR NOT {one_of('exclusion_reason', ['AMBIGUOUS'])}"


def gate_sql(name, predicates, scope="rows", table=META_SQL):
    n = "(" + " + ".join(f"count(*) FILTER (WHERE {p})" for p in predicates) + ")"
    return f"SELECT '{name}' AS \"check\", '{scope}' AS scope, {n} = 0 AS ok, {n}::BIGINT AS violations FROM {table}"


@query("label_invariants", " UNION ALL ".join([gate_sql(n, p) for n, p in BROKEN.items()] + [gate_sql("M-4", [SLICE_M4], "slice")]))
def label_invariants(t):
    """M-1 to M-7 of rows of a split, and M-4 of the same rows taken as a slice."""
    rows = meta(t)
    own = gates.gate_rows(rows, gates.label_invariants(STATUSES, EXCLUSIONS, POLICIES, REASONS, "ALLOW"))
    slices = [c for c in gates.label_invariants(STATUSES, EXCLUSIONS, POLICIES, REASONS, "ALLOW", ["AMBIGUOUS"]) if c[0] == "M-4"]
    return own.unionByName(gates.gate_rows(rows, slices).withColumn("scope", F.lit("slice"))).drop("detail")


SIX = ["lang", "attack_category", "label", "label_status", "exclusion_reason", "policy_id"]


@query("label_census_m9", f"SELECT {', '.join(f'coalesce({k}, ' + repr('—') + f') AS {k}' for k in SIX)}, count(*)::BIGINT AS rows FROM {META_SQL} GROUP BY ALL")
def label_census_m9(t):
    """M-9: rows by split (here: language), category, label, status, exclusion and policy."""
    return gates.label_census(meta(t), SIX)


BY_ID = split_sql("doc_id::VARCHAR", "id")


@query("identity_overlaps", f"""
WITH s AS (SELECT source, lang, string_split(source || ',' || lang || ',' || (doc_id % 40), ',') AS tags, {BY_ID} AS split FROM documents),
k AS (SELECT 'source' AS scope, source AS k, split FROM s UNION ALL SELECT 'lang', lang, split FROM s UNION ALL SELECT 'tags', unnest(tags), split FROM s), g AS (SELECT scope, k, count(DISTINCT split) > 1 AS x FROM k WHERE k IS NOT NULL GROUP BY scope, k)
SELECT 'disjoint' AS "check", scope, count(*) FILTER (WHERE x) = 0 AS ok, count(*) FILTER (WHERE x)::BIGINT AS violations FROM g GROUP BY scope""")
def identity_overlaps(t):
    """Identities, list-valued ones too, that are in more than one split, when rows are split by id."""
    rows = t("documents").select("source", "lang", F.split(F.concat_ws(",", "source", "lang", (F.col("doc_id") % 40).cast("string")), ",").alias("tags"), keys.split_of(F.col("doc_id").cast("string"), "id").alias("split"))
    return gates.identity_overlaps(rows, ["source", "lang", "tags"], "split").drop("detail")


FAM = "regexp_replace(" + PLAIN + ", '[0-9]+', '0', 'g')"


@query("split_gates", f"""
WITH d AS (SELECT doc_id, lang, text, {PLAIN} AS key, {BY_ID} AS split, {split_sql("lang || '|' || (doc_id % 5)", "fam")} AS own FROM documents),
e AS (SELECT text AS k, count(DISTINCT split) > 1 AS x FROM d GROUP BY text), c AS (SELECT key, count(DISTINCT split) > 1 AS x FROM d GROUP BY key),
f AS (SELECT lang, doc_id % 5 AS f, min(own) AS split FROM d GROUP BY ALL), v AS (SELECT lang, count(*) FILTER (WHERE split <> 'val') AS n, count(*) FILTER (WHERE split = 'test') AS t FROM f GROUP BY lang)
SELECT 'SPL-1' AS "check", 'assignment' AS scope, true AS ok, 0::BIGINT AS violations
UNION ALL SELECT 'SPL-3', 'family', count(*) FILTER (WHERE x) = 0, count(*) FILTER (WHERE x)::BIGINT FROM (SELECT lang, doc_id % 5, count(DISTINCT split) > 1 AS x FROM d GROUP BY lang, doc_id % 5)
UNION ALL SELECT 'SPL-4', 'rows', count(*) FILTER (WHERE split <> own) = 0, count(*) FILTER (WHERE split <> own)::BIGINT FROM d
UNION ALL SELECT 'SPL-6', 'exact', count(*) FILTER (WHERE x) = 0, count(*) FILTER (WHERE x)::BIGINT FROM e UNION ALL SELECT 'SPL-6', 'canonical', count(*) FILTER (WHERE x) = 0, count(*) FILTER (WHERE x)::BIGINT FROM c
UNION ALL SELECT 'SPL-7', 'rows', count(*) = 0, count(*)::BIGINT FROM d WHERE own = 'val' AND split <> 'val'
UNION ALL SELECT 'SPL-8', 'category', count(*) FILTER (WHERE NOT (n >= 3 AND t >= 1)) = 0, count(*) FILTER (WHERE NOT (n >= 3 AND t >= 1))::BIGINT FROM v""")
def split_gates(t):
    """Gates of a split by id, held against the split that whole families (language, id modulo 5) should have; 'val' stands for the reserve. SPL-1: the
    assignment's digest doesn't depend on the order or partitioning of rows. SPL-3: families in one split. SPL-4: rows are where their family is. SPL-6: equal
    and canonically equal texts don't span splits. SPL-7: no row of a reserved family elsewhere. SPL-8: categories that can be evaluated."""
    d = t("documents").select("doc_id", "lang", "text", keys.plain_key(F.col("text")).alias("key"), keys.split_of(F.col("doc_id").cast("string"), "id").alias("split"), F.concat_ws("|", "lang", (F.col("doc_id") % 5).cast("string")).alias("family"))
    d = d.withColumn("own", keys.split_of(F.col("family"), "fam"))
    one, two = (gates.digest(x, F.concat_ws("|", F.col("doc_id").cast("string"), "split"), "a") for x in (d, d.repartition(7, "text").sortWithinPartitions("key")))
    same = one.join(two.select("name", F.col("digest").alias("other")), "name").select(F.lit("SPL-1").alias("check"), F.lit("assignment").alias("scope"), (F.col("digest") == F.col("other")).alias("ok"), (F.col("digest") != F.col("other")).cast("long").alias("violations"))
    rows = gates.gate_rows(d, [("SPL-4", [F.col("split") != F.col("own")], ""), ("SPL-7", [(F.col("own") == "val") & (F.col("split") != "val")], "")])
    flags = gates.evaluability(d, "lang", "family", "own", "test", "val", 3, 1).agg(F.count_if(F.col("flag") != "EVALUABLE").alias("violations"))
    flags = flags.select(F.lit("SPL-8").alias("check"), F.lit("category").alias("scope"), (F.col("violations") == 0).alias("ok"), "violations")
    spans = [gates.spanning(d, F.col(c), "split", n, s) for n, c, s in (("SPL-3", "family", "family"), ("SPL-6", "text", "exact"), ("SPL-6", "key", "canonical"))]
    return gates.tables_of([same, *[x.drop("detail") for x in (rows, *spans)], flags])


INTEGRITY = f"""
WITH r AS (SELECT text, lang, source, toxic, {split_sql("d.doc_id::VARCHAR", "id")} AS split FROM documents d JOIN labels l USING (doc_id)),
h AS (SELECT text, split, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT 'lang' AS f, lang AS v, toxic FROM r UNION ALL SELECT 'source', source, toxic FROM r),
c AS (SELECT f, v, count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM x GROUP BY ALL), s AS (SELECT f, sum(n0 + n1) AS n, sum(greatest(n0, n1)) AS m, greatest(sum(n0), sum(n1)) AS b FROM c GROUP BY f),
z AS (SELECT max(n) AS hi, min(n) AS lo, sum(n) AS al FROM (SELECT lang, count(*) AS n FROM r GROUP BY lang)),
e AS (SELECT 'duplicates' AS "check", split AS scope, (sum(n) - count(*))::DOUBLE / sum(n) AS value FROM h GROUP BY split
UNION ALL SELECT 'leakage', split, (coalesce(sum(n) FILTER (WHERE text IN (SELECT text FROM h WHERE split = 'train')), 0))::DOUBLE / sum(n) FROM h WHERE split <> 'train' GROUP BY split
UNION ALL SELECT 'shortcut_accuracy', f, m::DOUBLE / n FROM s UNION ALL SELECT 'shortcut_margin', f, (m - b)::DOUBLE / n FROM s
UNION ALL SELECT 'purity', f, max(greatest(n0, n1)::DOUBLE / (n0 + n1)) FROM c JOIN s USING (f) WHERE (n0 + n1) * 100 >= s.n GROUP BY f
UNION ALL SELECT 'category_ratio', 'lang', hi::DOUBLE / lo FROM z UNION ALL SELECT 'category_share', 'lang', lo::DOUBLE / al FROM z)
SELECT "check", scope, round(value, 6) AS value, CASE "check" WHEN 'duplicates' THEN CASE WHEN value > 0.1 THEN 'WARN' ELSE 'PASS' END WHEN 'leakage' THEN CASE WHEN value >= 0.01 THEN 'FAIL' WHEN value > 0 THEN 'WARN' ELSE 'PASS' END
  WHEN 'shortcut_accuracy' THEN CASE WHEN value >= 0.8 THEN 'FAIL' WHEN value >= 0.65 THEN 'WARN' ELSE 'PASS' END WHEN 'shortcut_margin' THEN CASE WHEN value >= 0.2 THEN 'FAIL' WHEN value >= 0.1 THEN 'WARN' ELSE 'PASS' END
  WHEN 'purity' THEN CASE WHEN value >= 0.99 THEN 'FAIL' ELSE 'PASS' END WHEN 'category_ratio' THEN CASE WHEN value > 100 THEN 'WARN' ELSE 'PASS' END ELSE CASE WHEN value < 0.001 THEN 'WARN' ELSE 'PASS' END END AS status FROM e"""


@query("integrity_gate", INTEGRITY)
def integrity_gate(t):
    """Duplicates, leakage, shortcuts, purity and balance of the labelled documents, graded by fixed thresholds."""
    rows = t("documents").join(t("labels"), "doc_id").withColumn("split", keys.split_of(F.col("doc_id").cast("string"), "id"))
    return gates.integrity_gate(rows, "text", "split", "train", "toxic", ["lang", "source"], "lang")


@query("freeze_precheck", f"""
WITH r AS (SELECT *, {split_sql("doc_id::VARCHAR", "id")} AS split FROM {LABELLED}), n AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE doc_id % 90 <> 0) AS m, count(*) FILTER (WHERE quality = 1) AS b FROM r GROUP BY split),
c AS (SELECT lang, max(n) AS hi, sum(n) AS al FROM (SELECT lang, source, count(*) AS n FROM r GROUP BY ALL) GROUP BY lang), o AS (SELECT lang, count(*) FILTER (WHERE n_chars > 5000) AS o, count(*) AS al FROM r GROUP BY lang)
SELECT 'artifact_hashes' AS "check", 'artifacts' AS scope, false AS ok, 1::BIGINT AS violations UNION ALL SELECT 'row_meta_alignment', 'splits', count(*) FILTER (WHERE n <> m) = 0, count(*) FILTER (WHERE n <> m)::BIGINT FROM n
UNION ALL SELECT 'split_row_counts', 'splits', count(*) FILTER (WHERE split = 'val') = 0, count(*) FILTER (WHERE split = 'val')::BIGINT FROM n UNION ALL SELECT 'source_file_cap', 'categories', count(*) FILTER (WHERE 4 * hi > 3 * al) = 0, count(*) FILTER (WHERE 4 * hi > 3 * al)::BIGINT FROM c
UNION ALL SELECT 'over_limit', 'categories', count(*) FILTER (WHERE 100 * o > al) = 0, count(*) FILTER (WHERE 100 * o > al)::BIGINT FROM o
UNION ALL SELECT 'class_balance', 'splits', count(*) FILTER (WHERE 100 * b < 48 * n OR 100 * b > 52 * n) = 0, count(*) FILTER (WHERE 100 * b < 48 * n OR 100 * b > 52 * n)::BIGINT FROM n""")
def freeze_precheck(t):
    """What must hold before labelled documents are frozen; one artifact, some metadata and one count are planted faults."""
    rows = t("documents").join(t("labels"), "doc_id").withColumn("split", keys.split_of(F.col("doc_id").cast("string"), "id"))
    listed = t("region").sparkSession.createDataFrame([("a", "ok"), ("b", "sha_mismatch")], "name string, status string")
    expected = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", (F.col("n") + (F.col("split") == "val").cast("int")).alias("n"))
    found = gates.freeze_precheck(listed, rows, rows.where("doc_id % 90 <> 0"), expected, "split", "lang", "source", F.col("n_chars") > 5000, F.col("quality") == 1)
    return found.drop("detail")
