"""Evaluation queries: rule predictors on labelled documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import kappa as kappa_of
from ..functions.stats import rule_of_three, wilson
from ..operators import evaluate as ev
from .registry import LABELLED, L, R, h60, query

# Two rule predictors of toxic, one of which is undefined on short texts, and a score.
RULE1 = "regexp_like(text, '(?i)idiot|moron|stupid|loser')"
RULE2 = "regexp_like(text, '(?i)trash|scum|clown|pathetic|loser')"
DUCK1, DUCK2 = (r.replace("regexp_like", "regexp_matches") for r in (RULE1, RULE2))
SCORE = "(length(text) % 97) / 97.0"
BASE = f"(SELECT doc_id, lang, source, n_chars, text, CASE WHEN toxic = 1 THEN 'BLOCK' ELSE 'ALLOW' END AS label, {DUCK1} AS r1, CASE WHEN length(text) >= 150 THEN {DUCK2} END AS r2, ((length(text) % 97)::DOUBLE / 97.0::DOUBLE) AS score FROM {LABELLED})"
CELL = "CASE WHEN label = 'BLOCK' AND d = 'BLOCK' THEN 'TP' WHEN label = 'BLOCK' THEN 'FN' WHEN label = 'ALLOW' AND d = 'ALLOW' THEN 'TN' WHEN label = 'ALLOW' THEN 'FP' END"
DECIDED = f"(SELECT *, {CELL} AS cell FROM (SELECT *, CASE WHEN r1 THEN 'BLOCK' ELSE 'ALLOW' END AS d FROM {BASE}))"


def base(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return rows.select(
        "doc_id", "lang", "source", "n_chars", F.when(F.col("toxic") == 1, "BLOCK").otherwise("ALLOW").alias("label"), F.expr(RULE1).alias("r1"),
        F.expr(f"case when length(text) >= 150 then {RULE2} end").alias("r2"), (F.length("text") % 97 / F.lit(97.0)).alias("score"),
    )


def decided(t):
    rows = base(t).withColumn("d", F.when(F.col("r1"), "BLOCK").otherwise("ALLOW"))
    return rows.withColumn("cell", ev.cell(F.col("label"), F.col("d")))


def div(a, b):
    return f"round(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) END, 6)"


COUNTS = ", ".join(f"count(*) FILTER (WHERE cell = '{c.upper()}')::BIGINT AS {c}" for c in ("tp", "fp", "tn", "fn"))
F1, F1A = "(CASE WHEN 2*tp+fp+fn <> 0 THEN (2*tp)::DOUBLE/(2*tp+fp+fn) END)", "(CASE WHEN 2*tn+fp+fn <> 0 THEN (2*tn)::DOUBLE/(2*tn+fp+fn) END)"
RC, SP = "(CASE WHEN tp+fn <> 0 THEN tp::DOUBLE/(tp+fn) END)", "(CASE WHEN tn+fp <> 0 THEN tn::DOUBLE/(tn+fp) END)"
DERIVED = ", ".join([
    f"{div('tp+tn', 'tp+tn+fp+fn')} AS accuracy", f"{div('tp', 'tp+fp')} AS precision_block", f"{div('tp', 'tp+fn')} AS recall_block", f"{div('fp', 'fp+tn')} AS fpr", f"{div('fn', 'fn+tp')} AS fnr",
    f"{div('tn', 'tn+fp')} AS specificity", f"{div('tn', 'tn+fn')} AS npv", f"round({F1}, 6) AS f1_block", f"{div('5*tp', '5*tp+4*fn+fp')} AS f2_block", f"round({F1A}, 6) AS f1_allow",
    f"round(({F1}+{F1A})/2, 6) AS macro_f1", f"round(({RC}+{SP})/2, 6) AS balanced_accuracy",
    "round(CASE WHEN (tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn) <> 0 THEN (tp*tn-fp*fn)::DOUBLE/sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc",
])


@query("confusion_metrics", f"SELECT lang, tp, fp, tn, fn, {DERIVED} FROM (SELECT lang, {COUNTS} FROM {DECIDED} GROUP BY lang)")
def confusion_metrics(t):
    return ev.metrics(decided(t), F.col("cell"), ["lang"])


VIEW = CELL.replace("label", "label")


@query("confusion_three_views", f"""
WITH b AS (SELECT label, CASE WHEN r2 THEN 'BLOCK' WHEN NOT r2 THEN 'ALLOW' END AS p FROM {BASE}),
v AS (SELECT 'principal' AS view, label, coalesce(p, 'INVALID') AS d FROM b UNION ALL SELECT 'parseable_only', label, p FROM b WHERE p IS NOT NULL UNION ALL SELECT 'runtime', label, coalesce(p, 'BLOCK') FROM b)
SELECT view, tp, fp, tn, fn, {DERIVED} FROM (SELECT view, {COUNTS} FROM (SELECT *, {CELL} AS cell FROM v) GROUP BY view)""")
def confusion_three_views(t):
    rows = base(t).withColumn("valid", F.col("r2").isNotNull()).withColumn("p", F.when(F.col("r2"), "BLOCK").otherwise("ALLOW"))
    return ev.three_views(rows, "label", "p", "valid")


SLICED = ", ".join(f"{div(a, b)} AS {n}" for n, a, b in (("precision_block", "tp", "tp+fp"), ("recall_block", "tp", "tp+fn"), ("fpr", "fp", "fp+tn"), ("f1_block", "2*tp", "2*tp+fp+fn")))


@query("slice_metrics", f"SELECT field, value, tp, fp, tn, fn, {SLICED} FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, coalesce({x}, 'unknown') AS value, {COUNTS} FROM {DECIDED} GROUP BY 2" for f, x in (("lang", "lang"), ("source", "source"), ("length_bin", "(least(n_chars // 1000, 9))::VARCHAR"))) + ")")
def slice_metrics(t):
    rows = decided(t).withColumn("length_bin", F.least(F.expr("n_chars div 1000"), F.lit(9)))
    return ev.slices(rows, F.col("cell"), ["lang", "source", "length_bin"])


PAIRED = f"SELECT lang, count(*) FILTER (WHERE r1 AND r2)::BIGINT AS both, count(*) FILTER (WHERE r1 AND NOT r2)::BIGINT AS first_only, count(*) FILTER (WHERE NOT r1 AND r2)::BIGINT AS second_only, count(*) FILTER (WHERE NOT r1 AND NOT r2)::BIGINT AS neither, count(*) FILTER (WHERE r1 IS NULL OR r2 IS NULL)::BIGINT AS invalid FROM {BASE} GROUP BY lang"
MCN = "CASE WHEN first_only + second_only = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(first_only, second_only) + 1), lambda k: exp(lgamma(first_only + second_only + 1) - lgamma(k + 1) - lgamma(first_only + second_only - k + 1) - (first_only + second_only) * ln(2))))) END"


@query("mcnemar_exact", f"SELECT *, round({MCN}, 6) AS p_value FROM ({PAIRED})")
def mcnemar_exact(t):
    return ev.paired(base(t), F.col("r1"), F.col("r2"), ["lang"])


@query("paired_outcomes", f"""
SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN r1 IS NULL OR r2 IS NULL THEN 'invalid' WHEN r1 = (label = 'BLOCK') AND r2 = (label = 'BLOCK') THEN 'both_right' WHEN r1 = (label = 'BLOCK') THEN 'first_right' WHEN r2 = (label = 'BLOCK') THEN 'second_right' ELSE 'both_wrong' END AS outcome FROM {BASE}) GROUP BY outcome""")
def paired_outcomes(t):
    y = F.col("label") == "BLOCK"
    a, b = F.col("r1") == y, F.col("r2") == y
    kind = F.when(F.col("r1").isNull() | F.col("r2").isNull(), "invalid").when(a & b, "both_right").when(a, "first_right").when(b, "second_right").otherwise("both_wrong")
    return base(t).groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("holm_adjust", f"""
WITH p AS (SELECT lang, round({MCN}, 6) AS p_value FROM ({PAIRED})), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, lang) AS k FROM p)
SELECT lang, p_value, round(max(least(1.0::DOUBLE, (m - k + 1) * p_value)) OVER (ORDER BY p_value, lang ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm_adjust(t):
    return ev.holm(ev.paired(base(t), F.col("r1"), F.col("r2"), ["lang"]).select("lang", "p_value"), "lang", "p_value")


@query("auc_ap", f"""
WITH s AS (SELECT score, count(*) FILTER (WHERE label = 'BLOCK') AS p, count(*) FILTER (WHERE label <> 'BLOCK') AS n FROM {BASE} GROUP BY score),
c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM s)
SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round((sum(n * (cp - p) + 0.5 * p * n))::DOUBLE / (sum(p)::DOUBLE * sum(n)), 6) AS auc, round(sum(p * (cp::DOUBLE / (cp + cn))) / sum(p), 6) AS average_precision FROM c""")
def auc_ap(t):
    return ev.auc_ap(base(t), F.col("label") == "BLOCK", "score")


BINNED = f"(SELECT least(floor(score * 10), 9)::BIGINT AS bin, score AS p, (label = 'BLOCK')::INT AS y FROM {BASE})"


@query("calibration_bins", f"SELECT bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(abs(avg(p) - avg(y)), 6) AS gap FROM {BINNED} GROUP BY bin")
def calibration_bins(t):
    return ev.calibration(base(t), F.col("label") == "BLOCK", F.col("score"))


@query("calibration_errors", f"""
WITH g AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS g, sum((p - y) * (p - y)) AS s, sum(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS l FROM {BINNED} GROUP BY bin)
SELECT sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(g * n) / sum(n), 6) AS ece, round(max(g), 6) AS mce FROM g""")
def calibration_errors(t):
    return ev.calibration_errors(base(t), F.col("label") == "BLOCK", F.col("score"))


GRID = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("threshold_grid", f"""
WITH g AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE label = 'BLOCK' AND score >= threshold)::BIGINT AS tp, count(*) FILTER (WHERE label <> 'BLOCK' AND score >= threshold)::BIGINT AS fp,
  count(*) FILTER (WHERE label <> 'BLOCK' AND score < threshold)::BIGINT AS tn, count(*) FILTER (WHERE label = 'BLOCK' AND score < threshold)::BIGINT AS fn FROM {BASE}, g GROUP BY threshold)
SELECT *, {div('tp', 'tp+fn')} AS recall, {div('fp', 'fp+tn')} AS fpr FROM c""")
def threshold_grid(t):
    return ev.threshold_grid(base(t), F.col("label") == "BLOCK", F.col("score"), GRID)


Z = "1.959963984540054::DOUBLE"
W = f"(k::DOUBLE / n + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n)"
HALF = f"{Z} * sqrt((k::DOUBLE/n)*(1-k::DOUBLE/n)/n + {Z}*{Z}/(4*n::DOUBLE*n)) / (1 + {Z}*{Z}/n)"


@query("wilson_by_slice", f"""
SELECT lang, source, k, n, round(greatest({W} - {HALF}, 0), 6) AS low, round(least({W} + {HALF}, 1), 6) AS high, round(CASE WHEN k = 0 AND n > 3 THEN 3.0 / n END, 6) AS rule_of_three
FROM (SELECT lang, source, count(*) FILTER (WHERE label = 'BLOCK')::BIGINT AS k, count(*)::BIGINT AS n FROM {BASE} GROUP BY lang, source)""")
def wilson_by_slice(t):
    c = base(t).groupBy("lang", "source").agg(F.count_if(F.col("label") == "BLOCK").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("*", R(low).alias("low"), R(high).alias("high"), R(rule_of_three(F.col("k"), F.col("n"))).alias("rule_of_three"))


@query("kappa", f"""
WITH c AS (SELECT lang, "both"::DOUBLE AS a, first_only::DOUBLE AS b, second_only::DOUBLE AS c, neither::DOUBLE AS d FROM ({PAIRED})),
e AS (SELECT lang, (a + d) / (a+b+c+d) AS po, ((a+b)*(a+c) + (d+c)*(d+b)) / ((a+b+c+d)*(a+b+c+d)) AS pe FROM c)
SELECT lang, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e""")
def kappa(t):
    p = ev.paired(base(t), F.col("r1"), F.col("r2"), ["lang"])
    return p.select("lang", R(kappa_of(*[F.col(c) for c in ("both", "first_only", "second_only", "neither")])).alias("kappa"))


@query("cluster_bootstrap_ci", f"""
WITH s AS (SELECT source, sum((label = 'BLOCK')::INT)::BIGINT AS k, count(*)::BIGINT AS n FROM {BASE} GROUP BY source),
i AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, k, n FROM s), m AS (SELECT count(*) AS m FROM s),
d AS (SELECT a.range AS rep, b.range AS d FROM range(200) a, range((SELECT m FROM m)) b),
r AS (SELECT rep, sum(k)::DOUBLE / sum(n) AS rate FROM d JOIN i ON i.i = {h60("'boot|' || d.rep::VARCHAR || '|' || d.d::VARCHAR")} % (SELECT m FROM m) GROUP BY rep)
SELECT (SELECT m FROM m)::BIGINT AS clusters, count(*)::BIGINT AS reps, round(quantile_disc(rate, 0.025), 6) AS low, round(quantile_disc(rate, 0.5), 6) AS median, round(quantile_disc(rate, 0.975), 6) AS high FROM r""")
def cluster_bootstrap_ci(t):
    return ev.cluster_bootstrap(base(t), "source", F.col("label") == "BLOCK", 200, "boot")


@query("error_concentration", f"""
WITH e AS (SELECT source, count(*) AS n FROM {DECIDED} WHERE cell IN ('FP', 'FN') GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM e)
SELECT sum(n)::BIGINT AS errors, count(*)::BIGINT AS groups, round(sum(n) FILTER (WHERE k <= 2)::DOUBLE / sum(n), 6) AS top2_share FROM r""")
def error_concentration(t):
    e = decided(t).where(F.col("cell").isin("FP", "FN")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    r = e.withColumn("k", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "source")))
    return r.agg(L(F.sum("n")).alias("errors"), F.count(F.lit(1)).alias("groups"), R(F.sum(F.when(F.col("k") <= 2, F.col("n"))) / F.sum("n")).alias("top2_share"))


@query("multiclass_report", f"""
WITH r AS (SELECT label, (vec_id * 7 + label) % 3 AS p0, label % 3 AS y FROM embeddings), x AS (SELECT y, CASE WHEN p0 = 0 THEN y ELSE p0 END AS p FROM r),
k AS (SELECT DISTINCT y AS c FROM x UNION SELECT DISTINCT p FROM x),
j AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) AS support, (SELECT count(*) FROM x WHERE p = c) AS predicted, (SELECT count(*) FROM x WHERE y = c AND p = c) AS tp FROM k)
SELECT c::BIGINT AS class, support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp, coalesce({div('tp', 'predicted')}, 0) AS precision, coalesce({div('tp', 'support')}, 0) AS recall, coalesce({div('2*tp', 'predicted+support')}, 0) AS f1 FROM j""")
def multiclass_report(t):
    e = t("embeddings").select((L("label") % 3).alias("y"), ((F.col("vec_id") * 7 + F.col("label")) % 3).alias("p0"))
    return ev.multiclass(e.withColumn("p", F.when(F.col("p0") == 0, F.col("y")).otherwise(F.col("p0"))), "y", "p")


@query("group_weighted_metrics", f"""
WITH w AS (SELECT cell, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS w FROM {DECIDED})
SELECT round(sum(w), 6) AS weight, round(sum(w) FILTER (WHERE cell IN ('TP', 'TN')) / sum(w), 6) AS accuracy, round(sum(w) FILTER (WHERE cell = 'TP') / sum(w) FILTER (WHERE cell IN ('TP', 'FN')), 6) AS recall FROM w""")
def group_weighted_metrics(t):
    """Each source weighs 1: rows are summed by source first, so no window holds a source."""
    c = F.col("cell")
    g = decided(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isin("TP", "TN")).alias("ok"), F.count_if(c == "TP").alias("tp"), F.count_if(c.isin("TP", "FN")).alias("pos"))
    s = lambda x: F.sum(F.col(x) / F.col("n"))
    return g.agg(R(F.count(F.lit(1))).alias("weight"), R(s("ok") / F.count(F.lit(1))).alias("accuracy"), R(F.try_divide(s("tp"), s("pos"))).alias("recall"))


@query("suppressed_bins", f"""
WITH b AS (SELECT lang || '/' || label || '/' || least(n_chars // 1000, 9) AS bin, count(*)::BIGINT AS n FROM {BASE} GROUP BY 1),
w AS (SELECT *, sum(CASE WHEN n < 10 THEN n ELSE 0 END) OVER () AS small, coalesce(sum(n) OVER (ORDER BY n, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT bin, CASE WHEN NOT (n < 10 OR (small > 0 AND before < 10)) THEN n END AS n, (n < 10 OR (small > 0 AND before < 10)) AS hidden FROM w""")
def suppressed_bins(t):
    b = base(t).groupBy(F.concat_ws("/", "lang", "label", F.least(F.expr("n_chars div 1000"), F.lit(9)).cast("string")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return ev.suppress(b, "bin", "n", 10)


@query("prediction_problems", f"""
WITH c AS (SELECT doc_id, sha256(text) AS d FROM {LABELLED}), p AS (SELECT doc_id, sha256(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id % 91 = 0),
g AS (SELECT doc_id, count(*) AS n, min(d) AS d FROM p GROUP BY doc_id), j AS (SELECT coalesce(c.doc_id, g.doc_id) AS doc_id, c.doc_id IS NOT NULL AS i, c.d AS cd, g.n, g.d FROM c FULL JOIN g ON c.doc_id = g.doc_id)
SELECT * FROM (SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN NOT i THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN cd IS DISTINCT FROM d THEN 'changed' END AS problem FROM j) WHERE problem IS NOT NULL""")
def prediction_problems(t):
    """Violations of the 1:1, hash-checked join of cases with (deliberately broken) predictions."""
    docs = t("documents")
    cases = docs.join(t("labels"), "doc_id").select("doc_id", F.sha2("text", 256).alias("d"))
    changed = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    p = docs.where("doc_id % 7 <> 3").select("doc_id", F.sha2(changed, 256).alias("d")).unionByName(docs.where("doc_id % 91 = 0").select("doc_id", F.sha2("text", 256).alias("d")))
    return ev.prediction_problems(cases, p, "doc_id", "d")
