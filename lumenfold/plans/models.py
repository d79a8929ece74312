"""Model probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.keys import split_of
from ..operators import evaluate, ml
from .registry import R, query


NUMERIC, CATEGORICAL = ["n_chars", "upper", "symbols", "lines"], ["lang"]


def structure(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return rows.select(
        "doc_id", "lang", F.col("toxic").cast("double").alias("y"), F.col("n_chars").cast("double").alias("n_chars"), text.share(F.regexp_count("text", F.lit("[A-Z]")), F.length("text")).alias("upper"),
        text.share(F.regexp_count("text", F.lit(text.PUNCTUATION)), F.length("text")).alias("symbols"), F.size(F.split("text", "\n")).cast("double").alias("lines"), split_of(F.col("doc_id").cast("string"), "ml").alias("split"),
    )


def train_and_rest(t):
    f = structure(t)
    return f.where("split = 'train'"), f.where("split <> 'train'")


def auc(scored):
    return evaluate.auc_ap(scored.withColumn("p", R("p")), F.col("y") == 1, "p")


@query("logreg_probe", None)
def logreg_probe(t):
    """How well structure alone gives the label away: logistic regression on counts, AUC on the test split."""
    train, rest = train_and_rest(t)
    return auc(ml.fit_score(train, rest, "logistic", NUMERIC, CATEGORICAL)).withColumn("verdict", F.when(F.col("auc") > 0.65, "block").when(F.col("auc") > 0.55, "warn").otherwise("ok"))


@query("model_families", None)
def model_families(t):
    """AUC and average precision of each family of models on the same split."""
    train, rest = train_and_rest(t)
    parts = [auc(ml.fit_score(train, rest, family, NUMERIC, CATEGORICAL)).select(F.lit(family).alias("family"), "*") for family in ml.FAMILIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("calibration_methods", None)
def calibration_methods(t):
    """Brier score, log loss and calibration errors of native, sigmoid and isotonic probabilities, out of fold."""
    train, rest = train_and_rest(t)
    rows = ml.fit_score(train, rest, "logistic", NUMERIC, CATEGORICAL)
    parts = [evaluate.calibration_errors(ml.calibrate(rows, m, F.col("doc_id")), F.col("y") == 1, F.col("calibrated")).select(F.lit(m).alias("method"), "*") for m in ("native", "sigmoid", "isotonic")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("permutation_importance", None)
def permutation_importance(t):
    """How much the AUC falls when one field's values are moved between rows."""
    train, rest = train_and_rest(t)
    found = ml.permutation_importance(ml.fit(train, "logistic", NUMERIC, CATEGORICAL), rest, [*NUMERIC, *CATEGORICAL], "doc_id", "imp", lambda d: auc(d).first()["auc"] or 0.0)
    return rest.sparkSession.createDataFrame([(f, round(x, 6)) for f, x in found], "field string, importance double")


@query("char_probe", None)
def char_probe(t):
    """How well characters alone give the label away: logistic regression on tf-idf of 3- to 5-grams of the language's name and source."""
    rows = t("documents").join(t("labels"), "doc_id").select(F.col("toxic").cast("double").alias("y"), F.concat_ws(" ", "lang", "source").alias("t"), split_of(F.col("doc_id").cast("string"), "ml").alias("split"))
    return auc(ml.char_tfidf_probe(rows.where("split = 'train'"), rows.where("split <> 'train'"), "t", 1000))
