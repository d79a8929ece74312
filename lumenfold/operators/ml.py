"""Models on extracted features, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, StandardScaler, StringIndexer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash60

FAMILIES = {
    "logistic": lambda: LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01, maxIter=50),
    "forest": lambda: RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=30, maxDepth=6, seed=7),
    "boosted": lambda: GBTClassifier(featuresCol="features", labelCol="y", maxIter=15, maxDepth=4, seed=7),
}


def encoder(numeric: list[str], categorical: list[str]) -> list:
    """Stages: indexed and one-hot levels of the training rows, unseen ones kept apart; scaled numbers."""
    stages = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v")]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"_{c}_v" for c in categorical]], outputCol="_raw", handleInvalid="keep"))
    return [*stages, StandardScaler(inputCol="_raw", outputCol="features", withMean=False)]


def fit(train: DataFrame, family: str, numeric: list[str], categorical: list[str]):
    """A model of the family, with its encoder, fitted on train's y."""
    return Pipeline(stages=[*encoder(numeric, categorical), FAMILIES[family]()]).fit(train)


def scored(model, rows: DataFrame) -> DataFrame:
    """rows with p, the model's probability of y = 1."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def fit_score(train: DataFrame, rows: DataFrame, family: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """rows with p, the probability of y = 1 under a model of the family."""
    return scored(fit(train, family, numeric, categorical), rows)


def char_tfidf_probe(train: DataFrame, rows: DataFrame, text: str, vocabulary: int = 4096) -> DataFrame:
    """rows with p: logistic regression on tf-idf of character 3- to 5-grams, the vocabulary bounded."""
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("_t"), i, n))
    cut = lambda d: d.withColumn("_t", F.lower(text)).withColumn("_g", F.concat(grams(3), grams(4), grams(5)))
    stages = [CountVectorizer(inputCol="_g", outputCol="_c", vocabSize=vocabulary, minDF=3), IDF(inputCol="_c", outputCol="features"), FAMILIES["logistic"]()]
    out = Pipeline(stages=stages).fit(cut(train)).transform(cut(rows))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def fold(group: Column, folds: int, salt: str) -> Column:
    """Fold of a whole group, by hash."""
    return (hash60(F.concat(F.lit(salt + "|"), group.cast("string"))) % folds).cast("int")


def calibrator(rows: DataFrame, method: str):
    """What turns rows with p into rows with calibrated, fitted on rows (p, y): native (p itself), sigmoid (logistic on p) or isotonic."""
    if method == "native":
        return lambda d: d.withColumn("calibrated", F.col("p"))
    if method == "isotonic":
        fitted = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(rows.withColumn("y", F.col("y").cast("double")))
        return fitted.transform
    put = VectorAssembler(inputCols=["p"], outputCol="_p").transform
    fitted = LogisticRegression(featuresCol="_p", labelCol="y").fit(put(rows))
    return lambda d: fitted.transform(put(d)).select(*d.columns, vector_to_array("probability")[1].alias("calibrated"))


def calibrate(rows: DataFrame, method: str, group: Column, folds: int = 5, salt: str = "cal") -> DataFrame:
    """rows (p, y) with calibrated, out of fold: each fold of whole groups is calibrated by what the other folds taught, so that no row judges itself. A fold whose
    others hold one label only keeps p."""
    placed = rows.withColumn("_fold", fold(group, folds, salt))
    parts = []
    for k in range(folds):
        own, others = placed.where(F.col("_fold") == k).drop("_fold"), placed.where(F.col("_fold") != k).drop("_fold")
        both = others.select("y").distinct().limit(2).count() == 2
        parts.append(calibrator(others, method if both else "native")(own))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def permuted(rows: DataFrame, column: str, row_id: str, salt: str) -> DataFrame:
    """rows with one column's values moved between rows, by two hash orders joined on place. Places come from prefix sums over buckets: no window holds all rows."""
    from .split import bucket_rank

    def ranked(d, s):
        h = hash60(F.concat(F.lit(s), F.col(row_id).cast("string")))
        return bucket_rank(d.withColumn("_h", h), [], "_h", [row_id]).drop("_h", "size").withColumnRenamed("rank", "_k")

    values = ranked(rows.select(row_id, F.col(column).alias("_v")), salt + "v|").select("_k", "_v")
    return ranked(rows, salt + "r|").join(values, "_k").withColumn(column, F.col("_v")).select(*rows.columns)


def permutation_importance(model, rows: DataFrame, fields: list[str], row_id: str, salt: str, metric) -> list[tuple[str, float]]:
    """(field, how much metric(rows with p) falls when the field's values are moved between rows), under one fitted model."""
    base = metric(scored(model, rows))
    return [(f, base - metric(scored(model, permuted(rows, f, row_id, f"{salt}|{f}|")))) for f in fields]


def logistic_score(features: dict[str, float], scales: dict[str, float], bias: float) -> Column:
    """1 / (1 + exp(-(sum x / scale * coefficient + bias))) from portable coefficients."""
    z = F.lit(bias)
    for name, w in sorted(features.items()):
        z = z + F.col(name) / scales[name] * w
    return 1 / (1 + F.exp(-z))


def winner(candidates: DataFrame) -> DataFrame:
    """Of candidates (name, score, low, cost): those whose interval of difference to the best holds 0 (low <= 0) tie; the cheapest, then the first by name, wins."""
    return candidates.where("low <= 0").agg(F.min_by("name", F.struct("cost", -F.col("score"), "name")).alias("winner"), F.array_sort(F.collect_list("name")).alias("tied"))
