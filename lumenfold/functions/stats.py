"""Rates, intervals and tests as column expressions. An undefined ratio is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def ratio(n: Column, of: Column) -> Column:
    return F.try_divide(n.cast("double"), of.cast("double"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper 95 % bounds; (0, 1) of nothing."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    some = n > 0
    low = F.when(some, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0)
    return low, F.when(some, F.least(middle + half, F.lit(1.0))).otherwise(1.0)


def rule_of_three(errors: Column, n: Column) -> Column:
    """Upper bound when no error was seen in over three trials; else null."""
    return F.when((errors == 0) & (n > 3), 3.0 / n)


def log_factorial(n: Column) -> Column:
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long")))
    return F.aggregate(steps, F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts b and c; 1 when there are none."""
    n, least = (b + c).cast("long"), F.least(b, c).cast("long")
    terms = F.transform(
        F.sequence(F.lit(0).cast("long"), least),
        lambda k: F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0))),
    )
    tail = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0)))


def kappa(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Cohen's kappa of a 2x2 table; 1 when chance agreement is certain."""
    n = (both + first + second + neither).cast("double")
    seen = (both + neither) / n
    chance = ((both + first) * (both + second) + (neither + second) * (neither + first)) / (n * n)
    return F.when(chance == 1.0, 1.0).otherwise((seen - chance) / (1 - chance))


def confusion(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """The derived metrics of a confusion table; block is the positive class."""
    f = lambda b, t, x, y: ratio((1 + b * b) * t, (1 + b * b) * t + b * b * y + x)
    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, f1a = f(1, tp, fp, fn), f(1, tn, fn, fp)
    product = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision_block": ratio(tp, tp + fp),
        "recall_block": recall,
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "specificity": spec,
        "npv": ratio(tn, tn + fn),
        "f1_block": f1,
        "f2_block": f(2, tp, fp, fn),
        "f1_allow": f1a,
        "macro_f1": (f1 + f1a) / 2,
        "balanced_accuracy": (recall + spec) / 2,
        "mcc": F.try_divide((tp * tn - fp * fn).cast("double"), F.sqrt(product)),
    }
