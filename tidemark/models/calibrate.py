"""Calibration of probabilities: isotonic, and one class against the rest."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models import glm


def isotonic(rows: DataFrame, score: str, target: str) -> DataFrame:
    """``rows`` with ``calibrated``: the least-squares non-decreasing function of ``score`` fitted to ``target``. Rows of
    equal scores are one weighted point before pools of adjacent violators are merged."""
    points = rows.filter(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(score).cast("double").alias("__s")).agg(F.avg(target).alias("label"), F.count("*").cast("double").alias("__w"))
    vector = VectorAssembler(inputCols=["__s"], outputCol="features")
    fitted = IsotonicRegression(weightCol="__w").fit(vector.transform(points))
    at = fitted.transform(vector.transform(points)).select(F.col("__s"), F.col("prediction").alias("calibrated"))
    return rows.join(at, F.col(score).cast("double") == at["__s"], "left").drop("__s")


def one_against_rest(rows: DataFrame, classes: dict[str, Column], scores: dict[str, str]) -> DataFrame:
    """``rows`` with ``p_{class}``: each class's own logistic calibration of its score, renormalised to sum to one."""
    raw = {}
    for name, is_it in classes.items():
        fit = glm.logistic(rows.select(F.col(scores[name]).cast("double").alias("__x"), is_it.cast("int").alias("__y")), ["__x"], "__y")
        raw[name] = 1 / (1 + F.exp(-(float(fit.beta[0]) + F.col(scores[name]) * float(fit.beta[1]))))
    whole = sum(raw.values(), F.lit(0.0))
    return rows.withColumns({f"p_{name}": p / whole for name, p in raw.items()})


