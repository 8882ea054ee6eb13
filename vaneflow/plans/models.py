"""Forecast models and bucket probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import with_normal_cdf
from ..operators.asof import asof_join
from ..operators.ordered import running


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0):
    """Least squares with an L2 penalty `alpha` on the sum of squared weights, intercept free.

    Spark averages the loss over rows and scales the label to unit deviation first, so the penalty is
    divided by the row count and multiplied by the label's deviation."""
    rows = assemble(train, features)
    n, sd = rows.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    return LinearRegression(
        featuresCol="features", labelCol=target, predictionCol="pred", regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False,
        solver="normal",
    ).fit(rows)


def gram_columns(features: Sequence[str], target: str) -> list[Column]:
    """Sums that determine a least-squares fit: n, sum x, sum y, sum xx', sum xy, sum yy."""
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    cols = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    cols += [F.array(*[F.sum(a) for a in x]).alias("sx"), F.array(*[F.sum(a * y) for a in x]).alias("sxy")]
    cols += [F.array(*[F.sum(a * b) for a in x for b in x]).alias("sxx")]
    return cols


def ridge_by_group(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float, min_rows: int = 30) -> DataFrame:
    """An independent ridge fit and residual deviation per group.

    Spark sums the Gram matrix per group; only that small matrix is solved in Python, many per batch."""
    p = len(features)
    grams = df.dropna(subset=[*features, target]).groupBy(*keys).agg(*gram_columns(features, target)).filter(F.col("n") >= min_rows)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[list(keys)].copy()
            n = pdf["n"].to_numpy(float)[:, None]
            sx, sxy = np.stack(pdf["sx"]), np.stack(pdf["sxy"])
            sxx = np.stack(pdf["sxx"]).reshape(-1, p, p)
            sy, syy = pdf["sy"].to_numpy(), pdf["syy"].to_numpy()
            mx, my = sx / n, sy / n[:, 0]
            cov = sxx - n[:, :, None] * mx[:, :, None] * mx[:, None, :]
            cxy = sxy - n * mx * my[:, None]
            w = np.linalg.solve(cov + alpha * np.eye(p), cxy[:, :, None])[:, :, 0]
            sse = syy - n[:, 0] * my**2 - 2 * (w * cxy).sum(1) + np.einsum("gi,gij,gj->g", w, cov, w)
            out["n"] = pdf["n"]
            out["intercept"] = my - (w * mx).sum(1)
            out["weights"] = list(w)
            out["sigma"] = np.sqrt(np.maximum(sse, 0) / (n[:, 0] - 1))
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n LONG, intercept DOUBLE, weights ARRAY<DOUBLE>, sigma DOUBLE"
    return grams.mapInPandas(solve, schema)


def linear_prediction(features: Sequence[str], intercept: str = "intercept", weights: str = "weights") -> Column:
    total = F.col(intercept)
    for i, c in enumerate(features):
        total = total + F.get(F.col(weights), F.lit(i)) * F.col(c)
    return total


def boosted_regression(train: DataFrame, features: Sequence[str], target: str, rounds: int = 10, depth: int = 3, seed: int = 7):
    """Imputed features and boosted trees; importance is in `model.stages[-1].featureImportances`."""
    from pyspark.ml import Pipeline

    filled = [f"{c}_filled" for c in features]
    return Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"),
        GBTRegressor(labelCol=target, predictionCol="pred", maxIter=rounds, maxDepth=depth, seed=seed),
    ]).fit(train)


def logistic_classifier(train: DataFrame, features: Sequence[str], label: str):
    return LogisticRegression(labelCol=label, maxIter=50, regParam=0.01).fit(assemble(train, features))


def sign_classifiers(train: DataFrame, features: Sequence[str], label: str, rounds: int = 5, seed: int = 7) -> dict:
    rows = assemble(train, features)
    return {
        "logistic": logistic_classifier(train, features, label),
        "boosted": GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, seed=seed).fit(rows),
    }


def class_probability(col: str = "probability") -> Column:
    return F.get(vector_to_array(F.col(col)), F.lit(1))


def bucket_probabilities(
    ladder: DataFrame, group: Sequence[str], lo: str, hi: str, mean: Column, sd: Column, floor: float = 0.001, out: str = "model_p"
) -> DataFrame:
    """Normal mass of each bucket, floored, renormalised over the ladder (a handful of rows)."""
    edges = with_normal_cdf(ladder, _below_lo=(F.col(lo) - mean) / sd, _below_hi=(F.col(hi) - mean) / sd)
    mass = F.greatest(F.col("_below_hi") - F.col("_below_lo"), F.lit(floor))
    total = F.sum("_mass").over(Window.partitionBy(*group))
    return edges.withColumn("_mass", mass).withColumn(out, F.col("_mass") / total).drop("_mass", "_below_lo", "_below_hi")


def empirical_probabilities(
    ladder: DataFrame, residuals: DataFrame, keys: Sequence[str], lo: Column, hi: Column, residual: str, out: str = "model_p",
) -> DataFrame:
    """Share of past residuals that fall into each bucket.

    Residuals are counted per value and accumulated; two lookups on that curve give the share, so
    neither side is paired with the other."""
    counted = residuals.groupBy(*keys, F.col(residual).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    curve = running(counted, keys, ["_r"], _cum=("sum", F.col("_n")), _all=("total_sum", F.col("_n")))
    probes = ladder.withColumns({"_lo": lo, "_hi": hi})
    upper = asof_join(probes, curve, keys, "_hi", "_r", {"_cum_hi": "_cum", "_n_hi": "_all"})
    both = asof_join(upper, curve, keys, "_lo", "_r", {"_cum_lo": "_cum", "_n_lo": "_all"}, exact=False)
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    share = (F.coalesce("_cum_hi", F.lit(0)) - F.coalesce("_cum_lo", F.lit(0))) / F.col("_total")
    return both.join(totals, list(keys), "left").withColumn(out, share).drop(
        "_lo", "_hi", "_cum_hi", "_n_hi", "_cum_lo", "_n_lo", "_total")
