"""Logistic probes, out-of-fold scores and the calibrated judge, with MLlib.

vectors: (item, x array<double>, y 0/1, fold). The penalty C weighs the summed loss, so MLlib's
regParam is 1 / (C n) with n the sum of the rows' weights, and features are standardised, if at all, by a
scaler of their own whose deviation is the population's.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.scores import calibration_shift, nudge


class Probe:
    """A fitted probe: called with a DataFrame that has x, it adds p, the probability of class 1."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def __call__(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows.withColumn("features", array_to_vector("x")))
        return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def scored(probe: Probe, rows: DataFrame, x: str = "x") -> DataFrame:
    """rows with p by their column x, null where that is null: those rows take a vector of zeros through the probe."""
    width = probe.model.stages[-1].numFeatures
    filled = rows.withColumn("__x", F.coalesce(F.col(x), F.array_repeat(F.lit(0.0), width)))
    p = probe(filled.select(F.struct(*[F.col(c) for c in rows.columns]).alias("__row"), F.col("__x").alias("x")))
    return p.select("__row.*", F.when(F.col(f"__row.{x}").isNotNull(), F.col("p")).alias("p"))


def fit_probe(df: DataFrame, c: float = 1.0, balanced: bool = True, scaled: bool = False) -> Probe:
    """A logistic probe over x for the class y."""
    train = df.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    n, ones = train.agg(F.count("*"), F.sum("label")).first()
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col("label") == 1, n / (2 * max(ones, 1.0))).otherwise(n / (2 * max(n - ones, 1.0)))
    train = train.withColumn("w", weight)
    # the scaler divides by the sample deviation, sqrt(n / (n - 1)) times the population's, which the penalty makes up for
    factor = n / max(n - 1, 1) if scaled else 1.0
    lr = LogisticRegression(
        featuresCol="scaled" if scaled else "features", weightCol="w", regParam=1 / (c * n) / factor, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10
    )
    scaler = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)] if scaled else []
    return Probe(Pipeline(stages=[*scaler, lr]).fit(train))


def first_windows(windows: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` windows of each file (path, s), those that train the probe of sound; a file's label stands in each."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("s"))
    return windows.withColumn("__r", place).filter(F.col("__r") <= most).drop("__r")


def fit_audio(windows: DataFrame, most: int = 3) -> Probe:
    """The probe of sound: standardised, C = 0.1, classes as they are, over the first windows of each file."""
    return fit_probe(first_windows(windows, most), c=0.1, balanced=False, scaled=True)


def out_of_fold(df: DataFrame, folds: int, **options) -> DataFrame:
    """df with p from a probe fitted on the other folds, its scaler too."""
    out = None
    for k in range(folds):
        part = fit_probe(df.filter(F.col("fold") != k), **options)(df.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def judge(scores: DataFrame, target_rate: float = 0.10) -> DataFrame:
    """(item, y, p): a balanced probe over out-of-fold scores x, moved so that ``target_rate`` of real rows are at one half or more."""
    raw = fit_probe(scores)(scores)
    cut = raw.filter("y = 0").agg(F.percentile("p", F.lit(1 - target_rate)).alias("cut"))
    moved = raw.join(F.broadcast(cut)).withColumn("p", nudge(F.col("p"), calibration_shift(F.col("cut"))))
    return moved.drop("cut")
