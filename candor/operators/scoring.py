"""Scorers by name, trained models kept in a folder, and reports with detectors of the caller's own.

A scorer is a function from a DataFrame to the same rows with p, the probability of a fake; null
where there is no score. A model that was never saved gives null scores, so what stands on it falls
back: fused scores to the detectors that are there, the judge to their mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import kernels
from candor.functions import report as rp
from candor.operators import learning, reporting
from candor.sources.media import raster

Scorer = Callable[[DataFrame], DataFrame]


class Models:
    """Probes by name in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, probe: learning.Probe) -> None:
        probe.model.write().overwrite().save(f"{self.root}/{name}")

    def load(self, name: str) -> learning.Probe | None:
        """The probe, or None if none was saved under that name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/metadata")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return learning.Probe(PipelineModel.load(f"{self.root}/{name}")) if there else None

    def scorer(self, name: str, x: str = "x") -> Scorer:
        """p from the column x; null without a model and where x is null."""
        probe = self.load(name)

        def score(rows: DataFrame) -> DataFrame:
            if probe is None:
                return rows.withColumn("p", F.lit(None).cast("double"))
            return learning.scored(probe, rows, x)

        return score


def _of_pixels(compute: Callable[[np.ndarray], float]) -> Scorer:
    def score(images: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = zip(*(b[c].to_pylist() for c in ("height", "width", "channels")), strict=True)
                p = [None if raw is None else compute(raster(raw, *size)) for raw, size in zip(b["bgr"].to_pylist(), sizes, strict=True)]
                yield b.append_column("p", pa.array(p, pa.float64()))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
        return images.mapInArrow(run, f"{kinds}, p double")

    return score


def _judge(models: Models) -> Scorer:
    """Both fused scores by the trained judge, else the mean of those that are there; nothing but the scores counts."""
    fused = [models.scorer(name, name + "_x") for name in rp.FUSED]
    judge = models.scorer("judge")

    def score(rows: DataFrame) -> DataFrame:
        for name, scorer in zip(rp.FUSED, fused, strict=True):
            rows = scorer(rows).withColumnRenamed("p", name)
        scores = F.array(*[F.col(n) for n in rp.FUSED])
        there = F.filter(scores, lambda s: s.isNotNull())
        mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, s: a + s), F.size(there))
        rows = judge(rows.withColumn("x", F.when(F.size(there) == len(rp.FUSED), scores)))
        return rows.withColumn("p", F.coalesce("p", mean, F.lit(0.5))).drop("x", *rp.FUSED)

    return score


def scorer(name: str, models: Models) -> Scorer:
    """dummy and ela read images (height, width, channels, bgr); audio reads x; clip_probe and frequency
    read clip_probe_x and frequency_x, and judge both."""
    if name in kernels.SCORERS:
        return _of_pixels(kernels.SCORERS[name])
    if name in rp.FUSED:
        return models.scorer(name, f"{name}_x")
    if name == "audio":
        return models.scorer(name)
    if name == "judge":
        return _judge(models)
    raise ValueError(f"unknown scorer: {name}")


def image_reports(rows: DataFrame, detectors: dict[str, Scorer], judge: Scorer | None = None, calibration: Column | None = None) -> DataFrame:
    """reporting.image_reports of rows with the scores of the given detectors, fused by the given judge.

    detectors: by name. Those that a judge fuses and ela go into the report; where one is not given its
    score is null. judge reads x, the fused scores in order.
    """
    for name in (*rp.FUSED, "ela"):
        rows = detectors[name](rows).withColumnRenamed("p", name) if name in detectors else rows.withColumn(name, F.lit(None).cast("double"))
    model = None
    if judge is not None:
        scores = F.array(*[F.col(n) for n in rp.FUSED])
        rows = judge(rows.withColumn("x", F.when(F.forall(scores, lambda s: s.isNotNull()), scores))).withColumnRenamed("p", "judged")
        model = F.col("judged")
    return reporting.image_reports(rows, model, calibration)
