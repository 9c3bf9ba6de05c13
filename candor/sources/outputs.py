"""Sinks: reports, heat images, evaluation steps as they finish, and the robustness table."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import drawing, kernels
from candor.sources.media import raster


def write_reports(df: DataFrame, path: str, report: str = "report") -> None:
    """One JSON document a line from a column of structs; null fields are left out."""
    df.select(F.to_json(report).alias("value")).write.mode("overwrite").text(path)


def heat_images(images: DataFrame) -> DataFrame:
    """(path, png): images of sources.media.images under their error-level heat, as PNG bytes."""

    def draw(batches):
        for b in batches:
            for path, h, w, c, bgr in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                x = raster(bgr, h, w, c)
                drawn = drawing.png(drawing.overlay(x, kernels.error_heat(x)))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([drawn], pa.binary())], ["path", "png"])

    return images.select("path", "height", "width", "channels", "bgr").mapInArrow(draw, "path string, png binary")


def save_step(result: DataFrame, root: str, step: str) -> None:
    """Writes one step of an evaluation beside those already there; a step that is run again is replaced."""
    numbers = [F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in result.dtypes]
    one = result.select(*numbers).withColumn("step", F.lit(step))
    one.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("step").parquet(root)


def read_steps(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def markdown(grid: DataFrame, keys: list[str], metrics: list[str]) -> str:
    """A table of a small grid (detectors by degradations), in the order of its keys; 'n/a' where a metric is missing."""
    shown = lambda v: "n/a" if v is None or math.isnan(v) else f"{v:.3f}"
    lines = ["| " + " | ".join([*keys, *metrics]) + " |", "|" + "---|" * (len(keys) + len(metrics))]
    for row in grid.select(*keys, *metrics).orderBy(*keys).collect():
        lines.append("| " + " | ".join([*(str(row[k]) for k in keys), *(shown(row[m]) for m in metrics)]) + " |")
    return "\n".join(lines)
