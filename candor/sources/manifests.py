"""Manifests: tables of labelled media files (path, label, type, source_id, split), as CSV and from folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators import evaluation as ev
from candor.sources import media

COLUMNS = ("path", "label", "type", "source_id", "split")
SOUND = ("wav", "mp3", "flac")
PICTURES = ("jpg", "jpeg", "png", "webp")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))


def read_manifest(spark: SparkSession, path: str, guard: bool = True, absent_is_empty: bool = False) -> DataFrame:
    """The rows of a manifest CSV, all columns as strings.

    ValueError where a column is missing or, with ``guard``, a source is in more than one split; it
    names the first five such sources.
    """
    try:
        df = spark.read.csv(path, header=True)
    except AnalysisException:
        if absent_is_empty:
            return empty(spark)
        raise
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"manifest misses columns {missing}")
    if guard:
        bad = [r["source_id"] for r in ev.leaks(df).orderBy("source_id").limit(5).collect()]
        if bad:
            raise ValueError(f"sources in more than one split: {bad}")
    return df


def from_folder(spark: SparkSession, path: str, label: str, kind: str) -> DataFrame:
    """(path, label, type, source_id) of the media files below a folder; pictures whose header can't be read are left out."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    found = media.files(spark, path).filter(ext.isin(*PICTURES, *SOUND))
    readable = ext.isin(*SOUND) | media.metadata(F.col("content"))["width"].isNotNull()
    return found.filter(readable).select("path", F.lit(label).alias("label"), F.lit(kind).alias("type"), "source_id")


def build(real: list[DataFrame], fake: list[DataFrame], holdout: tuple[str, ...] = (), share: float = 0.3) -> DataFrame:
    """A manifest of such rows: split by source, held-out types only in the test split and of its sources."""
    rows = None
    for part in (*real, *fake):
        rows = part if rows is None else rows.unionByName(part)
    out = ev.assign(rows, ev.group_split(rows, share=share))
    for kind in holdout:
        out = ev.hold_out(out, kind)
    return out.select(*COLUMNS)


def write_manifest(df: DataFrame, path: str) -> None:
    df.select(*COLUMNS).write.mode("overwrite").csv(path, header=True)
