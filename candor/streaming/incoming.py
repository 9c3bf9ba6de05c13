"""Media files scored as they arrive, and scores aggregated in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, TimestampType, StringType

from candor.functions.scores import media_kind
from candor.sources.media import declared

FILES = StructType(
    [StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())]
)


def watch(spark: SparkSession, path: str, per_batch: int = 10_000) -> DataFrame:
    """New files of a folder and those below, as a stream of (path, kind, modificationTime, length, content)."""
    raw = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(path)
    return raw.select("path", media_kind(F.col("path")).alias("kind"), "modificationTime", "length", "content")


def signals(files: DataFrame) -> DataFrame:
    """What each file declares of itself; for streams and tables alike."""
    return files.select("path", "kind", "modificationTime", declared(F.col("content")).alias("m")).select("path", "kind", "modificationTime", "m.*")


def write(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream to Parquet. The file sink's log and the checkpoint make each file count once, also after a restart."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to a function, which must give the same result when it is called again with the same number."""
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_rates(stream: DataFrame, time: str, by: list[str], score: str, size: str, late: str, threshold: float = 0.5) -> DataFrame:
    """(start, *by, n, mean, rate) in tumbling windows of event time; rows later than ``late`` are left out once a window is closed."""
    hit = (F.col(score) >= threshold).cast("int")
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by)
    out = grouped.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.avg(hit).alias("rate"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "rate")
