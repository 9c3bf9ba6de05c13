"""The fixture tables as the engine's inputs: samples, frames, series, vectors, meta, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators.series import ordered_means


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Scored media: (path, type, label, source_id, p)."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("path"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_type") == "view", "real").otherwise("fake").alias("label"),
        F.col("user_id").alias("source_id"),
        (F.col("value") / (F.col("value") + F.lit(35.0))).alias("p"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Detector scores by frame: (video, frame, clip, freq)."""
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("bigint").alias("frame")).agg(
        F.least(F.lit(1.0), F.avg("l_discount") * 10).alias("clip"), F.least(F.lit(1.0), F.avg("l_tax") * 12.5).alias("freq")
    )


def frames_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """frames with each mean added in the table's order, for reports that compare means unrounded."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("bigint").alias("frame"), "l_discount", "l_tax",
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"),
    )
    means = ordered_means(lines, ["video", "frame"], ["__file", "__row"], ["l_discount", "l_tax"])
    return means.select("video", "frame", F.least(F.lit(1.0), F.col("l_discount") * 10).alias("clip"), F.least(F.lit(1.0), F.col("l_tax") * 12.5).alias("freq"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """frames in long form: (video, frame, detector, score)."""
    return frames(spark, sf).unpivot(["video", "frame"], ["clip", "freq"], "detector", "score")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly series by event type: (kind, i, mouth, audio), i counted from the first hour."""
    e = table(spark, sf, "events").withColumn("h", F.floor(F.unix_timestamp("ts") / 3600))
    by = e.groupBy(F.col("event_type").alias("kind"), "h").agg(F.count("*").cast("double").alias("mouth"), F.sum("value").alias("audio"))
    first = by.agg(F.min("h").alias("h0"))
    return by.join(F.broadcast(first)).select("kind", (F.col("h") - F.col("h0")).cast("int").alias("i"), "mouth", "audio")


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """File metadata: (media, jpeg_quality, min_side, ai_marker, editor, camera)."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("media"),
        F.when(d % 11 != 0, (F.lit(50) + d % 50).cast("double")).alias("jpeg_quality"),
        (F.lit(32) + d % 400).cast("int").alias("min_side"),
        F.when(d % 7 == 0, "flux").alias("ai_marker"),
        F.when(d % 7 == 1, "GIMP").alias("editor"),
        F.when(d % 7 < 4, "Canon").alias("camera"),
    )


# The same inputs in SQL, for the queries' DuckDB twins.
SAMPLES = """samples AS (SELECT event_id AS path, event_type AS type, CASE WHEN event_type = 'view' THEN 'real' ELSE 'fake' END AS label,
  user_id AS source_id, value / (value + 35.0::DOUBLE) AS p FROM events)"""
SPLIT = """groups AS (SELECT source_id, row_number() OVER (ORDER BY md5(source_id::VARCHAR), source_id) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT source_id FROM samples WHERE source_id IS NOT NULL)),
split AS (SELECT source_id, CASE WHEN rn <= floor(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM groups),
m0 AS (SELECT samples.*, split FROM samples JOIN split USING (source_id)),
m AS (SELECT * FROM m0 WHERE type <> 'purchase' OR split = 'test')"""
FRAMES = """frames AS (SELECT l_orderkey AS video, l_linenumber::BIGINT AS frame, least(1.0::DOUBLE, avg(l_discount) * 10) AS clip,
  least(1.0::DOUBLE, avg(l_tax) * 12.5::DOUBLE) AS freq FROM lineitem GROUP BY ALL),
signals AS (SELECT video, frame, 'clip' AS detector, clip AS score FROM frames UNION ALL SELECT video, frame, 'freq', freq FROM frames)"""
SERIES = """hours AS (SELECT event_type AS kind, floor(epoch(ts) / 3600)::BIGINT AS h, count(*)::DOUBLE AS mouth, sum(value) AS audio FROM events GROUP BY ALL),
series AS (SELECT kind, (h - (SELECT min(h) FROM hours))::INT AS i, mouth, audio FROM hours)"""
META = """meta AS (SELECT doc_id AS media, CASE WHEN doc_id % 11 <> 0 THEN (50 + doc_id % 50)::DOUBLE END AS jpeg_quality,
  (32 + doc_id % 400)::INT AS min_side, CASE WHEN doc_id % 7 = 0 THEN 'flux' END AS ai_marker,
  CASE WHEN doc_id % 7 = 1 THEN 'GIMP' END AS editor, CASE WHEN doc_id % 7 < 4 THEN 'Canon' END AS camera FROM documents)"""
