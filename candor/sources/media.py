"""Media files as tables, and kernels over their pixels as Arrow UDFs."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.functions import headers, kernels
from candor.functions import scores as sc
from candor.functions.scores import media_kind

#: Bytes at a file's head that are searched for provenance marks.
HEAD = 2_000_000
#: Samples a second of pcm().
RATE = 16_000


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, kind, modificationTime, length, content, source_id) of a folder and those below."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return raw.select("path", media_kind(F.col("path")).alias("kind"), "modificationTime", "length", "content", F.split_part(stem, F.lit("__"), F.lit(1)).alias("source_id"))


def provenance(content: Column) -> Column:
    """struct(ai_source, c2pa): marks among a file's first bytes."""
    text = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    return F.struct(text.contains("trainedAlgorithmicMedia").alias("ai_source"), (text.contains("c2pa") | text.contains("jumbf")).alias("c2pa"))


_HEADER = T.StructType(
    [
        T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
        T.StructField("has_exif", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("make", "model", "software", "text")),
        T.StructField("mean_luma", T.DoubleType()),
    ]
)


def metadata(content: Column) -> Column:
    """struct of headers.Header for the bytes of a file; all null or empty for what is no known image.

    Only bytes that begin like an image go to Python; sound and video stay where they are.
    """
    start = F.hex(F.substring(content, 1, 4))
    webp = (start == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return _metadata(F.when(start.startswith("FFD8") | start.startswith("424D") | (start == "89504E47") | webp, content))


@F.arrow_udf(_HEADER)
def _metadata(content: pa.Array) -> pa.Array:
    kind = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("has_exif", pa.bool_()),
                      *((n, pa.string()) for n in ("make", "model", "software", "text")), ("mean_luma", pa.float64())])
    return pa.array([headers.parse(raw or b"")._asdict() for raw in content.to_pylist()], kind)


def declared(content: Column) -> Column:
    """struct of what a file declares: its header's fields, camera, editor, AI mark, C2PA, JPEG quality and the signal."""
    m = metadata(content)
    return F.transform(F.array(F.struct(m.alias("m"), provenance(content).alias("p"))), lambda x: _declared(x["m"], x["p"]))[0]


def _declared(m: Column, marks: Column) -> Column:
    camera = sc.camera(m["make"], m["model"])
    editor = sc.editor(m["software"])
    marker = sc.ai_marker(m["software"], m["text"], marks["ai_source"])
    signal = sc.metadata_signal(marker, editor, camera)
    return F.struct(
        m["format"].alias("format"), m["width"].alias("width"), m["height"].alias("height"), m["has_exif"].alias("has_exif"), camera.alias("camera"),
        m["software"].alias("software"), editor.alias("editor"), marker.alias("ai_marker"), marks["c2pa"].alias("c2pa"),
        F.when(m["mean_luma"].isNotNull(), sc.jpeg_quality(m["mean_luma"])).alias("jpeg_quality"), signal.alias("signal"),
    )


def images(spark: SparkSession, path: str, keep_invalid: bool = False) -> DataFrame:
    """(path, height, width, channels, bgr): decoded images. Those that can't be decoded (WebP among them)
    are left out, or, with keep_invalid, stay without pixels; decoded then tells them apart."""
    df = spark.read.format("image").option("dropInvalid", not keep_invalid).option("recursiveFileLookup", True).load(path)
    df = df.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))
    if not keep_invalid:
        return df
    good = F.col("height") > 0
    return df.select("path", *[F.when(good, F.col(c)).alias(c) for c in df.columns[1:]], good.alias("decoded"))


def raster(bgr: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(bgr, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[..., 2::-1]


def image_features(df: DataFrame, degradation: str = "clean") -> DataFrame:
    """(path, spectrum, ela) of images, in one pass over the pixels, after a degradation."""

    def compute(batches):
        for b in batches:
            rows = [b.column(i).to_pylist() for i in range(5)]
            for lo in range(0, b.num_rows, 16):
                some = slice(lo, lo + 16)
                x = [kernels.DEGRADATIONS[degradation](raster(*r)) for r in zip(rows[4][some], rows[1][some], rows[2][some], rows[3][some], strict=True)]
                peaks = pa.array([kernels.error_peak(i) for i in x], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0)[some], pa.array(list(kernels.spectra(x)), pa.list_(pa.float64())), peaks], ["path", "spectrum", "peak"])

    found = df.select("path", "height", "width", "channels", "bgr").mapInArrow(compute, "path string, spectrum array<double>, peak double")
    return found.select("path", "spectrum", sc.ela_score(F.col("peak")).alias("ela"))


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """x at RATE, cut off at the lower of the two Nyquist frequencies."""
    if rate == RATE or not len(x):
        return x
    step = rate // math.gcd(rate, RATE)  # so many samples are a whole number of samples at RATE
    padded = -(-len(x) // step) * step
    m = padded * RATE // rate
    return np.fft.irfft(np.fft.rfft(x, padded), m)[: -(-len(x) * RATE // rate)] * (m / padded)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def pcm(content: pa.Array) -> pa.Array:
    """Mono samples at RATE of 16-bit WAV bytes, -1..1 but for overshoot; null for anything else, and for rates outside 1 kHz to 1 MHz."""
    out = []
    for raw in content.to_pylist():
        try:
            with wave.open(io.BytesIO(raw or b"")) as w:
                good = w.getsampwidth() == 2 and 1_000 <= w.getframerate() <= 1_000_000
                x = np.frombuffer(w.readframes(w.getnframes()), np.int16).reshape(-1, w.getnchannels()).mean(1) / 32768 if good else None
                x = x if x is None else resampled(x, w.getframerate())
        except (wave.Error, EOFError, ValueError):
            x = None
        out.append(x if x is None else x.astype(np.float32))
    return pa.array(out, pa.list_(pa.float32()))
