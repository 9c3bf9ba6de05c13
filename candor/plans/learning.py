"""Queries without SQL twins: probes, out-of-fold scores, the judge, and kernels over generated rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from candor.functions import kernels
from candor.functions import scores as sc
from candor.operators import learning as ml
from candor.plans.frames import _FUSE, _fused
from candor.plans.registry import query
from candor.sources.tables import table


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"))
    return v.withColumn("fold", F.pmod(F.xxhash64("item"), F.lit(5)).cast("int"))


@query()
def ml1_probe(spark, sf):
    v = _vectors(spark, sf)
    return ml.fit_probe(v)(v).select("item", "y", F.round("p", 4).alias("p"))


@query()
def ml2_scaled_lr(spark, sf):
    v = _vectors(spark, sf)
    return ml.fit_probe(v, c=0.5, scaled=True)(v).select("item", "y", F.round("p", 4).alias("p"))


@query()
def ml3_audio_probe(spark, sf):
    """Five vectors are a file's windows, all with the label of the first."""
    v = _vectors(spark, sf).select("item", "x", F.floor(F.col("item") / 5).alias("path"), (F.col("item") % 5).alias("s"), (F.floor(F.col("item") / 5) % 3 == 0).cast("int").alias("y"))
    return ml.fit_audio(v)(v).select("item", "y", F.round("p", 4).alias("p"))


@query()
def ml4_oof(spark, sf):
    return ml.out_of_fold(_vectors(spark, sf), 5).select("item", "fold", "y", F.round("p", 4).alias("p"))


@query()
def ml5_judge(spark, sf):
    v = _vectors(spark, sf)
    a = ml.out_of_fold(v, 5).select("item", "y", F.col("p").alias("p1"))
    b = ml.out_of_fold(v, 5, c=0.5, scaled=True).select("item", F.col("p").alias("p2"))
    both = a.join(b, "item").select("item", "y", F.array("p1", "p2").alias("x"))
    return ml.judge(both).select("item", "y", F.round("p", 4).alias("p"))


def _rasters(df, compute, schema):
    """Seeded noise, or its upsampled form for odd ids, in place of decoded images."""

    def run(batches):
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng(i)
                x = rng.integers(0, 256, (128, 128, 3), np.uint8)
                x = kernels.resize(x[:16, :16].astype(float), 128, 128).astype(np.uint8) if i % 2 else x
                out.append(compute(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "x"])

    return df.mapInArrow(run, f"id bigint, x {schema}")


def _ids(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("bigint").alias("id"))


@query()
def krn3_spectrum(spark, sf):
    return _rasters(_ids(spark, sf), lambda x: kernels.spectra([x])[0].tolist(), "array<double>")


@query()
def krn4_ela(spark, sf):
    return _rasters(_ids(spark, sf), kernels.SCORERS["ela"], "double")


@query()
def krn5_jpeg_loop(spark, sf):
    return _rasters(_ids(spark, sf), lambda x: float(np.abs(kernels.jpeg(x, 75).astype(float) - x).mean()), "double")


@query()
def krn6_downscale(spark, sf):
    return _rasters(_ids(spark, sf), lambda x: float(kernels.downscale(x).mean()), "double")


@query(f"""WITH {_FUSE}, g AS (SELECT video, round(avg(score), 9) AS p, bool_or(ai) AS ai, round(avg(clip), 9) AS clip, round(avg(freq), 9) AS freq FROM z GROUP BY video)
SELECT video, round(1 - p, 4) AS authenticity, CASE WHEN ai OR p >= 0.5 THEN 'likely_fake' ELSE 'likely_real' END AS verdict, 'clip,freq' AS names, round(clip, 4) AS clip, round(freq, 4) AS freq FROM g""")
def snk1_report_json(spark, sf):
    """What is read back from one JSON report for each video."""
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    z = _fused(spark, sf).groupBy("video").agg(mean("score"), F.max("ai").alias("ai"), mean("clip"), mean("freq"))
    signals = F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 4).alias("score_fake")) for n in ("clip", "freq")])
    report = F.struct(F.round(1 - F.col("score"), 4).alias("authenticity"), sc.verdict(F.col("score"), F.col("ai")).alias("verdict"), signals.alias("signals"))
    read = F.from_json(F.to_json(report), "authenticity double, verdict string, signals array<struct<name string, score_fake double>>")
    r = z.select("video", read.alias("r")).select("video", "r.*")
    scores = [F.get("signals", F.lit(i))["score_fake"].alias(n) for i, n in enumerate(("clip", "freq"))]
    return r.select("video", "authenticity", "verdict", F.array_join("signals.name", ",").alias("names"), *scores)
