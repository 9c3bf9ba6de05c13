"""Probes against an independent solver, models kept in a folder, scorers by name, injected detectors, decoration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import kernels
from candor.operators import learning as ml
from candor.operators import reporting, scoring

FUSED = ("clip_probe", "frequency")


def newton(x, y, c, balanced, scaled):
    """Probabilities of the logistic model that minimises c * weighted log loss + |w|^2 / 2, its intercept free."""
    x = (x - x.mean(0)) / x.std(0) if scaled else x
    x = np.column_stack([x, np.ones(len(x))])
    counts = np.bincount(y)
    weight = (len(y) / (2 * counts))[y] if balanced else np.ones(len(y))
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (c * weight * p * (1 - p))[:, None]).T @ x + ridge, c * x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
    return 1 / (1 + np.exp(-x @ w))


def points(seed=5, n=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 1] + [0, 3, 0, 1]
    return x, (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 2).astype(int)


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "item long, x array<double>, y int")


@pytest.mark.parametrize(("c", "balanced", "scaled"), [(1.0, True, False), (0.5, True, True), (0.1, False, True)])
def test_probe_by_newton_steps(spark, c, balanced, scaled):
    x, y = points()
    rows = frame(spark, x, y)
    got = [r.p for r in ml.fit_probe(rows, c, balanced, scaled)(rows).orderBy("item").collect()]
    assert np.allclose(got, newton(x, y, c, balanced, scaled), atol=2e-5)


def test_audio_probe_reads_three_windows_a_file(spark):
    x, y = points()
    rows = frame(spark, x, y).withColumns({"path": F.floor(F.col("item") / 5), "s": F.col("item") % 5})
    used = np.arange(len(x)) % 5 < 3
    some = rows.filter("s < 3")
    got = [r.p for r in ml.fit_audio(rows)(some).orderBy("item").collect()]
    assert np.allclose(got, newton(x[used], y[used], 0.1, False, True), atol=2e-5)


def test_models_are_kept_and_missing_ones_score_null(spark, tmp_path):
    x, y = points()
    rows, models = frame(spark, x, y), scoring.Models(spark, str(tmp_path))
    assert models.load("audio") is None
    none = scoring.scorer("audio", models)(rows)
    assert none.filter("p IS NOT NULL").isEmpty() and none.count() == len(x)
    probe = ml.fit_probe(rows, scaled=True)
    models.save("audio", probe)
    want = [r.p for r in probe(rows).orderBy("item").collect()]
    more = rows.unionByName(rows.limit(1).withColumns({"item": F.lit(-1).cast("long"), "x": F.lit(None).cast("array<double>")}))
    got = scoring.scorer("audio", models)(more).orderBy("item").collect()
    assert got[0].p is None and np.allclose([r.p for r in got[1:]], want)


def test_judge_falls_back_to_the_mean(spark, tmp_path):
    x, y = points()
    models = scoring.Models(spark, str(tmp_path))
    rows = frame(spark, x, y).withColumns({f"{n}_x": F.col("x") for n in FUSED}).drop("x")
    score = lambda: [r.p for r in scoring.scorer("judge", models)(rows).orderBy("item").collect()]
    assert score() == [0.5] * len(x)
    one, two = ml.fit_probe(frame(spark, x, y)), ml.fit_probe(frame(spark, x, y), c=0.5, scaled=True)
    models.save("clip_probe", one)
    a = np.array([r.p for r in one(frame(spark, x, y)).orderBy("item").collect()])
    assert np.allclose(score(), a)
    models.save("frequency", two)
    b = np.array([r.p for r in two(frame(spark, x, y)).orderBy("item").collect()])
    assert np.allclose(score(), (a + b) / 2)
    both = frame(spark, np.column_stack([a, b]), y)
    judge = ml.fit_probe(both)
    models.save("judge", judge)
    assert np.allclose(score(), [r.p for r in judge(both).orderBy("item").collect()])


def test_scorers_of_pixels_and_unknown_names(spark, tmp_path):
    models = scoring.Models(spark, str(tmp_path))
    pixels = np.random.default_rng(1).integers(0, 256, (64, 48, 3), np.uint8)
    rows = spark.createDataFrame([("a", 64, 48, 3, bytearray(pixels.tobytes())), ("b", None, None, None, None)], "path string, height int, width int, channels int, bgr binary")
    for name in ("dummy", "ela"):
        got = {r.path: r.p for r in scoring.scorer(name, models)(rows).collect()}
        assert got["b"] is None and got["a"] == pytest.approx(kernels.SCORERS[name](pixels[..., ::-1]))
    with pytest.raises(ValueError, match="unknown scorer"):
        scoring.scorer("other", models)


def test_detectors_and_judge_are_given_by_the_caller(spark, tmp_path):
    cols = "path string, ela_reliable boolean, min_side int, jpeg_quality double, face boolean, declared struct<score double, decisive boolean, shift double>, declared_finding string"
    rows = spark.createDataFrame([("a.jpg", True, 900, 95.0, True, (0.5, False, 0.0), "None.")], cols)
    give = lambda v: lambda df: df.withColumn("p", F.lit(v))
    report = lambda *a: scoring.image_reports(rows, *a).select("report.*").first()
    detectors = dict(zip(FUSED, (give(0.9), give(0.7)), strict=True))
    assert report(detectors).authenticity == pytest.approx(0.2, abs=1e-3)
    assert report(detectors, give(0.05)).verdict == "likely_real"
    missing = scoring.Models(spark, str(tmp_path)).scorer("judge")
    assert report(detectors, missing).authenticity == pytest.approx(0.2, abs=1e-3)
    alone = report({"clip_probe": give(0.9)}, give(0.05))
    assert alone.authenticity == pytest.approx(0.1, abs=1e-3) and alone.assessment.detectors_used == ["clip_probe"]
    assert report({}).verdict == "inconclusive"


def test_decoration(spark):
    reports = spark.createDataFrame([("x/a.jpg", "r"), ("b.mp4", "s")], "path string, verdict string")
    files = spark.createDataFrame([("x/a.jpg", 7, 1.26), ("b.mp4", 9, None)], "path string, length long, elapsed_s double")
    truth = spark.createDataFrame([("x/a.jpg", "fake", "swap")], "path string, label string, type string")
    a, b = reporting.decorated(reports, files, truth).orderBy("path", ascending=False).collect()
    assert (a.media_kind, a.provenance.filename, a.provenance.bytes, a.elapsed_s) == ("image", "a.jpg", 7, 1.3)
    assert a.ground_truth.label == "fake" and b.ground_truth is None and b.media_kind == "video" and b.elapsed_s is None
    assert "ground_truth" not in reporting.decorated(reports, files).columns


def test_undecodable_images_are_flagged(spark, tmp_path):
    from candor.functions import drawing
    from candor.sources import media

    (tmp_path / "a.png").write_bytes(drawing.png(np.zeros((4, 5, 3), np.uint8)))
    (tmp_path / "b.webp").write_bytes(b"RIFF0000WEBP")
    rows = {r.path[-5:]: r for r in media.images(spark, str(tmp_path), keep_invalid=True).collect()}
    assert rows["a.png"[-5:]].decoded and rows["a.png"[-5:]].width == 5 and not rows[".webp"].decoded and rows[".webp"].bgr is None
    assert media.images(spark, str(tmp_path)).count() == 1
