"""Raster kernels, sources and probes."""

import io
import wave

import numpy as np
import pytest

from candor import queries
from candor.functions import kernels
from candor.sources import media

SF = "/root/testdata/sf0.001"


def noise(n, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (n, n, 3), np.uint8)


def test_box_mean_by_brute_force():
    a = np.random.default_rng(1).random((9, 7))
    p = np.pad(a, 1, mode="symmetric")
    want = [[p[i : i + 3, j : j + 3].mean() for j in range(7)] for i in range(9)]
    assert np.allclose(kernels.box_mean(a, 3), want)


def test_jpeg_loses_less_at_higher_quality():
    x = kernels.resize(noise(32).astype(float), 100, 90).astype(np.uint8)
    loss = [np.abs(kernels.jpeg(x, q).astype(float) - x).mean() for q in (50, 75, 95)]
    assert loss[0] > loss[1] > loss[2] and kernels.jpeg(x, 75).shape == x.shape
    assert kernels.tables(50)[0].tolist() == kernels.LUMA.tolist() and kernels.LUMA.mean() == 57.625


def test_spectra_tell_noise_from_upsampled():
    smooth = kernels.resize(noise(16).astype(float), 128, 128).astype(np.uint8)
    a, b = kernels.spectra([noise(128), smooth])
    assert a[-1] > b[-1] and b[0] == 0 and np.allclose(b, kernels.spectra([smooth])[0])


def test_spectra_by_loops_over_the_whole_plane():
    x = noise(256, 3)
    y = kernels.luma(x)
    wave = np.array([0.5 - 0.5 * np.cos(2 * np.pi * k / 255) for k in range(256)])
    f = np.fft.fft2((y - y.mean()) * wave[:, None] * wave)
    total, n = np.zeros(32), np.zeros(32)
    for v in range(256):
        for u in range(256):
            r = np.hypot(v - 256 * (v >= 128), u - 256 * (u >= 128))
            ring = min(31, int(r / 128 * 32))
            total[ring] += np.log(abs(f[v, u]) ** 2 + 1e-8)
            n[ring] += 1
    assert np.allclose(kernels.spectra([x])[0], total / n - (total / n)[0])


def test_resize_weighs_areas():
    a = np.arange(48.0).reshape(6, 8)
    assert np.allclose(kernels.resize(a, 6, 8), a) and np.allclose(kernels.resize(a, 6, 8, cubic=True), a)
    assert np.allclose(kernels.resize(np.full((9, 7), 3.0), 4, 20, cubic=True), 3.0)
    checks = np.indices((64, 64)).sum(0) % 2 * 255.0  # a point sample would keep black or white
    assert np.abs(kernels.resize(checks, 16, 16)[2:-2, 2:-2] - 127.5).max() < 2
    assert kernels.resize(noise(10).astype(float), 5, 3).shape == (5, 3, 3)


def test_error_levels_by_definition():
    x = kernels.jpeg(noise(96), 60)
    lost = np.abs(kernels.jpeg(x, 90).astype(float) - x).sum(2) / 3
    size = max(3, 96 // 24)
    before, after = size // 2, size - 1 - size // 2
    at = lambda k: [k + d for d in range(-before, after + 1)]
    mirror = lambda k: -k - 1 if k < 0 else 191 - k if k > 95 else k
    mean = np.array([[np.mean([lost[mirror(v), mirror(u)] for v in at(i) for u in at(j)]) for j in range(96)] for i in range(96)])
    ratio = mean / (np.median(mean) + 0.001)
    assert np.allclose(kernels.error_ratio(x), ratio)
    assert kernels.error_peak(x) == pytest.approx(np.percentile(ratio, 99))
    assert np.allclose(kernels.error_heat(x), np.clip((ratio - 1) / 3, 0, 1))
    assert kernels.SCORERS["ela"](x) == pytest.approx(1 / (1 + np.exp(-(np.percentile(ratio, 99) - 5) / 0.8)))


def test_crop_splice_and_contrast():
    x = noise(96)
    assert kernels.crop(x, (8, 8, 80, 80)).shape == (224, 224, 3)
    a, b = kernels.splice(x, 1), kernels.splice(x, 1)
    assert (a == b).all() and a.shape == x.shape and (kernels.splice(x, 2) != a).any()
    assert kernels.SCORERS["dummy"](np.zeros((4, 4, 3), np.uint8)) == 0 and 0 < kernels.SCORERS["dummy"](x) <= 1
    assert 0 <= kernels.SCORERS["ela"](a) <= 1


def test_codecs_say_that_they_are_missing():
    with pytest.raises(NotImplementedError):
        kernels.DEGRADATIONS["h264"](noise(8))


def test_files_and_sound(spark, tmp_path):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(np.array([[0, 0], [16384, 0]], np.int16).tobytes())
    (tmp_path / "a__1.wav").write_bytes(buf.getvalue())
    (tmp_path / "b.JPG").write_bytes(b"not an image, c2pa")
    rows = {r.source_id: r for r in media.files(spark, str(tmp_path)).withColumn("p", media.provenance("content")).withColumn("x", media.pcm("content")).collect()}
    assert (rows["a"].kind, rows["b"].kind) == ("audio", "image")
    assert rows["a"].x == [0.0, 0.25] and rows["b"].x is None and rows["b"].p.c2pa and not rows["a"].p.c2pa


@pytest.mark.parametrize("rate", [8000, 44100, 48000])
def test_sound_is_resampled(spark, rate):
    tone = lambda r: 0.5 * np.sin(2 * np.pi * 440 * np.arange(r) / r)
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((tone(rate) * 32767).astype(np.int16).tobytes())
    x = spark.createDataFrame([(bytearray(buf.getvalue()),)], "content binary").select(media.pcm("content").alias("x")).first().x
    assert len(x) == 16000 and np.abs(np.array(x) - tone(16000)).max() < 1e-3


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_without_sql_run(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert rows and ("p" not in rows[0] or all(0 <= r.p <= 1 for r in rows))
