"""Headers, archives, manifests, sinks and streams, on files made here."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.functions import drawing, headers, kernels
from candor.sources import archives, manifests, media, outputs
from candor.streaming import incoming


def tiff(order, values):
    """A TIFF block of text tags."""
    mark = {"<": b"II", ">": b"MM"}[order]
    entries, data, at = b"", b"", 8 + 2 + 12 * len(values) + 4
    for tag, text in values.items():
        raw = text.encode() + b"\0"
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(data))
        entries += struct.pack(order + "HHI", tag, 2, len(raw)) + place
        data += raw if len(raw) > 4 else b""
    return mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(values)) + entries + b"\0" * 4 + data


def jpeg(exif=None, quality=75, comment=b""):
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    table = kernels.tables(quality)[0].astype(np.uint8).tobytes()
    out = b"\xff\xd8" + (part(0xE1, b"Exif\0\0" + exif) if exif else b"") + (part(0xFE, comment) if comment else b"")
    return out + part(0xDB, b"\0" + table) + part(0xC0, struct.pack(">BHHB", 8, 480, 640, 3)) + b"\xff\xda\0\2"


def png(extra=b""):
    whole = drawing.png(np.zeros((3, 5, 3), np.uint8))
    return whole[:33] + extra + whole[33:]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    h = headers.parse(jpeg(tiff(order, {271: " Canon ", 272: "R5", 305: "GIMP 2.10"})))
    assert (h.format, h.width, h.height, h.make, h.model, h.software, h.has_exif) == ("JPEG", 640, 480, "Canon", "R5", "GIMP 2.10", True)


@pytest.mark.parametrize("quality", [60, 75, 90])
def test_quality_from_table(spark, quality):
    from candor.functions import scores as sc

    mean = headers.parse(jpeg(quality=quality)).mean_luma
    assert spark.range(1).select(sc.jpeg_quality(F.lit(mean)).alias("q")).first().q == pytest.approx(quality, abs=1.5)


def test_text_chunks():
    assert headers.parse(png(chunk(b"tEXt", b"parameters\0Steps: 20, Sampler: Euler"))).text == "Steps: 20, Sampler: Euler"
    assert headers.parse(png(chunk(b"zTXt", b"k\0\0" + zlib.compress(b"packed")))).text == "packed"
    assert headers.parse(png(chunk(b"iTXt", b"k\0\0\0en\0k\0" + "é".encode()))).text == "é"
    h = headers.parse(png(chunk(b"eXIf", tiff("<", {305: "abc"}))))
    assert (h.width, h.height, h.software) == (5, 3, "abc")


def test_broken_headers_do_not_raise():
    whole = jpeg(tiff("<", {271: "A long maker's name", 305: "x"}), comment=b"hello")
    for raw in (whole, png(), b"RIFF\0\0\0\0WEBPVP8X", b"BM", b""):
        for n in range(len(raw)):
            headers.parse(raw[:n])
    for at in range(len(whole)):
        headers.parse(whole[:at] + b"\xff" + whole[at + 1 :])


def test_webp_and_bmp():
    body = b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert headers.parse(b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + body)[:3] == ("WEBP", 100, 50)
    assert headers.parse(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9))[:3] == ("BMP", 7, 9)


def test_overlay_and_palette():
    colours = drawing.palette()
    assert colours.shape == (256, 3) and colours[[0, 255]].tolist() == [[0, 0, 128], [128, 0, 0]] and colours[127, 1] == 255
    x = np.full((8, 6, 3), 100, np.uint8)
    out = drawing.overlay(x, np.ones((4, 3)))
    assert out.shape == x.shape and out[0, 0].tolist() == [114, 50, 50]
    raw = drawing.png(out)
    at = raw.index(b"IDAT")
    size = struct.unpack(">I", raw[at - 4 : at])[0]
    rows = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), np.uint8).reshape(8, 19)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(8, 6, 3) == out).all()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "media"
    d.mkdir()
    (d / "a__1.jpg").write_bytes(jpeg(tiff("<", {271: "Canon", 272: "R5"})))
    (d / "b__1.png").write_bytes(png(chunk(b"tEXt", b"Software\0Stable Diffusion")))
    (d / "b__2.jpg").write_bytes(jpeg(tiff(">", {305: "Adobe Photoshop"})) + b"c2pa")
    (d / "c.jpg").write_bytes(b"broken")
    (d / "d.wav").write_bytes(b"sound")
    (d / "e.jpg").write_bytes(jpeg() + b"trainedAlgorithmicMedia")
    return d


def test_declared(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in incoming.signals(media.files(spark, str(folder))).collect()}
    a, b, e = rows["a__1.jpg"], rows["b__1.png"], rows["b__2.jpg"]
    assert (a.camera, a.ai_marker, a.editor, a.signal.score, a.signal.shift) == ("Canon R5", None, None, 0.35, -0.4)
    assert a.jpeg_quality == pytest.approx(75, abs=1.5) and b.jpeg_quality is None
    assert (b.ai_marker, b.signal.decisive) == ("Stable Diffusion", True)
    assert (e.editor, e.c2pa, e.signal.score) == ("Adobe Photoshop", True, 0.55)
    assert rows["e.jpg"].ai_marker == "IPTC digital source type: AI-generated" and rows["c.jpg"].signal.score == 0.5


def test_manifest_round_trip(spark, folder, tmp_path):
    rows = manifests.from_folder(spark, str(folder), "real", "real")
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows.collect()) == ["a__1.jpg", "b__1.png", "b__2.jpg", "d.wav", "e.jpg"]
    fake = rows.withColumn("label", F.lit("fake")).withColumn("type", F.lit("gan"))
    whole = manifests.build([rows], [fake], ("gan",), 0.5)
    out = str(tmp_path / "manifest")
    manifests.write_manifest(whole, out)
    back = manifests.read_manifest(spark, out)
    assert back.columns == list(manifests.COLUMNS) and back.count() == whole.count()
    assert {r.split for r in back.filter("type = 'gan'").collect()} == {"test"}


def test_manifest_faults(spark, tmp_path):
    (tmp_path / "short.csv").write_text("path,label\na,real\n")
    with pytest.raises(ValueError, match="source_id"):
        manifests.read_manifest(spark, str(tmp_path / "short.csv"))
    (tmp_path / "leak.csv").write_text("path,label,type,source_id,split\na,real,real,s1,train\nb,real,real,s1,test\n")
    with pytest.raises(ValueError, match="s1"):
        manifests.read_manifest(spark, str(tmp_path / "leak.csv"))
    assert manifests.read_manifest(spark, str(tmp_path / "none.csv"), absent_is_empty=True).isEmpty()
    with pytest.raises(Exception, match="none.csv"):
        manifests.read_manifest(spark, str(tmp_path / "none.csv"))


def test_archives(spark, tmp_path):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for member in ("top/a.jpg", "top/b.PNG", f"top/{name}.jpg", "top/notes.txt"):
                z.writestr(member, member * 50, zipfile.ZIP_STORED if member.endswith("PNG") else None)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    members = archives.index(spark, str(tmp_path))
    assert members.count() == 6
    assert sorted(r["name"] for r in archives.in_every_archive(members).collect()) == ["a.jpg", "b.PNG"]
    got = archives.contents(members).collect()
    assert len(got) == 6 and all(bytes(r.content) == r.member.encode() * 50 for r in got)


def test_steps_and_table(spark, tmp_path):
    root = str(tmp_path / "steps")
    row = lambda auc: spark.createDataFrame([("seen", auc)], "grp string, auc double")
    outputs.save_step(row(0.5), root, "a")
    outputs.save_step(row(float("nan")), root, "b")
    outputs.save_step(row(0.75), root, "a")
    steps = outputs.read_steps(spark, root)
    assert sorted((r.step, r.auc) for r in steps.collect()) == [("a", 0.75), ("b", None)]
    assert outputs.markdown(steps, ["step"], ["auc"]).splitlines() == ["| step | auc |", "|---|---|", "| a | 0.750 |", "| b | n/a |"]


def test_reports_and_heat(spark, tmp_path):
    df = spark.range(2).select(F.struct("id", F.lit(None).cast("string").alias("gone")).alias("report"))
    outputs.write_reports(df, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"id":0}', '{"id":1}']
    d = tmp_path / "pictures"
    d.mkdir()
    (d / "x.png").write_bytes(drawing.png(np.random.default_rng(0).integers(0, 256, (64, 48, 3), np.uint8)))
    (made,) = outputs.heat_images(media.images(spark, str(d))).collect()
    h = headers.parse(bytes(made.png))
    assert (h.format, h.width, h.height) == ("PNG", 48, 64)


def test_stream_counts_each_file_once(spark, folder, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for _ in range(2):
        incoming.write(incoming.signals(incoming.watch(spark, str(folder))), out, log, once=True).awaitTermination()
        assert spark.read.parquet(out).count() == 6
    (folder / "new.png").write_bytes(png())
    incoming.write(incoming.signals(incoming.watch(spark, str(folder))), out, log, once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_windowed_rates_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("kind"), (F.col("id") % 8 / 8).alias("p"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    rates = lambda d: incoming.windowed_rates(d, "ts", ["kind"], "p", "1 hour", "10 minutes")
    q = rates(stream).writeStream.outputMode("complete").foreachBatch(lambda d, n: seen.append(d.collect())).option("checkpointLocation", str(tmp_path / "log"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen[-1]) == sorted(rates(rows).collect())
