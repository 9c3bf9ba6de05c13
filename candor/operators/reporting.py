"""Whole reports of images, videos and sound from detectors' scores, one row a file, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions import report as rp
from candor.functions import scores as sc
from candor.operators.series import ordered_mean, running_sum

# Places that round scores; frames that a video's report names.
PLACES, FLAGGED = 4, 3
# Caveats of video reports and notes on an input's quality.
NO_SOUND = "No audio track, so lip-sync and voice checks were skipped."
MISMATCH = "Possible lip-sync manipulation: mouth movement does not match the speech."


def _present(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _text(x: Column, places: int = 0) -> Column:
    return F.format_string(f"%.{places}f", F.bround(x, places))


def quality_notes(jpeg: Column, min_side: Column, face: Column) -> Column:
    return _present(
        [
            F.when(jpeg < 80, F.concat(F.lit("heavily compressed (JPEG ~"), _text(jpeg), F.lit(")"))),
            F.when(min_side < 256, F.concat(F.lit("low resolution ("), min_side.cast("string"), F.lit("px)"))),
            F.when(~face, "no face found"),
        ]
    )


def image_reports(df: DataFrame, model: Column | None = None, calibration: Column | None = None) -> DataFrame:
    """(path, report) from one row for each image.

    df: path, clip_probe and frequency (scores, null where a detector is not there), ela (null or its
    score), ela_reliable, min_side, jpeg_quality, face, declared (struct of score, decisive, shift),
    declared_finding. model, calibration: a trained judge's probability and shift, for images with
    both scores. Every step is an expression over the row, so images never meet.
    """
    pixel = {name: F.col(name) for name in rp.FUSED}
    call = sc.judged(list(pixel.values()), F.col("declared.shift"), F.col("declared.decisive"), F.col("min_side"), None, model, calibration)
    missing, unreliable = rp.skipped(pixel), F.col("ela").isNotNull() & ~F.col("ela_reliable")
    about = F.when(F.col("jpeg_quality").isNull(), "").otherwise(F.concat(F.lit(" (JPEG ~"), _text(F.col("jpeg_quality")), F.lit(")")))
    skip = lambda name, why: F.struct(F.lit(name).alias("name"), why.alias("reason"))
    skipped = _present([F.when(unreliable, skip("ela", F.concat(F.lit("file was recompressed"), about))), *[F.when(c.isNull(), skip(n, F.lit("not trained"))) for n, c in pixel.items()]])
    hidden = F.concat(F.lit("Editing analysis (ELA) is not used for the verdict: this file has been recompressed"), F.regexp_replace(about, "JPEG ~", "estimated JPEG quality ~"))
    caveats = F.concat(_present([F.when(unreliable, hidden)]), rp.caveats(missing, F.col("face")))
    used = F.size(F.filter(F.array(*pixel.values()), lambda x: x.isNotNull()))
    q = sc.input_quality(F.col("jpeg_quality"), F.col("min_side"), F.col("face"))
    agreement = sc.agreement(list(pixel.values()))
    coverage = used / F.lit(float(len(pixel)))
    out = df.withColumn("call", call).withColumn("agreement", agreement).withColumn("coverage", coverage)
    sure = sc.confidence(F.col("call.p"), F.col("agreement"), q, F.col("coverage"))
    told = [F.struct(F.lit(n).alias("name"), c.alias("score_fake"), rp.finding(F.lit(n), c).alias("finding")) for n, c in pixel.items()]
    fused = _present([F.when(c.isNotNull(), t) for c, t in zip(pixel.values(), told, strict=True)])
    out = out.withColumn("sure", F.round(sure, 9)).withColumn("level", sc.confidence_level(F.col("sure"), used, F.col("call.reason"))).withColumn("fused", fused)
    best = F.element_at(F.array_sort(F.transform("fused", lambda s: F.struct((-s["score_fake"]).alias("k"), s["name"].alias("name"), s["finding"].alias("finding")))), 1)
    summary = rp.summary(
        F.col("call.p"), F.col("call.verdict"), F.col("call.reason"), F.transform("fused", lambda s: s["finding"]), F.when(F.size("fused") > 0, best),
        F.when(F.col("declared.decisive"), F.col("declared_finding")), F.col("level"),
    )
    extra = [
        F.when(F.col("ela").isNotNull(), F.struct(F.lit("ela").alias("name"), F.col("ela").alias("score_fake"), F.lit(None).cast("string").alias("finding"))),
        F.struct(F.lit("metadata").alias("name"), F.col("declared.score").alias("score_fake"), F.col("declared_finding").alias("finding")),
    ]
    signals = F.transform(F.concat("fused", _present(extra)), lambda s: s.withField("score_fake", F.round(s["score_fake"], PLACES)))
    reason = F.nullif(F.col("call.reason"), F.lit(""))
    assessment = F.struct(
        F.col("level").alias("confidence"), F.round("sure", 3).alias("confidence_score"), reason.alias("low_confidence_reason"), F.round("agreement", 3).alias("agreement"),
        F.round("coverage", 3).alias("coverage"), sc.input_quality_label(q).alias("input_quality"), quality_notes(F.col("jpeg_quality"), F.col("min_side"), F.col("face")).alias("input_quality_notes"),
        F.array_sort(F.transform("fused", lambda s: s["name"])).alias("detectors_used"), skipped.alias("detectors_skipped"), F.col("face").alias("face_detected"),
    )
    return out.select(
        "path",
        F.struct(
            F.round(1 - F.col("call.p"), PLACES).alias("authenticity"), F.col("call.verdict").alias("verdict"), reason.alias("inconclusive_reason"), summary.alias("summary"),
            assessment.alias("assessment"), caveats.alias("caveats"), signals.alias("signals"),
        ).alias("report"),
    )


def video_reports(frames: DataFrame, detectors: list[str], clips: DataFrame, by: str = "video") -> DataFrame:
    """(by, report) from scores by frame and one row for each clip.

    frames: by, frame, time_s and a score column for each detector. clips: by, min_side, has_audio,
    lip_score, lip_reliable (null where there is no lip-sync check). Frames of a clip meet in windows:
    means are added in the order of frames, as a score of just 0.5 hangs on their last digit, and the
    frames named are the three with the largest mean.
    """
    mean = sum((F.col(d) for d in detectors), F.lit(0.0)) / F.lit(float(len(detectors)))
    each = frames.withColumn("__mean", mean)
    order = ["frame", *detectors]
    stats = [ordered_mean(d, f"__{d}", order).alias(d) for d in detectors] + [F.max(d).alias(f"max_{d}") for d in detectors] + [F.stddev_pop(d).alias(f"sd_{d}") for d in detectors]
    shown = F.struct(sc.places(F.col("__mean"), 9).alias("m"), (-F.col("frame")).alias("f"), F.col("time_s").alias("t"))
    rank = F.row_number().over(_largest(by, F.struct(sc.places(F.col("__mean"), 9), -F.col("frame"))))
    each = each.select("*", rank.alias("__r"), *[running_sum(d, [by], order).alias(f"__{d}") for d in detectors])
    top = F.reverse(F.array_sort(F.collect_list(F.when(F.col("__r") <= FLAGGED, shown))))
    whole = each.groupBy(by).agg(*stats, F.count("*").alias("n"), top.alias("top"))
    spread = sum((F.col(f"sd_{d}") for d in detectors), F.lit(0.0)) / F.lit(float(len(detectors)))
    out = whole.join(clips, by).withColumn("inconsistency", spread)
    shift = sc.lipsync_shift(F.col("lip_score"), F.col("lip_reliable"))
    out = out.withColumn("call", sc.judged([F.col(d) for d in detectors], shift, F.lit(False), F.col("min_side"), F.round("inconsistency", 9)))
    per = lambda d: F.concat(F.lit("Mean over "), F.col("n").cast("string"), F.lit(" frames; max "), _text(F.col(f"max_{d}"), 2), F.lit(", frame-to-frame std "), _text(F.col(f"sd_{d}"), 2), F.lit("."))
    signal = lambda n, s, f: F.struct(F.lit(n).alias("name"), F.round(s, PLACES).alias("score_fake"), f.alias("finding"))
    signals = [signal(d, F.col(d), per(d)) for d in detectors]
    steady = F.concat(F.lit("Average frame-to-frame score variation is "), _text(F.col("inconsistency"), 2), F.lit("."))
    signals.append(signal("frame_consistency", sc.consistency_score(F.col("inconsistency")), steady))
    flagged = F.transform("top", lambda s: F.struct((-s["f"]).alias("frame"), F.round(s["t"], 2).alias("time_s"), F.round(s["m"], 3).alias("score_fake")))
    caveats = _present([F.when(~F.col("has_audio"), NO_SOUND), F.when(F.col("lip_reliable") & (F.col("lip_score") >= 0.5), MISMATCH)])
    return out.select(
        by,
        F.struct(
            F.round(1 - F.col("call.p"), PLACES).alias("authenticity"), F.col("call.verdict").alias("verdict"), F.nullif(F.col("call.reason"), F.lit("")).alias("inconclusive_reason"),
            caveats.alias("caveats"), F.array(*signals).alias("signals"), flagged.alias("flagged_frames"),
        ).alias("report"),
    )


def _largest(by: str, order: Column):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order.desc())


def audio_reports(windows: DataFrame, by: str = "path") -> DataFrame:
    """(by, report) from scores (by, s, e, p) of a clip's windows: their mean, a verdict unless it is close to one half, and the windows of 0.5 and more."""
    out = windows.groupBy(by).agg(
        sc.places(F.avg("p"), 9).alias("p"), F.array_sort(F.collect_list(F.when(F.col("p") >= 0.5, F.struct("s", "e")))).alias("ranges")
    )
    near = F.abs(F.col("p") - 0.5) < sc.MARGIN
    return out.select(
        by,
        F.struct(
            sc.places(1 - F.col("p"), PLACES).alias("authenticity"), sc.audio_verdict(F.col("p")).alias("verdict"), F.when(near, "score is too close to 50%").alias("inconclusive_reason"),
            F.col("ranges").alias("audio_seconds"),
        ).alias("report"),
    )


def decorated(reports: DataFrame, files: DataFrame, truth: DataFrame | None = None, device: str = "spark") -> DataFrame:
    """reports (path and more) with media_kind, provenance, elapsed_s and, where truth has the path, ground_truth.

    files: path, length, and elapsed_s where it was measured. truth: path, label, type, one row for each path.
    """
    spent = F.round("__spent", 1) if "elapsed_s" in files.columns else F.lit(None).cast("double")
    about = files.select("path", F.col("length").alias("__bytes"), *[F.col("elapsed_s").alias("__spent")] * ("elapsed_s" in files.columns))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    source = F.struct(name.alias("filename"), F.col("__bytes").alias("bytes"), F.current_timestamp().alias("analyzed_at"), F.lit(device).alias("device"))
    out = reports.join(about, "path", "left").withColumns({"media_kind": sc.media_kind(F.col("path")), "provenance": source, "elapsed_s": spent})
    out = out.drop("__bytes", "__spent")
    if truth is None:
        return out
    return out.join(truth.select("path", F.struct("label", "type").alias("ground_truth")), "path", "left")


def dispatched(files: DataFrame, path: str = "path") -> DataFrame:
    """files with kind, and error where the extension is none that is known."""
    kind = sc.media_kind(F.col(path))
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return files.withColumn("kind", kind).withColumn("error", F.when(kind.isNull(), F.concat(F.lit("unsupported file type: "), ext)))
