"""Findings, caveats and summaries of a report as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Findings by detector, above 0.6 and not.
FINDINGS = {
    "clip_probe": ("Overall appearance resembles AI-generated or manipulated images.", "Overall appearance is consistent with real photos."),
    "frequency": (
        "High-frequency spectrum shows periodic/upsampling patterns typical of generated images.",
        "Frequency spectrum looks like that of camera-captured images.",
    ),
}
# Caveats, phrases of the summary and lip-sync labels.
CLEAN = "The image content shows no sign of AI generation or face manipulation."
STRONGEST = "Strongest evidence from the image content"
NOT_TRAINED = "Pixel detectors are not trained yet, so the verdict cannot rest on the image content."
NO_FACE = "No face was detected; the center of the image was analysed instead."
LABELS = {"in_sync": "IN SYNC", "out_of_sync": "OUT OF SYNC", "not_checked": "NOT CHECKED"}
FUSED = ("clip_probe", "frequency")


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))


def finding(detector: Column, score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (high, low) in FINDINGS.items():
        out = F.when(detector == name, F.when(score > 0.6, high).otherwise(low)).otherwise(out)
    return out


def skipped(scores: dict[str, Column]) -> Column:
    """Names of the fused detectors without a score."""
    return F.filter(F.array(*[F.when(scores[n].isNull(), n) for n in FUSED]), lambda x: x.isNotNull())


def caveats(untrained: Column, face: Column) -> Column:
    every = F.array(F.when(F.size(untrained) > 0, NOT_TRAINED), F.when(~face, NO_FACE))
    return F.filter(every, lambda x: x.isNotNull())


def lipsync_label(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, label in LABELS.items():
        out = F.when(status == key, label).otherwise(out)
    return out


def summary(p: Column, verdict: Column, reason: Column, findings: Column, top: Column, declared: Column, level: Column) -> Column:
    """The report's sentence. findings: array of findings used; top: struct(name, finding) of the largest score;
    declared: the metadata finding where the file declares itself synthetic, else null; level: confidence or null."""
    sure = percent(1 - p)
    fake = F.concat(F.lit("FAKE (authenticity "), sure, F.lit("). "))
    real = F.concat(F.lit("REAL (authenticity "), sure, F.lit(f"). {CLEAN} "), F.array_join(findings, " "))
    body = (
        F.when(declared.isNotNull(), F.concat(fake, declared))
        .when(verdict == "likely_real", real)
        .otherwise(F.concat(fake, F.lit(f"{STRONGEST} ("), top["name"], F.lit("): "), top["finding"]))
    )
    why = F.when(reason != "", F.concat(F.lit(" ("), reason, F.lit(")."))).otherwise(".")
    tail = F.when(level.isNotNull() & (level != "none"), F.concat(F.lit(" Confidence: "), level, why)).otherwise("")
    return F.when(verdict == "inconclusive", F.concat(F.lit("No verdict: "), reason, F.lit("."))).otherwise(F.concat(body, tail))


def tone(score: Column) -> Column:
    return F.when(score < 0.35, "good").when(score < 0.65, "warn").otherwise("bad")


def mouth_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The middle three fifths of a face's width and the lower two fifths of its height."""
    part = lambda share, of: (F.lit(share) * of).cast("int")
    return F.struct((x + part(0.2, w)).alias("x0"), (x + part(0.8, w)).alias("x1"), (y + part(0.6, h)).alias("y0"), (y + h).alias("y1"))
