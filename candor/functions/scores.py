"""Score arithmetic and decision tables as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the decision tables.
EPS = 1e-6
DISAGREE, MARGIN, MIN_SIDE, INCONSISTENT = 0.6, 0.12, 64, 0.3
DECLARED_AI = 0.97


def lit(x: float) -> Column:
    return F.lit(float(x))


def places(x: Column, n: int) -> Column:
    """x rounded as the SQL does it: scaled as a double, halves away from zero. F.round goes by the shortest decimal and differs at ties."""
    return F.round(x * lit(10**n)) / lit(10**n)


def logit(p: Column) -> Column:
    return F.log((p + lit(EPS)) / (lit(1) - p + lit(EPS)))


def sigmoid(z: Column) -> Column:
    return lit(1) / (lit(1) + F.exp(-z))


def nudge(p: Column, shift: Column) -> Column:
    """A probability moved by a shift of its log-odds."""
    return sigmoid(logit(p) + shift)


def calibration_shift(threshold: Column) -> Column:
    """The shift that moves a threshold to one half."""
    return -logit(threshold)


def correlation_score(c: Column) -> Column:
    return lit(1) / (lit(1) + F.exp((c - lit(0.15)) / lit(0.07)))


def ela_score(p99: Column) -> Column:
    return sigmoid((p99 - lit(5)) / lit(0.8))


def ela_heat(ratio: Column) -> Column:
    return F.greatest(lit(0), F.least(lit(1), (ratio - lit(1)) / lit(3)))


def lipsync_shift(score: Column, reliable: Column) -> Column:
    up, down = lit(1.5) * (lit(2) * score - lit(1)), lit(-0.4) * (lit(1) - lit(2) * score)
    return F.when(score.isNull() | ~F.coalesce(reliable, F.lit(True)), lit(0)).otherwise(F.when(score >= 0.5, up).otherwise(down))


def consistency_score(inconsistency: Column) -> Column:
    return F.least(lit(1), lit(2) * inconsistency)


def input_quality(jpeg: Column, min_side: Column, face: Column) -> Column:
    low_jpeg = F.when(jpeg < 80, lit(0.75)).otherwise(lit(1))
    small = F.when(min_side < 256, lit(0.6)).otherwise(lit(1))
    return low_jpeg * small * F.when(face, lit(1)).otherwise(lit(0.7))


def input_quality_label(q: Column) -> Column:
    return F.when(q >= 0.95, "good").when(q >= 0.6, "degraded").otherwise("poor")


def confidence(p: Column, agreement: Column, quality: Column, coverage: Column) -> Column:
    margin = F.abs(p - lit(0.5)) * lit(2)
    return margin * agreement * quality * (lit(0.5) + lit(0.5) * coverage)


def confidence_level(score: Column, expected: Column, reason: Column) -> Column:
    level = F.when(score >= 0.55, "high").when(score >= 0.3, "medium").otherwise("low")
    return F.when(expected == 0, "none").when(F.coalesce(reason, F.lit("")) != "", "low").otherwise(level)


# Fixed value: the reason where no detector has a score.
NO_DETECTORS = "no trained pixel detectors loaded"


# Fixed values in the next function: the reasons, in the order in which they are asked.
def low_confidence_reason(min_side: Column, spread: Column, inconsistency: Column, p: Column) -> Column:
    """The first reason that applies, or an empty string; null inputs give none."""
    return (
        F.when(min_side < MIN_SIDE, F.concat(F.lit("input is very low resolution ("), min_side.cast("string"), F.lit("px)")))
        .when(spread > DISAGREE, "detectors strongly disagree")
        .when(inconsistency > INCONSISTENT, "scores vary strongly between frames")
        .when(F.abs(p - lit(0.5)) < MARGIN, "score is too close to 50%")
        .otherwise("")
    )


def fuse(scores: list[Column], shift: Column, declared_ai: Column, model: Column | None = None, calibration: Column | None = None) -> Column:
    """The fused probability: the model's when every score and the model's are there, else the mean of those there.

    Null without any score; declared_ai lifts the result to DECLARED_AI at least, and to just that without scores.
    """
    present = F.filter(F.array(*scores), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(present, lit(0), lambda a, x: a + x), F.size(present).cast("double"))
    if model is not None:
        calibration = lit(0) if calibration is None else calibration
        whole = (F.size(present) == len(scores)) & model.isNotNull()
        p, shift = F.when(whole, model).otherwise(mean), shift + F.when(whole, calibration).otherwise(lit(0))
    else:
        p = mean
    moved = nudge(p, shift)
    return F.when(declared_ai, F.greatest(F.coalesce(moved, lit(0)), lit(DECLARED_AI))).otherwise(moved)


def verdict(p: Column, declared_ai: Column) -> Column:
    return F.when(declared_ai, "likely_fake").when(p.isNull(), "inconclusive").when(p >= 0.5, "likely_fake").otherwise("likely_real")


def judged(
    scores: list[Column], shift: Column, declared_ai: Column, min_side: Column, inconsistency: Column | None = None, model: Column | None = None, calibration: Column | None = None
) -> Column:
    """struct(p, verdict, reason): without any score one half and inconclusive; what a file declares settles the verdict, with no reason to doubt it."""
    none = F.size(F.filter(F.array(*scores), lambda x: x.isNotNull())) == 0
    p = F.coalesce(fuse(scores, shift, declared_ai, model, calibration), lit(0.5))
    spread = F.coalesce(F.greatest(*scores) - F.least(*scores), lit(0)) if len(scores) > 1 else lit(0)
    doubt = low_confidence_reason(min_side, F.round(spread, 9), lit(0) if inconsistency is None else inconsistency, F.round(p, 9))
    call = F.when(declared_ai, "likely_fake").when(none, "inconclusive").when(p >= 0.5, "likely_fake").otherwise("likely_real")
    reason = F.when(declared_ai, "").when(none, NO_DETECTORS).otherwise(doubt)
    return F.struct(p.alias("p"), call.alias("verdict"), reason.alias("reason"))


def audio_verdict(p: Column) -> Column:
    return F.when(F.abs(p - lit(0.5)) < MARGIN, "inconclusive").when(p >= 0.5, "likely_fake").otherwise("likely_real")


def metadata_signal(ai_marker: Column, editor: Column, camera: Column) -> Column:
    """struct(score, decisive, shift) of the first provenance mark that is there."""
    make = lambda s, d, m: F.struct(lit(s).alias("score"), F.lit(d).alias("decisive"), lit(m).alias("shift"))
    return (
        F.when(ai_marker.isNotNull(), make(0.97, True, 4.0)).when(editor.isNotNull(), make(0.55, False, 0.3))
        .when(camera.isNotNull(), make(0.35, False, -0.4)).otherwise(make(0.5, False, 0.0))
    )


def ela_unreliable(jpeg: Column, min_side: Column) -> Column:
    return jpeg.isNull() | F.coalesce((jpeg < 88) | (min_side < 256), F.lit(False))


def jpeg_quality(mean_luma: Column) -> Column:
    """Encoder quality from the mean of the luminance quantisation table, against the standard table's 57.625."""
    scale = lit(100) * mean_luma / lit(57.625)
    return F.when(scale <= 200, (lit(200) - scale) / lit(2)).otherwise(lit(5000) / scale)


def lipsync_gate(n: Column, fps: Column, face_share: Column, speech_share: Column, mouth_std: Column) -> Column:
    return (
        F.when(n < lit(3) * fps, "clip is shorter than 3 seconds")
        .when(face_share < 0.7, F.format_string("a face was found in only %.0f%% of frames", F.bround(face_share * 100)))
        .when(speech_share < 0.2, "little or no speech in the audio")
        .when(mouth_std < 1e-6, "no mouth movement could be measured").otherwise("checked")
    )


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, lit(0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def agreement(scores: list[Column]) -> Column:
    """1 less the spread of the scores there are; 1 for one, 0 for none."""
    spread = F.greatest(*scores) - F.least(*scores)
    return F.coalesce(lit(1) - spread, lit(0))


def face_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box with a margin of 0.3 of its longer side, inside the image; without a box the centre square."""
    m = (lit(0.3) * F.greatest(w, h)).cast("int")
    side = F.least(width, height)
    box = F.struct(
        F.greatest(F.lit(0), x - m).alias("x0"), F.greatest(F.lit(0), y - m).alias("y0"),
        F.least(width, x + w + m).alias("x1"), F.least(height, y + h + m).alias("y1"),
    )
    left, top = F.floor((width - side) / 2).cast("int"), F.floor((height - side) / 2).cast("int")
    centre = F.struct(left.alias("x0"), top.alias("y0"), (left + side).alias("x1"), (top + side).alias("y1"))
    return F.when(w.isNull(), centre).otherwise(box)


# Patterns of generator names, generation parameters and editors in metadata.
AI_TOOLS = (
    r"(?i)stable.?diffusion|midjourney|dall.?e|firefly|imagen|flux|comfyui|automatic1111|novelai|"
    r"leonardo\.ai|ideogram|runway|sora|gemini|openai|generative"
)
GENERATION = r"(?i)parameters|prompt|negative prompt|sampler|cfg scale"
EDITORS = r"(?i)photoshop|lightroom|gimp|snapseed|facetune|faceapp|canva|picsart|capcut|affinity"
# Fixed value: the mark for files that name themselves synthetic in their source type.
AI_SOURCE = "IPTC digital source type: AI-generated"


def _match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def ai_marker(software: Column, text: Column, ai_source: Column) -> Column:
    """The first mark of generation: a tool's name in software or text, a generation parameter in text, the declared source; else null."""
    both = F.concat_ws(" ", F.coalesce(software, F.lit("")), text)
    return F.coalesce(_match(both, AI_TOOLS), _match(text, GENERATION), F.when(ai_source, AI_SOURCE))


def editor(software: Column) -> Column:
    return F.when(software.rlike(EDITORS), software)


def camera(make: Column, model: Column) -> Column:
    """Make and model, null where both are missing or blank."""
    return F.nullif(F.trim(F.concat_ws(" ", F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit(""))))), F.lit(""))


KINDS = {"image": ("jpg", "jpeg", "png", "webp", "bmp"), "video": ("mp4", "mov", "avi", "mkv", "webm"), "audio": ("wav", "mp3", "flac", "m4a", "ogg")}


def media_kind(path: Column) -> Column:
    """image, video or audio by extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out
