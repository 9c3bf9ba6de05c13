"""Whole reports over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from candor.functions import scores as sc
from candor.operators import reporting
from candor.plans.frames import _FUSE, _REASON
from candor.plans.registry import query
from candor.sources.tables import FRAMES, frames, frames_in_order, meta, table


@query(f"""WITH {_FUSE}, v AS (SELECT DISTINCT media, jpeg_quality FROM meta), w AS (SELECT z.*, jpeg_quality, {_REASON} AS reason, video % 2 = 0 AS face, abs(score - 0.5) * 2 * (1 - abs(clip - freq))
  * (CASE WHEN jpeg_quality < 80 THEN 0.75::DOUBLE ELSE 1 END) * (CASE WHEN min_side < 256 THEN 0.6::DOUBLE ELSE 1 END) * (CASE WHEN video % 2 = 0 THEN 1 ELSE 0.7::DOUBLE END) AS conf FROM z JOIN v ON video % 1000 = media)
SELECT video || '-' || frame AS path, round(1 - score, 4) AS authenticity, CASE WHEN ai OR score >= 0.5 THEN 'likely_fake' ELSE 'likely_real' END AS verdict, nullif(reason, '') AS reason,
  CASE WHEN reason <> '' THEN 'low' WHEN round(conf, 9) >= 0.55 THEN 'high' WHEN round(conf, 9) >= 0.3 THEN 'medium' ELSE 'low' END AS level,
  (CASE WHEN face THEN 0 ELSE 1 END + CASE WHEN frame % 2 = 0 THEN 0 ELSE 1 END)::INT AS caveats,
  CASE WHEN frame % 2 = 0 THEN '' ELSE 'ela: file was recompressed' || CASE WHEN jpeg_quality IS NULL THEN '' ELSE ' (JPEG ~' || jpeg_quality::INT || ')' END END AS skipped FROM w""")
def pip2_image_report(spark, sf):
    """Each frame as an image of its own."""
    j = frames(spark, sf).join(meta(spark, sf), F.col("video") % 1000 == F.col("media"))
    rows = j.select(
        F.concat_ws("-", "video", "frame").alias("path"), F.col("clip").alias("clip_probe"), F.col("freq").alias("frequency"), F.col("clip").alias("ela"),
        (F.col("frame") % 2 == 0).alias("ela_reliable"), "min_side", "jpeg_quality", (F.col("video") % 2 == 0).alias("face"),
        sc.metadata_signal(F.col("ai_marker"), F.col("editor"), F.col("camera")).alias("declared"), F.lit("Declared.").alias("declared_finding"),
    )
    r = reporting.image_reports(rows).select("path", "report.*")
    skipped = F.array_join(F.transform("assessment.detectors_skipped", lambda s: F.concat_ws(": ", s["name"], s["reason"])), ",")
    return r.select("path", "authenticity", "verdict", F.col("inconclusive_reason").alias("reason"), F.col("assessment.confidence").alias("level"), F.size("caveats").alias("caveats"), skipped.alias("skipped"))


@query(f"""WITH {FRAMES}, g AS (SELECT video, avg(clip) AS clip, avg(freq) AS freq, (stddev_pop(clip) + stddev_pop(freq)) / 2 AS inc FROM frames GROUP BY video),
t AS (SELECT video, string_agg(frame::VARCHAR, ',' ORDER BY m DESC, frame) AS top FROM (SELECT video, frame, round((clip + freq) / 2, 9) AS m FROM frames QUALIFY row_number() OVER (PARTITION BY video ORDER BY round((clip + freq) / 2, 9) DESC, frame) <= 3) GROUP BY video),
o AS (SELECT o_orderkey AS video, (o_orderkey % 500 + 30)::INT AS min_side, o_orderkey % 3 > 0 AS sound, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS lip, o_orderkey % 6 <> 1 AS reliable FROM orders),
z AS (SELECT *, (clip + freq) / 2 AS m, CASE WHEN lip IS NULL OR NOT reliable THEN 0 WHEN lip >= 0.5 THEN 1.5 * (2 * lip - 1) ELSE -0.4 * (1 - 2 * lip) END::DOUBLE AS shift FROM g JOIN t USING (video) JOIN o USING (video)),
q AS (SELECT *, 1 / (1 + exp(-(ln((m + 1e-6) / (1 - m + 1e-6)) + shift))) AS p FROM z)
SELECT video, round(1 - p, 4) AS authenticity, CASE WHEN p >= 0.5 THEN 'likely_fake' ELSE 'likely_real' END AS verdict,
  CASE WHEN min_side < 64 THEN 'input is very low resolution (' || min_side || 'px)' WHEN round(abs(clip - freq), 9) > 0.6 THEN 'detectors strongly disagree'
    WHEN round(inc, 9) > 0.3 THEN 'scores vary strongly between frames' WHEN abs(round(p, 9) - 0.5) < 0.12 THEN 'score is too close to 50%' END AS reason,
  (CASE WHEN sound THEN 0 ELSE 1 END + CASE WHEN sound AND reliable AND lip >= 0.5 THEN 1 ELSE 0 END)::INT AS caveats, top FROM q""")
def pip3_video_report(spark, sf):
    o = F.col("o_orderkey")
    lip = F.when(o % 3 > 0, (o % 10) / F.lit(10.0))
    clips = table(spark, sf, "orders").select(o.alias("video"), (o % 500 + 30).cast("int").alias("min_side"), (o % 3 > 0).alias("has_audio"), lip.alias("lip_score"), (o % 6 != 1).alias("lip_reliable"))
    f = frames_in_order(spark, sf).withColumn("time_s", F.col("frame") / 25)
    r = reporting.video_reports(f, ["clip", "freq"], clips).select("video", "report.*")
    top = F.array_join(F.transform("flagged_frames", lambda s: s["frame"].cast("string")), ",")
    return r.select("video", "authenticity", "verdict", F.col("inconclusive_reason").alias("reason"), F.size("caveats").alias("caveats"), top.alias("top"))


@query(f"""WITH {FRAMES}, g AS (SELECT video, round(avg(clip), 9) AS p, coalesce(string_agg(3 * frame || '-' || 3 * frame + 3, ',' ORDER BY frame) FILTER (clip >= 0.5), '') AS ranges FROM frames GROUP BY video)
SELECT video, round(1 - p, 4) AS authenticity, CASE WHEN abs(p - 0.5) < 0.12 THEN 'inconclusive' WHEN p >= 0.5 THEN 'likely_fake' ELSE 'likely_real' END AS verdict, ranges FROM g""")
def pip4_audio_report(spark, sf):
    """Each frame as three seconds of sound."""
    w = frames_in_order(spark, sf).select("video", (F.col("frame") * 3).alias("s"), (F.col("frame") * 3 + 3).alias("e"), F.col("clip").alias("p"))
    r = reporting.audio_reports(w, "video").select("video", "report.*")
    ranges = F.array_join(F.transform("audio_seconds", lambda s: F.concat_ws("-", s["s"].cast("string"), s["e"].cast("string"))), ",")
    return r.select("video", "authenticity", "verdict", ranges.alias("ranges"))


_NAME = "doc_id || ['.jpg', '.PNG', '.mp4', '.wav', '.txt', '', '.m4a'][doc_id % 7 + 1]"


@query(f"""SELECT {_NAME} AS path, CASE WHEN doc_id % 7 < 2 THEN 'image' WHEN doc_id % 7 = 2 THEN 'video' WHEN doc_id % 7 IN (3, 6) THEN 'audio' END AS kind,
  CASE doc_id % 7 WHEN 4 THEN 'unsupported file type: .txt' WHEN 5 THEN 'unsupported file type: ' END AS error FROM documents""")
def pip1_dispatch(spark, sf):
    ends = F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".mp4", ".wav", ".txt", "", ".m4a")])
    path = F.concat(F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int")))
    return reporting.dispatched(table(spark, sf, "documents").select(path.alias("path")))


@query(f"""SELECT {_NAME} AS path, CASE WHEN doc_id % 7 < 2 THEN 'image' WHEN doc_id % 7 = 2 THEN 'video' WHEN doc_id % 7 IN (3, 6) THEN 'audio' END AS media_kind, {_NAME} AS filename, n_chars::BIGINT AS bytes,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS type, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN lang = 'en' THEN 'real' ELSE 'fake' END END AS label FROM documents""")
def pip10_decorated(spark, sf):
    """Every second document is a sample with a label that is known."""
    ends = F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".mp4", ".wav", ".txt", "", ".m4a")])
    docs = table(spark, sf, "documents").withColumn("path", F.concat(F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int"))))
    truth = docs.filter("doc_id % 2 = 0").select("path", F.when(F.col("lang") == "en", "real").otherwise("fake").alias("label"), F.col("lang").alias("type"))
    out = reporting.decorated(docs.select("path"), docs.select("path", F.col("n_chars").cast("bigint").alias("length")), truth)
    return out.select("path", "media_kind", "provenance.filename", "provenance.bytes", "ground_truth.type", "ground_truth.label")
