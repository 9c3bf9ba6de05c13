"""Queries over frame scores and per-frame series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candor.functions import scores as sc
from candor.operators import evaluation as ev
from candor.operators import series as se
from candor.plans.registry import query
from candor.sources.tables import FRAMES, META, SERIES, frames, meta, series, signals, table


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)  # no negative zero


@query(f"WITH {FRAMES} SELECT video, detector, round(avg(score), 6) AS mean FROM signals GROUP BY ALL")
def agg10_frame_mean(spark, sf):
    return signals(spark, sf).groupBy("video", "detector").agg(r6(F.avg("score"), "mean"))


@query(f"WITH {FRAMES} SELECT video, frame, round(avg(score), 6) AS mean FROM signals GROUP BY ALL")
def agg11_frame_cross_detector(spark, sf):
    return signals(spark, sf).groupBy("video", "frame").agg(r6(F.avg("score"), "mean"))


@query(f"WITH {FRAMES}, d AS (SELECT video, detector, stddev_pop(score) AS sd FROM signals GROUP BY ALL) SELECT video, round(avg(sd), 9) AS inconsistency, round(least(1, 2 * avg(sd)), 9) AS score FROM d GROUP BY video")
def agg12_inconsistency(spark, sf):
    d = signals(spark, sf).groupBy("video", "detector").agg(F.stddev_pop("score").alias("sd")).groupBy("video").agg(F.avg("sd").alias("x"))
    return d.select("video", F.round("x", 9).alias("inconsistency"), F.round(sc.consistency_score(F.col("x")), 9).alias("score"))


@query(f"WITH {FRAMES} SELECT video, detector, count(*) AS n, round(max(score), 6) AS most, round(stddev_pop(score), 6) AS sd FROM signals GROUP BY ALL")
def agg13_frame_stats(spark, sf):
    return signals(spark, sf).groupBy("video", "detector").agg(F.count("*").alias("n"), r6(F.max("score"), "most"), r6(F.stddev_pop("score"), "sd"))


@query(f"""WITH {FRAMES}, f AS (SELECT video, frame, round((clip + freq) / 2, 9) AS mean FROM frames)
SELECT video, frame, round(mean, 3) AS score, row_number() OVER (PARTITION BY video ORDER BY mean DESC, frame)::INT AS rn FROM f QUALIFY rn <= 3""")
def win8_top3_frames(spark, sf):
    f = frames(spark, sf).withColumn("mean", F.round((F.col("clip") + F.col("freq")) / 2, 9))
    return ev.first_n(f, ["video"], [F.desc("mean"), "frame"], 3).select("video", "frame", F.round("mean", 3).alias("score"), F.col("rn").cast("int").alias("rn"))


@query(f"WITH {FRAMES} SELECT video, frame, round(1 - abs(clip - freq), 6) AS agreement, round(abs(clip - freq), 6) AS spread FROM frames")
def agg20_agreement(spark, sf):
    a = sc.agreement([F.col("clip"), F.col("freq")])
    return frames(spark, sf).select("video", "frame", r6(a, "agreement"), r6(1 - a, "spread"))


@query(f"WITH {FRAMES} SELECT video, frame, round(max(score) FILTER (detector = 'clip'), 6) AS clip, round(max(score) FILTER (detector = 'freq'), 6) AS freq FROM signals GROUP BY ALL")
def jn9_pivot_scores(spark, sf):
    p = signals(spark, sf).groupBy("video", "frame").pivot("detector", ["clip", "freq"]).agg(F.max("score"))
    return p.select("video", "frame", r6(F.col("clip"), "clip"), r6(F.col("freq"), "freq"))


@query(f"WITH {FRAMES} SELECT video, frame, detector FROM signals WHERE round(score, 9) > 0.6")
def fil4_flagged(spark, sf):
    return signals(spark, sf).filter(F.round("score", 9) > 0.6).select("video", "frame", "detector")


@query(f"WITH {FRAMES} SELECT video, frame, arg_max(detector, {{'s': round(score, 9), 'd': detector}}) AS top FROM signals GROUP BY ALL")
def srt3_top_detector(spark, sf):
    return signals(spark, sf).groupBy("video", "frame").agg(F.max_by("detector", F.struct(F.round("score", 9), "detector")).alias("top"))


_FUSE = f"""{FRAMES}, {META}, j AS (SELECT video, frame, clip, freq, min_side, ai_marker IS NOT NULL AS ai,
  CASE WHEN ai_marker IS NOT NULL THEN 4.0::DOUBLE WHEN editor IS NOT NULL THEN 0.3::DOUBLE WHEN camera IS NOT NULL THEN -0.4::DOUBLE ELSE 0.0::DOUBLE END AS shift
  FROM frames JOIN meta ON video % 1000 = media),
p AS (SELECT *, (clip + freq) / 2 AS m FROM j), q AS (SELECT *, 1 / (1 + exp(-(ln((m + 1e-6) / (1 - m + 1e-6)) + shift))) AS z FROM p),
z AS (SELECT *, CASE WHEN ai THEN greatest(z, 0.97::DOUBLE) ELSE z END AS score FROM q)"""


def _fused(spark, sf):
    j = frames(spark, sf).join(meta(spark, sf), F.col("video") % 1000 == F.col("media"))
    ai = F.col("ai_marker").isNotNull()
    shift = sc.metadata_signal(F.col("ai_marker"), F.col("editor"), F.col("camera"))["shift"]
    return j.withColumn("shift", shift).withColumn("score", sc.fuse([F.col("clip"), F.col("freq")], F.col("shift"), ai)).withColumn("ai", ai)


@query(f"WITH {_FUSE} SELECT video, frame, round(score, 6) AS p, CASE WHEN ai OR score >= 0.5 THEN 'likely_fake' ELSE 'likely_real' END AS verdict FROM z")
def dec2_fuse(spark, sf):
    return _fused(spark, sf).select("video", "frame", r6(F.col("score"), "p"), sc.verdict(F.col("score"), F.col("ai")).alias("verdict"))


# what the file declares leaves no doubt; else the first that applies
_REASON = """CASE WHEN ai THEN '' WHEN min_side < 64 THEN 'input is very low resolution (' || min_side || 'px)'
  WHEN round(abs(clip - freq), 9) > 0.6 THEN 'detectors strongly disagree' WHEN abs(round(score, 9) - 0.5) < 0.12 THEN 'score is too close to 50%' ELSE '' END"""


def _judged(spark, sf):
    z = _fused(spark, sf)
    return z.withColumn("reason", sc.judged([F.col("clip"), F.col("freq")], F.col("shift"), F.col("ai"), F.col("min_side"))["reason"])


@query(f"WITH {_FUSE} SELECT video, frame, {_REASON} AS reason FROM z")
def dec3_reason(spark, sf):
    return _judged(spark, sf).select("video", "frame", "reason")


@query(f"""WITH {_FUSE}, v AS (SELECT DISTINCT media, jpeg_quality FROM meta), c AS (SELECT video, frame, {_REASON} AS reason, abs(score - 0.5) * 2 * (1 - abs(clip - freq))
  * (CASE WHEN jpeg_quality < 80 THEN 0.75::DOUBLE ELSE 1 END) * (CASE WHEN min_side < 256 THEN 0.6::DOUBLE ELSE 1 END) AS conf,
  (CASE WHEN jpeg_quality < 80 THEN 0.75::DOUBLE ELSE 1 END) * (CASE WHEN min_side < 256 THEN 0.6::DOUBLE ELSE 1 END) AS quality FROM z JOIN v ON video % 1000 = media)
SELECT video, frame, round(conf, 8) AS score, CASE WHEN reason <> '' THEN 'low' WHEN round(conf, 9) >= 0.55 THEN 'high' WHEN round(conf, 9) >= 0.3 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN quality >= 0.95 THEN 'good' WHEN quality >= 0.6 THEN 'degraded' ELSE 'poor' END AS input_quality FROM c""")
def dec4_confidence(spark, sf):
    z = _judged(spark, sf)
    q = sc.input_quality(F.col("jpeg_quality"), F.col("min_side"), F.lit(True))
    c = sc.confidence(F.col("score"), sc.agreement([F.col("clip"), F.col("freq")]), q, F.lit(1.0))
    return z.select(
        "video", "frame", F.round(c, 8).alias("score"), sc.confidence_level(F.round(c, 9), F.lit(2), F.col("reason")).alias("level"), sc.input_quality_label(q).alias("input_quality")
    )


@query(f"WITH {FRAMES} SELECT video, frame, CASE WHEN abs(round(clip, 9) - 0.5) < 0.12 THEN 'inconclusive' WHEN round(clip, 9) >= 0.5 THEN 'likely_fake' ELSE 'likely_real' END AS verdict FROM frames")
def dec8_audio_verdict(spark, sf):
    return frames(spark, sf).select("video", "frame", sc.audio_verdict(F.round("clip", 9)).alias("verdict"))


@query(f"WITH {FRAMES} SELECT video, frame, round(1 / (1 + exp(-(ln((clip + 1e-6) / (1 - clip + 1e-6)) + 0.3))), 6) AS p, round(-ln((freq + 1e-6) / (1 - freq + 1e-6)), 6) + 0 AS shift FROM frames")
def mth1_logit_nudge(spark, sf):
    return frames(spark, sf).select("video", "frame", r6(sc.nudge(F.col("clip"), F.lit(0.3)), "p"), r6(sc.calibration_shift(F.col("freq")), "shift"))


@query(f"WITH {FRAMES} SELECT video, frame, round(1 / (1 + exp((clip - 0.15) / 0.07)), 6) AS corr_score, round(1 / (1 + exp(-(10 * clip - 5) / 0.8)), 6) AS ela, round(greatest(0, least(1, (4 * freq - 1) / 3)), 6) AS heat FROM frames")
def mth3_corr_score(spark, sf):
    return frames(spark, sf).select(
        "video", "frame", r6(sc.correlation_score(F.col("clip")), "corr_score"), r6(sc.ela_score(F.col("clip") * 10), "ela"), r6(sc.ela_heat(F.col("freq") * 4), "heat")
    )


@query(f"WITH {FRAMES} SELECT video, frame, round(CASE WHEN frame % 3 = 0 THEN 0 WHEN round(clip, 9) >= 0.5 THEN 1.5 * (2 * clip - 1) ELSE -0.4 * (1 - 2 * clip) END, 6)::DOUBLE + 0 AS shift FROM frames")
def mth5_lipsync_shift(spark, sf):
    return frames(spark, sf).select("video", "frame", r6(sc.lipsync_shift(F.col("clip"), F.col("frame") % 3 != 0), "shift"))


@query(f"WITH {SERIES} SELECT kind, i, round((coalesce(lag(mouth) OVER w, 0) + mouth + coalesce(lead(mouth) OVER w, 0)) / 3, 6) AS smooth FROM series WINDOW w AS (PARTITION BY kind ORDER BY i)")
def win1_smooth(spark, sf):
    return series(spark, sf).select("kind", "i", r6(se.smooth("mouth", ["kind"]), "smooth"))


@query(f"WITH {SERIES} SELECT kind, i, round(CASE WHEN stddev_pop(audio) OVER w > 1e-9 THEN (audio - avg(audio) OVER w) / stddev_pop(audio) OVER w ELSE 0 END, 5) + 0 AS z FROM series WINDOW w AS (PARTITION BY kind)")
def win2_zscore(spark, sf):
    return series(spark, sf).select("kind", "i", (F.round(se.zscore("audio", ["kind"]), 5) + F.lit(0.0)).alias("z"))


@query(f"WITH {SERIES} SELECT kind, i, round(coalesce(abs(mouth - lag(mouth) OVER (PARTITION BY kind ORDER BY i)), 0), 6) AS motion FROM series")
def win3_frame_diff(spark, sf):
    return series(spark, sf).select("kind", "i", r6(se.difference("mouth", ["kind"]), "motion"))


@query("""WITH t AS (SELECT o_orderkey AS clip, (o_orderkey * 7919 % 400000)::BIGINT AS n FROM orders)
SELECT clip, unnest(CASE WHEN n <= 48000 THEN [0::BIGINT] ELSE range(0, n - 24000, 48000) END) AS start FROM t""")
def win4_tumbling_windows(spark, sf):
    n = (F.col("o_orderkey") * 7919 % 400000).cast("bigint")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip"), F.explode(se.audio_windows(n)).alias("start"))


_LAG = f"""{SERIES}, lags AS (SELECT unnest(range(-6, 7))::INT AS lag),
c AS (SELECT a.kind, lag, count(*) AS n, covar_pop(a.mouth, b.audio) AS cv, stddev_pop(a.mouth) AS sx, stddev_pop(b.audio) AS sy
  FROM series a, lags JOIN series b ON b.kind = a.kind AND b.i = a.i + lag GROUP BY ALL),
k AS (SELECT kind, lag, n, cv / (sx * sy) AS c FROM c WHERE n >= 8 AND sx >= 1e-9 AND sy >= 1e-9)"""


@query(f"WITH {_LAG} SELECT kind, lag, n, round(c, 6) + 0 AS c FROM k", name="agg17_lag_correlation")
def agg17_lag_corr(spark, sf):
    return se.lag_correlation(series(spark, sf), ["kind"], "mouth", "audio", 6).select("kind", "lag", "n", r6(F.col("c"), "c"))


@query(f"WITH {_LAG}, q AS (SELECT kind, lag, round(c, 9) AS c FROM k) SELECT kind, lag, round(c, 6) + 0 AS c FROM q QUALIFY row_number() OVER (PARTITION BY kind ORDER BY c DESC, lag) = 1")
def win7_best_lag(spark, sf):
    c = se.lag_correlation(series(spark, sf), ["kind"], "mouth", "audio", 6).withColumn("c", F.round("c", 9))
    return se.best_lag(c, ["kind"]).select("kind", "lag", r6(F.col("c"), "c"))


@query(f"""WITH {SERIES}, e AS (SELECT kind, max(i) AS last FROM series GROUP BY kind), s AS (SELECT kind, unnest(range(0, last - 22, 12))::INT AS start FROM e)
SELECT kind, start, count(*) AS n, round(sum(mouth), 6) AS total FROM s JOIN series USING (kind) WHERE i BETWEEN start AND start + 23 GROUP BY ALL""")
def win5_hop_windows(spark, sf):
    w = se.hop_windows(series(spark, sf), ["kind"], 24)
    return w.groupBy("kind", F.col("start").cast("int").alias("start")).agg(F.count("*").alias("n"), r6(F.sum("mouth"), "total"))


@query(f"""WITH {SERIES}, w AS (SELECT kind, i AS s, i + 3 AS e FROM series WHERE mouth >= 4), r AS (SELECT *, max(e) OVER (PARTITION BY kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY kind ORDER BY s, e) AS isle FROM r) SELECT kind, min(s) AS s, max(e) AS e FROM g GROUP BY kind, isle""")
def win6_coalesce(spark, sf):
    w = series(spark, sf).filter("mouth >= 4").select("kind", F.col("i").alias("s"), (F.col("i") + 3).alias("e"))
    return se.coalesce_ranges(w, ["kind"])


@query(f"WITH {SERIES}, q AS (SELECT kind, quantile_cont(audio, 0.95) AS p95, max(audio) AS top FROM series GROUP BY kind) SELECT kind, i, (top > 1e-6 AND audio > 0.2 * p95) AS speech FROM series JOIN q USING (kind)")
def win9_speech_mask(spark, sf):
    s = series(spark, sf)
    q = s.groupBy("kind").agg(F.percentile("audio", F.lit(0.95)).alias("p95"), F.max("audio").alias("top"))
    return s.join(F.broadcast(q), "kind").select("kind", "i", ((F.col("top") > 1e-6) & (F.col("audio") > 0.2 * F.col("p95"))).alias("speech"))


@query(f"WITH {SERIES} SELECT kind, round(quantile_cont(audio, 0.5), 6) AS p50, round(quantile_cont(audio, 0.95), 6) AS p95, round(quantile_cont(audio, 0.99), 6) AS p99 FROM series GROUP BY kind")
def agg15_percentiles(spark, sf):
    p = lambda x: F.percentile("audio", F.lit(x))
    return series(spark, sf).groupBy("kind").agg(r6(p(0.5), "p50"), r6(p(0.95), "p95"), r6(p(0.99), "p99"))


@query(f"WITH {SERIES} SELECT kind, (i // 24)::INT AS day, round(sqrt(avg(mouth * mouth) + 1e-12), 6) AS rms FROM series GROUP BY ALL")
def agg16_rms(spark, sf):
    return series(spark, sf).groupBy("kind", F.floor(F.col("i") / 24).cast("int").alias("day")).agg(r6(F.sqrt(F.avg(F.col("mouth") * F.col("mouth")) + F.lit(1e-12)), "rms"))


@query("""WITH u AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) t)
SELECT label, (i - 1)::INT AS i, round(avg(x), 6) + 0 AS mean, round(stddev_samp(x), 6) AS sd FROM u GROUP BY ALL""")
def agg19_pooling(spark, sf):
    u = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return u.groupBy("label", "i").agg(r6(F.avg("x"), "mean"), r6(F.stddev_samp("x"), "sd"))


@query("""SELECT o_orderkey AS video, unnest(list_distinct(list_transform(range(0, 16), lambda k: (k * (o_orderkey % 3000)) // 15)))::BIGINT AS frame FROM orders""")
def src4_frame_sampler(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("video"), F.explode(se.frame_sample(F.col("o_orderkey") % 3000 + 1)).alias("frame"))


@query(f"""WITH {SERIES}, g AS (SELECT kind, count(*) AS n, avg((audio > 50)::INT) AS speech, stddev_pop(mouth) AS sd FROM series GROUP BY kind)
SELECT kind, CASE WHEN n < 75 THEN 'clip is shorter than 3 seconds' WHEN round(speech, 9) < 0.2 THEN 'little or no speech in the audio' WHEN sd < 1e-6 THEN 'no mouth movement could be measured' ELSE 'checked' END AS status FROM g""")
def dec6_lipsync_gates(spark, sf):
    g = series(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.avg((F.col("audio") > 50).cast("int")).alias("speech"), F.stddev_pop("mouth").alias("sd"))
    return g.select("kind", sc.lipsync_gate(F.col("n"), F.lit(25.0), F.lit(1.0), F.round("speech", 9), F.col("sd")).alias("status"))


@query(f"WITH {FRAMES}, o AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0) SELECT video, count(*) AS frames, CASE WHEN any_value(o_totalprice) IS NULL THEN 'no audio track' ELSE 'ok' END AS audio FROM frames LEFT JOIN o ON video = o_orderkey GROUP BY video")
def jn13_soundtrack(spark, sf):
    audio = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice")
    clips = frames(spark, sf).groupBy("video").agg(F.count("*").alias("frames"))
    joined = clips.join(audio, F.col("video") == F.col("o_orderkey"), "left")
    return joined.select("video", "frames", F.when(F.col("o_totalprice").isNull(), "no audio track").otherwise("ok").alias("audio"))
