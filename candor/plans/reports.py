"""Queries over findings, summaries, lip-sync, boxes, names and archives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candor.functions import report as rp
from candor.functions import scores as sc
from candor.operators import evaluation as ev
from candor.operators import series as se
from candor.plans.evaluation import WITH, manifest, r6
from candor.plans.registry import query
from candor.sources.tables import FRAMES, SAMPLES, SERIES, frames, samples, series, signals, table


def _smoothed(rows: str, by: str) -> str:
    mean = ", ".join(f"(coalesce(lag({c}) OVER w, 0) + {c} + coalesce(lead({c}) OVER w, 0)) / 3 AS {c}" for c in ("mouth", "audio"))
    return f"(SELECT {by}, i, {mean} FROM {rows} WINDOW w AS (PARTITION BY {by} ORDER BY i))"


def _best(name: str, rows: str, by: str) -> str:
    on = " AND ".join(f"a.{b} = b.{b}" for b in by.split(", "))
    keys = ", ".join(f"a.{b}" for b in by.split(", "))
    return f"""{name}_s AS {_smoothed(rows, by)}, {name}_c AS (SELECT {keys}, lag, round(covar_pop(a.mouth, b.audio) / (stddev_pop(a.mouth) * stddev_pop(b.audio)), 9) AS c
  FROM {name}_s a, lags JOIN {name}_s b ON {on} AND b.i = a.i + lag GROUP BY ALL HAVING count(*) >= 8 AND stddev_pop(a.mouth) >= 1e-9 AND stddev_pop(b.audio) >= 1e-9),
{name} AS (SELECT {by}, lag, c FROM {name}_c QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY c DESC, lag) = 1)"""


@query(f"""WITH {SERIES}, lags AS (SELECT unnest(range(-6, 7))::INT AS lag),
t AS (SELECT kind, quantile_cont(audio, 0.95) AS p95, max(audio) AS top, max(i) AS last FROM series GROUP BY kind),
told AS (SELECT series.*, (top > 1e-6 AND audio > 0.2 * p95)::INT AS speech FROM series JOIN t USING (kind)),
whole AS (SELECT kind, count(*) AS n, avg(speech) AS share, stddev_pop(mouth) AS sd FROM told GROUP BY kind),
st AS (SELECT kind, unnest(range(0, last - 46, 24))::INT AS start FROM t), win AS (SELECT kind, start, i, mouth, audio, speech FROM told JOIN st USING (kind) WHERE i BETWEEN start AND start + 47),
{_best("b", "series", "kind")}, {_best("v", "win", "kind, start")},
loose AS (SELECT kind, start AS s, start + 48 AS e FROM (SELECT kind, start, avg(speech) AS share FROM win GROUP BY ALL) LEFT JOIN v USING (kind, start) WHERE share > 0.4 AND coalesce(c, -1) < 0.08),
r AS (SELECT *, max(e) OVER (PARTITION BY kind ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM loose),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY kind ORDER BY s) AS isle FROM r),
x AS (SELECT kind, string_agg(s || '-' || e, ',' ORDER BY s) AS ranges FROM (SELECT kind, min(s) AS s, max(e) AS e FROM g GROUP BY kind, isle) GROUP BY kind),
z AS (SELECT kind, n < 72 OR share < 0.2 OR sd < 1e-6 AS bad, coalesce(c, -1) AS c, coalesce(lag, 0) AS lag, ranges FROM whole LEFT JOIN b USING (kind) LEFT JOIN x USING (kind)),
q AS (SELECT *, CASE WHEN bad THEN 0.5::DOUBLE ELSE 1 / (1 + exp((c - 0.15) / 0.07)) END AS score FROM z)
SELECT kind, CASE WHEN bad THEN 'not_checked' WHEN score >= 0.5 THEN 'out_of_sync' ELSE 'in_sync' END AS status, round(score, 6) AS score,
  CASE WHEN NOT bad THEN lag END AS lag, CASE WHEN NOT bad AND score >= 0.5 THEN coalesce(ranges, '') END AS ranges FROM q""")
def dec7_lipsync(spark, sf):
    found = se.lipsync(series(spark, sf), ["kind"], 24)
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))), ",")
    return found.select("kind", "status", r6(F.col("score"), "score"), F.col("lag").cast("int").alias("lag"), ranges.alias("ranges"))


_HIGH = {k: v[0].replace("'", "''") for k, v in rp.FINDINGS.items()}
_LOW = {k: v[1].replace("'", "''") for k, v in rp.FINDINGS.items()}
_NAMED = "CASE detector WHEN 'clip' THEN 'clip_probe' ELSE 'frequency' END"
_TEXT = f"""CASE WHEN detector = 'clip' THEN CASE WHEN round(score, 9) > 0.6 THEN '{_HIGH["clip_probe"]}' ELSE '{_LOW["clip_probe"]}' END
  ELSE CASE WHEN round(score, 9) > 0.6 THEN '{_HIGH["frequency"]}' ELSE '{_LOW["frequency"]}' END END"""


def _found(spark, sf):
    name = F.when(F.col("detector") == "clip", "clip_probe").otherwise("frequency")
    score = F.round("score", 9)
    return signals(spark, sf).select("video", "frame", name.alias("name"), score.alias("score"), rp.finding(name, score).alias("finding"))


@query(f"WITH {FRAMES} SELECT video, frame, {_NAMED} AS name, {_TEXT} AS finding FROM signals")
def dec10_findings(spark, sf):
    return _found(spark, sf).select("video", "frame", "name", "finding")


@query(f"""WITH {FRAMES}, s AS (SELECT video, frame, {_NAMED} AS name, round(score, 9) AS score, {_TEXT} AS finding FROM signals),
g AS (SELECT video, frame, round(avg(score), 9) AS p, string_agg(finding, ' ' ORDER BY name) AS every, arg_max(name, {{'s': score, 'n': name}}) AS top, arg_max(finding, {{'s': score, 'n': name}}) AS told FROM s GROUP BY ALL)
SELECT video, frame, CASE WHEN p >= 0.5 THEN 'FAKE (authenticity ' || round_even((1 - p) * 100, 0)::INT || '%). {rp.STRONGEST} (' || top || '): ' || told
  ELSE 'REAL (authenticity ' || round_even((1 - p) * 100, 0)::INT || '%). {rp.CLEAN} ' || every END || ' Confidence: '
  || CASE WHEN abs(p - 0.5) < 0.12 THEN 'low (score is too close to 50%).' ELSE 'medium.' END AS summary FROM g""")
def str9_summary(spark, sf):
    s = _found(spark, sf).groupBy("video", "frame").agg(
        F.round(F.avg("score"), 9).alias("p"),
        F.transform(F.array_sort(F.collect_list(F.struct("name", "finding"))), lambda x: x["finding"]).alias("findings"),
        F.max_by(F.struct("name", "finding"), F.struct("score", "name")).alias("top"),
    )
    p, near = F.col("p"), F.abs(F.col("p") - 0.5) < 0.12
    text = rp.summary(
        p, sc.verdict(p, F.lit(False)), F.when(near, "score is too close to 50%").otherwise(""), F.col("findings"), F.col("top"),
        F.lit(None).cast("string"), F.when(near, "low").otherwise("medium"),
    )
    return s.select("video", "frame", text.alias("summary"))


@query(f"""WITH {FRAMES}, f AS (SELECT video, frame, CASE WHEN frame % 3 > 0 THEN clip END AS clip, CASE WHEN frame % 4 > 0 THEN freq END AS freq FROM frames)
SELECT video, frame, concat_ws(',', CASE WHEN clip IS NULL THEN 'clip_probe' END, CASE WHEN freq IS NULL THEN 'frequency' END) AS skipped,
  concat_ws(' ', CASE WHEN clip IS NULL OR freq IS NULL THEN '{rp.NOT_TRAINED}' END, CASE WHEN video % 2 = 0 THEN '{rp.NO_FACE}' END) AS caveats FROM f""")
def dec9_caveats(spark, sf):
    f = frames(spark, sf)
    missing = rp.skipped({"clip_probe": F.when(F.col("frame") % 3 > 0, F.col("clip")), "frequency": F.when(F.col("frame") % 4 > 0, F.col("freq"))})
    notes = rp.caveats(missing, F.col("video") % 2 != 0)
    return f.select("video", "frame", F.array_join(missing, ",").alias("skipped"), F.array_join(notes, " ").alias("caveats"))


@query(f"WITH {FRAMES} SELECT video, frame, CASE WHEN round(clip, 9) < 0.35 THEN 'good' WHEN round(clip, 9) < 0.65 THEN 'warn' ELSE 'bad' END AS tone, round_even(round(clip, 9) * 100, 0)::INT || '%' AS pct FROM frames")
def dec13_tone(spark, sf):
    p = F.round("clip", 9)
    return frames(spark, sf).select("video", "frame", rp.tone(p).alias("tone"), rp.percent(p).alias("pct"))


@query("""SELECT kind, status, CASE status WHEN 'in_sync' THEN 'IN SYNC' WHEN 'out_of_sync' THEN 'OUT OF SYNC' WHEN 'not_checked' THEN 'NOT CHECKED' END AS label
FROM (SELECT event_id AS kind, ['in_sync', 'out_of_sync', 'not_checked', 'other'][event_id % 4 + 1] AS status FROM events)""")
def str12_lipsync_label(spark, sf):
    status = F.element_at(F.array(*[F.lit(s) for s in (*rp.LABELS, "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("kind"), status.alias("status"), rp.lipsync_label(status).alias("label"))


_CONDITIONS = (("clean", 1.0), ("jpeg75", 1.1), ("half", 1.2))


@query(f"""{WITH}, d(name, f) AS (VALUES ('clean', 1.0::DOUBLE), ('jpeg75', 1.1::DOUBLE), ('half', 1.2::DOUBLE)),
g AS (SELECT name, avg((p * f >= 0.5)::INT) AS fpr FROM m, d WHERE split = 'test' AND label = 'real' GROUP BY name),
w AS (SELECT max(fpr) FILTER (name = 'clean') AS base, arg_max(name, {{'f': fpr, 'n': name}}) AS name, max(fpr) AS fpr FROM g)
SELECT name, round(base, 6) AS base, round(fpr, 6) AS fpr, fpr > base + 0.02 AS stands_out FROM w""")
def dec12_worst_fpr(spark, sf):
    grid = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("f")) for n, f in _CONDITIONS]))
    rows = manifest(spark, sf).filter("split = 'test' AND label = 'real'").select("p", grid)
    g = rows.groupBy("name").agg(F.avg((F.col("p") * F.col("f") >= 0.5).cast("int")).alias("fpr"))
    w = g.agg(F.max(F.when(F.col("name") == "clean", F.col("fpr"))).alias("base"), F.max(F.struct("fpr", "name")).alias("worst")).select("base", "worst.*")
    return w.select("name", r6(F.col("base"), "base"), r6(F.col("fpr"), "fpr"), (F.col("fpr") > F.col("base") + 0.02).alias("stands_out"))


@query(f"WITH {FRAMES} SELECT video, frame, detector FROM signals WHERE frame % 2 = 0 AND detector <> 'ela' AND detector IN ('clip', 'freq')")
def fil2_reliable(spark, sf):
    reliable = F.col("frame") % 2 == 0
    return signals(spark, sf).filter(reliable & (F.col("detector") != "ela") & F.col("detector").isin("clip", "freq")).select("video", "frame", "detector")


@query(f"{WITH} SELECT path FROM m WHERE split = 'test' AND path IN (SELECT doc_id FROM documents) AND ['.jpg', '.png', '.wav'][path % 3 + 1] <> '.wav'")
def fil7_sample_eligibility(spark, sf):
    there = table(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    ext = F.element_at(F.array(F.lit(".jpg"), F.lit(".png"), F.lit(".wav")), (F.col("path") % 3 + 1).cast("int"))
    return manifest(spark, sf).filter(F.col("split") == "test").filter(ext.isin(".jpg", ".jpeg", ".png", ".webp")).join(there, "path", "left_semi").select("path")


@query("""WITH s AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) t),
f AS (SELECT f::INT AS frame, floor(f * 7.5::DOUBLE) AS lo, floor((f + 1) * 7.5::DOUBLE) AS hi FROM (SELECT unnest(range(0, 9)) AS f) t)
SELECT vec_id, frame, round(sqrt(avg(x * x) + 1e-12), 6) AS rms FROM s JOIN f ON i >= lo AND i < hi GROUP BY ALL""")
def jn11_frame_loudness(spark, sf):
    # frame f holds the samples from floor(f * hop) up to floor((f + 1) * hop), so sample i is in the least f with i + 1 <= (f + 1) * hop
    s = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    frame = (F.ceil((F.col("i") + 1) / 7.5) - 1).cast("int")
    return s.groupBy("vec_id", frame.alias("frame")).agg(r6(F.sqrt(F.avg(F.col("x") * F.col("x")) + F.lit(1e-12)), "rms"))


@query("""WITH s AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) t),
b AS (SELECT vec_id, least(floor(sqrt((i // 8 - 4) * (i // 8 - 4) + (i % 8 - 4) * (i % 8 - 4))), 3)::INT AS ring, avg(x) AS mean FROM s GROUP BY ALL)
SELECT vec_id, ring, round(mean - first_value(mean) OVER (PARTITION BY vec_id ORDER BY ring), 6) + 0 AS profile FROM b""")
def agg18_radial_profile(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    dy, dx = F.floor(F.col("i") / 8) - 4, F.col("i") % 8 - 4
    ring = F.least(F.floor(F.sqrt(dy * dy + dx * dx)), F.lit(3)).cast("int")
    b = s.groupBy("vec_id", ring.alias("ring")).agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return b.select("vec_id", "ring", r6(F.col("mean") - F.first("mean").over(Window.partitionBy("vec_id").orderBy("ring")), "profile"))


@query(f"WITH {SERIES} SELECT kind, i, round((audio - avg(audio) OVER w) / (stddev_pop(audio) OVER w + 1e-7), 5) + 0 AS x FROM series WINDOW w AS (PARTITION BY kind)")
def mth12_waveform(spark, sf):
    w = Window.partitionBy("kind")
    x = (F.col("audio") - F.avg("audio").over(w)) / (F.stddev_pop("audio").over(w) + F.lit(1e-7))
    return series(spark, sf).select("kind", "i", (F.round(x, 5) + F.lit(0.0)).alias("x"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events")
def mth13_nan_to_null(spark, sf):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", F.when(~F.isnan(x), x).alias("value"))


@query("""WITH b AS (SELECT o_orderkey AS id, (o_orderkey % 200)::INT AS x, (o_orderkey % 150)::INT AS y, (48 + o_orderkey % 90)::INT AS w, (48 + o_orderkey % 70)::INT AS h FROM orders)
SELECT id, x + floor(0.2::DOUBLE * w)::INT AS x0, x + floor(0.8::DOUBLE * w)::INT AS x1, y + floor(0.6::DOUBLE * h)::INT AS y0, y + h AS y1 FROM b""")
def mth15_mouth_box(spark, sf):
    o = F.col("o_orderkey")
    i = lambda c: c.cast("int")
    box = rp.mouth_box(i(o % 200), i(o % 150), i(48 + o % 90), i(48 + o % 70))
    return table(spark, sf, "orders").select(o.alias("id"), box.alias("b")).select("id", "b.*")


@query("""SELECT c_custkey, nullif(trim(concat_ws(' ', trim(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ' ' ELSE '' END), trim(CASE WHEN c_custkey % 2 > 0 THEN c_name ELSE '' END))), '') AS camera FROM customer""")
def str5_camera(spark, sf):
    make = F.when(F.col("c_custkey") % 3 > 0, F.concat("c_mktsegment", F.lit(" ")))
    model = F.when(F.col("c_custkey") % 2 > 0, F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", sc.camera(make, model).alias("camera"))


@query("SELECT l_orderkey AS image, arg_max(l_linenumber, {'a': l_quantity * l_linenumber, 'n': -l_linenumber})::INT AS face FROM lineitem GROUP BY l_orderkey")
def srt2_largest_face(spark, sf):
    area = F.col("l_quantity") * F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(
        F.max_by("l_linenumber", F.struct(area, -F.col("l_linenumber"))).cast("int").alias("face")
    )


@query(f"WITH {FRAMES} SELECT video, string_agg(DISTINCT detector, ',' ORDER BY detector) AS used FROM signals WHERE score > 0 GROUP BY video")
def srt4_sorted_names(spark, sf):
    return signals(spark, sf).filter("score > 0").groupBy("video").agg(F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("used"))


@query("WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR), user_id) AS place FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)) SELECT user_id, place FROM g WHERE place <= 20")
def srt6_identity_shuffle(spark, sf):
    ids = table(spark, sf, "events").select("user_id").filter("user_id IS NOT NULL").distinct().withColumn("k", F.md5(F.col("user_id").cast("string")))
    return ev.global_rank(ids, "k", "user_id").filter("rank <= 20").select("user_id", F.col("rank").alias("place"))


@query(f"WITH {SAMPLES} SELECT source_id FROM samples WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(DISTINCT type) > 1 ORDER BY source_id LIMIT 5")
def srt7_head(spark, sf):
    several = samples(spark, sf).filter("source_id IS NOT NULL").groupBy("source_id").agg(F.count_distinct("type").alias("n")).filter("n > 1")
    return several.orderBy("source_id").limit(5).select("source_id")


@query("SELECT c AS missing FROM (VALUES ('path'), ('label'), ('type'), ('source_id'), ('split'), ('doc_id'), ('text')) v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE documents))")
def set4_missing_columns(spark, sf):
    wanted = {"path", "label", "type", "source_id", "split", "doc_id", "text"}
    return spark.createDataFrame([(c,) for c in sorted(wanted - set(table(spark, sf, "documents").columns))], "missing string")


@query("""WITH f AS (SELECT o_orderkey AS video, list_distinct(list_transform(range(0, 8), lambda k: (k * (o_orderkey % 3000)) // 7)) AS l FROM orders),
u AS (SELECT video, unnest(l)::BIGINT AS frame FROM f)
SELECT video, frame, printf('%d__f%02d.jpg', video, row_number() OVER (PARTITION BY video ORDER BY frame) - 1) AS name FROM u""")
def src5_frame_names(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video"), F.posexplode(se.frame_sample(F.col("o_orderkey") % 3000 + 1, 8)).alias("n", "frame"))
    return f.select("video", "frame", F.format_string("%d__f%02d.jpg", "video", "n").alias("name"))


@query("SELECT page_id, split_part(regexp_extract(split_part(url, '?', 1), '([^/]*?)(\\.[^./]*)?$', 1) || '__f03', '__', 1) AS source_id FROM pages")
def src10_source_ids(spark, sf):
    stem = F.regexp_extract(F.split_part("url", F.lit("?"), F.lit(1)), r"([^/]*?)(\.[^./]*)?$", 1)
    return table(spark, sf, "pages").select("page_id", F.split_part(F.concat(stem, F.lit("__f03")), F.lit("__"), F.lit(1)).alias("source_id"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def src15_row_groups(spark, sf):
    return ev.first_n(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 10).select("lang", "doc_id")


@query(f"""WITH {FRAMES}, f AS (SELECT video, frame, CASE WHEN frame % 3 > 0 THEN clip END AS clip, freq FROM frames),
p AS (SELECT video, frame, CASE WHEN clip IS NULL THEN freq ELSE 1 / (1 + exp(-(2 * clip + freq - 1))) END AS p, CASE WHEN clip IS NULL THEN 0 ELSE 0.3 END AS shift FROM f)
SELECT video, frame, round(1 / (1 + exp(-(ln((p + 1e-6) / (1 - p + 1e-6)) + shift))), 6) AS p FROM p""")
def ml6_judge_apply(spark, sf):
    clip = F.when(F.col("frame") % 3 > 0, F.col("clip"))
    model = sc.sigmoid(2 * clip + F.col("freq") - 1)
    p = sc.fuse([clip, F.col("freq")], F.lit(0.0), F.lit(False), model, F.lit(0.3))
    return frames(spark, sf).select("video", "frame", r6(p, "p"))


@query("""WITH v AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT label, vec_id, round(coalesce(list_sum(list_transform(range(1, 65), lambda k: abs(embedding[k]::DOUBLE - before[k]::DOUBLE))) / 64, 0), 6) AS motion FROM v""")
def krn11_mouth_motion(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("before", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    diff = F.zip_with("embedding", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    motion = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / 64
    return v.select("label", "vec_id", r6(F.coalesce(motion, F.lit(0.0)), "motion"))
