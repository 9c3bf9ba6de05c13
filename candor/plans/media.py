"""Queries over files, metadata, vectors and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from candor.functions import scores as sc
from candor.plans.registry import query
from candor.sources.tables import META, meta, table


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)  # no negative zero


@query(f"""WITH {META} SELECT media, CASE WHEN ai_marker IS NOT NULL THEN 0.97::DOUBLE WHEN editor IS NOT NULL THEN 0.55::DOUBLE WHEN camera IS NOT NULL THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END AS score,
  ai_marker IS NOT NULL AS decisive, CASE WHEN ai_marker IS NOT NULL THEN 4.0::DOUBLE WHEN editor IS NOT NULL THEN 0.3::DOUBLE WHEN camera IS NOT NULL THEN -0.4::DOUBLE ELSE 0.0::DOUBLE END AS shift FROM meta""")
def dec1_metadata_signal(spark, sf):
    s = sc.metadata_signal(F.col("ai_marker"), F.col("editor"), F.col("camera"))
    return meta(spark, sf).select("media", s["score"].alias("score"), s["decisive"].alias("decisive"), s["shift"].alias("shift"))


@query(f"WITH {META} SELECT media, (jpeg_quality IS NULL OR jpeg_quality < 88 OR min_side < 256) AS unreliable FROM meta")
def fil5_ela_reliability(spark, sf):
    return meta(spark, sf).select("media", sc.ela_unreliable(F.col("jpeg_quality"), F.col("min_side")).alias("unreliable"))


@query(f"WITH {META}, s AS (SELECT media, 100 * jpeg_quality / 57.625 AS scale FROM meta) SELECT media, round(CASE WHEN scale <= 200 THEN (200 - scale) / 2 ELSE 5000 / scale END, 6)::DOUBLE AS quality FROM s")
def mth9_jpeg_quality(spark, sf):
    return meta(spark, sf).select("media", r6(sc.jpeg_quality(F.col("jpeg_quality")), "quality"))


@query("""WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
SELECT vec_id, round(embedding[1] / norm, 6) + 0 AS first, round(embedding[64] / norm, 6) + 0 AS last FROM v""")
def mth10_l2(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("v", sc.l2_normalise(F.transform("embedding", lambda x: x * 3)))
    return v.select("vec_id", r6(F.get("v", F.lit(0)), "first"), r6(F.get("v", F.lit(63)), "last"))


@query("""WITH b AS (SELECT o_orderkey AS id, (o_orderkey % 200)::INT AS x, (o_orderkey % 150)::INT AS y, CASE WHEN o_orderkey % 5 > 0 THEN (48 + o_orderkey % 90)::INT END AS w, (48 + o_orderkey % 70)::INT AS h FROM orders),
m AS (SELECT *, floor(0.3::DOUBLE * greatest(w, h))::INT AS m FROM b)
SELECT id, CASE WHEN w IS NULL THEN 40 ELSE greatest(0, x - m) END AS x0, CASE WHEN w IS NULL THEN 0 ELSE greatest(0, y - m) END AS y0,
  CASE WHEN w IS NULL THEN 280 ELSE least(320, x + w + m) END AS x1, CASE WHEN w IS NULL THEN 240 ELSE least(240, y + h + m) END AS y1 FROM m""")
def mth14_boxes(spark, sf):
    o = F.col("o_orderkey")
    box = sc.face_box((o % 200).cast("int"), (o % 150).cast("int"), F.when(o % 5 > 0, (48 + o % 90).cast("int")), (48 + o % 70).cast("int"), F.lit(320), F.lit(240))
    return table(spark, sf, "orders").select(o.alias("id"), box.alias("b")).select("id", "b.*")


_HAY = "html || CASE WHEN page_id % 3 = 0 THEN ' Made with Stable Diffusion' WHEN page_id % 3 = 1 THEN ' Edited in GIMP 2' ELSE '' END"


def _hay():
    return F.concat("html", F.when(F.col("page_id") % 3 == 0, " Made with Stable Diffusion").when(F.col("page_id") % 3 == 1, " Edited in GIMP 2").otherwise(""))


@query(f"""SELECT page_id, regexp_matches({_HAY}, '{sc.AI_TOOLS}') AS ai, regexp_matches({_HAY}, '{sc.GENERATION}') AS generation, regexp_matches({_HAY}, '{sc.EDITORS}') AS edited FROM pages""")
def str1_marker_patterns(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", _hay().rlike(sc.AI_TOOLS).alias("ai"), _hay().rlike(sc.GENERATION).alias("generation"), _hay().rlike(sc.EDITORS).alias("edited")
    )


@query("SELECT page_id, contains(substr(html, 1, 2000000), 'c2pa') OR contains(substr(html, 1, 2000000), 'jumbf') AS c2pa, contains(substr(html, 1, 2000000), 'DOCTYPE') AS doctype FROM pages")
def src2_byte_markers(spark, sf):
    head = F.substring("html", 1, 2_000_000)
    return table(spark, sf, "pages").select("page_id", (head.contains("c2pa") | head.contains("jumbf")).alias("c2pa"), head.contains("DOCTYPE").alias("doctype"))


_PATH = "doc_id || '.' || ['jpg', 'PNG', 'mp4', 'wav', 'txt', 'WebP', 'm4a'][doc_id % 7 + 1]"


@query(f"""WITH p AS (SELECT doc_id, lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM documents)
SELECT doc_id, CASE WHEN e IN ('jpg', 'png', 'webp') THEN 'image' WHEN e = 'mp4' THEN 'video' WHEN e IN ('wav', 'm4a') THEN 'audio' END AS kind FROM p""")
def src3_dispatch(spark, sf):
    ends = F.array(*[F.lit(x) for x in ("jpg", "PNG", "mp4", "wav", "txt", "WebP", "m4a")])
    path = F.concat_ws(".", F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", sc.media_kind(path).alias("kind"))


@query("SELECT page_id, split_part(split_part(url, '/', -1), '?', 1) AS stem, md5(concat_ws('|', 'clip', 'clean', url)) AS cache_key FROM pages")
def str7_str8_keys(spark, sf):
    stem = F.split_part(F.split_part("url", F.lit("/"), F.lit(-1)), F.lit("?"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", stem.alias("stem"), F.md5(F.concat_ws("|", F.lit("clip"), F.lit("clean"), "url")).alias("cache_key"))


@query("SELECT doc_id, md5(concat_ws('|', 'clip', 'clean', doc_id::VARCHAR)) AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def src16_cache_miss(spark, sf):
    key = F.md5(F.concat_ws("|", F.lit("clip"), F.lit("clean"), F.col("doc_id").cast("string")))
    have = table(spark, sf, "labels").select(key.alias("cache_key"))
    return table(spark, sf, "documents").select("doc_id", key.alias("cache_key")).join(have, "cache_key", "left_anti").select("doc_id", "cache_key")


@query("SELECT source, (n_chars % 97)::BIGINT AS file FROM documents GROUP BY ALL HAVING count(DISTINCT lang) = 4")
def set3_intersect(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", (F.col("n_chars") % 97).alias("file")).agg(F.count_distinct("lang").alias("n"))
    return d.filter("n = 4").select("source", "file")


@query("""WITH f AS (SELECT DISTINCT source, (n_chars % 97)::BIGINT AS file FROM documents), a AS (SELECT DISTINCT lang FROM documents)
SELECT source, file, lang FROM f, a EXCEPT SELECT source, (n_chars % 97)::BIGINT, lang FROM documents""")
def jn6_job_list(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.col("n_chars") % 97).alias("file"), "lang")
    langs = d.agg(F.collect_set("lang").alias("langs"))  # one row: the archives
    jobs = d.select("source", "file").distinct().crossJoin(F.broadcast(langs)).select("source", "file", F.explode("langs").alias("lang"))
    return jobs.join(d.distinct(), ["source", "file", "lang"], "left_anti")


@query("SELECT c_custkey, round_even(c_acctbal / 100, 1) AS pct FROM customer")
def str11_half_even(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.bround(F.col("c_acctbal") / 100, 1).alias("pct"))


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 524288000 AND lang IN ('en', 'de')")
def fil8_upload_guard(spark, sf):
    return table(spark, sf, "documents").filter((F.octet_length("text") <= 524_288_000) & F.col("lang").isin("en", "de")).select("doc_id")


@query("SELECT doc_id, substr(text, 1, 200) AS head FROM documents")
def fil9_slices(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 200).alias("head"))
