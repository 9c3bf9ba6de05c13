"""Queries over scored samples: splits, leakage, rates, areas, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators import evaluation as ev
from candor.plans.registry import query
from candor.sources.tables import SAMPLES, SPLIT, samples, table

WITH = f"WITH {SAMPLES}, {SPLIT}"


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)  # no negative zero


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf)
    return ev.hold_out(ev.assign(s, ev.group_split(s)), "purchase")


@query(f"""{WITH}, seen AS (SELECT DISTINCT type FROM m WHERE split = 'train' AND label = 'fake'),
t AS (SELECT type, p, (label = 'fake')::INT AS y FROM m WHERE split = 'test'),
b AS (SELECT g.grp, y, p FROM t, (VALUES ('seen'), ('unseen')) g(grp) WHERE y = 0
  UNION ALL SELECT CASE WHEN type IN (SELECT type FROM seen) THEN 'seen' ELSE 'unseen' END, y, p FROM t WHERE y = 1),
k AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0::DOUBLE AS rk FROM b),
a AS (SELECT grp, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc FROM k GROUP BY grp)
SELECT grp, count(*) AS n, sum(y)::BIGINT AS n_fake, round(avg((p >= 0.5)::INT) FILTER (y = 0), 6) AS fpr,
  round(avg((p >= 0.5)::INT) FILTER (y = 1), 6) AS tpr, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS acc, round(any_value(auc), 6) AS auc
FROM b JOIN a USING (grp) GROUP BY grp""")
def ml7_evaluate(spark, sf):
    out = ev.evaluate(manifest(spark, sf))
    return out.select("grp", "n", "n_fake", *[r6(F.col(c), c) for c in ("fpr", "tpr", "acc", "auc")])


@query(f"{WITH} SELECT source_id, split FROM split")
def srt1_group_split(spark, sf):
    return ev.group_split(samples(spark, sf))


@query(f"""{WITH}, bad AS (SELECT source_id, CASE WHEN path % 97 = 0 THEN 'test' ELSE split END AS split FROM m)
SELECT source_id, count(DISTINCT split) AS splits FROM bad GROUP BY source_id HAVING count(DISTINCT split) > 1""")
def agg1_leak_guard(spark, sf):
    return ev.leaks(manifest(spark, sf).withColumn("split", F.when(F.col("path") % 97 == 0, "test").otherwise(F.col("split"))))


@query(f"{WITH} SELECT type, split, count(*) AS n FROM m GROUP BY ALL")
def agg7_type_split_counts(spark, sf):
    return manifest(spark, sf).groupBy("type", "split").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT path, split FROM m WHERE type = 'purchase'")
def fil6_holdout(spark, sf):
    return manifest(spark, sf).filter("type = 'purchase'").select("path", "split")


@query(f"{WITH} SELECT path, (label = 'fake')::INT AS y FROM m WHERE split = 'train'")
def fil1_training_rows(spark, sf):
    return manifest(spark, sf).filter("split = 'train'").select("path", ev.positives().alias("y"))


@query(f"{WITH} SELECT path FROM m WHERE split = 'test' AND label = 'fake' AND type IN (SELECT type FROM m WHERE split = 'train' AND label = 'fake')")
def jn1_seen(spark, sf):
    m = manifest(spark, sf)
    seen = m.filter("split = 'train' AND label = 'fake'").select("type").distinct()
    return m.filter("split = 'test' AND label = 'fake'").join(F.broadcast(seen), "type", "left_semi").select("path")


@query(f"{WITH} SELECT path FROM m WHERE split = 'test' AND label = 'fake' AND NOT EXISTS (SELECT 1 FROM m t WHERE t.split = 'train' AND t.label = 'fake' AND t.type = m.type)")
def jn2_unseen(spark, sf):
    m = manifest(spark, sf)
    seen = m.filter("split = 'train' AND label = 'fake'").select("type").distinct()
    return m.filter("split = 'test' AND label = 'fake'").join(F.broadcast(seen), "type", "left_anti").select("path")


@query(f"{WITH} SELECT path, split FROM samples JOIN split USING (source_id)")
def jn3_source_lookup(spark, sf):
    s = samples(spark, sf)
    return ev.assign(s, ev.group_split(s)).select("path", "split")


@query(f"{WITH} SELECT path FROM samples SEMI JOIN (SELECT source_id FROM split WHERE split = 'test') USING (source_id)")
def jn4_test_sources(spark, sf):
    s = samples(spark, sf)
    return s.join(ev.group_split(s).filter("split = 'test'"), "source_id", "left_semi").select("path")


@query(f"{WITH} SELECT type, count(*) AS n, round(avg((p >= 0.5)::INT), 6) AS rate FROM m WHERE split = 'test' AND label = 'fake' GROUP BY type")
def agg2_rate_by_type(spark, sf):
    t = manifest(spark, sf).filter("split = 'test' AND label = 'fake'")
    return t.groupBy("type").agg(F.count("*").alias("n"), r6(F.avg((F.col("p") >= 0.5).cast("int")), "rate"))


@query(f"{WITH} SELECT count(*) AS n, round(avg((p >= 0.5)::INT), 6) AS fpr FROM m WHERE split = 'test' AND label <> 'fake'")
def agg3_fpr(spark, sf):
    t = manifest(spark, sf).filter("split = 'test' AND label <> 'fake'")
    return t.agg(F.count("*").alias("n"), r6(F.avg((F.col("p") >= 0.5).cast("int")), "fpr"))


@query(f"{WITH} SELECT count(*) AS n, round(avg(((p >= 0.5) = (label = 'fake'))::INT), 6) AS acc FROM m WHERE split = 'test'")
def agg4_accuracy(spark, sf):
    hit = ((F.col("p") >= 0.5) == (F.col("label") == "fake")).cast("int")
    return manifest(spark, sf).filter("split = 'test'").agg(F.count("*").alias("n"), r6(F.avg(hit), "acc"))


@query(f"""{WITH}, k AS (SELECT split, (label = 'fake')::INT AS y, rank() OVER (PARTITION BY split ORDER BY p)
  + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0::DOUBLE AS rk FROM m)
SELECT split, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY split""")
def agg5_auc(spark, sf):
    return ev.auc(manifest(spark, sf).withColumn("y", ev.positives()), ["split"]).select("split", r6(F.col("auc"), "auc"))


@query(f"""{WITH} SELECT type, min(label) AS label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test,
  count(DISTINCT source_id) AS sources FROM m GROUP BY type""")
def agg8_status(spark, sf):
    counts = [F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "test")]
    return manifest(spark, sf).groupBy("type").agg(F.min("label").alias("label"), *counts, F.count_distinct("source_id").alias("sources"))


@query(f"""{WITH} SELECT count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND label = 'real') AS n_real,
  count(*) FILTER (split = 'test' AND label = 'fake') AS n_fake, string_agg(DISTINCT type, ',' ORDER BY type) FILTER (split = 'train' AND label = 'fake') AS types FROM m""")
def agg9_eval_header(spark, sf):
    test = F.col("split") == "test"
    train_types = F.collect_set(F.when((F.col("split") == "train") & (F.col("label") == "fake"), F.col("type")))
    return manifest(spark, sf).agg(
        F.count(F.when(test, 1)).alias("n_test"),
        F.count(F.when(test & (F.col("label") == "real"), 1)).alias("n_real"),
        F.count(F.when(test & (F.col("label") == "fake"), 1)).alias("n_fake"),
        F.array_join(F.sort_array(train_types), ",").alias("types"),
    )


@query(f"{WITH} SELECT round(quantile_cont(p, 0.9), 6) AS threshold, round(-ln((quantile_cont(p, 0.9) + 1e-6) / (1 - quantile_cont(p, 0.9) + 1e-6)), 6) + 0 AS shift FROM m WHERE label = 'real' AND split = 'train'")
def agg14_quantile_threshold(spark, sf):
    from candor.functions.scores import calibration_shift

    q = manifest(spark, sf).filter("label = 'real' AND split = 'train'").agg(F.percentile("p", F.lit(0.9)).alias("q"))
    return q.select(r6(F.col("q"), "threshold"), r6(calibration_shift(F.col("q")), "shift"))


@query(f"{WITH} SELECT label, count(*) AS n, round(avg(p), 6) AS mean, round(max(p), 6) AS most, round(min(p), 6) AS least, round(avg((p >= 0.6)::INT), 6) AS rate FROM m GROUP BY label")
def agg21_calibration_summary(spark, sf):
    p = F.col("p")
    return manifest(spark, sf).groupBy("label").agg(
        F.count("*").alias("n"), r6(F.avg(p), "mean"), r6(F.max(p), "most"), r6(F.min(p), "least"), r6(F.avg((p >= 0.6).cast("int")), "rate")
    )


@query("SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings) / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM embeddings GROUP BY label")
def agg22_class_weights(spark, sf):
    return ev.class_weights(table(spark, sf, "embeddings").select("label"), "label").select("label", "n", r6(F.col("weight"), "weight"))


@query(f"""WITH {SAMPLES}, g AS (SELECT source_id, row_number() OVER (ORDER BY md5(source_id::VARCHAR), source_id) AS rn FROM (SELECT DISTINCT source_id FROM samples))
SELECT source_id, (rn % 5)::INT AS fold FROM g""")
def win10_group_folds(spark, sf):
    return ev.group_folds(samples(spark, sf), "source_id", 5)


@query(f"WITH {SAMPLES} SELECT source_id, path FROM samples QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY path) <= 3")
def win11_first_n(spark, sf):
    return ev.first_n(samples(spark, sf), ["source_id"], ["path"], 3).select("source_id", "path")


@query(f"""{WITH} SELECT type, path FROM m WHERE split = 'test'
QUALIFY row_number() OVER (PARTITION BY type ORDER BY md5(path::VARCHAR), path) <= CASE WHEN label = 'real' THEN 3 ELSE 1 END""")
def srt5_stratified(spark, sf):
    t = ev.first_n(manifest(spark, sf).filter("split = 'test'"), ["type"], [F.md5(F.col("path").cast("string")), "path"], 3)
    return t.filter("label = 'real' OR rn = 1").select("type", "path")


@query(f"{WITH} SELECT type, min(label) AS label FROM m GROUP BY type HAVING count(*) FILTER (split = 'train') = 0 AND min(label) = 'fake'")
def dec11_unseen_types(spark, sf):
    t = manifest(spark, sf).groupBy("type").agg(F.min("label").alias("label"), F.count(F.when(F.col("split") == "train", 1)).alias("n"))
    return t.filter("n = 0 AND label = 'fake'").select("type", "label")


# Stand-ins: a detector's score is a function of p, a degradation multiplies it.
_DETECTORS = {"judge": "p", "clip_probe": "p * p", "frequency": "abs(p - 0.3D)", "ela": "1 - p"}
_LOSS = {"clean": 1.0, "jpeg75": 0.9, "jpeg50": 0.8, "down0.5": 0.7, "h264": 0.6}
#: The runs that are published.
PUBLISHED = [("judge", "clean"), ("clip_probe", "clean"), ("frequency", "clean"), ("judge", "jpeg75"), ("judge", "jpeg50"), ("judge", "down0.5")]
_RUNS = f"""{WITH}, runs AS (SELECT m.* EXCLUDE (p), detector, degradation, CASE detector WHEN 'judge' THEN p WHEN 'clip_probe' THEN p * p WHEN 'frequency' THEN abs(p - 0.3::DOUBLE) ELSE 1 - p END * f AS p
  FROM m, (VALUES ('judge'), ('clip_probe'), ('frequency'), ('ela')) d(detector), (VALUES ('clean', 1.0::DOUBLE), ('jpeg75', 0.9::DOUBLE), ('jpeg50', 0.8::DOUBLE), ('down0.5', 0.7::DOUBLE), ('h264', 0.6::DOUBLE)) g(degradation, f)),
seen AS (SELECT DISTINCT type FROM m WHERE split = 'train' AND label = 'fake'),
t AS (SELECT detector, degradation, type, p, (label = 'fake')::INT AS y FROM runs WHERE split = 'test'),
b AS (SELECT detector, degradation, g.grp, y, p FROM t, (VALUES ('seen'), ('unseen')) g(grp) WHERE y = 0
  UNION ALL SELECT detector, degradation, CASE WHEN type IN (SELECT type FROM seen) THEN 'seen' ELSE 'unseen' END, y, p FROM t WHERE y = 1),
k AS (SELECT detector, degradation, grp, y, p, rank() OVER (PARTITION BY detector, degradation, grp ORDER BY p) + (count(*) OVER (PARTITION BY detector, degradation, grp, p) - 1) / 2.0::DOUBLE AS rk FROM b),
e AS (SELECT detector, degradation, grp, count(*) AS n, sum(y)::BIGINT AS n_fake, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0) AS auc,
  avg((p >= 0.5)::INT) FILTER (y = 0) AS fpr, avg((p >= 0.5)::INT) FILTER (y = 1) AS tpr, avg(((p >= 0.5)::INT = y)::INT) AS acc FROM k GROUP BY ALL)"""


def _runs(spark: SparkSession, sf: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return ev.runs(manifest(spark, sf), {(d, g): F.expr(_DETECTORS[d]) * F.lit(_LOSS[g]) for d, g in pairs})


@query(f"""{_RUNS} SELECT detector, degradation, round(max(fpr), 6) AS fpr, round(max(auc) FILTER (grp = 'seen'), 6) AS seen_auc, round(max(auc) FILTER (grp = 'unseen'), 6) AS unseen_auc,
  round(max(tpr) FILTER (grp = 'unseen'), 6) AS unseen_rate FROM e GROUP BY ALL""")
def ml9_robustness_grid(spark, sf):
    grid = ev.robustness(_runs(spark, sf, [(d, g) for d in _DETECTORS for g in _LOSS]))
    return grid.select("detector", "degradation", *[r6(F.col(c), c) for c in ("fpr", "seen_auc", "unseen_auc", "unseen_rate")])


@query(f"""{_RUNS}, h AS (SELECT count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND label = 'real') AS n_test_real, count(*) FILTER (split = 'test' AND label = 'fake') AS n_test_fake,
  string_agg(DISTINCT type, ',' ORDER BY type) FILTER (split = 'train' AND label = 'fake') AS types FROM m)
SELECT detector || '/' || degradation AS step, grp, n, n_fake, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(acc, 6) AS acc, round(auc, 6) AS auc, h.* FROM e, h
WHERE degradation = 'clean' AND detector <> 'ela' OR detector = 'judge' AND degradation <> 'h264'""")
def pip9_published_run(spark, sf):
    """The published runs, measured in one job, beside the sizes of the split."""
    head = ev.published(manifest(spark, sf)).withColumn("types", F.array_join("train_fake_types", ",")).drop("train_fake_types")
    out = ev.evaluate(_runs(spark, sf, PUBLISHED), by=("detector", "degradation"))
    step = F.concat_ws("/", "detector", "degradation").alias("step")
    return out.select(step, "grp", "n", "n_fake", *[r6(F.col(c), c) for c in ("fpr", "tpr", "acc", "auc")]).join(F.broadcast(head))



@query("SELECT archive.lang AS lang, d.n AS degradation FROM (SELECT DISTINCT lang FROM documents) archive, (VALUES ('clean'), ('jpeg75'), ('jpeg50'), ('half'), ('h264')) d(n)")
def jn7_grid(spark, sf):
    kinds = F.explode(F.array(*[F.lit(x) for x in ("clean", "jpeg75", "jpeg50", "half", "h264")]))
    return table(spark, sf, "documents").select("lang").distinct().select("lang", kinds.alias("degradation"))


@query(f"WITH {SAMPLES} SELECT path, v.n AS variant FROM samples, (VALUES ('clean'), ('flip'), ('jpeg'), ('half')) v(n)")
def jn8_augmentation(spark, sf):
    return samples(spark, sf).select("path", F.explode(F.array(*[F.lit(x) for x in ("clean", "flip", "jpeg", "half")])).alias("variant"))


@query(f"WITH {SAMPLES} SELECT path, type FROM samples WHERE label = 'real' UNION ALL SELECT path, type FROM samples WHERE label = 'fake'")
def set1_concatenate(spark, sf):
    s = samples(spark, sf)
    return s.filter("label = 'real'").select("path", "type").unionByName(s.filter("label = 'fake'").select("path", "type"))


@query(f"WITH {SAMPLES} SELECT DISTINCT type, label FROM samples")
def set6_distinct(spark, sf):
    return samples(spark, sf).select("type", "label").distinct()


@query(f"WITH {SAMPLES} SELECT path FROM samples WHERE substr(md5(path::VARCHAR), 1, 10) = substr(md5('17'), 1, 10)")
def jn12_sample_lookup(spark, sf):
    return samples(spark, sf).filter(F.substring(F.md5(F.col("path").cast("string")), 1, 10) == F.substring(F.md5(F.lit("17")), 1, 10)).select("path")
