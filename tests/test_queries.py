"""Every query with SQL gives DuckDB's rows; goldens of the decision tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from candor import queries
from candor.functions import scores as sc
from candor.operators import evaluation as ev
from candor.operators import reporting
from candor.operators import series as se

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, found):
    fix = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted([tuple(fix(x) for x in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(columns, got.select(*columns).collect()) == rows(columns, want.select(*[f'"{c}"' for c in columns]).fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fusion_goldens(spark):
    lit = lambda *x: [F.lit(v).cast("double") for v in x]
    no = F.lit(False)
    fuse = lambda scores, shift=0.0, ai=no: one(spark, sc.fuse(lit(*scores), F.lit(shift), ai))
    assert fuse([0.05, 0.95]) == pytest.approx(0.5)
    assert fuse([0.1, 0.1]) == pytest.approx(0.1000008, abs=1e-7)
    assert fuse([0.9, 0.9]) == pytest.approx(0.8999992, abs=1e-7)
    assert fuse([0.52, 0.56], -0.4) == pytest.approx(0.4403707, abs=1e-7)
    assert fuse([None, None]) is None and fuse([None, None], 0.0, F.lit(True)) == 0.97
    reason = lambda side, spread, inc, p: one(spark, sc.low_confidence_reason(F.lit(side), *lit(spread, inc, p)))
    assert reason(32, 0.0, 0.0, 0.1) == "input is very low resolution (32px)"
    assert reason(300, 0.9, 0.0, 0.5) == "detectors strongly disagree"
    assert reason(300, 0.0, 0.4, 0.5) == "scores vary strongly between frames"
    assert reason(300, 0.0, 0.0, 0.5) == "score is too close to 50%" and reason(None, 0.0, 0.0, 0.9) == ""


def test_judged_goldens(spark):
    def judged(a, b, shift=0.0, ai=False, side=300, inc=0.0):
        r = one(spark, sc.judged([F.lit(a).cast("double"), F.lit(b).cast("double")], F.lit(shift), F.lit(ai), F.lit(side), F.lit(inc)))
        return round(r["p"], 6), r["verdict"], r["reason"]

    assert judged(None, None) == (0.5, "inconclusive", sc.NO_DETECTORS)
    assert judged(None, None, ai=True) == (0.97, "likely_fake", "")
    assert judged(0.05, 0.95) == (0.5, "likely_fake", "detectors strongly disagree")
    assert judged(0.05, 0.95, ai=True, side=10) == (0.97, "likely_fake", "")
    assert judged(0.1, None) == (0.100001, "likely_real", "") and judged(0.9, 0.9, side=63)[2] == "input is very low resolution (63px)"
    assert judged(0.2, 0.2, inc=0.4)[2] == "scores vary strongly between frames"


def test_score_goldens(spark):
    x = lambda c: one(spark, c)
    assert [round(x(sc.correlation_score(F.lit(c))), 4) for c in (0.0, 0.15, 0.3)] == [0.8950, 0.5, 0.1050]
    assert [round(x(sc.ela_score(F.lit(c))), 4) for c in (1.0, 5.0, 6.0)] == [0.0067, 0.5, 0.7773]
    shift = lambda s, r: x(sc.lipsync_shift(F.lit(s).cast("double"), F.lit(r)))
    assert shift(0.9, True) == pytest.approx(1.2) and shift(0.1, True) == pytest.approx(-0.32) and shift(0.9, False) == shift(None, True) == 0


def test_audio_reports_round_as_the_sql(spark, duck):
    clips = {"a": [0.5, 0.5375], "b": [0.58125], "c": [0.4875, 0.55], "d": [0.99375], "e": [0.00625]}
    w = spark.createDataFrame([(k, i, i + 3, p) for k, ps in clips.items() for i, p in enumerate(ps)], "path string, s int, e int, p double")
    got = {r.path: r.report.authenticity for r in reporting.audio_reports(w).collect()}
    assert got == {k: duck.execute("SELECT round(1 - round(list_avg($1::DOUBLE[]), 9), 4)", [ps]).fetchone()[0] for k, ps in clips.items()}


def lines_in_files(spark, path, files):
    """A lineitem of one file for each list of (video, frame, discount, tax), and a serial connection that reads it."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_discount double, l_tax double").coalesce(1)
        df.write.parquet(str(path / f"part{i}"))
        (path / "lineitem.parquet").mkdir(exist_ok=True)
        next((path / f"part{i}").glob("*.parquet")).rename(path / "lineitem.parquet" / f"{i}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view lineitem as select * from read_parquet('{path}/lineitem.parquet/*.parquet')")
    return con


def test_audio_reports_add_in_the_table_s_order(spark, tmp_path):
    first = [(1, 1, 0.02, 0.0), (2, 1, 0.01, 0.0), (3, 1, 0.03, 0.0)]
    rest = [(1, 1, 0.03, 0.0), (1, 1, 0.1, 0.0), (2, 1, 0.05, 0.0), (2, 1, 0.09, 0.0), (3, 1, 0.04, 0.0), (3, 1, 0.08, 0.0)]
    con = lines_in_files(spark, tmp_path, [first, rest])
    want = con.sql(queries.ORACLES["pip4_audio_report"])
    got = queries.QUERIES["pip4_audio_report"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_video_reports_add_in_the_table_s_order(spark, tmp_path):
    first = [(36, 1, 0.09, 0.06), (66, 1, 0.02, 0.05), (66, 1, 0.1, 0.04), (66, 1, 0.04, 0.06)]
    rest = [(36, 1, 0.08, 0.01), (36, 1, 0.05, 0.04), (36, 1, 0.03, 0.01), (66, 1, 0.0, 0.08), (66, 1, 0.0, 0.01), (66, 1, 0.04, 0.08)]
    con = lines_in_files(spark, tmp_path, [first, rest])
    spark.createDataFrame([(36,), (66,)], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    con.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.sql(queries.ORACLES["pip3_video_report"])
    got = queries.QUERIES["pip3_video_report"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_windows_and_frames(spark):
    starts = lambda n: one(spark, se.audio_windows(F.lit(n)))
    assert [starts(int(s * 16000)) for s in (4, 4.5, 5, 9)] == [[0], [0], [0, 48000], [0, 48000, 96000]]
    assert one(spark, se.frame_sample(F.lit(5))) == [0, 1, 2, 3, 4]
    assert one(spark, se.frame_sample(F.lit(100))) == [0, 6, 13, 19, 26, 33, 39, 46, 52, 59, 66, 72, 79, 85, 92, 99]


def test_lipsync(spark):
    import numpy as np

    def envelope(seed, n=250):
        x = np.convolve(np.abs(np.random.default_rng(seed).normal(size=n)), np.ones(5) / 5, "same")
        return x**2 + 0.01

    a, b = envelope(0), envelope(1)
    cases = {"synced": (a, a), "shifted": (np.roll(a, 2), a), "other": (b, a), "silent": (a, np.zeros(250)), "short": (a[:50], a[:50]), "still": (np.ones(250), a)}
    rows = [(k, i, float(m[i]), float(s[i])) for k, (m, s) in cases.items() for i in range(len(m))]
    df = spark.createDataFrame(rows, "media string, i int, mouth double, audio double")
    got = {r.media: r for r in se.lipsync(df, ["media"], 25).collect()}
    assert got["synced"].score < 0.3 and got["synced"].lag == 0 and got["synced"].ranges is None
    assert got["shifted"].status == "in_sync" and abs(got["shifted"].lag) == 2
    assert got["other"].status == "out_of_sync" and got["other"].ranges and all(r.s < r.e for r in got["other"].ranges)
    assert {k: got[k].reason for k in ("silent", "short", "still")} == {
        "silent": "little or no speech in the audio", "short": "clip is shorter than 3 seconds", "still": "no mouth movement could be measured",
    }
    assert all(got[k].status == "not_checked" and got[k].score == 0.5 for k in ("silent", "short", "still"))


def test_split_keeps_sources_whole(spark):
    df = spark.range(400).select((F.col("id") / 2).cast("int").alias("source_id"), "id")
    split = ev.group_split(df)
    assert split.filter("split = 'test'").count() == 60 and split.count() == 200
    assert ev.leaks(ev.assign(df, split)).isEmpty()


def test_auc_by_brute_force(spark):
    data = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.2, 0), (0.9, 0), (1.0, 1)]
    df = spark.createDataFrame(data, "p double, y int").withColumn("g", F.lit(1))
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ev.auc(df, ["g"]).first()["auc"] == pytest.approx(want)
    assert ev.auc(df.filter("y = 1"), ["g"]).first()["auc"] is None
