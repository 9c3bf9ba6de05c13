"""Operators over per-frame series: rows (series, i, values), i counting from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions.scores import correlation_score, lipsync_gate


def smooth(c: str, by: list[str], order: str = "i") -> Column:
    """The mean of three neighbours; what is missing at the ends counts as 0."""
    return F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-1, 1)) / F.lit(3.0)


def zscore(c: str, by: list[str]) -> Column:
    """Standard score by the population deviation, all 0 for a constant series."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(sd > 1e-9, (F.col(c) - F.avg(c).over(w)) / sd).otherwise(F.lit(0.0))


def difference(c: str, by: list[str], order: str = "i") -> Column:
    """Absolute difference to the row before, 0 for the first."""
    return F.coalesce(F.abs(F.col(c) - F.lag(c).over(Window.partitionBy(*by).orderBy(order))), F.lit(0.0))


def running_sum(c: str, by: list[str], order: list[str]) -> Column:
    """The sum of doubles added one after the other in the given order, as far as each row; nulls are left out.

    A window, which spills. Rows that ``order`` leaves open should be alike, and share their sum.
    """
    return F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))


def ordered_mean(c: str, running: str, order: list[str]) -> Column:
    """An aggregate: the mean of c from its running sum's last value, so that it doesn't hang on how rows are split."""
    return F.try_divide(F.max_by(running, F.struct(*order)), F.count(c))


def ordered_means(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(*by, *columns): means of doubles added in the given order."""
    run = df.select("*", *[running_sum(c, by, order).alias(f"__{c}") for c in columns])
    return run.groupBy(*by).agg(*[ordered_mean(c, f"__{c}", order).alias(c) for c in columns])


def lag_correlation(df: DataFrame, by: list[str], x: str, y: str, most: int, least_pairs: int = 8) -> DataFrame:
    """(*by, lag, n, c): Pearson correlation of x at i and y at i + lag, for each lag up to ``most`` either way.

    Lags are exploded on one side, so the join is on equal keys. Lags of fewer pairs, or where a
    side is constant, have no row.
    """
    left = df.select(*by, F.col("i").alias("at"), F.col(x).alias("x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    right = df.select(*by, F.col("i").alias("at"), F.col(y).alias("y"))
    pairs = left.withColumn("at", F.col("at") + F.col("lag")).join(right, [*by, "at"])
    sx, sy = F.stddev_pop("x"), F.stddev_pop("y")
    out = pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), sx * sy).alias("c"), sx.alias("sx"), sy.alias("sy"))
    return out.filter((F.col("n") >= least_pairs) & (F.col("sx") >= 1e-9) & (F.col("sy") >= 1e-9)).select(*by, "lag", "n", "c")


def best_lag(correlations: DataFrame, by: list[str]) -> DataFrame:
    """(*by, lag, c) of the largest correlation, the lowest lag of equal ones."""
    best = F.max_by(F.struct("lag", "c"), F.struct("c", -F.col("lag")))
    return correlations.groupBy(*by).agg(best.alias("b")).select(*by, "b.lag", "b.c")


def hop_windows(df: DataFrame, by: list[str], width: int) -> DataFrame:
    """Rows repeated for each full window of ``width`` that starts at a multiple of half of it; adds start."""
    step = width // 2
    ends = df.groupBy(*by).agg(F.max("i").alias("__last"))
    out = df.join(ends, by)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (width - 1)) / step)).cast("int")
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("__last") - (width - 1)) / step)).cast("int")
    k = F.explode(F.when(first <= last, F.sequence(first, last)))
    return out.withColumn("start", k).withColumn("start", F.col("start") * step).drop("__last")


def coalesce_ranges(df: DataFrame, by: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """(*by, s, e): ranges that overlap or touch, merged."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach, 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__isle", F.sum("__new").over(w))
    return marked.groupBy(*by, "__isle").agg(F.min(start).alias("s"), F.max(end).alias("e")).drop("__isle")


def audio_windows(length: Column, size: int = 48_000) -> Column:
    """Starts of the windows of a clip of ``length`` samples: a tail of half a window or less is left out."""
    return F.when(length <= size, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), length - (size // 2 + 1)).cast("bigint"), F.lit(size).cast("bigint")))


def frame_sample(total: Column, n: int = 16) -> Column:
    """n frame numbers spread evenly over 0..total-1, truncated, without repeats."""
    last = F.greatest(total - 1, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * last / F.lit(n - 1)).cast("bigint")))


def _coupling(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """(*by, lag, c): the best lag of the smoothed series; rows without any valid lag are absent."""
    smoothed = df.select(*by, "i", smooth("mouth", by).alias("mouth"), smooth("audio", by).alias("audio"))
    found = lag_correlation(smoothed, by, "mouth", "audio", most).withColumn("c", F.round("c", 9))
    return best_lag(found, by)


def lipsync(df: DataFrame, by: list[str], fps: float, face_share: float = 1.0) -> DataFrame:
    """(*by, status, reason, score, c, lag, ranges) for series of mouth motion and loudness by frame.

    Status is in_sync, out_of_sync or not_checked, the latter with its reason and a score of one
    half. Ranges (frames, end exclusive) are where speech goes without its motion, only for those
    out of sync. All steps group and join on ``by``; a series is never gathered as an array.
    """
    width, most = int(2 * fps), round(0.25 * fps)
    top = df.groupBy(*by).agg(F.percentile("audio", F.lit(0.95)).alias("p95"), F.max("audio").alias("top"))
    told = df.join(top, by).withColumn("speech", ((F.col("top") > 1e-6) & (F.col("audio") > 0.2 * F.col("p95"))).cast("int")).drop("p95", "top")
    whole = told.groupBy(*by).agg(F.count("*").alias("n"), F.avg("speech").alias("share"), F.stddev_pop("mouth").alias("sd"))
    gate = lipsync_gate(F.col("n"), F.lit(float(fps)), F.lit(float(face_share)), F.col("share"), F.col("sd"))
    best = whole.withColumn("gate", gate).join(_coupling(df, by, most), by, "left")
    best = best.withColumn("c", F.coalesce("c", F.lit(-1.0))).withColumn("lag", F.coalesce("lag", F.lit(0)))

    windows = hop_windows(told, by, width)
    share = windows.groupBy(*by, "start").agg(F.avg("speech").alias("share"))
    loose = share.filter("share > 0.4").join(_coupling(windows, [*by, "start"], most), [*by, "start"], "left").filter("coalesce(c, -1) < 0.08")
    ranges = coalesce_ranges(loose.select(*by, F.col("start").alias("s"), (F.col("start") + width).alias("e")), by)
    ranges = ranges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))

    checked = F.col("gate") == "checked"
    score = F.when(checked, correlation_score(F.col("c"))).otherwise(F.lit(0.5))
    out = best.join(ranges, by, "left").withColumn("score", score)
    status = F.when(~checked, "not_checked").when(F.col("score") >= 0.5, "out_of_sync").otherwise("in_sync")
    return out.withColumn("status", status).select(
        *by, "status", F.when(~checked, F.col("gate")).alias("reason"), "score",
        F.when(checked, F.col("c")).alias("c"), F.when(checked, F.col("lag")).alias("lag"),
        F.when(F.col("status") == "out_of_sync", F.coalesce("ranges", F.array().cast("array<struct<s:bigint,e:bigint>>"))).alias("ranges"),
    )
