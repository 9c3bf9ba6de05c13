"""Grouped evaluation of scored samples and the splits it stands on.

samples: path, type, label ('fake' is positive, anything else real), source_id, p, and split once assigned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds rank, the row's place, from 1, in the order of a hexadecimal digest and a tie-breaker, and total, the number of rows.

    The digest's first three digits make 4,096 buckets; ranks are numbered inside buckets and
    shifted by the sizes of the buckets before, so no task sorts more than a bucket.
    """
    df = df.withColumn("__b", F.substring(key, 1, 3))
    sizes = df.groupBy("__b").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over 4,096 rows at most
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("total", F.sum("__n").over(Window.partitionBy())).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key, tie))
    return df.join(F.broadcast(sizes), "__b").withColumn("rank", F.col("__before") + inside).drop("__b", "__before")


def group_split(df: DataFrame, group: str = "source_id", share: float = 0.3) -> DataFrame:
    """(group, split): the first floor(n * share) groups in digest order are 'test', so no group is in both."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("__k", F.md5(F.col(group).cast("string")))
    take = F.floor(F.col("total") * F.lit(float(share)))
    return global_rank(groups, "__k", group).select(group, F.when(F.col("rank") <= take, "test").otherwise("train").alias("split"))


def assign(df: DataFrame, split: DataFrame, group: str = "source_id") -> DataFrame:
    return df.join(split, group)


def hold_out(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a held-out type stay only where their source is a test source, and count as test."""
    return df.filter((F.col("type") != kind) | F.col("type").isNull() | (F.col("split") == "test"))


def leaks(df: DataFrame) -> DataFrame:
    """Sources with rows in more than one split; null sources and splits don't count."""
    found = df.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.count_distinct("split").alias("splits"))
    return found.filter("splits > 1")


def positives() -> Column:
    return F.coalesce(F.col("label") == "fake", F.lit(False)).cast("int")


def _below(df: DataFrame, by: list[str], score: str, y: str, buckets: int = 1024) -> DataFrame:
    """(*by, __p, __pos, __neg, __under): by distinct score, its positives and negatives and the negatives below it.

    Scores in [0, 1] are counted by distinct value in buckets of the score; negatives below are a
    running sum inside a bucket plus the buckets before, so no task holds a whole group's scores.
    """
    cell = F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1))
    each = df.groupBy(*by, cell.alias("__b"), F.col(score).alias("__p")).agg(F.sum(y).alias("__pos"), F.sum(1 - F.col(y)).alias("__neg"))
    cells = each.groupBy(*by, "__b").agg(F.sum("__neg").alias("__cell"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__cell").over(before), F.lit(0))).drop("__cell")
    inside = Window.partitionBy(*by, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__less", F.coalesce(F.sum("__neg").over(inside), F.lit(0)))
    return each.join(cells, [*by, "__b"]).withColumn("__under", F.col("__before") + F.col("__less"))


def _area() -> Column:
    won = F.sum(F.col("__pos") * (F.col("__under") + F.col("__neg") * F.lit(0.5)))
    return F.try_divide(won, (F.sum("__pos") * F.sum("__neg")).cast("double"))


def auc(df: DataFrame, by: list[str], score: str = "p", y: str = "y") -> DataFrame:
    """(*by, auc): the mid-rank area under the curve, null where a class is empty."""
    return _below(df, by, score, y).groupBy(*by).agg(_area().alias("auc"))


def evaluate(df: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, grp, n, n_fake, fpr, tpr, acc, auc) for fakes of types seen in training and of unseen ones.

    Both groups are measured against the same real test rows, so those are counted in each. Rates and
    areas come from one table of counts by group and score. by: columns that tell runs of the same
    samples apart, such as a detector and a degradation; all are measured in one job.
    """
    seen = df.filter("split = 'train' AND label = 'fake'").select(F.col("type").alias("__t")).distinct()
    test = df.filter("split = 'test'").select(*by, "type", "p", positives().alias("y")).join(seen, F.col("type") == F.col("__t"), "left")
    both, one = F.array(F.lit("seen"), F.lit("unseen")), F.array(F.when(F.col("__t").isNull(), "unseen").otherwise("seen"))
    rows = test.select(*by, "y", "p", F.explode(F.when(F.col("y") == 0, both).otherwise(one)).alias("grp"))
    pos, neg, said = F.col("__pos"), F.col("__neg"), F.col("__p") >= threshold
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))
    return _below(rows, [*by, "grp"], "p", "y").groupBy(*by, "grp").agg(
        F.sum(pos + neg).alias("n"),
        F.sum(pos).cast("bigint").alias("n_fake"),
        share(F.when(said, neg).otherwise(0), neg).alias("fpr"),
        share(F.when(said, pos).otherwise(0), pos).alias("tpr"),
        share(F.when(said, pos).otherwise(neg), pos + neg).alias("acc"),
        _area().alias("auc"),
    )


def runs(df: DataFrame, scores: dict[tuple[str, str], Column]) -> DataFrame:
    """df once for each (detector, degradation), with that run's p."""
    each = [F.struct(F.lit(d).alias("detector"), F.lit(g).alias("degradation"), p.alias("p")) for (d, g), p in scores.items()]
    return df.withColumn("__run", F.explode(F.array(*each))).drop("p").select("*", "__run.*").drop("__run")


def robustness(df: DataFrame) -> DataFrame:
    """(detector, degradation, fpr, seen_auc, unseen_auc, unseen_rate) of runs, null where a class is empty."""
    keys = ("detector", "degradation")
    of = lambda grp, c: F.max(F.when(F.col("grp") == grp, F.col(c)))
    return evaluate(df, by=keys).groupBy(*keys).agg(
        F.max("fpr").alias("fpr"), of("seen", "auc").alias("seen_auc"), of("unseen", "auc").alias("unseen_auc"), of("unseen", "tpr").alias("unseen_rate")
    )


def published(df: DataFrame) -> DataFrame:
    """What is published with an evaluation, one row: sizes of the test split and the sorted types of fakes trained on."""
    test = F.col("split") == "test"
    of = F.collect_set(F.when((F.col("split") == "train") & (F.col("label") == "fake"), F.col("type")))
    return df.agg(
        F.count(F.when(test, 1)).alias("n_test"), F.count(F.when(test & (F.col("label") == "real"), 1)).alias("n_test_real"),
        F.count(F.when(test & (F.col("label") == "fake"), 1)).alias("n_test_fake"), F.array_sort(of).alias("train_fake_types"),
    )


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= n)


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold): groups dealt to k folds in digest order."""
    groups = df.select(group).distinct().withColumn("__k", F.md5(F.col(group).cast("string")))
    return global_rank(groups, "__k", group).select(group, F.pmod(F.col("rank"), F.lit(k)).cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over the classes
    return counts.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))
