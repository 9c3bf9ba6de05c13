"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed place in its source, 60 bits of a hash. A target of ``k`` whole sources
and a rest takes every document k times and once more those whose place is at most a threshold.
Thresholds come from histograms: words are summed by source and the leading 12 bits, a running sum
over those 4,096 buckets finds the bucket in which the rest is reached, the next 12 bits refine that
bucket only, and the places inside the last, tiny bucket settle it. Repeated rows share a place; where
the threshold falls among them, as many of them are taken as come nearest to the target. No documents
are sorted; a larger target takes a superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.llm import lookups
from candor.llm.scratch import Scratch

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def _key(id_col: str, text_col: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _ranked(scratch: Scratch, rows: DataFrame, by: Column) -> DataFrame:
    """rows, written in the order of ``by``, with rank from 0: a row's place in its part plus the parts before.

    The sort deals ranges to tasks; only one number for each part meets in one place.
    """
    own = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = scratch.save(rows.orderBy(by).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    parts = rows.groupBy(F.shiftright("__row", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(parts), F.shiftright("__row", 33) == F.col("__part"))
    return out.withColumn("rank", F.col("__before") + own).drop("__row", "__part", "__before")


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the total of all
    sizes; a target stops at ``most`` times its source's size and the excess is reshared by weight.
    That is min(cap, level * weight) for one level. It is found as stated: the level that the sources
    below their caps have is raised, one grouped sum at a time, until no more of them reach their caps.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by = _ranked(scratch, by, F.col("source").asc_nulls_last())
    turn = F.col("rank") % len(weights)
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by = scratch.save(by.withColumn("cap", F.lit(float(most)) * F.col("source_size")), "weights")
    total, weight = by.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = 0.0, -1
    full, full_weight, n = 0.0, 0.0, 0
    while n > capped and weight and weight > full_weight:
        capped, level = n, (total - full) / (weight - full_weight)
        over = by.filter(F.lit(level) * F.col("w") > F.col("cap"))
        full, full_weight, n = over.agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0)), F.count("*")).first()
    return by.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _boundary(cells: DataFrame, name: str, *on: str) -> DataFrame:
    """The first cell of each source at which the running sum of ``size`` reaches ``rest``.

    cells: source, rest, cell, size, n. Returns __s, the columns ``on``, the cell as __name, rest less
    the cells before it, size and n; a source whose cells don't reach its rest is absent.
    """
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = cells.withColumn("after", F.sum("size").over(run))
    hit = after.filter((F.col("after") >= F.col("rest")) & (F.col("after") - F.col("size") < F.col("rest")))
    left = F.col("rest") - (F.col("after") - F.col("size"))
    return hit.select(F.col("source").alias("__s"), *on, F.col("cell").alias(f"__{name}"), left.alias("rest"), "size", "n")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    most: int = MAX_REPEATS,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats for every row; ``keep`` adds columns of docs.

    taken is repeats * size. A source's taken words differ from its target by no more than half the
    size of the document at its threshold, repeated rows too: of rows of one id and text any may be
    the ones taken. Null text counts no words; null and empty sources are sources. A source without
    words has target 0. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    here = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    placed = docs.select(*here, size.alias("size"), _key(id_col, text_col).alias("place"))
    placed = scratch.save(placed, "sizes")

    source_keys = scratch.save(targets(scratch, placed, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    goals = scratch.save(source_keys.select(F.col("source").alias("__s"), rest.alias("rest")).filter("rest > 0"), "goals")

    counted = [F.sum("size").alias("size"), F.count("*").alias("n")]
    top = placed.filter("size > 0").withColumn("b1", F.shiftright("place", 48)).withColumn("b2", F.shiftright("place", 36).bitwiseAND(4095))
    cells = top.groupBy("source", F.col("b1").alias("cell")).agg(*counted)
    first = _boundary(lookups.attach(cells, goals, [(F.col("source"), "__s")], F.col("cell")), "b1")
    first = scratch.save(first.drop("size", "n"), "first")
    cells = lookups.attach(top, first, [(F.col("source"), "__s"), (F.col("b1"), "__b1")], F.col("b2"))
    second = _boundary(cells.groupBy("source", "__b1", "rest", F.col("b2").alias("cell")).agg(*counted), "b2", "__b1")
    second = scratch.save(second.drop("size", "n"), "second")
    cells = lookups.attach(top, second, [(F.col("source"), "__s"), (F.col("b1"), "__b1"), (F.col("b2"), "__b2")], F.col("place"))
    last = _boundary(cells.groupBy("source", "rest", F.col("place").alias("cell")).agg(*counted), "place")
    # n rows are at the threshold, usually one; m of them leave the sum nearest its target
    m = F.floor(F.col("rest") / (F.col("size") / F.col("n")) + F.lit(0.5))
    cuts = scratch.save(last.select("__s", F.col("__place").alias("place"), m.alias("m"), "n"), "cuts")

    same = source_keys["source"].eqNullSafe(cuts["__s"])
    plan = source_keys.join(cuts, same, "left").select(
        source_keys["source"].alias("__mix_source"),
        F.col("source_size").alias("__mix_source_size"),
        F.col("target").alias("__mix_target"),
        whole.cast("bigint").alias("__mix_whole"),
        F.coalesce(F.when(F.col("m") < F.col("n"), F.col("place") - 1).otherwise(F.col("place")), F.lit(-1)).alias("__mix_upto"),
        F.when((F.col("m") > 0) & (F.col("m") < F.col("n")), F.col("m")).alias("__mix_some"),
    )
    plan = scratch.save(plan, "plan")
    if keep is None:
        rows = placed.select("doc_id", F.col("source").alias("__mix_of"), F.col("size").alias("__mix_size"), F.col("place").alias("__mix_place"))
        head = [F.col("doc_id")]
    else:
        rows = docs.select("*", F.col(source_col).alias("__mix_of"), size.alias("__mix_size"), _key(id_col, text_col).alias("__mix_place"))
        head = [F.col(c) for c in keep]
    joined = lookups.attach(rows, plan, [(F.col("__mix_of"), "__mix_source")], F.col("__mix_place"))
    taken = F.col("__mix_place") <= F.col("__mix_upto")
    split = F.col("__mix_some").isNotNull() & (F.col("__mix_place") == F.col("__mix_upto") + 1)
    if not plan.filter("__mix_some IS NOT NULL").isEmpty():
        some = _numbered(scratch, joined.filter(split))
        joined = joined.filter(~split).withColumn("__mix_more", taken).unionByName(some)
    else:
        joined = joined.withColumn("__mix_more", taken)
    repeats = F.col("__mix_whole") + F.when(F.col("__mix_more"), 1).otherwise(0)
    return joined.select(
        *head,
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (repeats * F.col("__mix_size")).alias("taken"),
        repeats.alias("repeats"),
    )


def _numbered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Rows at a place that is taken in part, with __mix_more for __mix_some rows of each source.

    They are numbered inside the parts they are written in, after the numbers of the parts before, so
    rows of one place, however many, stay spread.
    """
    rows = scratch.save(rows.withColumn("__mix_row", F.monotonically_increasing_id()), "tied")
    part = F.shiftright("__mix_row", 33)
    parts = rows.groupBy(F.col("__mix_of").alias("__mix_s"), part.alias("__mix_part")).agg(F.count("*").alias("__mix_n"))
    before = F.sum("__mix_n").over(Window.partitionBy("__mix_s").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__mix_s", "__mix_part", F.coalesce(before, F.lit(0)).alias("__mix_before"))
    out = rows.join(parts, F.col("__mix_of").eqNullSafe(F.col("__mix_s")) & (part == F.col("__mix_part")))
    inside = F.row_number().over(Window.partitionBy("__mix_of", "__mix_part").orderBy("__mix_row"))
    out = out.withColumn("__mix_more", F.col("__mix_before") + inside <= F.col("__mix_some"))
    return out.drop("__mix_row", "__mix_s", "__mix_part", "__mix_before")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of the mix: documents with the columns of docs, each as often as it is taken."""
    names = docs.columns
    fresh = [f"__mix_c{i}" for i in range(len(names))]  # so that no column of docs can clash
    renamed = docs.toDF(*fresh)
    at = {n: fresh[names.index(n)] for n in ("doc_id", "text", "source")}
    out = mix(renamed, at["doc_id"], at["text"], at["source"], keep=fresh)
    times = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return out.filter("repeats > 0").select(*fresh, times.alias("__mix_n")).select(*[F.col(f).alias(n) for f, n in zip(fresh, names, strict=True)])


ORACLE = """
WITH d AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w,
      source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos FROM s),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, pos) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
p AS (SELECT source, place, sum(size) AS size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, place),
r AS (SELECT p.source, place, size, n, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY p.source ORDER BY place) AS after
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
c AS (SELECT source, place, floor((rest - (after - size)) / (size::DOUBLE / n) + 0.5::DOUBLE) AS m
  FROM r WHERE rest > 0 AND after >= rest AND after - size < rest),
k AS (SELECT *, row_number() OVER (PARTITION BY source, place) AS nth FROM d),
e AS (SELECT k.*, whole + CASE WHEN k.place < c.place OR (k.place = c.place AND (size = 0 OR nth <= m)) THEN 1 ELSE 0 END AS repeats, source_size, target
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, repeats::BIGINT AS repeats FROM e
"""
