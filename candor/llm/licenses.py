"""License scans by diagonal voting.

Rolling word pairs of every text are joined by hash to the places of the same pairs in a fixed table
of license templates. A hit at document word p and template word t votes for the diagonal p - t, so
a template that stands in a text in full gives all its pairs on one diagonal, at its first word.
Neighbouring diagonals are merged, as a word left out or put in moves the rest of a notice by one,
and a span is verified by the share of the template's words that its hits cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words: runs of digits, letters and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Diagonals at most so far apart are one place.
GAP = 3
#: Share of a template's words that a span covers at least.
COVER = 0.8

# The phrases of the base labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Notices of the method's own labels, as words.
NOTICES = {
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache-2": ("licensed under the apache license version 2 0", "apache license version 2 0 january 2004"),
    "gpl-notice": (
        "this work is licensed under the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license", "mozilla public license version 2 0"),
    "cc": ("licensed under a creative commons attribution", "this work is licensed under a creative commons"),
    "public-domain": ("this is free and unencumbered software released into the public domain", "dedicated to the public domain"),
}


def _templates() -> list[tuple[int, str, bool, list[str]]]:
    rows = [(label, True, text.split()) for label, text in PHRASES.items()]
    rows += [(label, False, text.split()) for label, texts in NOTICES.items() for text in texts]
    return [(n, *row[:2], row[2]) for n, row in enumerate(rows, 1)]


def template_places(spark: SparkSession) -> DataFrame:
    """(hash, tpl, label, base, at, bit, len, w0, w1): a row for each word pair of each template; a fixed, small table."""
    values = ", ".join(_place_values())
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(tpl, label, base, at, bit, len, w0, w1)")
    return table.withColumn("hash", F.xxhash64("w0", "w1"))


def _place_values() -> list[str]:
    return [
        f"({n}, '{label}', {str(base).lower()}, {i}, cast({1 << i} as bigint), {len(words)}, '{words[i]}', '{words[i + 1]}')"
        for n, label, base, words in _templates()
        for i in range(len(words) - 1)
    ]


def _low(word: Column) -> Column:
    """A-Z in lower case, and nothing else; over the few words that hit."""
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of the base phrases, first_word and last_word are their smallest and
    largest first word. labels are the base labels found and those of verified spans, both distinct,
    sorted and comma-joined, empty if there are none. score is the largest cover of a place. spans
    has label, first and last word of each verified place. Null text is empty. Repeated rows and
    null ids come out as often as they go in; an empty table gives an empty table; further columns
    are ignored.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD_ANY_CASE), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words.alias("w")
    )
    # One row for each word with its right neighbour, and one at place -1 that stands for the text.
    right = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    none = F.array(F.struct(F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("r")))
    pairs = F.concat(none, F.arrays_zip(F.col("w"), right.alias("r")))
    each = rows.select("id", "text_hash", F.size("w").alias("n"), F.posexplode(pairs).alias("p", "g"))
    hashed = F.when(F.col("p") == 0, F.lit(0)).otherwise(F.xxhash64(F.lower("g.w"), F.lower("g.r")))
    each = each.select("id", "text_hash", "n", (F.col("p") - 1).alias("p"), hashed.alias("hash"), F.col("g.w").alias("a"), F.col("g.r").alias("b"))
    places = template_places(spark)
    text_row = spark.range(1).selectExpr(
        "0 tpl", "'' label", "false base", "0 at", "0L bit", "0 len", "'' w0", "'' w1", "0L hash"
    )
    hits = each.join(F.broadcast(places.unionByName(text_row)), "hash")
    exact = (F.col("tpl") == 0) & (F.col("p") == -1) | (_low(F.col("a")) == F.col("w0")) & (_low(F.col("b")) == F.col("w1"))
    hits = hits.filter(exact).select("id", "text_hash", "n", "tpl", "label", "base", "len", "bit", (F.col("p") - F.col("at")).alias("diagonal"))

    # Repeated rows vote once; how many there are is counted on the text's own row.
    votes = hits.groupBy("id", "text_hash", "n", "tpl", "label", "base", "len", "diagonal").agg(
        F.bit_or("bit").alias("mask"), F.count("*").alias("rows")
    )
    near = Window.partitionBy("id", "text_hash", "tpl").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > GAP, F.lit(True)).cast("int")
    votes = votes.withColumn("place", F.sum(apart).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.bit_count("mask") == F.col("len") - 1
    merged = votes.groupBy("id", "text_hash", "n", "tpl", "label", "base", "len", "place").agg(
        F.bit_or("mask").alias("mask"),
        F.min("diagonal").alias("first"),
        F.max("diagonal").alias("last"),
        F.max("rows").alias("rows"),
        F.count(F.when(full, 1)).alias("n_full"),
        F.min(F.when(full, F.col("diagonal"))).alias("first_full"),
        F.max(F.when(full, F.col("diagonal"))).alias("last_full"),
    )
    covered = F.bit_count(F.col("mask").bitwiseOR(F.shiftleft("mask", 1)))  # words of pairs that hit
    cover = F.when(F.col("tpl") > 0, covered / F.col("len"))
    good = F.when(F.col("base"), F.col("n_full") > 0).otherwise(cover >= COVER) & (F.col("tpl") > 0)
    span = F.struct("label", F.greatest(F.col("first"), F.lit(0)).alias("first"), (F.col("last") + F.col("len") - 1).alias("last"))
    base = F.col("base") & (F.col("n_full") > 0)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = merged.groupBy("id", "text_hash", "n").agg(
        F.max(F.when(F.col("tpl") == 0, F.col("rows"))).alias("rows"),
        F.coalesce(F.sum(F.when(base, F.col("n_full"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("first_full"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("last_full"))).cast("bigint").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, cover)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, span))).alias("spans"),
    )
    each_row = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return out.select("*", each_row.alias("__n")).select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_words"),
        "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
    )


ORACLE = f"""
WITH tp(tpl, label, base, pos, bit, len, w0, w1) AS (VALUES {", ".join(_place_values())}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
e AS (SELECT rid, w, unnest(range(1, len(w))) AS p FROM d),
h AS (SELECT rid, tpl, label, base, len, bit, p - 1 - pos AS diagonal FROM e JOIN tp ON w[p] = w0 AND w[p + 1] = w1),
v AS (SELECT rid, tpl, label, base, len, diagonal, bit_or(bit) AS mask FROM h GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tpl ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM v),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tpl ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS place,
    bit_count(mask) = len - 1 AS whole FROM o),
m AS (SELECT rid, tpl, label, base, len, bit_or(mask) AS mask, count(*) FILTER (whole) AS n_full,
    min(diagonal) FILTER (whole) AS f, max(diagonal) FILTER (whole) AS l FROM c GROUP BY rid, tpl, label, base, len, place),
g AS (SELECT *, bit_count(mask | (mask << 1))::DOUBLE / len AS cover FROM m),
k AS (SELECT *, CASE WHEN base THEN n_full > 0 ELSE cover >= {COVER} END AS good FROM g),
r AS (SELECT rid, sum(n_full) FILTER (base AND n_full > 0) AS n_base, min(f) FILTER (base) AS first_word, max(l) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND n_full > 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good) AS labels, max(cover) FILTER (good) AS score FROM k GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)
"""
