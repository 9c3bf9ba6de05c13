"""Joins with small tables: broadcast where they are measured to be small, else dealt by key and salt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast, as measured by ``weight``.
BROADCAST_BYTES = 16 << 20
#: Parts that the rows of one key are dealt to where the table is larger.
SALTS = 64


def weight(table: DataFrame) -> int:
    """About the bytes of a written table: 16 for each value, and the strings' own lengths."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t in ("string", "binary")]
    each = sum(strings, F.lit(16 * len(table.columns)))
    return table.agg(F.sum(each)).first()[0] or 0


def attach(rows: DataFrame, table: DataFrame, same: list[tuple[Column, str]], salt: Column) -> DataFrame:
    """rows with the columns of the row of table that equals them null-safely in each of ``same``; inner.

    table: a written table, one row for each key, its names new to rows. A table over BROADCAST_BYTES
    is repeated SALTS times and joined by key and ``salt``, an integer that differs among rows of a key.
    """
    on = [c.eqNullSafe(F.col(name)) for c, name in same]
    if weight(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    dealt = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return mine.join(dealt, [*on, F.col("__salt") == F.col("__part")]).drop("__salt", "__part")
