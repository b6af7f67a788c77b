"""Gapless numbers of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.shared import small_side, staged

#: monotonically_increasing_id() counts the rows of a partition in these low bits.
_ROW_BITS = 33


def numbered(rows: DataFrame, *order, name: str = "number") -> DataFrame:
    """rows with their place, from 0, in the order of the given columns; equal rows may stand in any order.

    Rows are dealt out by ranges of the order and of a salt, so many equal ones fill several partitions. The dealt rows are
    written before they are counted: ranges come from a sample, and what is read twice must be the same twice.
    """
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each partition
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = dealt.withColumn("_part", part).join(small_side(starts), "_part")
    return out.select(*rows.columns, (F.col("_start") + row).alias(name))
