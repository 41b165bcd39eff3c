"""Exact positions of rows within keys, without ever gathering a key in one task.

The rows are range-partitioned and sorted by key and order, so that a hot key spreads
over as many partitions as its rows need. Counts (or sums) per partition and key, summed
over the partitions before, give every partition the offset at which its part of a key
begins. Only the first and the last key of a partition can lie in several partitions, so
there are never more than two offsets a partition, a bound that makes them safe to send
to all executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.session import cut_lineage

ROWS_A_PARTITION = 1_000_000


def partitions_for(rows: int, at_least: int = 8, rows_a_partition: int = ROWS_A_PARTITION) -> int:
    return max(at_least, math.ceil(rows / rows_a_partition))


def sorted_runs(df: DataFrame, keys: list[str], order: list[str], partitions: int) -> DataFrame:
    """``df`` range-partitioned and sorted by keys and order, with its partition (``part``), written to the shared folder, so that partitions stay as they are."""
    cols = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    laid = df.repartitionByRange(partitions, *cols).sortWithinPartitions(*cols).withColumn("part", F.spark_partition_id())
    return cut_lineage(laid)


def part_offsets(runs: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """part, keys, offset for the parts of those keys that lie in several partitions: rows (or the sum of ``weight``) of the key in the partitions before. At most two rows a partition."""
    total = F.count("*") if weight is None else F.sum(weight)
    counts = runs.groupBy("part", *keys).agg(total.cast("long").alias("n"))
    # a key in several partitions is the first or the last of each of them
    first, last = Window.partitionBy("part").orderBy(*[F.col(k).asc_nulls_first() for k in keys]), Window.partitionBy("part").orderBy(*[F.col(k).desc_nulls_last() for k in keys])
    edge = counts.withColumn("a", F.row_number().over(first)).withColumn("b", F.row_number().over(last)).filter("a = 1 or b = 1").drop("a", "b")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return edge.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", *keys, "offset").filter("offset > 0")
