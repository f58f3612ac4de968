"""Running sums and numbers over all rows, in two levels: no window without a partition, and no order made in one task.

Rows are dealt out by ranges of (group, order) and written; within a part, sums run as a window; parts are summed, a row a part and group,
and the sums of earlier parts are added. A group may be all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.stages import staged


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], groups: list[str] | None = None) -> DataFrame:
    """rows with, for each name in sums, the sum of that column over the group's earlier rows (0 for the first).

    order: at least one sort column; rows that are equal in all of them come in any order, the same for all sums. Groups are not null;
    without any, all rows are one.
    """
    own = groups or []
    keys = [F.col(g) for g in own]
    names = {name: f"__{name}" for name in sums}
    dealt = rows.withColumns({names[n]: F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()}).repartitionByRange(*keys, *order)
    dealt = staged(dealt.sortWithinPartitions(*keys, *order).withColumns({"__part": F.spark_partition_id(), "__nth": F.monotonically_increasing_id()}))
    inside = W.partitionBy(*own, "__part").orderBy("__nth").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*own).orderBy("__part").rowsBetween(W.unboundedPreceding, -1) if own else W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy(*own, "__part").agg(*[F.sum(c).alias(c) for c in names.values()])  # a row for each part of a group
    offsets = parts.select(*own, "__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names.values()])
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in names.items()}).join(offsets, [*own, "__part"])
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"{c}_before")).alias(n) for n, c in names.items()])


def numbered(rows: DataFrame, order: list[Column], name: str = "place", groups: list[str] | None = None) -> DataFrame:
    """rows with their number, from 1, in an order."""
    return prefix_sums(rows, order, {name: F.lit(1)}, groups).withColumn(name, F.col(name) + 1)
