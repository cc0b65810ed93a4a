"""Running sums over rows of any number: ranges of a sort order are totalled, and a row's sum is that of its range so far after the totals before it.

A group of any size is spread over as many ranges as its rows need, so a group
that holds a third of the rows is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.cut import cut


def running(rows: DataFrame, values: dict[str, Column], order: list[Column], group: list[str] | None = None) -> DataFrame:
    """rows with a column for each of values: the sum of the value up to the row, itself included, within its group, in order.

    Values are whole numbers; ties in the order are settled by how rows were
    read. Totals are one row a range, the starts of groups one row a group.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group or [])]
    sorted_by = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    own = [F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(f"__v{i}") for i, v in enumerate(values.values())]
    named = rows.withColumn("__row", F.struct(*rows.columns)).withColumn("__tie", F.monotonically_increasing_id())
    names = [f"__g{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(order))], [f"__v{i}" for i in range(len(own))]
    # what gives ties their numbers is written first: ranges are sampled in a pass of their own
    base = cut(named.select("__row", "__tie", *keys, *sorted_by, *own))
    dealt = base.repartitionByRange(n, *names[0], *names[1], "__tie").sortWithinPartitions(*names[0], *names[1], "__tie")
    placed = cut(dealt.select("__row", *names[0], *names[2], F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    totals = placed.groupBy("__part").agg(*[F.sum(v).alias(v) for v in names[2]])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_start") for v in names[2]])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.select("*", *[F.sum(v).over(inside).alias(f"{v}_sum") for v in names[2]]).join(F.broadcast(starts), "__part")  # a row a range
    sums = sums.select("__row", *names[0], *[(F.col(f"{v}_start") + F.col(f"{v}_sum")).alias(f"{v}_sum") for v in names[2]], *names[2])
    if group:
        first = sums.groupBy(*names[0]).agg(*[F.min(F.col(f"{v}_sum") - F.col(v)).alias(f"{v}_from") for v in names[2]])
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names[0]]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        sums = sums.alias("a").join(first.alias("b"), cond).select("a.__row", *[(F.col(f"{v}_sum") - F.col(f"{v}_from")).alias(f"{v}_sum") for v in names[2]])
    return sums.select("__row.*", *[F.col(f"{v}_sum").alias(name) for v, name in zip(names[2], values, strict=True)])
