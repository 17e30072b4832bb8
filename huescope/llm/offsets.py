"""Running totals over all rows, or those of a group, without bringing either into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table


def running_start(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over all rows before this one in the given order (of its group, if named).

    Rows are dealt by ranges of (group, order) to tasks; only a row for each task and group is
    summed across tasks, so a hot group is spread over as many tasks as its rows need. Ties are
    broken by the rows' places in their sorted task. Nulls of `value` count as 0; a null group is a group.
    """
    by = [F.col(group).asc_nulls_last()] if group else []
    keys = ["_part"] + (["_group"] if group else [])
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    if group:
        dealt = dealt.withColumn("_group", F.struct(F.col(group)))  # a struct is not null where its field is
    dealt = table(dealt, "dealt")
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    sums = dealt.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    over = Window.partitionBy(*(["_group"] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(before, keys).withColumn(out, F.col("_before") + F.col("_local")).drop("_before", "_local", "_row", *keys)
