"""Row numbers over a whole table without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import materialize


def global_row_number(df: DataFrame, *order: Column | str, name: str = "row_number", parts: int = 64) -> DataFrame:
    """``df`` with numbers from 1 in the given order.

    Rows are dealt out by ranges of the order, numbered inside each range, and
    moved up by the sizes of the ranges before (``parts`` numbers). The dealt rows
    are written, as ranges come from a sample that another run would draw anew.
    Order columns should tell rows apart; ties get any order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()), "ranges")
    mine = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.withColumn(name, mine).join(F.broadcast(base), "_part").withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_part", "_base")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, parts: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to each row.

    A group is dealt out by ranges of the order (written, as above), summed inside
    each range and moved up by the ranges before, so a group of any size is many
    tasks. Order columns should tell rows of a group apart.
    """
    ranged = materialize(df.withColumn("_v", value).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    mine = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_part", *group).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # ``parts`` rows a group at most
    keys = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    base = sums.select("_part", *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    out = ranged.withColumn(name, F.sum("_v").over(mine)).join(base.withColumnRenamed("_part", "_p"), [F.col("_part") == F.col("_p"), *keys])
    return out.withColumn(name, F.col(name) + F.col("_base")).drop("_v", "_part", "_p", "_base", *[f"_g{i}" for i in range(len(group))])
