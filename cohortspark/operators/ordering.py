"""Numbering rows in a total order without a single task, and samples against all rows in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut

_IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column | str], name: str = "r") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which has to tell all rows apart.

    Rows are dealt out by ranges and sorted within them; each range starts where the counts of those
    before it end (a table of one row per partition).
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def running_sums(rows: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums in a total order, the row itself included: ``sums`` has new names by column.

    As ``numbered``: each range of rows sums up by itself, from where the sums of those before it end.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    totals = placed.groupBy("__part").agg(*(F.sum(c).alias(f"__{n}") for c, n in sums.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *(F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums.values()))
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.join(F.broadcast(starts), "__part")
    for c, n in sums.items():
        within = within.withColumn(n, F.sum(c).over(own) + F.coalesce(F.col(f"__{n}"), F.lit(0)))
    return within.drop("__part", "__at", *(f"__{n}" for n in sums.values()))


def ranked(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "i") -> DataFrame:
    """``rows`` with their place (from 1) within their group; the order has to tell the group's rows apart.

    One group may hold any share of the rows: places are counted over all of them, and a group's first
    one is taken off.
    """
    placed = numbered(rows, [*group, *order], "__r")
    firsts = placed.groupBy(*group).agg(F.min("__r").alias("__first"))
    return placed.join(firsts, group).withColumn(name, F.col("__r") - F.col("__first") + 1).drop("__r", "__first")


def against_all(sample: DataFrame, rows: DataFrame, key: str, block: int = 64, salts: int = 16) -> DataFrame:
    """Every row with every row of ``sample`` (columns must not clash; ``key`` orders the sample).

    The result is as large as the product; the sample is cut into blocks of ``block`` rows, and each
    row meets whole blocks in an equi-join that is spread by ``salts``. Nothing is broadcast.
    """
    blocks = numbered(sample, [key], "__r").withColumn("__block", F.floor((F.col("__r") - 1) / block))
    blocks = cut(blocks.groupBy("__block").agg(F.collect_list(F.struct(*sample.columns)).alias("__own")))
    n = blocks.count()
    if n == 0:
        return rows.join(sample, F.lit(False))
    spread = blocks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(salts)).cast("int"))
    salted = salted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return salted.join(spread, ["__block", "__salt"]).select(*rows.columns, F.inline("__own"))
