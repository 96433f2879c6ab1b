"""Consecutive numbers over a distributed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.tables import settle


def number_rows(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with ``name`` from 0, gapless by ``order``.

    Ranges of the order are sorted and written once; places are counted inside a range
    and the counts of the ranges before it are added, so no task holds all rows. Only
    one row for each range goes through a single task.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = settle(ranged, "numbered").withColumn("_range", F.shiftright("_at", 33))
    counts = settle(ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_from")), "number-counts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_from")).drop("_at", "_range", "_from", "_before")
