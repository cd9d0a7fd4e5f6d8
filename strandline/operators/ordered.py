"""One order over all rows of a table, in ranges of it instead of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import cut


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with range_number: the ranges follow each other in the order given, which must tell rows apart where ties matter.

    Written and read again, as two sorts would choose other ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(ranges, *order).withColumn("range_number", F.spark_partition_id()))


def before(df: DataFrame, value, combine) -> DataFrame:
    """(range_number, before): an aggregate of all rows in the ranges before each. Only a row for each range comes to the driver."""
    rows = sorted(tuple(r) for r in df.groupBy("range_number").agg(value.alias("v")).collect())
    out, so_far = [], None
    for number, v in rows:
        out.append((number, so_far))
        so_far = v if so_far is None else so_far if v is None else combine(so_far, v)
    return df.sparkSession.createDataFrame(out, "range_number int, before long")


def inside(*order) -> Window:
    return Window.partitionBy("range_number").orderBy(*order)
