"""Progress and lateness of a stream of events, in the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.time import interval_micros, micros
from strandline.operators import ordered


def schedule(events: DataFrame, key: str, max_delay: str = "30 minutes", speedup: float = 10_000.0) -> DataFrame:
    """events with delay_us, a number below max_delay drawn from the key, arrival_us = time + delay, and replay_us since the first event."""
    most = interval_micros(max_delay)
    delay = F.pmod(F.col(key) * F.lit(2654435761), F.lit(most))
    out = events.withColumn("delay_us", delay).withColumn("arrival_us", micros(F.col("ts")) + F.col("delay_us"))
    first = events.agg(F.min(micros(F.col("ts"))).alias("_first"))
    return out.crossJoin(F.broadcast(first)).withColumn("replay_us", F.ceil((F.col("arrival_us") - F.col("_first")) / F.lit(speedup))).drop("_first")


def lateness(scheduled: DataFrame, key: str, out_of_orderness: str = "30 minutes", shard: str | None = None) -> DataFrame:
    """scheduled with watermark_us (the newest event that arrived before, less the bound and 1), behind_us (how far behind that newest event), is_late (before the watermark).

    With a shard column each shard has a progress of its own, as each source partition has; without one, all rows have one order, which is cut
    into ranges: each has the newest event of those before it, and an order of its own.
    """
    t, order = micros(F.col("ts")), ("arrival_us", key)
    if shard:
        rows, newest = scheduled, F.max(t).over(Window.partitionBy(shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    else:
        rows = ordered.ranged(scheduled, *order)
        rows = rows.join(F.broadcast(ordered.before(rows, F.max(t), max)), "range_number")
        newest = F.greatest(F.max(t).over(ordered.inside(*order).rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    rows = rows.withColumn("newest_us", newest)
    newest = F.col("newest_us")
    mark = newest - interval_micros(out_of_orderness) - 1
    return rows.withColumns({"watermark_us": mark, "behind_us": F.greatest(F.lit(0), newest - t), "is_late": F.coalesce(t < mark, F.lit(False))}).drop("range_number", "before", "newest_us")


def progress(late: DataFrame, every: str = "1 day") -> DataFrame:
    """(period, events, late, behind, most_behind_us) for each period of event time."""
    return late.groupBy(F.window("ts", every).alias("w")).agg(
        F.count("*").alias("events"), F.count_if("is_late").alias("late"), F.count_if(F.col("behind_us") > 0).alias("behind"), F.max("behind_us").alias("most_behind_us")
    ).select(F.col("w.start").alias("period"), "events", "late", "behind", "most_behind_us")
