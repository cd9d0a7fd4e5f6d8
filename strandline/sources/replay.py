"""Replay of events: random delays, the order of arrival, watermarks, pacing."""

from __future__ import annotations

import heapq
import random
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.time import replay_time
from strandline.storage import cut


def delays(maximum: int, seed: int = 137) -> Callable[[], int]:
    """Normal delays with mean maximum / 4 and deviation maximum / 2, drawn again while outside 0 to maximum."""
    draw = random.Random(seed)

    def one() -> int:
        while True:
            d = draw.gauss(maximum / 4, maximum / 2)
            if 0 <= d <= maximum:
                return int(d)

    return one if maximum > 0 else lambda: 0


def scheduled(events: Iterable, time_of: Callable, delay: Callable[[object], int] = lambda _: 0, interval: int | None = None, max_delay: int = 0, allow_late: bool = True, ordered: bool = False) -> Iterator[tuple[str, object, int, bool]]:
    """("event", event, emit time, late) and ("watermark", None, watermark, False) in order of emission.

    An event is emitted at its time plus delay. The first watermark is due an interval after the first event's emission and so on; one due at t says
    t - max_delay - 1. late: the event's time isn't after the last watermark. Late events are left out unless they are allowed. With ordered, an event
    before its predecessor is an error.
    """
    heap, last, due, mark, number = [], None, None, None, 0

    def flush(up_to):
        nonlocal due, mark
        while heap:
            mark_first = due is not None and due <= heap[0][0]
            if up_to is not None and (due if mark_first else heap[0][0]) > up_to:
                return
            if mark_first:
                mark = due - max_delay - 1
                yield "watermark", None, mark, False
                due += interval
                continue
            at, _, event = heapq.heappop(heap)
            if due is None and interval:
                due = at + interval
            late = mark is not None and time_of(event) <= mark
            if allow_late or not late:
                yield "event", event, at, late

    for event in events:
        t = time_of(event)
        if t is None:
            continue
        if ordered and last is not None and t < last:
            raise ValueError("events aren't in order of time")
        last = t if last is None else max(last, t)
        heapq.heappush(heap, (t + delay(event), number, event))
        number += 1
        yield from flush(t - 1 if not ordered else t)
    yield from flush(None)
    if due is not None:
        yield "watermark", None, due - max_delay - 1, False


def paced(events: Iterable, time_of: Callable, speedup: float, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> Iterator:
    """events, each held back to its replay time; a speed-up of 0 doesn't wait. Events that are behind pass at once."""
    start = first = None
    for event in events:
        t = time_of(event)
        if speedup:
            if start is None:
                start, first = clock() * 1000, t
            ahead = replay_time(start, first, t, speedup) - clock() * 1000
            if ahead > 0:
                wait(ahead / 1000)
        yield event


#: Rows of a file that slices() writes.
FILE_ROWS = 250_000


def write_batch(df: DataFrame, path: str, files: int) -> None:
    """df as exactly so many files behind those that are there, some of them empty if it has few rows: a stream that takes as many for a batch takes this and no more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    there = lambda: sum(f.getPath().getName().endswith(".parquet") for f in system.listStatus(at)) if system.exists(at) else 0
    wanted = there() + files
    (df.coalesce(1) if files == 1 else df.repartition(files)).write.mode("append").parquet(path)
    for _ in range(wanted - there()):
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)


def slices(df: DataFrame, path: str, count: int, order: str = "ts") -> int:
    """df as count slices in the order given, each of as many files, which is returned: a streaming reader takes so many a batch. For tests and demonstrations.

    A slice has a file for every FILE_ROWS rows or so, of rows from all over it; only slices follow each other in order. The bounds between them are quantiles to a
    thousandth, of ranks, not of all values. df is computed once.
    """
    kept = cut(df)
    keyed = kept if "_order" in df.columns else kept.withColumn("_order", F.unix_micros(F.col(order).cast("timestamp")).cast("double"))
    bounds = keyed.approxQuantile("_order", [i / count for i in range(1, count)], 0.001)
    files = max(1, -(-kept.count() // (count * FILE_ROWS)))
    edges = [float("-inf"), *bounds, float("inf")]
    for lo, hi in zip(edges, edges[1:]):
        write_batch(keyed.where((F.col("_order") > lo) & (F.col("_order") <= hi)).drop("_order"), path, files)
    return files
