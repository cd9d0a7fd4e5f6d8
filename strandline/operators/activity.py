"""Unusual activity: feature vectors, as-of frequency, decayed k-means, classification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import text_features
from strandline.functions.vectors import distance, minus, squared_distance


def featurized(events: DataFrame, text: str = "text") -> DataFrame:
    """events with the features of their text instead of it."""
    return events.withColumn("features", text_features(F.col(text))).drop(text)


def frequency(events: DataFrame, window: str = "12 hours", slide: str = "1 hour") -> DataFrame:
    """(person_id, window_end, n): posts and comments of a person in each window; likes don't count."""
    return events.where("event_type <> 'Like'").groupBy("person_id", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n")).select("person_id", F.col("w.end").alias("window_end"), "n")


def as_of(events: DataFrame, counts: DataFrame, limit: str = "6 hours") -> DataFrame:
    """events with n, the count of the person's latest window that was complete at the event, 0 if there is none or its last moment is older than limit.

    Both sides are merged into one order of time for each person, so that the cost doesn't depend on how many windows an event has before it.
    """
    moment = F.col("window_end") - F.expr("INTERVAL 1 MILLISECOND")
    marks = counts.select("person_id", moment.alias("_at"), F.lit(0).alias("_kind"), F.struct(moment.alias("at"), "n").alias("_mark"))
    rows = events.select("person_id", F.col("ts").alias("_at"), F.lit(1).alias("_kind"), F.struct(*events.columns).alias("_event"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    past = Window.partitionBy("person_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_mark", ignorenulls=True).over(past)
    fresh = F.col("last.at") >= F.col("_at") - F.expr(f"INTERVAL {limit}")
    return both.withColumn("last", last).where("_kind = 1").select("_event.*", F.when(fresh, F.col("last.n")).otherwise(F.lit(0)).alias("n"))


def classified(points: DataFrame, model: DataFrame) -> DataFrame:
    """points with the index of the nearest cluster and its distance; of equally near ones the lower index. Without a model there is no row.

    model: (index, centroid), a handful of rows by its nature: it goes to every task as one array.
    """
    whole = model.agg(F.sort_array(F.collect_list(F.struct("index", "centroid"))).alias("_model")).where(F.size("_model") > 0)
    near = F.array_min(F.transform("_model", lambda c: F.struct(squared_distance(F.col("features"), c["centroid"]).alias("d"), c["index"].alias("index"))))
    return points.crossJoin(F.broadcast(whole)).withColumn("_near", near).select(*points.columns, F.col("_near.index").alias("cluster"), F.sqrt("_near.d").alias("distance"))


def merged(old: DataFrame, new: DataFrame, decay: float) -> DataFrame:
    """The new model with the old one's decayed weight; a cluster without weight on either side keeps the new centroid. (index, centroid, weight, label)"""
    o = old.select("index", F.col("centroid").alias("o_c"), (F.col("weight") * decay).alias("o_w"))
    n = new.select("index", F.col("centroid").alias("n_c"), F.col("weight").alias("n_w"), "label")
    w = F.col("n_w") + F.coalesce("o_w", F.lit(0.0))
    mixed = F.zip_with("n_c", F.coalesce("o_c", "n_c"), lambda a, b: (a * F.col("n_w") + b * F.coalesce("o_w", F.lit(0.0))) / w)
    return n.join(o, "index", "left").select("index", F.when(w > 0, mixed).otherwise(F.col("n_c")).alias("centroid"), w.alias("weight"), "label")


def metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: the mean distance that centroids moved, the mean change of weight, and the change of k."""
    o = old.select("index", F.col("centroid").alias("o_c"), F.col("weight").alias("o_w"))
    both = new.join(o, "index", "left")
    moved = distance(F.col("centroid"), F.col("o_c"))
    counted = lambda c: F.avg(F.when(~F.isnan(c), c))
    sizes = old.agg(F.count("*").alias("old_k")).crossJoin(new.agg(F.count("*").alias("new_k")))
    return both.agg(counted(moved).alias("average_distance"), counted(F.col("weight") - F.col("o_w")).alias("average_weight_difference")).crossJoin(sizes).select("average_distance", "average_weight_difference", (F.col("new_k") - F.col("old_k")).alias("k_difference"))


def largest(model: DataFrame, k: int) -> DataFrame:
    """The k clusters of the largest weight; of equal ones the lower index."""
    return model.orderBy(F.desc("weight"), "index").limit(k)


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """(index, difference): how each centroid that both models have moved."""
    return new.join(old.select("index", F.col("centroid").alias("o_c")), "index").select("index", minus(F.col("centroid"), F.col("o_c")).alias("difference"))


# --- Lloyd's k-means on one batch of points, as the streaming model update runs it --------------------------------------


def initial(points: np.ndarray, k: int, seed: int = 137) -> np.ndarray:
    """k different points drawn by a seeded order, filled up with Gaussian ones."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0) if len(points) else points
    chosen = distinct[rng.permutation(len(distinct))[:k]]
    while len(chosen) < k:
        width = points.shape[1] if points.ndim == 2 and points.shape[1] else 1
        chosen = np.unique(np.concatenate([chosen.reshape(-1, width), rng.normal(size=(k - len(chosen), width))]), axis=0)
    return chosen


def resized(centroids: list[tuple[int, np.ndarray, float]], k: int) -> list[tuple[int, np.ndarray, float]]:
    """k clusters of (index, centroid, weight): the k of the largest weight, or the largest split in two until there are enough. The half above gets a new index."""
    if len(centroids) > k:
        return sorted(centroids, key=lambda c: -c[2])[:k]
    out, turn = list(centroids), 0
    while len(out) < k:
        turn += 1
        at = max(range(len(out)), key=lambda i: out[i][2])
        index, centre, weight = out[at]
        shift = 3 * turn * 1e-14 * np.maximum(centre, 1)
        free = max(c[0] for c in out) + 1
        out[at : at + 1] = [(index, centre - shift, weight / 2), (free, centre + shift, weight / 2)]
    return out


def lloyd(points: np.ndarray, centroids: list[tuple[int, np.ndarray, float]], k: int, rounds: int = 1000) -> list[tuple[int, np.ndarray, float]]:
    """Assigns and averages until no centroid moves. Of equal centroids the last counts; there are k of them in each round.

    As soon as fewer clusters than k have points, the centroids stay as they are, and those without points have the weight 0.
    """
    if not centroids:
        if not len(points):
            raise ValueError("without points there must be centroids")
        centroids = [(i, c, 0.0) for i, c in enumerate(initial(points, k))]
    now = centroids
    for _ in range(rounds):
        now = resized(list({tuple(np.asarray(c).tolist()): (i, c, w) for i, c, w in now}.values()), k)
        if not len(points):
            return [(i, c, 0.0) for i, c, _ in now]
        centres = np.array([c for _, c, _ in now], float)
        which = np.argmin(((points[:, None, :] - centres[None, :, :]) ** 2).sum(2), axis=1)
        size = np.bincount(which, minlength=len(now))
        if (size > 0).sum() < k:
            return [(i, c, float(n)) for (i, c, _), n in zip(now, size)]
        mean = np.array([points[which == j].mean(0) for j in range(len(now))])
        now = [(i, m, float(n)) for (i, _, _), m, n in zip(now, mean, size)]
        if np.array_equal(mean, centres):
            return now
    raise ArithmeticError(f"no fixed point in {rounds} rounds")


def merge_clusters(old, new, decay: float):
    """merged() for (index, centroid, weight) lists."""
    before = {i: (c, w * decay) for i, c, w in old}
    out = []
    for i, c, w in new:
        c0, w0 = before.get(i, (c, 0.0))
        out.append((i, (c * w + c0 * w0) / (w + w0) if w + w0 else c, w + w0))
    return out


def lloyd_distributed(points: DataFrame, centroids: list[tuple[int, list[float]]], rounds: int = 1000, tolerance: float = 1e-9) -> list[tuple[int, list[float], float]]:
    """The same on a large table of features, to a fixed point: each round is one pass with partial sums for each cluster; only k rows come to the driver.

    No fixed point in so many rounds is an error. The features are kept between the rounds, on disk where memory is short.
    """
    now, dims = sorted(centroids, key=lambda c: c[0]), len(centroids[0][1])
    kept = points.where("features is not null").select("features").mapInArrow(_blocks, "dims int, points binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            centres = np.array([[float(x) for x in c] for _, c in now])
            # Rows come in the order of their tasks, so that sums don't depend on which was done first.
            rows = sorted(map(tuple, kept.mapInArrow(lambda batches, centres=centres: _sums(batches, centres), "part int, n array<long>, sums array<double>").collect()))
            size = np.sum([r[1] for r in rows], axis=0) if rows else np.zeros(len(now))
            total = np.sum([r[2] for r in rows], axis=0).reshape(len(now), dims) if rows else np.zeros_like(centres)
            new = [(i, (total[j] / size[j]).tolist() if size[j] else c) for j, (i, c) in enumerate(now)]
            shift = max(math.dist(a[1], b[1]) for a, b in zip(now, new))
            now = new
            if shift <= tolerance:
                return [(i, list(c), float(size[j])) for j, (i, c) in enumerate(now)]
    finally:
        kept.unpersist()
    raise ArithmeticError(f"no fixed point in {rounds} rounds")


BLOCK = 4096


def _blocks(batches):
    """Arrays of features as packed blocks, which every round reads as they are."""
    for batch in batches:
        column = batch.column(0)
        for at in range(0, len(column), BLOCK):
            part = column.slice(at, BLOCK)
            values = part.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.RecordBatch.from_pydict({"dims": pa.array([len(values) // len(part)], pa.int32()), "points": pa.array([values.tobytes()], pa.binary())})


def _sums(batches, centres: np.ndarray):
    """How many points of a task are nearest to each centre, of equally near ones the first, and their sums: one row for all its blocks."""
    n, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
    for batch in batches:
        for dims, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            points = np.frombuffer(packed.as_buffer(), "<f8").reshape(-1, dims)
            which = np.argmin(np.stack([((points - c) ** 2).sum(1) for c in centres]), axis=0)
            n += np.bincount(which, minlength=len(centres))
            for j in range(len(centres)):
                sums[j] += points[which == j].sum(0)
    yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n.tolist()], pa.list_(pa.int64())), "sums": pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))})
