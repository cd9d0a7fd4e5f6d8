"""Streaming jobs over any streaming DataFrame of events; the windowed ones call the batch operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import document_id
from strandline.functions.time import from_micros, interval_micros, micros
from strandline.functions.vectors import squared_distance
from strandline.operators import activity, recommend, replies, statistics
from strandline.settings import Settings
from strandline.sources.keyed import KeyedTable
from strandline.storage import cut, shared_dir, ship
from strandline.streaming.processors import AsOfFrequency, ClusterUpdates, PostStatistics


def post_statistics(events: DataFrame, window: str = "12 hours", slide: str = "30 minutes", count_author: bool = False) -> DataFrame:
    return statistics.aligned(events, window, slide, count_author)


def post_statistics_anchored(events: DataFrame, window: str = "12 hours", slide: str = "30 minutes", count_author: bool = False) -> DataFrame:
    """Events of a post before its open window are dropped; the query's observed metrics count them, and those ahead of, in and before the current slide."""
    ship(events.sparkSession)
    keyed = events.select("post_id", "event_type", "person_id", "ts", micros(F.col("ts")).alias("t"))
    out = keyed.groupBy("post_id").transformWithStateInPandas(PostStatistics(interval_micros(window), interval_micros(slide), count_author), PostStatistics.OUTPUT, "Append", "EventTime")
    out = out.observe("post_statistics", *[F.sum(c).alias(c) for c in ("ahead", "current", "older", "dropped")])
    return out.select("post_id", from_micros(F.col("window_us")).alias("window_end"), "comment_count", "reply_count", "like_count", "distinct_users", "new_post")


def posts_in_window(events: DataFrame, window: str = "4 hours", slide: str = "1 hour") -> DataFrame:
    return recommend.posts_in_window(events, window, slide)


def person_frequency(events: DataFrame, window: str = "12 hours", slide: str = "1 hour") -> DataFrame:
    return activity.frequency(events, window, slide)


def with_frequency(rows: DataFrame, limit: str = "6 hours") -> DataFrame:
    """rows: (person_id, event_id, t, is_count, n), events and counts in one stream, t in microseconds."""
    ship(rows.sparkSession)
    return rows.groupBy("person_id").transformWithStateInPandas(AsOfFrequency(interval_micros(limit)), AsOfFrequency.OUTPUT, "Append", "None")


def run(df: DataFrame, folder: str, mode: str = "append", each=None, progress: Progress | None = None) -> None:
    """Runs a query over all that is there, to Parquet in folder/out or through each(batch, number); its checkpoint is in folder, so that a second run goes on."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{folder}/out")).start()
    query.awaitTermination()
    if progress:
        progress.take(query)


class Progress:
    """What queries report of their progress: rows, rate, watermark, state rows, rows dropped as late, and what was observed."""

    def __init__(self):
        self.rows: list[dict] = []

    def take(self, query) -> list[dict]:
        for p in query.recentProgress:
            state = p.get("stateOperators") or [{}]
            self.rows.append(
                {
                    "batch": p["batchId"],
                    "rows": p["numInputRows"],
                    "rate": p.get("processedRowsPerSecond"),
                    "watermark": (p.get("eventTime") or {}).get("watermark"),
                    "state_rows": sum(s.get("numRowsTotal", 0) for s in state),
                    "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
                    "observed": {k: v.asDict() if hasattr(v, "asDict") else v for k, v in (p.get("observedMetrics") or {}).items()},
                }
            )
        return self.rows

    def totals(self, name: str) -> dict[str, int]:
        """The sums of an observation's metrics over all batches."""
        out: dict[str, int] = {}
        for row in self.rows:
            for k, v in (row["observed"].get(name) or {}).items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not be there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


class ReplyTrees:
    """Reply trees of a stream of comments: each batch is resolved together with the comments that still wait, against the mapping so far.

    resolved is a keyed table of (comment_id, post_id, ts), dropped a table of comments that will never have a post. A comment that waits longer than
    patience (in units of ts behind the newest) is dropped, and everything below a dropped comment with it, whenever it comes. ttl_hours: how long after it was resolved
    a comment can be replied to, in time of processing; None is forever. metrics has a row for each batch.
    """

    COLUMNS = "comment_id long, reply_to_post_id long, reply_to_comment_id long, ts long"
    NAMES = [c.split()[0] for c in COLUMNS.split(", ")]

    def __init__(self, spark: SparkSession, folder: str, patience: int, ttl_hours: float | None = None):
        self.resolved = KeyedTable(spark, f"{folder}/resolved", "comment_id")
        self.folder, self.spark, self.patience, self.ttl = folder, spark, patience, ttl_hours

    def dropped(self) -> DataFrame:
        return _written(self.spark, f"{self.folder}/dropped", self.COLUMNS)

    def metrics(self) -> DataFrame:
        return _written(self.spark, f"{self.folder}/metrics", "batch long, resolved long, dropped long, waiting long, mappings long")

    def _mapping(self, number: int) -> DataFrame:
        """Comments resolved by earlier batches that can still be replied to."""
        if not self.resolved.exists(before=number):
            return self.spark.createDataFrame([], "comment_id long, post_id long, ts long")
        known = self.resolved.rows(before=number)
        if self.ttl is not None:
            known = known.where(F.col("resolved_at") >= F.current_timestamp() - F.make_interval(secs=F.lit(float(self.ttl * 3600))))
        return known.select("comment_id", "post_id", "ts")

    def batch(self, new: DataFrame, number: int) -> None:
        waiting = _written(self.spark, f"{self.folder}/waiting/{number - 1}", self.COLUMNS)
        comments = cut(waiting.unionByName(new.select(*[F.col(c).cast("long") for c in self.NAMES])))
        asked = comments.select(F.col("reply_to_comment_id").alias("comment_id")).where("comment_id is not null").distinct()
        mapping = self._mapping(number)
        mappings = mapping.count()
        known = mapping.join(asked, "comment_id", "left_semi").select("comment_id", F.col("post_id").alias("reply_to_post_id"), F.lit(None).cast("long").alias("reply_to_comment_id"), "ts")
        tree = cut(replies.reply_tree(known.unionByName(comments)))
        rooted = comments.join(tree.where("post_id is not null").select("comment_id", "post_id"), "comment_id").select("comment_id", "post_id", "ts", F.current_timestamp().alias("resolved_at"))
        self.resolved.upsert(rooted, number)
        newest = comments.agg(F.max("ts").alias("newest"))
        open_ = cut(comments.join(tree.where("post_id is null").select("comment_id"), "comment_id", "left_semi").crossJoin(F.broadcast(newest)))
        # Below one that is dropped now or was before, nothing can be resolved: a tree with those as its roots finds it all.
        before = _written(self.spark, f"{self.folder}/dropped", f"{self.COLUMNS}, batch long").where(F.col("batch") < number).join(asked, "comment_id", "left_semi")
        late = open_.where(F.col("ts") < F.col("newest") - self.patience)
        roots = late.select("comment_id").unionByName(before.select("comment_id")).distinct()
        as_root = roots.select("comment_id", F.lit(-1).cast("long").alias("reply_to_post_id"), F.lit(None).cast("long").alias("reply_to_comment_id"), F.lit(0).cast("long").alias("ts"))
        below = open_.join(roots, "comment_id", "left_anti").select(*self.NAMES[:3], F.lit(0).cast("long").alias("ts"))
        lost = cut(replies.reply_tree(as_root.unionByName(below)).where("post_id is not null").select("comment_id"))
        gone, left = open_.join(lost, "comment_id", "left_semi").select(*self.NAMES), open_.join(lost, "comment_id", "left_anti").select(*self.NAMES)
        gone.write.mode("overwrite").parquet(f"{self.folder}/dropped/batch={number}")
        left.write.mode("overwrite").parquet(f"{self.folder}/waiting/{number}")
        counts = (number, rooted.count(), gone.count(), left.count(), mappings)
        self.spark.createDataFrame([counts], "batch long, resolved long, dropped long, waiting long, mappings long").write.mode("overwrite").parquet(f"{self.folder}/metrics/number={number}")
        # What an older batch left waiting is not needed any more, as only the last one can run again.
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/waiting/{number - 2}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def cluster_updates(vectors: DataFrame, settings: Settings, control: str | None = None) -> DataFrame:
    """Models and their metadata of a stream of (ts, features) with a watermark, as rows of ClusterUpdates.OUTPUT.

    One key holds the window, as the window's count needs one order of all points; it holds at most cluster_max points at a time, and those ahead of it.
    """
    ship(vectors.sparkSession)
    processor = ClusterUpdates(interval_micros(settings.cluster_window), settings.cluster_min, settings.cluster_max, settings.clusters, settings.decay, control)
    keyed = vectors.select(F.lit(0).alias("key"), "ts", micros(F.col("ts")).alias("t"), "features")
    return keyed.groupBy("key").transformWithStateInPandas(processor, ClusterUpdates.OUTPUT, "Append", "EventTime")


def classified_as_of(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """vectors with version, cluster and distance by the last model whose window ended at or before each; those before the first model have none. A row for each window and cluster is few."""
    each = models.groupBy("version", "end_us").agg(F.sort_array(F.collect_list(F.struct("index", "centroid"))).alias("clusters"))
    all_ = each.agg(F.sort_array(F.collect_list(F.struct("end_us", "version", "clusters"))).alias("_models"))
    near = F.array_min(F.transform(F.col("_model.clusters"), lambda c: F.struct(squared_distance(F.col("features"), c["centroid"]).alias("d"), c["index"].alias("index"))))
    known = vectors.crossJoin(F.broadcast(all_)).withColumn("_model", F.try_element_at(F.filter("_models", lambda m: m["end_us"] <= micros(F.col("ts"))), F.lit(-1))).where("_model is not null")
    return known.withColumn("_near", near).select(*vectors.columns, F.col("_model.version").alias("version"), F.col("_near.index").alias("cluster"), F.sqrt("_near.d").alias("distance"))


class Activity:
    """The newest event of each person: a keyed table from a stream's batches, without those older than days before the newest of all.

    metrics has a row for each batch: the persons held and those removed.
    """

    def __init__(self, spark: SparkSession, folder: str, days: int):
        self.spark, self.folder, self.days = spark, folder, days
        self.table = KeyedTable(spark, f"{folder}/activity", "person_id", "last_ts")

    def batch(self, new: DataFrame, number: int) -> None:
        latest = recommend.last_activity(new.select("person_id", F.col("ts").cast("timestamp").alias("ts")))
        if self.table.exists(before=number):
            latest = latest.unionByName(self.table.rows(before=number).select("person_id", "last_ts"))
        latest = cut(latest.groupBy("person_id").agg(F.max("last_ts").alias("last_ts")))
        oldest = latest.agg((F.max("last_ts") - F.make_interval(days=F.lit(self.days))).alias("oldest"))
        kept = cut(latest.crossJoin(F.broadcast(oldest)).where(F.col("last_ts") >= F.col("oldest")).select("person_id", "last_ts"))
        whole, held = latest.count(), kept.count()
        # The whole map is one write: what was removed must not come back from an older one.
        self.table.replace(kept, number)
        self.spark.createDataFrame([(number, held, whole - held)], "batch long, held long, removed long").write.mode("overwrite").parquet(f"{self.folder}/metrics/number={number}")

    def read(self) -> DataFrame:
        return self.table.read()

    def metrics(self) -> DataFrame:
        return _written(self.spark, f"{self.folder}/metrics", "batch long, held long, removed long")


class Recommendations:
    """Recommendations for each closed window of a stream of (person_id, window_end, posts): features, signatures, candidates, those known and inactive removed, top N.

    posts and persons are tables of features, known one of pairs or of circles (see recommend.circles), activity gives (person_id, last_ts) as it is at the batch. The results
    are a keyed table by person and window; metrics has a row for each batch.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, posts: DataFrame, persons: DataFrame, known: DataFrame, activity):
        self.spark, self.folder, self.settings, self.posts, self.persons, self.known, self.activity = spark, folder, settings, posts, persons, known, activity
        self.sigs = cut(recommend.signatures(persons, settings.hashes))
        self.table = KeyedTable(spark, f"{folder}/recommendations", "document_id")

    def batch(self, windows: DataFrame, number: int) -> None:
        s = self.settings
        features = recommend.activity_features(windows, self.posts, self.persons)
        queries = cut(recommend.signatures(features, s.hashes))
        circles = self.known if "circles" in self.known.columns else None
        last = self.activity()
        found = lambda **wanted: recommend.candidates(queries, self.sigs, s.hashes, s.lsh_threshold, **wanted)
        unknown = lambda **more: found(circles=circles, activity=last, days=s.active_days, **more)
        active, similar = ((d if circles is not None else recommend.exclude_known(d, self.known)) for d in (unknown(), unknown(least=s.min_similarity)))
        best = recommend.top(cut(similar), queries, self.sigs, s.recommendations, s.min_similarity)
        rows = recommend.recommendations(best, queries).withColumn("document_id", document_id(F.col("person_id"), F.unix_millis("window_end")))
        self.table.upsert(rows, number)
        counts = [(number, *(d.count() for d in (queries, found(), active)))]
        self.spark.createDataFrame(counts, "batch long, queries long, candidates long, active long").write.mode("overwrite").parquet(f"{self.folder}/metrics/number={number}")

    def metrics(self) -> DataFrame:
        return _written(self.spark, f"{self.folder}/metrics", "batch long, queries long, candidates long, active long")


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark)
