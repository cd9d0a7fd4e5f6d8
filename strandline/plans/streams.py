"""The streaming jobs over the given tables: replayed in order of time from files, closed by marker events, read back as tables."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import registry as batch
from strandline.plans.registry import ntz, query
from strandline.settings import Settings
from strandline.sources import tables as T
from strandline.sources.events import bounded
from strandline.sources.keyed import KeyedTable
from strandline.sources.replay import slices, write_batch
from strandline.storage import cut
from strandline.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MARK = -1


@contextmanager
def rocks(spark: SparkSession):
    """Timers and typed state need this state store."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def replayed(events: DataFrame, folder: str, parts: int = 4) -> DataFrame:
    """events as a stream of files in order of time, and two markers a month apart behind them, which close all windows."""
    files = slices(events, f"{folder}/in", parts)
    last = events.agg(F.max("ts").alias("ts"))
    for days in (30, 60):
        row = last.select(*[(F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts") if c == "ts" else (F.lit("Comment") if t == "string" else F.lit(MARK)).cast(t).alias(c) for c, t in events.dtypes])
        write_batch(row, f"{folder}/in", files)
    stream = events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    return bounded(stream)


def run(spark, d, job, key) -> DataFrame:
    folder = jobs.new_folder(spark)
    out = job(replayed(T.forum_events(spark, d), folder))
    jobs.run(out, folder)
    return ntz(spark.read.schema(out.schema).parquet(f"{folder}/out").where(F.col(key) != MARK))


@query("stream_post_stats", batch.ORACLE["post_stats_aligned"])
def stream_post_stats(spark, d):
    return run(spark, d, jobs.post_statistics, "post_id")


@query("stream_post_stats_anchored", batch.ORACLE["post_stats_anchored"])
def stream_post_stats_anchored(spark, d):
    with rocks(spark):
        return run(spark, d, jobs.post_statistics_anchored, "post_id")


@query("stream_posts_in_window", batch.ORACLE["posts_in_window"])
def stream_posts_in_window(spark, d):
    return run(spark, d, lambda e: jobs.posts_in_window(e).select("person_id", "window_end", batch.joined_col("posts")), "person_id")


@query("stream_person_frequency", batch.ORACLE["person_frequency"])
def stream_person_frequency(spark, d):
    return run(spark, d, jobs.person_frequency, "person_id")


@query("stream_event_frequency_asof", batch.ORACLE["event_frequency_asof"])
def stream_event_frequency_asof(spark, d):
    """Events and the counts of their persons' windows, merged by time."""
    fe = T.forum_events(spark, d).where("event_type <> 'Like'")
    us = F.unix_micros("ts")
    counts = batch.activity.frequency(fe).select("person_id", F.lit(MARK).cast("long").alias("event_id"), (F.unix_micros("window_end") - 1000).alias("t"), F.lit(True).alias("is_count"), "n")
    rows = fe.select("person_id", "event_id", us.alias("t"), F.lit(False).alias("is_count"), F.lit(0).cast("long").alias("n")).unionByName(counts)
    rows = rows.withColumn("ts", F.timestamp_micros("t"))
    folder = jobs.new_folder(spark)
    with rocks(spark):
        files = slices(rows, f"{folder}/in", 4)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in").drop("ts")
        out = jobs.with_frequency(stream)
        jobs.run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("event_id", "person_id", "n")


@query("stream_reply_tree", batch.ORACLE["post_mapping"])
def stream_reply_tree(spark, d):
    """Comments in order of time, so that replies before what they reply to wait a batch or more."""
    comments = T.comments(spark, d).select("comment_id", "reply_to_post_id", "reply_to_comment_id", "ts").withColumn("_order", F.col("ts").cast("double"))
    folder = jobs.new_folder(spark)
    files = slices(comments, f"{folder}/in", 3, "ts")
    stream = spark.readStream.schema(comments.drop("_order").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    trees = jobs.ReplyTrees(spark, folder, 10**9)
    jobs.run(stream, folder, each=trees.batch)
    return trees.resolved.read().select("comment_id", "post_id")


@query(
    "stream_reply_dropped",
    f"""WITH RECURSIVE {batch.COMMENTS}, {batch.TREE} SELECT comment_id, reply_to_comment_id FROM co WHERE comment_id NOT IN (SELECT comment_id FROM tree)""",
)
def stream_reply_dropped(spark, d):
    """The comments that the stream of trees drops once a last comment, later than all by more than its patience, is there."""
    comments = T.comments(spark, d).select("comment_id", "reply_to_post_id", "reply_to_comment_id", "ts")
    last = comments.agg(F.lit(MARK).cast("long").alias("comment_id"), F.lit(MARK).cast("long").alias("reply_to_post_id"), F.lit(None).cast("long").alias("reply_to_comment_id"), (F.max("ts") + 10**6 + 1).alias("ts"))
    comments = comments.unionByName(last).withColumn("_order", F.col("ts").cast("double"))
    folder = jobs.new_folder(spark)
    files = slices(comments, f"{folder}/in", 3, "ts")
    stream = spark.readStream.schema(comments.drop("_order").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    trees = jobs.ReplyTrees(spark, folder, 10**6)
    jobs.run(stream, folder, each=trees.batch)
    return trees.dropped().select("comment_id", "reply_to_comment_id")


@query("stream_clusters", None)
def stream_clusters(spark, d):
    """The models that the activity vectors' stream gives, one for each closed window."""
    vectors = cut(batch._vectors(spark, d).join(T.forum_events(spark, d).select("event_id", "ts"), "event_id").select("event_id", "ts", "features"))
    folder = jobs.new_folder(spark)
    files = slices(vectors, f"{folder}/in", 4)
    marks = vectors.agg(F.max("ts").alias("ts")).select(F.lit(MARK).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("array<double>").alias("features"))
    write_batch(marks, f"{folder}/in", files)
    stream = bounded(spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"))
    with rocks(spark):
        out = jobs.cluster_updates(stream, Settings())
        jobs.run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out").where("kind = 'model'").select("version", "index", "centroid", "weight")


@query("stream_recommendations", batch.ORACLE["recommendations"])
def stream_recommendations(spark, d):
    """The whole job: the activity of persons first, then recommendations for each window that the stream closes."""
    folder, settings = jobs.new_folder(spark), replace(Settings(), lsh_threshold=batch.THRESHOLD, hashes=batch.HASHES, recommendations=batch.TOP, min_similarity=batch.LEAST)
    events = replayed(T.forum_events(spark, d), folder)
    seen = jobs.Activity(spark, f"{folder}/seen", 10_000)
    jobs.run(events, f"{folder}/seen", each=seen.batch)
    windows = jobs.posts_in_window(events, batch.WINDOW, batch.SLIDE)
    posts, persons = (cut(x) for x in (batch._post_features(spark, d), batch._persons(spark, d)))
    job = jobs.Recommendations(spark, folder, settings, posts, persons, cut(batch._circles(spark, d)), seen.read)
    jobs.run(windows, folder, each=job.batch)
    rows = job.table.read().where(F.col("person_id") != MARK)
    return ntz(rows.select("person_id", "window_end", F.array_join(F.transform("persons", lambda p: p["person_id"].cast("string")), ",").alias("persons")))


@query("upserted_last_activity", f"WITH {batch.FE} SELECT person_id, max(ts) AS last_ts FROM fe GROUP BY 1")
def upserted_last_activity(spark, d):
    """The newest event of each person in a keyed table that the stream's batches write to."""
    folder = jobs.new_folder(spark)
    events = T.forum_events(spark, d).select("person_id", "ts")
    files = slices(events, f"{folder}/in", 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    table = KeyedTable(spark, f"{folder}/table", "person_id", "ts")
    jobs.run(stream, folder, each=table.sink())
    return ntz(table.read().select("person_id", F.col("ts").alias("last_ts")))
