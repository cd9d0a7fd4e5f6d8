"""Jobs from the command line: python -m strandline.streaming.main JOB --out FOLDER [--files FOLDER | --topics FOLDER --group NAME] [--settings FILE] [--master URL].

Every job reads its streams as the settings say, runs over all that is there, and goes on from its checkpoint in the folder when it is run again.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.settings import Settings
from strandline.sources.events import Sources, as_events, pairs
from strandline.sources.topics import Topic
from strandline.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(settings: Settings, master: str | None = None, name: str = "strandline") -> SparkSession:
    """A session for streams: local on all cores without a master; state that has timers, and shuffle partitions as topics have them where none are set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.streaming.stateStore.providerClass", ROCKS).config("spark.sql.session.timeZone", "UTC")
    return (builder.master(master) if master else builder.master("local[*]").config("spark.sql.shuffle.partitions", str(settings.topic_partitions))).getOrCreate()


def load(sources: Sources, out: str, settings: Settings) -> None:
    """Likes and posts from files to topics, keyed by post."""
    for name, rows, key in (("likes", sources.likes(), "post_id"), ("posts", sources.posts(), "post_id")):
        topic = Topic(sources.spark, out, name, rows.schema.simpleString(), settings.topic_partitions)
        topic.write_stream(rows, f"{out}/_checkpoints/{name}", key).awaitTermination()


def replies(sources: Sources, out: str, settings: Settings) -> None:
    """Comments with their posts to the topic resolved, and those dropped beside it."""
    raw = sources.raw_comments().withColumn("ts_us", F.unix_micros("ts"))
    patience = int(jobs.interval_micros(settings.max_out_of_orderness))
    trees = jobs.ReplyTrees(sources.spark, f"{out}/trees", patience, settings.mapping_ttl_hours)

    def batch(rows: DataFrame, number: int) -> None:
        rows = jobs.cut(rows)
        details = rows.select("comment_id", "person_id", "reply_to_comment_id", "ts")
        details.write.mode("overwrite").parquet(f"{out}/details/batch={number}")
        trees.batch(rows.select("comment_id", "reply_to_post_id", "reply_to_comment_id", F.col("ts_us").alias("ts")), number)
        known = trees.resolved.rows().where(F.col("write") == number).select("comment_id", "post_id")
        sources.spark.read.parquet(f"{out}/details").drop("batch").join(known, "comment_id").select("comment_id", "post_id", "person_id", "reply_to_comment_id", "ts").write.mode("overwrite").parquet(f"{out}/resolved/batch={number}")

    jobs.run(raw, f"{out}/trees", each=batch)


def _events(sources: Sources) -> DataFrame:
    return as_events(sources.posts(), sources.comments(), sources.likes())


def statistics(sources: Sources, out: str, settings: Settings) -> None:
    """Statistics of active posts to the topic statistics."""
    rows = jobs.post_statistics_anchored(_events(sources), settings.statistics_window, settings.statistics_slide, settings.count_author)
    progress = jobs.Progress()
    jobs.run(rows, f"{out}/statistics", progress=progress)
    print(progress.totals("post_statistics"))


def activity(sources: Sources, out: str, settings: Settings) -> None:
    """Cluster models of the texts of posts; parameters that change are read from the file parameters in the out folder."""
    posts = jobs.activity.featurized(sources.posts().select("post_id", "person_id", "ts", "content"), "content")
    jobs.run(jobs.cluster_updates(posts, settings, f"{out}/parameters"), f"{out}/models")


def recommendations(sources: Sources, out: str, settings: Settings) -> None:
    """Recommendations of persons by what they like; features are those of the relations in the files' folder."""
    spark, folder = sources.spark, (sources.files or "").rstrip("/")
    relation = lambda name: pairs(spark, f"{folder}/{name}.csv").toDF("person_id", "id")
    persons = jobs.recommend.person_features(relation("interests"), relation("work"), relation("study"))
    posts = jobs.recommend.post_features(spark.read.schema("post_id long, forum_id long, tags array<int>").parquet(f"{folder}/post_info"), spark.read.schema("forum_id long, features array<string>").parquet(f"{folder}/forum_features"))
    seen = jobs.Activity(spark, f"{out}/activity", settings.active_days)
    jobs.run(sources.likes(), f"{out}/activity", each=seen.batch)
    windows = jobs.posts_in_window(sources.likes(), settings.recommendation_window, settings.recommendation_slide)
    job = jobs.Recommendations(spark, f"{out}/recommendations", settings, posts, persons, relation("knows").toDF("person_id", "known_id"), seen.read)
    jobs.run(windows, f"{out}/recommendations", each=job.batch)


JOBS: dict[str, Callable] = {"load": load, "replies": replies, "statistics": statistics, "activity": activity, "recommendations": recommendations}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandline")
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--out", required=True)
    for name in ("files", "topics", "group", "settings", "master"):
        p.add_argument(f"--{name}")
    a = p.parse_args(argv)
    settings = Settings.load(a.settings)
    spark = SparkSession.getActiveSession() or session(settings, a.master, a.job)
    JOBS[a.job](Sources(spark, settings, a.files, a.topics, a.group), a.out.rstrip("/"), settings)


if __name__ == "__main__":
    main()
