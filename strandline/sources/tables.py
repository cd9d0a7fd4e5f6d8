"""The given tables as events, posts, comments, persons and forums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import ship

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_forum_events(events: DataFrame) -> DataFrame:
    """signup is a post, click a comment, error a reply, all else a like; the post is props.k."""
    kind = F.when(F.col("event_type") == "signup", "Post").when(F.col("event_type") == "click", "Comment").when(F.col("event_type") == "error", "Reply").otherwise("Like")
    return events.select(
        "event_id",
        kind.alias("event_type"),
        F.get_json_object("props", "$.k").cast("long").alias("post_id"),
        F.col("user_id").alias("person_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def forum_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_forum_events(read(spark, sf_dir, "events"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts; every fifth has an image and no content. Post ids are three times those of documents, so that events name posts that aren't there,
    and every fourth post is in a forum that isn't there."""
    image, forum = F.col("doc_id") % 5 == 0, F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    return read(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 3).alias("post_id"),
        F.when(F.col("doc_id") % 4 == 0, forum + 100).otherwise(forum).alias("forum_id"),
        F.when(~image, F.col("text")).alias("content"),
        F.when(image, F.concat(F.lit("img"), F.col("doc_id").cast("string"))).alias("image_file"),
        F.array((F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 3).cast("int")).alias("tags"),
    )


def forums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("forum_id"), F.col("n_name").alias("title"))


def forum_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("forum_id"), F.col("p_type").alias("tag")).distinct()


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn 0 comments on the post conv_id, the others reply to the turn before; some come before what they reply to."""
    late = F.when((F.col("conv_id") * 7 + F.col("turn") * 13) % 5 == 0, 1500).otherwise(0)
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
        F.when(F.col("turn") == 0, F.col("conv_id")).alias("reply_to_post_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("reply_to_comment_id"),
        (F.col("turn") * 1000 - late).alias("ts"),
        "role",
        "text",
    )


def person_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(person_id, id) of interests, work places and schools: parts bought, nation, market segment."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("person_id"), F.col("l_partkey").cast("string").alias("id"))
    customer = read(spark, sf_dir, "customer")
    return bought, customer.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").cast("string").alias("id")), customer.select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("id"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), "c_nationkey", "c_mktsegment")


#: Persons of one nation and segment know those of higher numbers.
CIRCLE = ("c_nationkey", "c_mktsegment")
