"""Reply trees: from comments to the posts they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.storage import cut


def reply_tree(comments: DataFrame) -> DataFrame:
    """(comment_id, post_id, depth): every comment with its post, or a null post for a dropped one.

    comments: (comment_id, reply_to_post_id, reply_to_comment_id, ts). A comment on a post is rooted. A reply is rooted if what it replies to is, and isn't
    later than it; all others, and all below them, are dropped. The order of rows has no meaning. Each round doubles the length of the known paths, so
    that a tree of depth d takes log d joins, not d. Replies in a circle are dropped.
    """
    own = comments.select("comment_id", "reply_to_post_id", "reply_to_comment_id", "ts").where("comment_id is not null").dropDuplicates(["comment_id"])
    parent = own.select(F.col("comment_id").alias("p"), F.col("ts").alias("p_ts"))
    # up: the ancestor that decides, null once it is decided; post: null for a dropped one
    state = cut(
        own.join(parent, F.col("reply_to_comment_id") == F.col("p"), "left").select(
            "comment_id",
            F.col("reply_to_post_id").alias("post_id"),
            F.when(F.col("reply_to_post_id").isNull() & (F.col("ts") >= F.col("p_ts")), F.col("p")).alias("up"),
            F.when(F.col("reply_to_post_id").isNull() & F.col("p").isNotNull(), 1).otherwise(0).alias("depth"),
        )
    )
    open_now, before = state.where("up is not null").count(), None
    while open_now and open_now != before:
        above = state.select(F.col("comment_id").alias("a"), F.col("post_id").alias("a_post"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"))
        state = cut(
            state.join(above, F.col("up") == F.col("a"), "left").select(
                "comment_id",
                F.coalesce("post_id", "a_post").alias("post_id"),
                F.col("a_up").alias("up"),
                (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
            )
        )
        before, open_now = open_now, state.where("up is not null").count()
    return state.select("comment_id", "post_id", F.when(F.col("post_id").isNotNull(), F.col("depth")).alias("depth"))


def resolved(comments: DataFrame, tree: DataFrame) -> DataFrame:
    """The comments with their posts; those that have none are left out."""
    return comments.join(tree.where("post_id is not null").select("comment_id", "post_id"), "comment_id")


def dropped(comments: DataFrame, tree: DataFrame) -> DataFrame:
    return comments.join(tree.where("post_id is null").select("comment_id"), "comment_id", "left_semi")


def look_up(comments: DataFrame, mapping: DataFrame) -> DataFrame:
    """(comment_id, post_id, resolved): the post a comment names, or else that of what it replies to in the mapping (comment_id, post_id)."""
    known = mapping.select(F.col("comment_id").alias("m"), F.col("post_id").alias("m_post"))
    post = F.coalesce("reply_to_post_id", "m_post")
    return comments.join(known, F.col("reply_to_comment_id") == F.col("m"), "left").select("comment_id", post.alias("post_id"), post.isNotNull().alias("resolved"))


def profile(comments: DataFrame) -> DataFrame:
    """One row about a file of comments: comments, replies, replies to later rows, replies to unknown comments, least and largest lag."""
    parent = comments.select(F.col("comment_id").alias("p"), F.col("ts").alias("p_ts"))
    both = comments.join(parent, F.col("reply_to_comment_id") == F.col("p"), "left")
    reply = F.col("reply_to_comment_id").isNotNull()
    lag = F.when(reply, F.col("ts") - F.col("p_ts"))
    return both.agg(
        F.count("*").alias("comments"),
        F.count_if(reply).alias("replies"),
        F.count_if(lag < 0).alias("forward"),
        F.count_if(reply & F.col("p").isNull()).alias("unknown_parent"),
        F.min(lag).alias("least_lag"),
        F.max(lag).alias("largest_lag"),
    )


def descendants(comments: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, comment_id, valid) of everything below the given comments; valid only if no reply on the path is before what it replies to."""
    spark = comments.sparkSession
    comments.select("comment_id", "reply_to_comment_id", "ts").createOrReplaceTempView("_tree_comments")
    roots.select("comment_id").createOrReplaceTempView("_tree_roots")
    return spark.sql(
        """WITH RECURSIVE below (root_id, comment_id, ts, valid) MAX RECURSION LEVEL 10000 AS (
             SELECT r.comment_id, c.comment_id, c.ts, true FROM _tree_roots r JOIN _tree_comments c ON c.comment_id = r.comment_id
             UNION ALL
             SELECT b.root_id, c.comment_id, c.ts, b.valid AND c.ts >= b.ts FROM below b JOIN _tree_comments c ON c.reply_to_comment_id = b.comment_id)
           SELECT root_id, comment_id, valid FROM below WHERE root_id <> comment_id"""
    )


def arrival_windows(comments: DataFrame, size: int) -> DataFrame:
    """A count window over all rows in order of time: the number of the window that each row falls in. Ranges of the order are counted first, so that no task has all rows."""
    rows = ordered.ranged(comments, "ts", "comment_id")
    rows = rows.join(F.broadcast(ordered.before(rows, F.count("*"), lambda a, b: a + b)), "range_number")
    nth = F.row_number().over(ordered.inside("ts", "comment_id")) + F.coalesce("before", F.lit(0)) - 1
    return rows.withColumn("count_window", F.floor(nth / size)).drop("range_number", "before")
