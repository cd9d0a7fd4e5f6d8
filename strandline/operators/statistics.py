"""Statistics of active posts in sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.time import from_micros, interval_micros, micros

WINDOW, SLIDE = "12 hours", "30 minutes"


def _counts(counted) -> list:
    of = lambda kind: F.count_if(F.col("event_type") == kind).alias(f"{kind.lower()}_count")
    return [of("Comment"), of("Reply"), of("Like"), counted, F.max(F.col("event_type") == "Post").alias("new_post")]


def _user(count_author: bool):
    """The person, if the event counts for distinct users: a post's author does only on demand."""
    return F.col("person_id") if count_author else F.when(F.col("event_type") != "Post", F.col("person_id"))


def aligned(events: DataFrame, window: str = WINDOW, slide: str = SLIDE, count_author: bool = False) -> DataFrame:
    """Windows aligned to the epoch, each event copied into all its windows. This form also runs on streams."""
    return (
        events.groupBy("post_id", F.window("ts", window, slide).alias("w"))
        .agg(*_counts(F.size(F.collect_set(_user(count_author))).cast("long").alias("distinct_users")))
        .select("post_id", F.col("w.end").alias("window_end"), "comment_count", "reply_count", "like_count", "distinct_users", "new_post")
    )


def _multiple(window: str, slide: str) -> tuple[int, int]:
    size, step = interval_micros(window), interval_micros(slide)
    if size % step:
        raise ValueError("the window must be a multiple of the slide")
    return size, step


SUMS = ("comment_count", "reply_count", "like_count")


def _from_panes(events: DataFrame, keys: list[str], copies: int, count_author: bool) -> DataFrame:
    """keys, end and the counts of every window that holds an event. events: keys, pane, event_type, person_id; window end e holds the panes from e - copies to e - 1.

    No event is copied to its windows: counts change at the first window that holds a pane and at the first that doesn't any more, and so does the number of
    persons, where a person's windows don't go on; windows are sums of the changes before them. A person's panes and a post's changes are bounded by the time
    they span; frequent posts and persons are summed up before they are shuffled.
    """
    panes = events.groupBy(*keys, _user(count_author).alias("user"), "pane").agg(*_counts(F.count("*").alias("n")))
    mine = Window.partitionBy(*keys, "user").orderBy("pane")
    known = F.col("user").isNotNull()
    begins = known & F.coalesce(F.col("pane") - F.lag("pane").over(mine) > copies, F.lit(True))
    ends = known & F.coalesce(F.lead("pane").over(mine) - F.col("pane") > copies, F.lit(True))
    parts = [*SUMS, "n", F.col("new_post").cast("long").alias("posts")]
    changes = panes.select(*keys, "pane", *parts, begins.cast("long").alias("up"), ends.cast("long").alias("down"))
    names = [*SUMS, "n", "posts"]
    at = lambda end, sign, users: F.struct(end.alias("end"), *[(sign * F.col(c)).alias(c) for c in names], users.alias("distinct_users"))
    both = changes.select(*keys, F.explode(F.array(at(F.col("pane") + 1, 1, F.col("up")), at(F.col("pane") + 1 + copies, -1, -F.col("down")))).alias("x"))
    names.append("distinct_users")
    sums = both.select(*keys, "x.*").groupBy(*keys, "end").agg(*[F.sum(c).alias(c) for c in names])
    order = Window.partitionBy(*keys).orderBy("end")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = sums.select(*keys, "end", F.lead("end").over(order).alias("next"), *[F.sum(c).over(before).alias(c) for c in names]).where("n > 0")
    return runs.select(*keys, F.explode(F.sequence("end", F.col("next") - 1)).alias("end"), *SUMS, "distinct_users", (F.col("posts") > 0).alias("new_post"))


def by_panes(events: DataFrame, window: str = WINDOW, slide: str = SLIDE, count_author: bool = False) -> DataFrame:
    """The same rows as aligned(), by changes of panes of one slide instead of copies of events. The window must be a multiple of the slide."""
    size, step = _multiple(window, slide)
    paned = events.select("post_id", "person_id", "event_type", F.floor(micros(F.col("ts")) / step).alias("pane"))
    out = _from_panes(paned, ["post_id"], size // step, count_author)
    return out.select("post_id", from_micros(F.col("end") * step).alias("window_end"), *SUMS, "distinct_users", "new_post")


def anchors(events: DataFrame, size: int, step: int) -> DataFrame:
    """(post_id, anchors): the sorted (from, anchor) of each post, in microseconds; an anchor holds for the events from its time on. events: (post_id, t).

    A post's windows end at its first event plus a step and every step from there. It falls asleep at the first such time whose window
    holds no event any more; the next event after that sets a new anchor. That takes a gap of more than size, and where such
    gaps are is seen in the first and last event of each stretch of that length, which are few whatever the events.
    """
    stretches = events.groupBy("post_id", F.floor(F.col("t") / size).alias("stretch")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    before = F.lag("last").over(Window.partitionBy("post_id").orderBy("stretch"))
    gaps = stretches.withColumn("before", before).where(F.col("before").isNull() | (F.col("first") - F.col("before") > size))
    asleep = lambda s, x: x["first"] > s["anchor"] + step * (F.floor((x["before"] + size - s["anchor"]) / step) + 1)
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.array().cast("array<struct<from:bigint,anchor:bigint>>").alias("found"))

    def step_on(s, x):
        woken = s["anchor"].isNull() | asleep(s, x)
        anchor = F.when(woken, x["first"] + step).otherwise(s["anchor"])
        return F.struct(anchor.alias("anchor"), F.when(woken, F.concat(s["found"], F.array(F.struct(x["first"].alias("from"), anchor.alias("anchor"))))).otherwise(s["found"]).alias("found"))

    lists = gaps.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("first", "before"))).alias("gaps"))
    return lists.select("post_id", F.aggregate("gaps", start, step_on, lambda s: s["found"]).alias("anchors"))


def anchored(events: DataFrame, window: str = WINDOW, slide: str = SLIDE, count_author: bool = False) -> DataFrame:
    """Windows anchored at each post's first event, with dormancy; a window counts events from its end less the size, exclusive of its end.

    Every event gets the last anchor that is not after it, and with it a pane; the rest is that of by_panes(). Posts and times that are null are left out. The
    window must be a multiple of the slide.
    """
    size, step = _multiple(window, slide)
    own = events.where("post_id is not null and ts is not null").select("post_id", "person_id", "event_type", micros(F.col("ts")).alias("t"))
    known = own.join(anchors(own.select("post_id", "t"), size, step), "post_id")
    anchor = F.element_at(F.filter("anchors", lambda a: a["from"] <= F.col("t")), -1)["anchor"]
    paned = known.select("post_id", "person_id", "event_type", "t", anchor.alias("anchor")).withColumn("pane", F.floor((F.col("t") - F.col("anchor")) / step))
    out = _from_panes(paned.drop("t"), ["post_id", "anchor"], size // step, count_author)
    # Windows of two anchors don't end at the same time: a new anchor comes after the last window of the one before.
    return out.select("post_id", from_micros(F.col("anchor") + F.col("end") * step).alias("window_end"), *SUMS, "distinct_users", "new_post")


def with_titles(posts: DataFrame, forums: DataFrame) -> DataFrame:
    """Post information: a forum that isn't known has the title <unknown forum>; no content or image is an empty text."""
    return posts.join(forums, "forum_id", "left").select(
        "post_id",
        "forum_id",
        F.coalesce("title", F.lit("<unknown forum>")).alias("forum_title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("image_file", F.lit("")).alias("image_file"),
    )


def enriched(statistics: DataFrame, info: DataFrame) -> DataFrame:
    """Statistics with the post's content, or its image where that is empty, and its forum's title; both unknown for an unknown post."""
    shown = F.when(F.col("content") == "", F.col("image_file")).otherwise(F.col("content"))
    return statistics.join(info, "post_id", "left").select(
        *statistics.columns, F.coalesce(shown, F.lit("<unknown content>")).alias("content"), F.coalesce("forum_title", F.lit("<unknown forum>")).alias("forum_title")
    )


def tumbling_counts(events: DataFrame, key: str, window: str = "30 days") -> DataFrame:
    return events.groupBy(key, F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.end").alias("window_end"), "n")
