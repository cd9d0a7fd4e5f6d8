import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.time import bucket_end, format_duration, interval_micros, parse_zoned, replay_time
from strandline.operators import statistics

EVENTS = [("Comment", 1, 100, 0), ("Comment", 2, 100, 0), ("Reply", 1, 200, 30), ("Reply", 1, 200, 30), ("Comment", 2, 100, 60), ("Comment", 2, 200, 100), ("Reply", 1, 100, 500), ("Reply", 1, 300, 600)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "event_type string, post_id long, person_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")


@pytest.mark.parametrize("t,upper,size,end", [(1, 100, 10, 10), (5, 100, 10, 10), (9, 100, 10, 10), (11, 100, 10, 20), (15, 100, 10, 20), (19, 100, 10, 20), (5, 101, 10, 11), (4, 105, 10, 5), (14, 105, 10, 15), (1, 200, 30, 20), (0, 200, 30, 20), (-1, 200, 30, 20), (-39, 200, 30, -10), (-40, 200, 30, -10), (-41, 200, 30, -40), (-50, 200, 30, -40), (-80, 200, 30, -70), (0, 10, 10, 10), (10, 100, 10, 20), (11, 101, 10, 21), (0, 20, 10, 10), (11, 21, 10, 21)])
def test_bucket_end(spark, t, upper, size, end):
    assert spark.range(1).select(bucket_end(F.lit(t), F.lit(upper), size)).first()[0] == end


def test_bucket_size():
    with pytest.raises(ValueError):
        bucket_end(F.lit(1), F.lit(1), 0)


@pytest.mark.parametrize("operator", [statistics.aligned, statistics.by_panes, statistics.anchored])
def test_tumbling_sums(events, operator):
    r = operator(events, "20 milliseconds", "20 milliseconds").agg(F.sum("reply_count"), F.sum("comment_count")).first()
    assert tuple(r) == (4, 4)


@pytest.mark.parametrize("operator", [statistics.aligned, statistics.by_panes, statistics.anchored])
def test_one_window(events, operator):
    rows = {r.post_id: r.distinct_users for r in operator(events, "1000 milliseconds", "1000 milliseconds").collect()}
    assert rows == {1: 3, 2: 2}


def test_author_counts_on_demand(spark):
    one = spark.createDataFrame([("Post", 1, 7, 0)], "event_type string, post_id long, person_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    for operator in (statistics.aligned, statistics.by_panes, statistics.anchored):
        assert {r.distinct_users for r in operator(one).collect()} == {0}
        assert {r.distinct_users for r in operator(one, count_author=True).collect()} == {1}


def anchors_by_hand(times, size, step):
    out, anchor, last = [], None, None
    for now in sorted(times):
        if anchor is None or now > anchor + step * ((last + size - anchor) // step + 1):
            anchor = now + step
        out.append(anchor)
        last = now
    return out


def test_anchor_moves_after_sleep(spark):
    assert anchors_by_hand([0, 5, 14, 40, 52], 10, 5) == [5, 5, 5, 45, 45]
    random.seed(1)
    posts = {1: [0, 5, 14, 40, 52], 2: [0, 15], 3: [0, 16]} | {i: [random.randrange(400) for _ in range(random.randint(1, 40))] for i in range(4, 60)}
    df = spark.createDataFrame([(i, t) for i, ts in posts.items() for t in ts], "post_id long, t long")
    for r in statistics.anchors(df, 10, 5).collect():
        known = [max((a for a in r.anchors if a[0] <= t), key=lambda a: a[0])[1] for t in sorted(posts[r.post_id])]
        assert known == anchors_by_hand(posts[r.post_id], 10, 5)


@pytest.mark.parametrize("author", [False, True])
def test_windows_against_every_event(spark, author):
    random.seed(2)
    rows = [(random.choice(["Post", "Comment", "Reply", "Like"]), random.choice([1, 1, 1, 2, 3]), random.randrange(6), random.randrange(300) ** 2 // 30) for _ in range(400)]
    df = spark.createDataFrame(rows, "event_type string, post_id long, person_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    size, step = 60, 20

    def counted(of, end):
        now = [(k, u) for k, _, u, t in of if end - size <= t < end]
        users = {u for k, u in now if author or k != "Post"}
        return (*(sum(k == x for k, _ in now) for x in ("Comment", "Reply", "Like")), len(users), any(k == "Post" for k, _ in now)) if now else None

    want, apart = {}, {}
    for p in (1, 2, 3):
        of = [r for r in rows if r[1] == p]
        for end in range(0, 4000, step):
            if x := counted(of, end):
                want[p, end] = x
        times = sorted(r[3] for r in of)
        for t, a in zip(times, anchors_by_hand(times, size, step)):
            for i in range((t - a) // step + 1, (t - a) // step + size // step + 1):
                apart[p, a + i * step] = counted(of, a + i * step)
    text = f"{size} milliseconds", f"{step} milliseconds"
    for operator, right in ((statistics.aligned, want), (statistics.by_panes, want), (statistics.anchored, apart)):
        got = operator(df, *text, count_author=author).select("post_id", F.unix_millis("window_end"), *statistics.SUMS, "distinct_users", "new_post").collect()
        assert {(r[0], r[1]): tuple(r[2:]) for r in got} == right and len(got) == len(right)


def test_window_must_be_a_multiple(events):
    with pytest.raises(ValueError):
        statistics.by_panes(events, "11 milliseconds", "5 milliseconds")


def test_time(spark):
    rows = spark.createDataFrame([("1970-01-01T00:00:01.000Z",), ("1970-01-01T01:00:00-01:00",), ("1970-01-01T01:00:00+01:00",), ("nonsense",), (None,)], "s string")
    assert [r[0] for r in rows.select(F.unix_millis(parse_zoned(F.col("s")))).collect()] == [1000, 7_200_000, 0, None, None]
    assert replay_time(1000, 100, 200, 10) == 1010
    with pytest.raises(ValueError):
        replay_time(0, 0, 0, 0)
    assert interval_micros("30 minutes") == 1_800_000_000 and format_duration(93_784_005) == "1d 02:03:04.005"
