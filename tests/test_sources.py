import pytest

from strandline.sources import events, replay
from strandline.sources.topics import Topic
from strandline.storage import shared_dir


def test_files(spark, tmp_path):
    (tmp_path / "likes.csv").write_text("Person.id|Post.id|creationDate\n1|2|2012-02-02T01:09:00Z\nx|3|2012-02-02T01:09:00Z\n4|5|never\n6|7|2012-02-02T02:09:00+01:00\n")
    got = events.likes(spark, str(tmp_path / "likes.csv")).collect()
    assert [(r.person_id, r.post_id) for r in got] == [(1, 2), (6, 7)] and got[0].ts == got[1].ts
    (tmp_path / "posts.csv").write_text("h|h|h|h|h|h|h|h|h|h|h\n1|2|2012-02-02T01:09:00Z||1.1.1.1|b|en| hi |[3, 1]|9|8\n")
    r = events.posts(spark, str(tmp_path / "posts.csv")).first()
    assert (r.post_id, r.image_file, r.content, r.tags, r.forum_id) == (1, None, "hi", [1, 3], 9)
    (tmp_path / "comments.csv").write_text("h|h|h|h|h|h|h|h|h\n1|2|2012-02-02T01:09:00Z|i|b|c|7||3\n2|2|2012-02-02T01:10:00Z|i|b|c||1|3\n")
    assert [(r.reply_to_post_id, r.reply_to_comment_id) for r in events.raw_comments(spark, str(tmp_path / "comments.csv")).collect()] == [(7, None), (None, 1)]


def test_topic(spark):
    topic = Topic(spark, shared_dir(spark), "likes", "person_id long, ts long", 3)
    assert not topic.exists()
    topic.create()
    with pytest.raises(ValueError):
        topic.create()
    topic.append(spark.createDataFrame([(i % 5, i) for i in range(20)], topic.schema), "person_id")
    assert topic.table().count() == 20
    copy = Topic(spark, shared_dir(spark), "copy", topic.schema)
    topic_stream = topic.stream()
    query = copy.write_stream(topic_stream, shared_dir(spark))
    query.awaitTermination()
    assert copy.table().count() == 20
    topic.create(overwrite=True)
    topic.delete()
    assert not topic.exists()


def test_schedule():
    out = list(replay.scheduled([("e1", 10_000), ("e2", 20_000), ("e3", 30_000)], lambda e: e[1], interval=15_000))
    assert [x[2] for x in out if x[0] == "watermark"] == [24_999, 39_999]
    assert [x[1][0] for x in out if x[0] == "event"] == ["e1", "e2", "e3"]


def test_late_schedule():
    rows = [("e1", 1000, 0), ("e2", 2000, 12_500), ("e3", 3000, 0), ("e4", 14_000, 0), ("e5", 15_000, 0)]
    out = list(replay.scheduled(rows, lambda e: e[1], lambda e: e[2], interval=2000, max_delay=1300))
    assert [x[1][0] for x in out if x[0] == "event"] == ["e1", "e3", "e4", "e2", "e5"]
    assert [x[2] for x in out if x[0] == "watermark"] == list(range(1699, 15_700, 2000))
    assert [x[1][0] for x in out if x[0] == "event" and x[3]] == ["e2"]
    assert "e2" not in [x[1][0] for x in replay.scheduled(rows, lambda e: e[1], lambda e: e[2], 2000, 1300, allow_late=False) if x[0] == "event"]
    with pytest.raises(ValueError):
        list(replay.scheduled([("a", 2), ("b", 1)], lambda e: e[1], ordered=True))


def test_pace():
    now, waited = [0.0], []

    def wait(s):
        waited.append(round(s, 6))
        now[0] += s

    assert list(replay.paced([0, 1000, 500, 3000], lambda t: t, 10, wait, lambda: now[0])) == [0, 1000, 500, 3000] and waited == [0.1, 0.2]
    assert list(replay.paced([5, 6], lambda t: t, 0, wait)) == [5, 6]


def test_delays():
    draw = replay.delays(100)
    got = [draw() for _ in range(1000)]
    assert min(got) >= 0 and max(got) <= 100 and got[:3] == [d() for d in [replay.delays(100)] for _ in range(3)]
