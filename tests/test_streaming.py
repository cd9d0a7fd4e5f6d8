"""Streams that stop and go on, what they drop and count, sinks, selectors and jobs."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import control
from strandline.functions.time import format_timestamp
from strandline.functions.vectors import divided, plus
from strandline.operators import activity
from strandline.plans.streams import rocks
from strandline.settings import Settings
from strandline.sources import events, sinks, topics
from strandline.sources.keyed import KeyedTable
from strandline.storage import shared_dir
from strandline.streaming import jobs, main
from strandline.streaming.processors import AdaptiveWindow, StreamingClusters

DAY = 86_400_000_000
TREE = "comment_id long, reply_to_post_id long, reply_to_comment_id long, ts long"
P = lambda *xs: np.array(xs, float)


def vectors(spark, rows, path):
    """rows of (microseconds, features) as one more file of a stream's folder."""
    spark.createDataFrame([(t, None if p is None else [float(x) for x in p]) for t, p in rows], "t long, features array<double>").select(F.timestamp_micros("t").alias("ts"), "features").coalesce(1).write.mode("append").parquet(path)


def clusters(spark, folder, settings, path=None):
    stream = events.bounded(spark.readStream.schema("ts timestamp, features array<double>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "1 hours")
    out = jobs.cluster_updates(stream, settings, path)
    with rocks(spark):
        jobs.run(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def test_clusters_go_on_after_a_restart(spark):
    random.seed(3)
    settings = replace(Settings(), cluster_min=5, cluster_max=40, clusters=2)
    parts = [[(d * DAY + random.randrange(DAY), (random.gauss(0, 1) + 5 * (i % 2), random.gauss(0, 1))) for i in range(n)] for d, n in enumerate((30, 3, 20, 55, 12))] + [[(40 * DAY, None)]]
    once, twice = shared_dir(spark), shared_dir(spark)
    for part in parts:
        vectors(spark, part, f"{once}/in")
    whole = clusters(spark, once, settings)
    for half in (parts[:3], parts[3:]):
        for part in half:
            vectors(spark, part, f"{twice}/in")
        split = clusters(spark, twice, settings)  # a new query, from the checkpoint
    rows = lambda df: sorted((r.version, r.end_us, r['index'], tuple(round(x, 9) for x in r.centroid), r.weight) for r in df.where("kind = 'model'").collect())
    assert rows(whole) == rows(split) and rows(whole)
    # The same by one window and model in order of time.
    window, model, want = AdaptiveWindow(DAY, 5, 40), StreamingClusters(2, settings.decay), []
    closed = [x for t, p in sorted(x for part in parts[:-1] for x in part) for x in window.add(t, p)]
    assert not [x for x in closed if x[0] > 4 * DAY]
    meta = whole.where("kind = 'metadata'").orderBy("version").collect()
    assert [r.firing for r in meta].count("early") == 1 and {r.firing for r in meta} == {"early", "regular", "delayed"}
    assert sum(r.points for r in meta) == 120 and meta[0].k_difference == 2 and all(r.k_difference == 0 for r in meta[1:]) and meta[1].average_distance is not None
    first = sorted(parts[0])
    want = model.update([p for _, p in first])
    got = {r['index']: r for r in whole.where("kind = 'model' and version = 1").collect()}
    assert {i: (pytest.approx(c.tolist()), w) for i, c, w, _ in want} == {i: (r.centroid, r.weight) for i, r in got.items()}
    # Each point by the last model before it.
    points = spark.createDataFrame([(t, list(p)) for part in parts[:-1] for t, p in part], "t long, features array<double>").select(F.timestamp_micros("t").alias("ts"), "t", "features")
    models = whole.where("kind = 'model'")
    ends = {}
    for r in models.collect():
        ends.setdefault((r.end_us, r.version), []).append((r['index'], r.centroid))
    for r in jobs.classified_as_of(points, models).collect():
        end, version = max(e for e in ends if e[0] <= r.t)
        near = min((sum((a - b) ** 2 for a, b in zip(r.features, c)), i) for i, c in ends[end, version])
        assert (r.version, r.cluster) == (version, near[1]) and r.distance == pytest.approx(near[0] ** 0.5)


def test_parameters_change_between_windows(spark, tmp_path):
    file = tmp_path / "parameters"
    file.write_text("k = 1\nlabel:0 = all\n")
    folder = shared_dir(spark)
    settings = replace(Settings(), cluster_min=1, clusters=2)
    vectors(spark, [(i, (i, i)) for i in range(10)], f"{folder}/in")
    vectors(spark, [(DAY + i, (i, 2 * i)) for i in range(10)], f"{folder}/in")
    vectors(spark, [(2 * DAY + 7_200_000_000, (0, 0))], f"{folder}/in")
    first = clusters(spark, folder, settings, str(file))
    assert [(r.version, r['index'], r.label) for r in first.where("kind = 'model'").orderBy("version").collect()][0] == (1, 0, "all")
    file.write_text("k = 3\n")
    vectors(spark, [(5 * DAY, (1, 1)), (5 * DAY + 1, (2, 5))], f"{folder}/in")
    vectors(spark, [(9 * DAY, None)], f"{folder}/in")
    last = clusters(spark, folder, settings, str(file)).where("kind = 'model'")
    assert last.where(F.col("version") == last.agg(F.max("version")).first()[0]).count() == 3


def test_control_lines():
    lines = ["# x", "k = 4", " label : 2 = Lunatics ", "decay=0.5 # later", "k = a", "speed = 3", "", "k"]
    assert control.read(lines) == {"k": "4", "label:2": "lunatics", "decay": "0.5"}


def test_split_values():
    points = np.array([(i, i) for i in range(6)], float)
    got = activity.lloyd(points, [(0, P(1, 1), 1.0), (1, P(2, 2), 2.0), (2, P(3, 3), 3.0)], 5)
    assert sorted(c[0] for _, c, _ in got) == pytest.approx([1.0, 1.99999999999988, 2.00000000000012, 2.99999999999991, 3.00000000000009], abs=1e-15)
    got = activity.lloyd(np.array([[5.0, 5.0]]), [(0, P(1, 1), 0.0), (1, P(2, 2), 0.0), (2, P(2, 2), 0.0)], 3)
    assert {tuple(c): (i, w) for i, c, w in got}[2.0, 2.0] == (2, 1.0) and sorted(c[0] for _, c, _ in got) == pytest.approx([0.99999999999997, 1.00000000000003, 2.0], abs=1e-15)
    assert all(w == 0 for _, c, w in got if c[0] != 2)
    same = activity.lloyd(np.array([[5.0, 5.0]]), [(0, P(1, 1), 0), (1, P(2, 2), 0), (2, P(3, 3), 0)], 3)
    assert [(i, tuple(c), w) for i, c, w in same] == [(0, (1, 1), 0), (1, (2, 2), 0), (2, (3, 3), 1)]


def test_no_fixed_point_is_an_error(spark):
    points = np.array([(0.0,), (1.0,), (9.0,), (11.0,), (12.0,)])
    with pytest.raises(ArithmeticError):
        activity.lloyd(points, [(0, P(0), 1), (1, P(1), 1)], 2, rounds=1)
    df = spark.createDataFrame([([float(x[0])],) for x in points], "features array<double>")
    with pytest.raises(ArithmeticError):
        activity.lloyd_distributed(df, [(0, [0.0]), (1, [1.0])], rounds=1)
    assert [w for _, _, w in activity.lloyd_distributed(df, [(0, [0.0]), (1, [1.0])])] == [2, 3]


def tree_rows(spark, rows):
    return spark.createDataFrame(rows, TREE)


def test_dropped_replies(spark):
    trees = jobs.ReplyTrees(spark, shared_dir(spark), 100)
    batches = [[(1, 9, None, 10), (2, None, 77, 20), (3, None, 2, 30)], [(4, None, 3, 150), (5, None, 1, 160)], [(6, None, 4, 170), (7, None, 5, 170), (8, None, 1, 5)], [(10, 9, None, 400)]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch changes nothing
            trees.batch(tree_rows(spark, rows), n)
    assert {r.comment_id for r in trees.resolved.read().collect()} == {1, 5, 7, 10}
    # 2 waits for 77 in vain; 3 and 4 are below it, 6 comes when it is gone; 8 is earlier than what it replies to.
    assert {r.comment_id for r in trees.dropped().collect()} == {2, 3, 4, 6, 8}
    counts = {r.batch: (r.resolved, r.dropped, r.waiting) for r in trees.metrics().collect()}
    assert counts[0] == (1, 0, 2) and sum(c[1] for c in counts.values()) == 5 and counts[3][2] == 0


def test_mapping_is_forgotten(spark):
    for ttl, want in ((None, {1, 2}), (0.0, {1})):
        trees = jobs.ReplyTrees(spark, shared_dir(spark), 10**6, ttl)
        trees.batch(tree_rows(spark, [(1, 9, None, 10)]), 0)
        trees.batch(tree_rows(spark, [(2, None, 1, 20)]), 1)
        assert {r.comment_id for r in trees.resolved.read().collect()} == want


def test_activity_is_evicted(spark):
    seen = jobs.Activity(spark, shared_dir(spark), 14)
    day = lambda rows: spark.createDataFrame([(p, d * 86400) for p, d in rows], "person_id long, s long").select("person_id", F.timestamp_seconds("s").alias("ts"))
    seen.batch(day([(1, 0), (2, 5), (1, 3)]), 0)
    for _ in range(2):
        seen.batch(day([(3, 18), (2, 4)]), 1)
    assert {(r.person_id, r.last_ts.day) for r in seen.read().collect()} == {(2, 6), (3, 19)}
    seen.batch(day([(1, 19)]), 2)
    assert {r.person_id for r in seen.read().collect()} == {1, 2, 3}
    assert [(r.held, r.removed) for r in seen.metrics().orderBy("batch").collect()] == [(2, 0), (2, 1), (3, 0)]


def test_keyed_table_folds(spark):
    table = KeyedTable(spark, shared_dir(spark), "k", fold=3)
    table.create("k int, v string")
    with pytest.raises(ValueError):
        table.create("k int, v string")
    want = {}
    for n in range(10):
        rows = [(n % 4, f"v{n}"), (100 + n, "x")]
        want |= dict(rows)
        for _ in range(1 + n % 2):
            table.upsert(spark.createDataFrame(rows, "k int, v string"), n)
        assert {r.k: r.v for r in table.read().collect()} == want
    assert len(table._numbers("write")) < 3 and len(table._numbers("base")) == 1
    table.drop()
    assert not table.exists()


def test_dropped_events_are_counted(spark):
    folder = shared_dir(spark)
    hour = 3600
    parts = [[("Post", 1, 1, 0), ("Like", 1, 2, 100)], [("Like", 1, 3, 40 * hour)], [("Like", 1, 4, 41 * hour), ("Like", 1, 5, 10)], [("Like", 2, 5, 400 * hour)], [("Like", 2, 5, 800 * hour)]]
    for rows in parts:
        spark.createDataFrame(rows, "event_type string, post_id long, person_id long, s long").select("event_type", "post_id", "person_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = events.bounded(spark.readStream.schema("event_type string, post_id long, person_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "1 hours")
    progress = jobs.Progress()
    with rocks(spark):
        jobs.run(jobs.post_statistics_anchored(stream), folder, progress=progress)
    totals = progress.totals("post_statistics")
    assert totals["ahead"] >= 3 and set(totals) == {"ahead", "current", "older", "dropped"}
    assert sum(r["rows"] for r in progress.rows) == 7 and any(r["watermark"] for r in progress.rows) and all("state_rows" in r for r in progress.rows)
    rows = spark.read.parquet(f"{folder}/out")
    assert rows.where("post_id = 1").agg(F.max("distinct_users")).first()[0] >= 1


def test_text_sinks(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "x int, y string, z int")
    sinks.text_rows(df, f"file://{tmp_path}/rows")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/rows").collect()) == ["1|a|", "2|b|3"]
    sinks.debug_text(df.repartition(2), f"file://{tmp_path}/debug")
    assert sorted(r.value.split("|", 1)[1] for r in spark.read.text(f"file://{tmp_path}/debug").collect()) == ["1|a|", "2|b|3"]
    sinks.console(df, "traces")
    sinks.errors(df.select("y"))
    out = capsys.readouterr().out
    assert "traces" in out and "errors" in out and "|a" in out
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    sinks.text_rows(stream, f"{tmp_path}/stream", f"{tmp_path}/c1").awaitTermination()
    sinks.errors(stream.select("y"), f"{tmp_path}/errors", f"{tmp_path}/c2").awaitTermination()
    sinks.console(stream, "batch").awaitTermination()
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/stream").collect()) == ["1|a|", "2|b|3"] and spark.read.text(f"{tmp_path}/errors").count() == 2
    assert "batch 0" in capsys.readouterr().out


def test_lines_and_malformed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|2\nq|3\n4|5\n")
    good, bad = events.delimited(spark, str(tmp_path / "a.csv"), "x int, y int"), events.malformed(spark, str(tmp_path / "a.csv"), "x int, y int")
    assert [tuple(r) for r in good.collect()] == [(1, 2), (4, 5)] and [r.line for r in bad.collect()] == ["q|3"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "l.txt").write_text("1-2\nnothing\n3-4\n")
    parse = lambda line: F.when(line.rlike(r"^\d+-\d+$"), F.struct(F.split_part(line, F.lit("-"), F.lit(1)).cast("int").alias("a"), F.split_part(line, F.lit("-"), F.lit(2)).cast("int").alias("b")))
    assert [tuple(r) for r in events.lines(spark, str(tmp_path / "b"), parse).collect()] == [(1, 2), (3, 4)]
    assert events.lines(spark, str(tmp_path / "b"), parse, streaming=True).isStreaming


def test_small_functions(spark):
    r = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0, 9.0], 0)], "a array<double>, b array<double>, t long").select(plus(F.col("a"), F.col("b")), divided(F.col("a"), F.lit(2.0)), format_timestamp(F.timestamp_millis(F.lit(1500)))).first()
    assert tuple(r) == ([4.0, 7.0], [0.5, 1.0], "1970-01-01 00:00:01.500")
    parts = spark.range(100).select("id", topics.partition_of(F.col("id"), 7).alias("p"))
    assert {r.p for r in parts.collect()} == set(range(7)) and parts.groupBy("id").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    m = spark.createDataFrame([(0, [1.0], 5.0, None), (1, [2.0], 9.0, None), (2, [3.0], 5.0, None)], "index int, centroid array<double>, weight double, label string")
    assert [r['index'] for r in activity.largest(m, 2).collect()] == [1, 0]


def files(tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "likes.csv").write_text("p|q|t\n1|100|2012-02-02T01:00:00Z\n2|100|2012-02-02T02:00:00Z\n2|101|2012-02-02T03:00:00Z\n")
    (folder / "posts.csv").write_text("h|h|h|h|h|h|h|h|h|h|h\n100|1|2012-02-02T00:30:00Z||1.1.1.1|b|en|hi there|[1]|9|8\n101|2|2012-02-02T00:40:00Z||1.1.1.1|b|en|good day|[2]|9|8\n")
    (folder / "comments.csv").write_text("h|h|h|h|h|h|h|h|h\n1|3|2012-02-02T01:10:00Z|i|b|c|100||3\n2|4|2012-02-02T01:20:00Z|i|b|c||1|3\n3|4|2012-02-02T01:25:00Z|i|b|c||77|3\n")
    return str(folder)


def test_source_selector(spark, tmp_path):
    folder = files(tmp_path)
    by_file = events.Sources(spark, Settings(), folder)
    assert by_file.likes().isStreaming and by_file.posts().isStreaming and by_file.raw_comments().isStreaming
    with pytest.raises(ValueError):
        events.Sources(spark, Settings()).likes()
    with pytest.raises(ValueError):
        events.Sources(spark, Settings(), folder, group="g").likes()
    asked = []
    kafka = events.Sources(spark, Settings(), folder, group="g", kafka=lambda name, schema, group: asked.append((name, group)) or by_file.likes())
    assert kafka.likes().isStreaming and asked == [("likes", "g")]


def test_jobs_from_files_to_statistics(spark, tmp_path):
    folder, out = files(tmp_path), str(tmp_path / "out")
    with rocks(spark):
        main.main(["load", "--files", folder, "--out", out])
        main.main(["replies", "--files", folder, "--out", out])
        main.main(["replies", "--files", folder, "--out", out])  # nothing new
        main.main(["activity", "--files", folder, "--out", out])
        main.main(["statistics", "--topics", out, "--group", "g", "--out", out])
    assert spark.read.parquet(f"{out}/likes").count() == 3 and spark.read.parquet(f"{out}/posts").count() == 2
    assert {(r.comment_id, r.post_id, r.person_id) for r in spark.read.parquet(f"{out}/resolved").collect()} == {(1, 100, 3), (2, 100, 4)}
    assert spark.read.parquet(f"{out}/statistics/out").count() >= 0
