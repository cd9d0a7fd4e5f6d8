import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import control, lsh
from strandline.functions.text import int_set, optional_long, optional_string, text_features
from strandline.operators import activity, recommend
from strandline.settings import Settings, state_ttl_ms
from strandline.streaming.processors import AdaptiveWindow, StreamingClusters

P = lambda *xs: np.array(xs, float)


def model(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in c], float(w), None) for i, c, w in rows], "index int, centroid array<double>, weight double, label string")


@pytest.mark.parametrize("old,new,decay,centroid,weight", [((1, 1), (2, 1), 1.0, 1.5, 2), ((1, 2), (2, 1), 0.5, 1.5, 2), ((1, 9), (2, 1), 1.0, 1.1, 10), ((1, 9), (2, 1), 0.0, 2, 1), ((1, 0), (2, 0), 0.5, 2, 0)])
def test_merge(spark, old, new, decay, centroid, weight):
    a, b = [(0, (old[0],) * 2, old[1])], [(0, (new[0],) * 2, new[1])]
    r = activity.merged(model(spark, a), model(spark, b), decay).first()
    assert r.centroid == pytest.approx([centroid] * 2) and r.weight == weight
    (_, c, w), = activity.merge_clusters([(0, P(old[0]), old[1])], [(0, P(new[0]), new[1])], decay)
    assert c == pytest.approx(centroid) and w == weight


def test_classify(spark):
    m = model(spark, [(0, (1, 10, 100), 1), (1, (2, 11, 101), 1), (2, (100, 200, 300), 1)])
    points = spark.createDataFrame([([1.4, 10.4, 100.4],), ([1.6, 10.6, 100.6],), ([99.0, 199.0, 299.0],)], "features array<double>")
    assert [r.cluster for r in activity.classified(points, m).collect()] == [0, 1, 2]
    assert activity.classified(points, m.limit(0)).count() == 0


def test_lloyd():
    pts = np.array([(6, 2, 0), (4, 4, 3), (8, 6, 0), (0, 0, 3), (0, 0, 0), (0, 3, 0)], float)
    got = activity.lloyd(pts, [], 2)
    assert sorted((tuple(c), w) for _, c, w in got) == [((0, 1, 1), 3), ((6, 4, 1), 3)]
    with pytest.raises(ValueError):
        activity.lloyd(np.zeros((0, 2)), [], 2)
    kept = activity.lloyd(np.zeros((0, 2)), [(0, P(1, 1), 5), (1, P(2, 2), 6)], 2)
    assert [(i, tuple(c), w) for i, c, w in kept] == [(0, (1, 1), 0), (1, (2, 2), 0)]


def test_one_point():
    got = activity.lloyd(np.array([[5.0, 5.0]]), [(0, P(1, 1), 0), (1, P(2, 2), 0), (2, P(3, 3), 0)], 3)
    assert {i: w for i, _, w in got} == {0: 0, 1: 0, 2: 1}
    fewer = activity.lloyd(np.array([[5.0, 5.0]]), [(0, P(1, 1), 1), (1, P(2, 2), 2), (2, P(3, 3), 3), (3, P(4, 4), 0)], 2)
    assert {i: w for i, _, w in fewer} == {2: 1, 1: 0}


def test_initial_is_distinct():
    c = activity.initial(np.array([(1, 1), (1, 1), (2, 2)], float), 5)
    assert len({tuple(x) for x in c}) == 5 and {(1, 1), (2, 2)} <= {tuple(x) for x in c}


def test_distributed_lloyd(spark):
    pts = [(6, 2, 0), (4, 4, 3), (8, 6, 0), (0, 0, 3), (0, 0, 0), (0, 3, 0)]
    df = spark.createDataFrame([([float(x) for x in p],) for p in pts], "features array<double>")
    got = activity.lloyd_distributed(df, [(0, [6, 2, 0]), (1, [0, 0, 0])])
    assert [(c, w) for _, c, w in got] == [([6, 4, 1], 3), ([0, 1, 1], 3)]


def test_adaptive_window():
    w = AdaptiveWindow(10, 2, 4)
    assert [x for t in (1, 2, 3) for x in w.add(t, t)] == [] and w.add(4, 4) == [(10, [1, 2, 3, 4], "early")]
    assert w.add(5, 5) == [] and w.advance(10) == []  # too few: goes on to 20
    assert w.add(12, 12) == [] and w.advance(20) == [(20, [5, 12], "delayed")]
    w.add(25, 25), w.add(31, 31), w.add(26, 26), w.add(27, 27)
    assert w.advance(30) == [(30, [25, 26, 27], "regular")] and w.points == [31]


def test_streaming_clusters():
    s = StreamingClusters(2, 0.5)
    s.configure({"k": "1", "label:0": "all"})
    (_, c, w, label), = s.update([[0.0, 0.0], [2.0, 2.0]])
    assert tuple(c) == (1, 1) and w == 2 and label == "all"
    (_, c, w, _), = s.update([[4.0, 4.0]])
    assert tuple(c) == (2.5, 2.5) and w == 2 and s.version == 2


def test_control(spark):
    got = {r.line: (r.key, r.value, r.error) for r in control.parsed(spark.createDataFrame([(x,) for x in ("label:1=test1", " label : 1 = test1", "", "# x", "k=2", "decay=0.5", "k", "k = ", "k = a")], "line string")).collect()}
    assert got["label:1=test1"][:2] == got[" label : 1 = test1"][:2] == ("label:1", "test1")
    assert got["k=2"] == ("k", "2", None) and got["decay=0.5"] == ("decay", "0.5", None)
    assert got["k"][2] == "Invalid parameter line: k" and got["k = "][2] and got["k = a"][2] and "" not in got and "# x" not in got


def test_text(spark):
    rows = spark.createDataFrame([("AB cd, ab; x1.",), ("",), (None,), ("ABCD ABCD wxyz",)], "t string")
    got = [r[0] for r in rows.select(text_features(F.col("t"))).collect()]
    assert got == [[7.5, 0.25, 0.0], [0, 0, 0], [0, 0, 0], [pytest.approx(20 / 3), pytest.approx(2 / 3), 1.0]]
    sets = spark.createDataFrame([("[2, 1, 2]",), ("[]",), (None,)], "t string").select(int_set(F.col("t"))).collect()
    assert [r[0] for r in sets] == [[1, 2], [], []]
    r = spark.createDataFrame([(" a ", " 5 "), (" ", ""), (None, "x")], "a string, b string").select(optional_string(F.col("a")), optional_long(F.col("b"))).collect()
    assert [tuple(x) for x in r] == [("a", 5), (None, None), (None, None)]


def test_minhash(spark):
    base = ["A", "B", "C"]
    sets = {"equal": base, "similar": ["A", "B", "_"], "superset": [*base, "X", "Y", "Z"], "subset": ["A", "C"], "disjoint": ["X", "Y", "Z"], "numbers": ["1", "2", "3"]}
    df = spark.createDataFrame([(k, base, v) for k, v in sets.items()], "name string, a array<string>, b array<string>")
    n = 400
    got = {r.name: (r.j, r.s) for r in df.select("name", lsh.jaccard(F.col("a"), F.col("b")).alias("j"), lsh.similarity(lsh.signature(F.col("a"), n), lsh.signature(F.col("b"), n)).alias("s")).collect()}
    assert got["equal"] == (1, 1) and got["disjoint"] == (0, 0) and got["numbers"] == (0, 0)
    assert all(abs(j - s) < 0.1 for j, s in got.values())
    sig = df.limit(1).select(lsh.signature(F.col("a"), 5).alias("s"))
    assert sig.select(lsh.decoded(lsh.encoded(F.col("s"))) == F.col("s")).first()[0]
    assert lsh.bands(100, 0.2) == (43, 2) and lsh.bands(100, 0.1) == (57, 1)
    assert [round(lsh.inclusion_probability(s, 100, 0.2), 3) for s in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)] == pytest.approx([0.004, 0.017, 0.102, 0.351, 0.827, 1.0], abs=0.002)


def test_activity_sets(spark):
    events = spark.createDataFrame([(1, 100, 0), (2, 100, 1), (2, 200, 2), (3, 100, 3), (3, 200, 4), (3, 300, 5)], "person_id long, post_id long, h int").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    assert {r.person_id: r.posts for r in recommend.posts_in_window(events, "24 hours", "24 hours").collect()} == {1: [100], 2: [100, 200], 3: [100, 200, 300]}
    last = spark.createDataFrame([(1, 1000), (2, 5000), (1, 7000), (2, 4000), (1, 3000)], "person_id long, ts long")
    assert {r.person_id: r.last_ts for r in recommend.last_activity(last).collect()} == {1: 7000, 2: 5000}


def test_settings(tmp_path):
    f = tmp_path / "s.conf"
    f.write_text("# x\nclusters = 7\ndecay = 0.5\ncount_author = true\n")
    s = Settings.load(str(f))
    assert (s.clusters, s.decay, s.count_author, s.hashes) == (7, 0.5, True, 100)
    f.write_text("nothing = 1")
    with pytest.raises(ValueError):
        Settings.load(str(f))
    assert state_ttl_ms(3_600_000, 0) == 60_000 and state_ttl_ms(3_600_000, 10) == 360_000
