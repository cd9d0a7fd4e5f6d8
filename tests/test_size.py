"""Steps that grew faster than their input: their plans, and their results on rows where the larger step made a difference."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import lsh
from strandline.operators import activity, recommend
from strandline.plans import registry, streams  # noqa: F401
from strandline.sources import replay
from strandline.streaming.processors import AdaptiveWindow, Waiting

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["active_only", "exclude_known", "recommend_topn", "recommendations"])
def test_no_pairs_of_acquaintances(spark, name):
    assert "known_id" not in plan(registry.QUERIES[name](spark, SF))


def test_candidates_meet_by_numbers(spark):
    assert "array_join" not in plan(registry.QUERIES["lsh_candidates"](spark, SF))


def test_sketches():
    n, rng = 100, np.random.default_rng(5)
    bases = [rng.integers(0, 50, 6).tolist() for _ in range(200)]
    sigs = lsh.least_hashes(pa.array([*bases, None, []]), n)
    assert sigs.null_count == 2
    plain = [[min((a * x + b) % lsh.PRIME for x in f) for a, b in lsh.coefficients(n)] for f in bases]
    assert sigs.to_pylist()[:200] == plain
    got = lsh.sketches(sigs, n, 0.2).to_pylist()
    assert got[200]["bands"] is None and got[201]["prints"] is None
    b, r = lsh.bands(n, 0.2)
    for i, j in zip(range(199), range(1, 200)):
        mine, theirs = ([(x["key"], x["first"]) for x in got[k]["bands"]] for k in (i, j))
        assert [x == y for x, y in zip(mine, theirs)] == [plain[i][k * r : k * r + r] == plain[j][k * r : k * r + r] for k in range(b)]
    assert len({x["key"] for row in got[:200] for x in row["bands"]}) == len({(k, *p[k * r : k * r + r]) for p in plain for k in range(b)})


def test_agreeing(spark):
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 4, 100) * 2**20 + rng.integers(0, 3, 100) * 127 for _ in range(2))
    rows = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    p = rows.select(*[lsh.sketch(F.col(c), 100, 0.2)["prints"].alias(c) for c in "ab"])
    assert p.select(lsh.agreeing(F.col("a"), F.col("b"), 100)).first()[0] == int(((a & 255) == (b & 255)).sum())


def test_known_without_a_join(spark):
    assert "Join" not in plan(registry.QUERIES["known_persons"](spark, SF))
    rows = [(5, 1, "A"), (1, 1, "A"), (9, 1, "A"), (9, 1, "A"), (3, 1, "B"), (1, 1, "B"), (4, None, "A"), (6, None, "A"), (7, 2, None), (None, 1, "A"), (8, 3, "C")]
    persons = spark.createDataFrame(rows, "person_id long, n long, s string")
    got = {r.person_id: r.known for r in recommend.known_persons(persons, "n", "s").collect()}
    assert got == {1: [3, 5, 9, 9], 5: [9, 9]}
    many = spark.range(1000).select(F.col("id").alias("person_id"), (F.col("id") % 3).alias("n"))
    got = {r.person_id: r.known for r in recommend.known_persons(many, "n").collect()}
    assert got == {i: list(range(i + 3, 1000, 3)) for i in range(997)}


def test_circles_are_the_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(3)), rng.integers(0, 12, 5).astype(str).tolist()) for i in range(60)]
    persons = spark.createDataFrame(rows, "person_id long, n long, features array<string>")
    sigs = recommend.signatures(persons.select("person_id", "features"), 20)
    queries = sigs.select("person_id", F.lit(1).alias("window_end"), "signature")
    other = persons.select(F.col("person_id").alias("known_id"), "n")
    pairs = persons.join(other, "n").where("person_id < known_id").select("person_id", "known_id")
    found = recommend.candidates(queries, sigs, 20, 0.2)
    mine = recommend.candidates(queries, sigs, 20, 0.2, circles=recommend.circles(persons, "n"))
    assert found.count() > mine.count() > 0
    assert sorted(mine.collect()) == sorted(recommend.exclude_known(found, pairs).collect())
    similar = recommend.candidates(queries, sigs, 20, 0.2, least=0.5)
    best = [sorted(recommend.top(x, queries, sigs, 5, 0.5).collect()) for x in (similar, found)]
    assert best[0] == best[1] and len(best[0])


def test_lloyd_without_a_lambda_for_each_point(spark, monkeypatch):
    monkeypatch.setattr(activity, "classified", lambda *_: pytest.fail("a point at a time"))
    points = np.concatenate([np.random.default_rng(8).normal(c, 1, (500, 3)) for c in (0, 3, 9)])
    df = spark.createDataFrame([(x,) for x in points.tolist()], "features array<double>").repartition(3)
    got = activity.lloyd_distributed(df, [(2, [9.0] * 3), (0, [0.0] * 3), (1, [1.0] * 3), (5, [99.0] * 3)])
    centres = np.array([[0.0] * 3, [1.0] * 3, [9.0] * 3])
    for _ in range(200):
        which = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([points[which == j].mean(0) for j in range(3)])
    assert [i for i, _, _ in got] == [0, 1, 2, 5] and got[3][1:] == ([99.0] * 3, 0)
    assert np.allclose([c for _, c, _ in got[:3]], centres) and [w for _, _, w in got[:3]] == np.bincount(which).tolist()


class State(dict):
    """A map or a value in state, which notes what is read."""

    def __init__(self):
        self.read, self.value = [], None

    def updateValue(self, key, value):
        self[key] = value

    def getValue(self, key):
        self.read.append(key)
        return self[key]

    removeKey = dict.pop

    def update(self, value):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value


def test_only_the_opening_window_is_read(monkeypatch):
    monkeypatch.setattr(Waiting, "PART", 2)
    state, known = State(), State()
    waiting = Waiting(state, known)
    for end in (20, 30, 50):
        waiting.add(end, np.array([[float(end), i] for i in range(3)]))
    waiting.save()
    w = AdaptiveWindow(10, 1, 100, Waiting(state, known))
    w.begin(5)
    assert list(w.join([[0, 0], [1, 1]])) == [] and len(w.closed(10).__next__()[1]) == 2
    w = AdaptiveWindow(10, 1, 100, Waiting(state, known))
    w.end = 10
    assert [x for x in w.closed(10)] == [] and [list(p) for p in w.points] == [[20, 0], [20, 1], [20, 2]]
    assert {end for end, _ in state.read} == {20} and {end for end, _ in state} == {30, 50}
    assert [(end, len(p), f) for end, p, f in w.closed(60)] == [(20, 3, "regular"), (30, 3, "regular"), (50, 3, "regular")] and w.end is None


def test_slices_have_files_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "FILE_ROWS", 10)
    rows = spark.range(200).select("id", F.timestamp_seconds(F.when(F.col("id") < 60, 60).otherwise(F.col("id"))).alias("ts"))
    at = str(tmp_path / "in")
    files = replay.slices(rows, at, 4)
    replay.write_batch(rows.limit(1), at, files)
    assert files == 5
    batches = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(at)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: batches.append(sorted((r.ts, r.id) for r in df.collect()))).start().awaitTermination()
    assert len(batches) == 5 and sum(map(len, batches)) == 201 and [r[1] for b in batches[:4] for r in b] == list(range(200))
    assert all(a[-1][0] < b[0][0] for a, b in zip(batches[:3], batches[1:4]) if a and b)
