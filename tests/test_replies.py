import random

import pytest

from strandline.operators import replies
from strandline.sources.keyed import KeyedTable
from strandline.storage import shared_dir
from strandline.streaming.jobs import ReplyTrees

POST = 999
C = lambda i, t: (i, POST, None, t)
R = lambda i, t, p: (i, None, p, t)
CASES = [
    ([R(875890, 1000, 875870), C(875870, 1010), R(875910, 2000, 875890), R(875930, 3000, 875910), R(875970, 4000, 875930), R(876010, 5000, 875970)], {875870}),
    ([C(236570, 1000), R(236620, 2000, 236590), R(236590, 3000, 236570), R(236640, 4000, 236590), R(236650, 5000, 236620)], {236570, 236590, 236640}),
    ([R(113, 1000, 112), R(112, 3000, 111), C(111, 5000)], {111}),
    ([R(113, 1000, 112), C(111, 2000), R(112, 3000, 111)], {111, 112}),
    ([C(111, 1000), R(112, 2000, 111), R(113, 3000, 112)], {111, 112, 113}),
    ([C(111, 1000), R(113, 2000, 112), R(112, 3000, 111)], {111, 112}),
    ([C(111, 2000), R(113, 3000, 112), R(112, 1000, 111)], {111}),
    ([R(112, 1000, 111), C(111, 2000), R(113, 3000, 112)], {111}),
    ([R(112, 1000, 111), R(113, 3000, 112), C(111, 2000)], {111}),
    ([C(111, 1000), R(112, 2000, 111), R(113, 3000, 112), R(114, 4000, 112), R(115, 5000, 113)], {111, 112, 113, 114, 115}),
    ([R(112, 2000, 111), R(113, 3000, 111), C(111, 9999)], {111}),
    ([C(1, 1), R(2, 5, 3), R(3, 5, 2), R(4, 9, 77)], {1}),
]
SCHEMA = "comment_id long, reply_to_post_id long, reply_to_comment_id long, ts long"


@pytest.mark.parametrize("rows,rooted", CASES)
def test_trees(spark, rows, rooted):
    random.shuffle(rows)
    tree = replies.reply_tree(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.comment_id for r in tree if r.post_id == POST} == rooted
    assert {r.comment_id for r in tree} == {r[0] for r in rows}


def test_random_forest(spark):
    random.seed(1)
    rows, valid, times = [], set(), {}
    for i in range(1, 400):
        t = random.randrange(10_000)
        if random.random() < 0.1 or i == 1:
            rows.append(C(i, t))
            valid.add(i)
        else:
            p = random.randrange(max(1, i - 5), i)
            rows.append(R(i, t, p))
            if p in valid and t >= times[p]:
                valid.add(i)
        times[i] = t
    random.shuffle(rows)
    tree = replies.reply_tree(spark.createDataFrame(rows, SCHEMA)).where("post_id is not null").collect()
    assert {r.comment_id for r in tree} == valid


def test_descendants(spark):
    rows = [C(111, 1000), R(211, 3000, 111), R(212, 2000, 111), R(311, 2500, 212), R(312, 2500, 211), R(411, 2500, 312)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.comment_id: r.valid for r in replies.descendants(df, df.where("comment_id = 111")).collect()}
    assert got == {211: True, 212: True, 311: True, 312: False, 411: False}


def test_batches_give_the_same(spark):
    rows = [C(1, 10), R(3, 30, 2), R(2, 20, 1), R(4, 40, 3), R(5, 5, 1), R(6, 50, 5)]
    trees = ReplyTrees(spark, shared_dir(spark), 10**6)
    for n in range(3):
        part = spark.createDataFrame(rows[2 * n : 2 * n + 2], SCHEMA)
        trees.batch(part, n)
        trees.batch(part, n)  # a repeated batch changes nothing
    assert {r.comment_id for r in trees.resolved.read().collect()} == {1, 2, 3, 4}


def test_keyed_table(spark):
    table = KeyedTable(spark, shared_dir(spark), "k", "t")
    table.upsert(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string"), 0)
    table.upsert(spark.createDataFrame([(1, 0, "d")], "k int, t int, v string"), 1)
    table.upsert(spark.createDataFrame([(1, 0, "d")], "k int, t int, v string"), 1)
    want = {(1, "d"), (2, "c")}
    assert {(r.k, r.v) for r in table.read().collect()} == want
    assert {(r.k, r.v) for r in table.compact(shared_dir(spark)).read().collect()} == want
