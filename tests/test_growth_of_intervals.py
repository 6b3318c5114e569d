"""Overlaps that are counted: as by all pairs, and without making the pairs of a key that many rows share."""

import random

from duolex.operators import intervals


def made(n, seed, keys):
    rnd, out = random.Random(seed), []
    for i in range(n):
        s = rnd.randrange(-200, 3000)
        out.append((i // 2, None if i % 50 == 7 else 0 if i % 3 == 0 else rnd.randrange(keys), s, None if i % 60 == 11 else s + rnd.choice([-3, 0, 1, 2, 3, 8, 9, 50, 700, 5000])))
    return [*out, out[3]]


def test_counts_as_by_all_pairs(spark, monkeypatch):
    a, b = made(400, 1, 40), made(300, 2, 40)
    want = {}
    for x in a:
        for y in b:
            if x[1] is not None and x[1] == y[1] and x[3] is not None and y[3] is not None and x[3] > y[2] and x[2] < y[3]:
                n, least = want.get(y[0], (0, x[0]))
                want[y[0]] = n + 1, min(least, x[0])
    left = spark.createDataFrame(a, "i int, k int, start long, end long")
    right = spark.createDataFrame(b, "j int, k int, start_r long, end_r long")
    for pairs in (10, 0, 10**9):  # some keys by nodes, all, none
        monkeypatch.setattr(intervals, "PAIRS", pairs)
        got = {r.j: (r.n, r.i) for r in intervals.overlap_counts(left, right, ["k"], "j", "i").collect()}
        assert got == want
    assert intervals.overlap_counts(left.limit(0), right, ["k"], "j", "i").collect() == []


def test_pairs_of_a_common_key_are_not_made(spark, monkeypatch):
    """600 million pairs of one key; no rows of it come to the join of pairs."""
    left = spark.range(30_000).selectExpr("id as i", "0 as k", "id % 7 as start", "id % 7 + 50 as end")
    right = spark.range(20_000).selectExpr("id as j", "0 as k", "10L as start_r", "10L + id % 5 as end_r")
    seen, pairs = [], intervals.overlapping
    monkeypatch.setattr(intervals, "overlapping", lambda a, b, *x: seen.append(a.count()) or pairs(a, b, *x))
    got = intervals.overlap_counts(left, right, ["k"], "j", "i").groupBy("n", "i").count().collect()
    assert [tuple(x) for x in got] == [(30_000, 0, 20_000)] and seen == [0]
