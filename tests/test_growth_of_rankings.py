"""Many rankings at once: rows that can't be among the first aren't moved, and none that is goes missing."""

import hashlib

from pyspark.sql import functions as F

from duolex.operators import corpus


def moved(spark, run):
    """What run() gives, and the number of rows that its stages wrote to shuffles."""
    sc, j = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(j.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, none, j.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def brute(rows, seeds, cuts):
    hits = {}
    for seed in range(seeds):
        u = lambda r: int(hashlib.md5("|".join([str(seed)] + ([] if r[0] is None else [str(r[0])])).encode()).hexdigest()[:13], 16) / 2**52  # noqa: B023, E731
        order = sorted(rows, key=lambda r: (r[2] is None, -(u(r) ** (1 / r[2])) if r[2] else 0, r[0] is not None, r[0]))
        for c in cuts:
            for r in order[:c]:
                hits[r[1], c] = hits.get((r[1], c), 0) + 1
    return hits


def got(spark, rows, seeds, cuts):
    d = spark.createDataFrame(rows, "id long, source string, weight double").repartition(40, F.col("id"))
    found, n = moved(spark, lambda: corpus.ranking_experiment(d, seeds, cuts).collect())
    return {(r.source, r.cut): r.hits for r in found}, n


def test_only_the_first_are_moved(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, (0.2, 1.0, 9.5)[i % 3]) for i in range(3000)]
    hits, n = got(spark, rows, 60, (1, 5, 10))
    assert hits == brute(rows, 60, (1, 5, 10))
    assert n < 60 * 200 + 2 * 3000  # 10 for each of 40 tasks and 60 seeds would be 24,000


def test_seeds_that_fall_short(spark):
    """Few numbers that many rows share: for some seeds too few keys are over the bar, which is lowered for these."""
    rows = [(i % 30, f"s{i % 3}", 1.0 + i % 3) for i in range(3000)]
    hits, _ = got(spark, rows, 40, (1, 7, 150))
    assert hits == brute(rows, 40, (1, 7, 150))


def test_odd_rows(spark):
    """No weight, no id, weights of very different sizes, and more to be ranked than there are rows."""
    rows = [(i, "a", 1e-9) for i in range(400)] + [(1000 + i, "b", 50.0) for i in range(100)] + [(2000 + i, "c", None) for i in range(30)] + [(None, "d", 2.0)]
    for cuts in ((1, 20), (90, 120), (500, 520), (600,)):
        hits, _ = got(spark, rows, 8, cuts)
        assert hits == brute(rows, 8, cuts), cuts
