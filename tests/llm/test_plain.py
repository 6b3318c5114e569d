"""Learners, partitions and alignments against plain versions of the same method."""

import heapq
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duolex.llm import ctw, decontaminate, licenses, neardup, quality, sharding, simhash, toxicity

from .helpers import plain
from .test_similar import shingles, stays

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def read(sf, name, *columns):
    return zip(*(c.to_pylist() for c in pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).columns), strict=True)


# --- sharding

def differenced(sizes, k):
    """Karmarkar-Karp with lists: the two partitions of the largest spread, largest part on smallest part."""
    heap = [(-s, i, [0] * (k - 1) + [s]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        v = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        n += 1
        heapq.heappush(heap, (v[0] - v[-1], n, v))
    return heap[0][2]


def test_plain_differencing(spark):
    rnd = random.Random(3)
    rows = [(f"g{i}", rnd.randrange(1, 1 << 40)) for i in range(600)]
    got = sharding.assign(spark.createDataFrame(rows, "g string, bytes long"), 16).collect()
    total, size = Counter(), dict(rows)
    for r in got:
        total[r.shard] += size[r.g]
    assert len(got) == 600 and sorted(total.values()) == differenced([s for _, s in rows], 16)


def test_shards_are_balanced(spark, monkeypatch):
    """The law of the query: over many buckets too, shards differ by less than a thousandth of their mean."""
    for groups in (4000, 500):
        monkeypatch.setattr(sharding, "GROUPS", groups)
        total = Counter()
        for r in sharding.op3_sharding(spark, "/root/testdata/sf0.1").collect():
            total[r.shard] += r["size"]
        assert len(total) == 40 and max(total.values()) - min(total.values()) < 0.001 * np.mean(list(total.values()))


def test_groups_that_dwarf_a_bucket(spark, monkeypatch):
    """Large groups, one of them larger than a shard's share, among many small ones in many buckets."""
    monkeypatch.setattr(sharding, "GROUPS", 50)
    rnd = random.Random(4)
    sizes = [*[rnd.randrange(100, 1000) for _ in range(5000)], 900_000, *[rnd.randrange(20_000, 60_000) for _ in range(12)]]
    got = sharding.assign(spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(sizes)], "g string, bytes long"), 8).collect()
    total = Counter()
    for r in got:
        total[r.shard] += sizes[int(r.g[1:])]
    rest = sorted(total.values())[:-1]
    assert len(got) == len(sizes) and max(total.values()) == 900_000 and rest[-1] - rest[0] < 0.005 * rest[0]


# --- decontamination

def test_all_pairs_aligned(spark):
    """The links of the query are those of an alignment of every item with every whole document."""
    items = {i: tuple(decontaminate.words_of((t or "").encode())) for i, t in read(SF, "benchmark", "item_id", "text")}
    counts, want = {i: Counter(w) for i, w in items.items()}, set()
    for d, t in read(SF, "documents", "doc_id", "text"):
        w = decontaminate.words_of((t or "").encode())
        for i, item in items.items():
            top = decontaminate.EQUAL * len(item)
            if item and decontaminate.EQUAL * decontaminate.shared(counts[i], w) >= decontaminate.SHARE * top:  # no alignment has more equal words
                score, equal, _, _ = decontaminate.align(item, tuple(w))
                if score >= decontaminate.SHARE * top and equal >= min(decontaminate.LEAST_WORDS, len(item)):
                    want.add((d, i))
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(spark, SF).collect()} == want


def test_rows_that_are_worked_out_again(monkeypatch):
    rnd = random.Random(8)
    pairs = [tuple(tuple(rnd.choices("abcde", k=rnd.randrange(1, 60))) for _ in range(2)) for _ in range(60)]
    whole = [decontaminate.align(*p) for p in pairs]
    for kept in (1, 2, 7):
        monkeypatch.setattr(decontaminate, "KEPT", kept)
        assert [decontaminate.align(*p) for p in pairs] == whole


def test_long_item(spark):
    """An item of 50,000 words, of which a document has a tenth replaced."""
    rnd = random.Random(9)
    item = [f"w{rnd.randrange(3000)}" for _ in range(50_000)]
    copy = [f"x{i}" if rnd.random() < 0.1 else w for i, w in enumerate(item)]
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.links(plain(spark, [(1, " ".join(item)), (2, " ".join(copy)), (3, " ".join(copy[:5000]))]), table).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]
    assert next(r for r in got if r.doc_id == 2).identity == pytest.approx(sum(a == b for a, b in zip(item, copy, strict=True)) / 50_000, abs=0.002)


# --- quality rules

def covering(rows, edges):
    """Sequential covering over rows ({test: value}, bad, held) by counting every condition in every row."""
    holds = lambda rule, x: all(x[n] > t if op == ">" else x[n] <= t for n, op, t in rule)
    least, rules = quality.COVERAGE * sum(bad for _, bad, _ in rows), []
    while len(rules) < quality.RULES:
        free = [r for r in rows if not any(holds(rule, r[0]) for rule in rules)]
        rule = []
        while len(rule) < quality.CONDITIONS:
            now = [(x, bad) for x, bad, held in free if not held and holds(rule, x)]
            p, n = sum(b for _, b in now), sum(not b for _, b in now)
            if not p or not n:
                break
            best = (0.0, None)
            for name in quality.TESTS:
                for t in edges[name]:
                    for op in ("<=", ">"):
                        pp = sum(b for x, b in now if holds([(name, op, t)], x))
                        nn = sum(not b for x, b in now if holds([(name, op, t)], x))
                        if pp >= least and (gain := pp * (math.log2(pp / (pp + nn)) - math.log2(p / (p + n)))) > best[0] + 1e-9:
                            best = (gain, (name, op, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        score = []
        for k in range(len(rule)):
            hit = [bad for x, bad, held in free if held and holds(rule[: k + 1], x)]
            score.append(((2 * sum(hit) - len(hit)) / max(len(hit), 1), -k, sum(hit), len(hit)))
        _, k, p, all_ = max(score)
        if not all_ or p / all_ < quality.PRECISION or p < least / 3:
            break
        rules.append(rule[: 1 - k])
    return rules


def test_plain_covering(spark):
    """The list that Spark learns is that of a plain learner over the same thresholds, quantiles of the labelled rows."""
    sf = SF.replace("sf0.001", "sf0.01")
    stats = quality.statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.learn(stats, labels)
    known = labels.filter("quality in (0, 1)").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rows = [(r.asDict(), r.bad, r.held) for r in stats.join(known, "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[F.expr(e).cast("double").alias(n) for n, e in quality.TESTS.items()]).collect()]
    at = [i / (quality.BINS + 1) for i in range(1, quality.BINS + 1)]
    rank = lambda v, p: sorted(v)[max(0, math.ceil(p * len(v)) - 1)]
    edges = {n: sorted({rank([x[n] for x, _, _ in rows], p) for p in (*at, 0.99, 0.995)} | {rank([x[n] for x, bad, _ in rows if bad], p) for p in at[::3]}) for n in quality.TESTS}
    assert got and got == covering(rows, edges)


# --- toxicity

def test_plain_label_model():
    """Expectation maximisation with loops gives the same accuracies, weights and posteriors."""
    rnd = np.random.default_rng(2)
    y = rnd.random(3000) < 0.3
    votes = np.stack([np.where(rnd.random(3000) < np.where(y, hit, false), 1, np.where(rnd.random(3000) < 0.2, -1, 0)) for hit, false in ((0.8, 0.05), (0.6, 0.1), (0.5, 0.02))], 1)
    u, count = np.unique(votes, axis=0, return_counts=True)
    start = np.clip(0.1 + 0.3 * (u > 0).sum(1), 0.05, 0.95)
    model = toxicity.LabelModel(u.astype(float), count.astype(float), start)
    post, weight = list(start), [1.0] * 3
    for turn in range(4):
        for _ in range(30):
            w = [[(1 - p) * c for p, c in zip(post, count, strict=True)], [p * c for p, c in zip(post, count, strict=True)]]
            prior = [(sum(x) + 1) / (sum(count) + 2) for x in w]
            table = [[[(sum(x for x, row in zip(w[c], u, strict=True) if row[v] == k) + 0.5) / (sum(w[c]) + 1.5) for k in (-1, 0, 1)] for v in range(3)] for c in (0, 1)]
            log = lambda c, row: math.log(prior[c]) + sum(weight[v] * math.log(table[c][v][row[v] + 1]) for v in range(3))  # noqa: E731, B023
            post = [1 / (1 + math.exp(log(0, row) - log(1, row))) for row in u]
        if turn < 3:
            cov = defaultdict(float)
            for c in (0, 1):
                m = [sum((post[i] if c else 1 - post[i]) * count[i] * u[i][v] for i in range(len(u))) / sum((post[i] if c else 1 - post[i]) * count[i] for i in range(len(u))) for v in range(3)]
                for i in range(len(u)):
                    for a in range(3):
                        for b in range(3):
                            cov[a, b] += (post[i] if c else 1 - post[i]) * count[i] * (u[i][a] - m[a]) * (u[i][b] - m[b])
            r = {ab: abs(x) / math.sqrt(cov[ab[0], ab[0]] * cov[ab[1], ab[1]]) for ab, x in cov.items()}
            weight = [1 / (1 + sum(r[a, b] for b in range(3) if a != b and r[a, b] >= 0.1)) for a in range(3)]
    assert model.prior == pytest.approx(prior) and model.table == pytest.approx(np.array(table)) and model.weight == pytest.approx(weight)
    assert model.posterior(u.astype(float)) == pytest.approx(post)


def test_linear_classifier_is_at_its_optimum():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(500, 4))
    y = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0, 0.5] + 0.3)))
    w = toxicity.fit_linear(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    slope = np.concatenate([[(p - y).sum()], x.T @ (p - y) + w[1:]])
    assert np.abs(slope).max() < 1e-4


def test_log_gamma():
    n = np.array([0, 1, 5, 1023, 1024, 5000, 10**6, 10**12])
    for small, add in ((ctw.HALVES, 0.5), (ctw.WHOLES, 1.0)):
        assert ctw.log_gamma(n, small, add) == pytest.approx([math.lgamma(x + add) for x in n.tolist()], rel=1e-14, abs=1e-12)


# --- near duplicates

def test_against_all_pairs_of_documents(spark):
    """No document more and none less than an exact search keeps; SimHash alone finds most of the pairs."""
    docs = sorted(read(SF.replace("sf0.001", "sf0.01"), "documents", "doc_id", "text"))
    texts = [t or "" for _, t in docs]
    want = [docs[i][0] for i in stays(texts)]
    assert want == sorted(r.doc_id for r in neardup.deduplicate(spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")).collect())
    sets = [shingles(t) for t in dict.fromkeys(texts)]
    prints = [simhash.simhash(neardup.shingle_set(t.encode(), 1)) for t in dict.fromkeys(texts)]
    holds, pairs = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            for j in holds[g]:
                pairs[j, i] += 1
            holds[g].append(i)
    alike = [(i, j) for (i, j), n in pairs.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    near = sum((prints[i] ^ prints[j]).bit_count() <= neardup.BITS for i, j in alike)
    assert alike and near >= 0.4 * len(alike)  # a handful of pairs here; the README has the share on larger tables


def test_long_runs(spark, monkeypatch):
    """Every run is long, and every run of fingerprints is cut once more."""
    rnd = random.Random(14)
    base = [[f"b{k}w{i}" for i in range(120)] for k in range(3)]
    texts = []
    for k in range(90):
        w = list(base[k % 3])
        for i in rnd.sample(range(120), rnd.choice((0, 1, 2, 3))):
            w[i] = f"y{rnd.randrange(5)}"
        texts.append(" ".join(w))
    want = stays(texts)
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(simhash, "LONG", 4)
    monkeypatch.setattr(simhash, "SMALL", 2)
    assert sorted(r.doc_id for r in neardup.deduplicate(plain(spark, list(enumerate(texts)))).collect()) == want


def test_parities_never_miss():
    """Sizes and parities rule out no pair that is similar, whatever the widths; close pairs of a run are all those left."""
    rnd = np.random.default_rng(7)
    for _ in range(30):
        base = rnd.integers(0, 1 << 62, rnd.integers(3, 400)).astype(np.uint64)
        sets = []
        for _ in range(40):
            drop = rnd.random(len(base)) < rnd.random() * 0.2
            sets.append(np.unique(np.concatenate([base[~drop], rnd.integers(0, 1 << 62, rnd.integers(0, 1 + len(base) // 5)).astype(np.uint64)])))
        par, n, root = [neardup.parities(s) for s in sets], np.array([len(s) for s in sets]), np.arange(40) // 3
        got = {(min(i, j), max(i, j)) for i, j in zip(*map(list, neardup.close_in_run(n, root, par, 0.8, None)), strict=True)}
        best = {(min(i, j), max(i, j)) for i, j in zip(*map(list, neardup.close_in_run(n, root, par, 0.8, 2)), strict=True)}
        assert best <= got and {i for p in got for i in p} == {i for p in best for i in p}
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert neardup.apart(par[i], par[j]) <= n[i] + n[j] - 2 * both
                if both >= 0.8 * (n[i] + n[j] - both) and root[i] != root[j]:
                    assert (j, i) in got


def test_forest_in_pieces(monkeypatch):
    """Links of a long run by pieces of the other bits have the components of all its links."""
    monkeypatch.setattr(simhash, "LONG", 8)
    rnd = random.Random(15)
    shift, width = simhash.segments(4)[0]
    f = []
    for _ in range(40):
        x = rnd.getrandbits(64) >> width << width
        for _ in range(6):
            y = x
            for b in rnd.sample(range(width, 64), rnd.randrange(5)):
                y ^= 1 << b
            f.append(y)
    f = np.array(sorted(set(f)), np.uint64)

    def parts(a, b):
        up = list(range(len(f)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in zip(a, b, strict=True):
            i, j = find(int(i)), find(int(j))
            up[max(i, j)] = min(i, j)
        return [find(i) for i in range(len(f))]

    position = shift  # all rows share the first segment, so links are at home at its first position
    got = simhash.forest(f, 4, position)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    assert parts(*got) == parts(i, j)


# --- licences

def test_public_domain_is_not_cc0(spark):
    got = licenses.scan(plain(spark, [(1, "This work is in the public domain."), (2, "Released under CC0 1.0.")])).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: "public-domain", 2: "CC0-1.0"}


@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
def test_whole_texts(spark, name):
    """A licence by its entire text, whatever its case, wrapping, quotation marks and holder."""
    t = licenses.TEXTS[name]
    head, _, rest = t.partition("\n")
    odd = f"{head.upper()}\nCopyright (c) 2019 Some Holder\n" + rest.replace('"', "“").replace(" ", "\n ")
    got = licenses.scan(plain(spark, [(1, odd), (2, t + " And more.")])).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: name, 2: None}
