"""Chains and cycles of any length: right results in rounds that follow the longest chain, not the number of nodes."""

import random

import pytest

from duolex.operators import rules


def brute(rows):
    at = {k: (p, v) for k, p, *v in rows}
    out = {}
    for k, _, *own in rows:
        found, seen, here = list(own), {k}, at[k][0]
        while here is not None and here in at and here not in seen:
            found = [x if x is not None else y for x, y in zip(found, at[here][1], strict=True)]
            seen.add(here)
            here = at[here][0]
        out[k] = tuple(found)
    return out


def followed(spark, rows, schema="id long, up long, v string, w string"):
    got = rules.follow_chain(spark.createDataFrame(rows, schema), "id", "up", ["v", "w"]).collect()
    assert len(got) == len(rows)
    return {r.id: (r.v, r.w) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_any_graph(spark, seed):
    """Random parents make cycles with tails; few values, cycles of every length to 20, a long chain, a node that none names."""
    r = random.Random(seed)
    value = lambda k: f"{k}" if r.random() < 0.15 else None
    rows = [(k, r.choice([None, k, 10_000, r.randrange(300), r.randrange(300), r.randrange(300)]), value(k), value(k)) for k in range(300)]
    for n in range(1, 21):
        keys = r.sample(range(1000 * n, 1000 * n + 500), n + 9)
        ring, tail = keys[:n], keys[n:]
        rows += [(k, ring[(i + 1) % n], value(k) if n % 2 else None, None) for i, k in enumerate(ring)]
        rows += [(k, ([*tail, ring[0]])[i + 1], None, value(k)) for i, k in enumerate(tail)]
    keys = r.sample(range(50_000, 60_000), 70)
    rows += [(k, p, None, None) for k, p in zip(keys, keys[1:], strict=False)] + [(keys[-1], None, "end", None), (None, keys[60], None, "no key")]
    assert followed(spark, rows) == brute(rows)


def test_rounds(spark, monkeypatch):
    """A cycle among many nodes ends with its own length's log2, and settled rows are kept once."""
    kept, plain = [], rules.cut

    def cut(df):
        kept.append(out := plain(df))
        return out

    monkeypatch.setattr(rules, "cut", cut)
    rows = [(k, None, "x", "y") for k in range(4000)] + [(5000, 5001, None, "b"), (5001, 5000, None, None), (5002, 5001, None, None)]
    assert followed(spark, rows) == brute(rows)
    assert len(kept) <= 5  # 13 for 4,003 nodes otherwise
    assert sum(df.count() for df in kept) < 4100
