"""Near duplicates of the pipeline against all pairs."""

import random
from collections import defaultdict

from duolex.llm import neardup

from .helpers import plain


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def stays(texts, least=0.8):
    """Ids that an exact search keeps: the smallest of each component."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        meets = defaultdict(int)
        for g in s:
            for j in holds[g]:
                meets[j] += 1
            holds[g].append(i)
        for j, both in meets.items():
            if both >= least * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [i for i in range(len(texts)) if find(i) == i]


def edited(rnd, base, n):
    w = list(base)
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"x{rnd.getrandbits(40)}"
    return " ".join(w)


def test_no_pair_is_missed(spark):
    """Pairs around the limit, a passage that many documents share, and short texts."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(300):
        base = [f"w{rnd.getrandbits(30)}" for _ in range(rnd.choice((8, 30, 84, 300)))] + (passage if k % 3 == 0 else [])
        texts += [" ".join(base), edited(rnd, base, max(1, len(base) * rnd.choice((14, 18, 20, 22, 24)) // 1000))]
    want = stays(texts)
    assert 300 < len(want) < 600
    assert sorted(r.doc_id for r in neardup.deduplicate(plain(spark, list(enumerate(texts)))).collect()) == want


def test_large_family_around_the_limit(spark):
    """Runs much longer than SMALL, in which many of the candidates of any one member fail."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = [edited(rnd, base, rnd.choice((2, 3, 3, 4))) for _ in range(400)]
    want = stays(texts)
    assert 1 < len(want) < 300
    assert sorted(r.doc_id for r in neardup.deduplicate(plain(spark, list(enumerate(texts)))).collect()) == want
