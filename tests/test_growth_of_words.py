"""Lattices of many stretches at once: as those of each stretch alone."""

import random
from collections import Counter

from duolex.plans import segment


def test_many_stretches_as_each_alone(monkeypatch):
    r = random.Random(4)
    words = {"".join(r.choices("あいうカキ鏡", k=r.randrange(1, 5))): r.choice([1.0, 2.0, 2.5, 4.0]) for _ in range(80)} | {"い": 1.5, "う": 3.0, "あ": 2000.0}
    words.pop("鏡", None)  # a letter that isn't a word
    stretches = ["".join(r.choices("あいうカキ鏡鰯", k=r.randrange(1, 40))) for _ in range(300)] + ["い", "鰯"]
    times = [float(r.randrange(1, 5)) for _ in stretches]
    monkeypatch.setattr(segment, "AT_ONCE", 500)
    for long in (1000, 20):  # those over it go alone
        monkeypatch.setattr(segment, "LONG", long)
        for model in (segment.Words(words, 4), segment.Words({}, 3)):
            assert model.lattice().best(stretches) == [model.best(s) for s in stretches]
            want, counted = Counter(), Counter()
            for s, n in zip(stretches, times, strict=True):
                model.expected(s, n, want)
                for a in range(len(s)):
                    counted.update({s[a:b]: 0 for b in range(a + 1, min(a + 4, len(s)) + 1)})
                    for b in range(a + 1, min(a + 4, len(s)) + 1):
                        counted[s[a:b]] += n
            got = dict(zip(*model.lattice().expected(stretches, times), strict=True))
            assert all(abs(got.get(w, 0) - want[w]) < 1e-6 * (1 + want[w]) for w in model.cost)
            assert want.keys() & model.cost.keys() <= got.keys()  # those of no weight too
            texts = ["", "abc、".join(stretches[:9]), *stretches[:20], "x"]
            assert model.tokens_of(texts) == [model.tokens(t) for t in texts]
    sums = Counter()
    for w, x in zip(*segment.substring_counts(stretches, times, 4), strict=True):
        sums[w] += x
    assert sums == counted and segment.substring_counts([], [], 4) == ([], [])
