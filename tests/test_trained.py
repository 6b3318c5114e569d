"""Word splitting and alignment learned by EM, against enumerations of all paths with dictionaries."""

import math
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from duolex.functions import analyzers
from duolex.operators import corpus
from duolex.plans import lexicon, segment


def paths(s, longest):
    if not s:
        yield []
    for n in range(1, min(longest, len(s)) + 1):
        for rest in paths(s[n:], longest):
            yield [s[:n], *rest]


TEXTS = ["ねこがすき", "いぬがすき", "ねこといぬ。ABC 猫がいる", "ねこがすき", None, "", "カメラがすき!", "猫 がいる"]


def enumerated(texts, longest, least, rounds):
    import regex

    rows = Counter(s for t in texts if t for s in regex.findall(f"{segment.LETTERS}+", t))
    found = Counter()
    for s, n in rows.items():
        for a in range(len(s)):
            for b in range(a + 1, min(a + longest, len(s)) + 1):
                found[s[a:b]] += n
    found = {w: x for w, x in found.items() if len(w) == 1 or x >= least}
    total = sum(found.values())
    cost = {w: math.log(total / x) for w, x in found.items()}
    for _ in range(rounds):
        got = Counter()
        for s, n in rows.items():
            every = [(p, math.exp(-sum(cost[w] for w in p))) for p in paths(s, longest) if all(w in cost for w in p)]
            whole = sum(x for _, x in every)
            for p, x in every:
                for w in p:
                    got[w] += n * x / whole
        got = {w: x for w, x in got.items() if len(w) == 1 or 2 * x >= least}
        whole = segment.digamma(sum(got.values()))
        cost = {w: whole - segment.digamma(max(x, 1e-3)) for w, x in got.items()}
    return cost


def test_words_by_all_paths(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    model = segment.train(d, longest=4, least=2, rounds=3)
    want = enumerated(TEXTS, 4, 2, 3)
    assert model.cost.keys() == want.keys() and all(abs(model.cost[w] - want[w]) < 1e-6 for w in want)
    for t in filter(None, TEXTS):
        got = model.tokens(t)
        assert [t[a:b] for _, _, a, b in got] == [w for w, *_ in got] and [p for _, p, _, _ in got] == list(range(len(got)))
        assert all(x[3] <= y[2] for x, y in zip(got, got[1:], strict=False))  # ascending
    for s in ("ねこがすき", "いぬがすき", "ねこといぬ"):
        cheapest = min((sum(want.get(w, 50.0 if len(w) == 1 else math.inf) for w in p)) for p in paths(s, 4))
        assert math.isclose(sum(model.cost.get(s[a:b], 50.0) for a, b in model.best(s)), cheapest, abs_tol=1e-6)
    assert [w for w, *_ in model.tokens("ABC! 猫、12")] == ["ABC", "猫", "12"]
    assert [w for w, *_ in model.tokens("鰯")] == ["鰯"] and model.tokens("…!") == []


def test_words_of_nothing(spark):
    model = segment.train(spark.createDataFrame([("only latin",), (None,)], "text string"))
    assert model.cost == {} and [w for w, *_ in model.tokens("鰯のx")] == ["鰯", "の", "x"]


def test_digamma():
    assert abs(segment.digamma(1.0) + 0.5772156649) < 1e-8 and abs(segment.digamma(10.5) - 2.3030010343) < 1e-8


def test_import_counts_trained_words(spark):
    """The import's Japanese word counts come from a model trained on its own texts."""
    line = "key string, language string, text string, speaker string, context string, notes string, audio_path string, weight int, file_ordinal int, line_ordinal int"
    said = ["ねこがすき", "いぬがすき", "ねこがいる", "いぬがいる", "とりがすき", "とりがいる"]
    rows = [(str(i), lang, t, "", "", "", None, 0, 0, 2 * i + (lang == "ja")) for i, ja in enumerate(said) for lang, t in (("en", f"words of number {i}"), ("ja", ja))]
    models = []

    def trained(pairs):
        models.append(segment.train(pairs, "ja_text", least=2))
        return lambda text: segment.word_count(text, models[0])

    got = corpus.import_corpus(spark.createDataFrame(rows, line), "game", 1, japanese_words=trained).collect()
    assert len(got) == 6
    for r in got:
        assert r.japanese.word_count == len(models[0].tokens(r.japanese.text)) > 1


def brute_lexicon(pairs, simple, jumping):
    """Model 1 and HMM by summing over every alignment of every pair."""
    pairs = [(s, t) for s, t in pairs if s and t]
    t = None

    def shares(count):
        whole = Counter()
        for (e, _), x in count.items():
            whole[e] += x
        return {k: x / whole[k[0]] for k, x in count.items()}

    for _ in range(simple):
        count = Counter()
        for s, f in pairs:
            for w in f:
                p = [1.0 if t is None else t[e, w] for e in ["", *s]]
                for e, x in zip(["", *s], p, strict=True):
                    count[e, w] += x / sum(p)
        t = shares(count)
    jumps = lexicon.uniform_jumps()

    def every(s, f):
        for a in product(range(len(s)), repeat=len(f)):
            x = 1 / len(s)
            for j, i in enumerate(a):
                x *= t[s[i], f[j]]
                if j:
                    width = lambda k: jumps[max(-lexicon.FAR, min(lexicon.FAR, k - a[j - 1]))]  # noqa: B023, E731
                    x *= width(i) / sum(map(width, range(len(s))))
            yield a, x

    for _ in range(jumping):
        count, moved = Counter(), Counter()
        for s, f in pairs:
            got = list(every(s, f))
            whole = sum(x for _, x in got)
            for a, x in got:
                for j, i in enumerate(a):
                    count[s[i], f[j]] += x / whole
                    if j:
                        moved[max(-lexicon.FAR, min(lexicon.FAR, i - a[j - 1]))] += x / whole
        t, jumps = shares(count), {d: max(moved[d], 1e-9) for d in jumps}
    post = [{(j, i): sum(x for a, x in got if a[j] == i) / sum(x for _, x in got) for j in range(len(f)) for i in range(len(s))} if s and f and (got := list(every(s, f))) else {} for s, f in [*pairs]]
    return t, jumps, post


@pytest.mark.parametrize("simple, jumping", [(3, 0), (2, 2)])
def test_lexicon_by_all_alignments(spark, simple, jumping):
    pairs = [(["the", "house"], ["la", "casa"]), (["the", "red", "house"], ["la", "casa", "roja"]), (["a", "house"], ["una", "casa"]), (["a", "house"], ["una", "casa"]), (["red"], ["roja", "roja"]), ([], ["x"]), (["y"], []), (["the", "a", "the"], ["la", "una", "la"])]
    d = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "id int, source array<string>, target array<string>")
    model = lexicon.train(d, simple, jumping)
    t, jumps, post = brute_lexicon(pairs, simple, jumping)
    got = {(r.source, r.target): r.p for r in model.table.collect()}
    want = {k: x for k, x in t.items() if k[0]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert all(abs(model.jumps[d] - jumps[d]) < 1e-6 for d in jumps)
    links = {(r.id, r.j, r.i): r.score for r in lexicon.linked(d, model, 0.0).collect()}
    full = [k for k, (s, f) in enumerate(pairs) if s and f]
    assert len(links) == sum(len(p) for p in post)
    for k, p in zip(full, post, strict=True):
        for (j, i), x in p.items():
            assert abs(links[k, j, i] - x) < 1e-6


def test_aligned_finds_the_order(spark):
    """Sentences whose other side has the words in reverse order."""
    import random

    rnd = random.Random(3)
    en = "apple bread cat dog earth fire green house iron jump".split()
    ja = dict(zip(en, "りんご パン ねこ いぬ 土 火 緑 いえ 鉄 とぶ".split(), strict=True))
    rows = []
    for k in range(150):
        words = rnd.choices(en, k=rnd.randrange(2, 7))
        rows.append((k, " ".join(words), "・".join(ja[w] for w in words[::-1])))
    rows += [(900, "", "ねこ"), (901, None, None), (902, "cat", "")]
    got = {r.id: r.alignment_data for r in lexicon.aligned(spark.createDataFrame(rows, "id int, en string, ja string"), simplify=False).collect()}
    assert len(got) == len(rows) and got[900] == got[901] == got[902] == []
    right = total = 0
    for k, a, b in rows[:150]:
        want = {(a_[2], a_[3], b_[2], b_[3]) for a_, b_ in zip(analyzers.english_spans(a), analyzers.japanese_spans(b)[::-1], strict=True)}
        right, total = right + len(want & {tuple(x) for x in got[k]}), total + len(want)
    assert right / total > 0.95
