"""Japanese words without a dictionary: a unigram model of words, learned by EM over the corpus, and the best path of a lattice.

The lattice of a stretch of Japanese letters has an edge for every substring that is a word of the model. EM weighs all paths:
tasks run forward and backward over their stretches and sum the expected count of each word, an aggregate adds these up, and
a word's cost is the digamma-discounted logarithm of its share, which starves words that shorter ones explain. The model has
at most `size` words, which is what travels to the tasks; the corpus is read by the tasks only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAN, HIRAGANA, KATAKANA, ranges
from ..session import cut, partitions

#: Letters that belong to a stretch, and tokens that are words as they stand: letters and digits of other scripts.
LETTERS = f"[{ranges(HAN)}{ranges(HIRAGANA)}{ranges(KATAKANA)}ー々]"
OTHERS = rf"(?:(?!{LETTERS})[\p{{L}}\p{{N}}\p{{M}}])+"
#: Sums that a task hands on at once.
HELD = 100_000


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


@dataclass
class Words:
    """A cost for each word, the length of the longest, and the cost of a letter that isn't one."""

    cost: dict[str, float]
    longest: int
    unknown: float = 50.0
    _pattern: list = field(default_factory=list, repr=False)
    _lattice: list = field(default_factory=list, repr=False, compare=False)

    def edges(self, s: str) -> list[list[tuple[int, float]]]:
        """For each place the words that end there: (start, cost)."""
        cost, out = self.cost, []
        for end in range(1, len(s) + 1):
            into = [(a, cost[w]) for a in range(max(0, end - self.longest), end) if (w := s[a:end]) in cost]
            out.append(into if into and into[-1][0] == end - 1 else [*into, (end - 1, self.unknown)])
        return out

    def best(self, s: str) -> list[tuple[int, int]]:
        """The cheapest words of a stretch as spans; of equal paths the one with the longest last words."""
        total, back = [0.0], [0]
        for into in self.edges(s):
            c, a = min((total[a] + c, a) for a, c in into)
            total.append(c)
            back.append(a)
        out, end = [], len(s)
        while end:
            out.append((back[end], end))
            end = back[end]
        return out[::-1]

    def expected(self, s: str, n: float, into: Counter) -> None:
        """Adds n times the expected count of each word over all paths of a stretch."""
        edges = self.edges(s)
        ahead = [0.0]  # log probability of the letters up to a place
        for e in edges:
            top = max(ahead[a] - c for a, c in e)
            ahead.append(top + math.log(sum(math.exp(ahead[a] - c - top) for a, c in e)))
        whole, rest = ahead[-1], [-math.inf] * len(s) + [0.0]
        for end in range(len(s), 0, -1):
            for a, c in edges[end - 1]:
                x = rest[end] - c
                into[s[a:end]] += n * math.exp(ahead[a] + x - whole)
                hi, lo = max(rest[a], x), min(rest[a], x)
                rest[a] = hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi

    def tokens(self, text: str) -> list[tuple[str, int, int, int]]:
        """(term, pos, start, end) of a text, ascending; symbols are left out. An analyzer for `analyzers.register`."""
        import regex

        if not self._pattern:
            self._pattern.append(regex.compile(f"(?P<j>{LETTERS}+)|{OTHERS}"))
        out: list[tuple[str, int, int, int]] = []
        for m in self._pattern[0].finditer(text):
            for a, b in self.best(m[0]) if m["j"] else [(0, len(m[0]))]:
                out.append((m[0][a:b], len(out), m.start() + a, m.start() + b))
        return out

    def tokens_of(self, texts: list[str]) -> list[list[tuple[str, int, int, int]]]:
        """`tokens` of many texts at once."""
        import regex

        if not self._pattern:
            self._pattern.append(regex.compile(f"(?P<j>{LETTERS}+)|{OTHERS}"))
        found = [list(self._pattern[0].finditer(t)) for t in texts]
        best = iter(self.lattice().best([m[0] for each in found for m in each if m["j"]]))
        out = []
        for each in found:
            mine: list[tuple[str, int, int, int]] = []
            for m in each:
                s, at = m[0], m.start()
                for a, b in next(best) if m["j"] else [(0, len(s))]:
                    mine.append((s[a:b], len(mine), at + a, at + b))
            out.append(mine)
        return out

    def lattice(self) -> Lattice:
        if not self._lattice:
            self._lattice.append(Lattice(self))
        return self._lattice[0]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pattern": [], "_lattice": []}


#: Letters of the stretches that are worked on at once; longer stretches than the second go alone.
AT_ONCE, LONG = 400_000, 1_000


def _in_parts(stretches: list[str]) -> Iterator[range]:
    begin, size = 0, 0
    for i, s in enumerate(stretches):
        size += len(s)
        if size >= AT_ONCE or i + 1 == len(stretches):
            yield range(begin, i + 1)
            begin, size = i + 1, 0


class Lattice:
    """The lattices of many stretches: a step takes the n-th letter of all of them. Words are found by a tree of their letters."""

    def __init__(self, model: Words):
        self.model, self.longest = model, max(model.longest, 1)
        letters = sorted({c for w in model.cost for c in w})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        code, node = {c: i for i, c in enumerate(letters)}, {"": 0}
        step: dict[int, int] = {}
        for w in model.cost:
            for i in range(1, len(w) + 1):
                if w[:i] not in node:
                    node[w[:i]] = len(node)
                    step[node[w[: i - 1]] * len(letters) + code[w[i - 1]]] = node[w[:i]]
        self.words = list(node)
        self.cost = np.array([model.cost.get(w, math.inf) for w in self.words])
        self.keys = np.array(sorted(step), np.int64)
        self.child = np.array([step[k] for k in self.keys.tolist()], np.int64)

    def edges(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs and nodes of the words of each length that begin at each letter; left: letters up to the stretch's end."""
        cost, nodes = np.full((self.longest, len(points)), math.inf), np.full((self.longest, len(points)), -1)
        letter = np.searchsorted(self.letters, points)
        known = letter < len(self.letters)
        known[known] = self.letters[letter[known]] == points[known]
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for k in range(self.longest):
            some = left[at] > k
            at, node = at[some], node[some]
            some = known[at + k]
            at, node = at[some], node[some]
            if not len(at) or not len(self.keys):
                break
            key = node * len(self.letters) + letter[at + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            some = self.keys[i] == key
            at, node = at[some], self.child[i[some]]
            nodes[k, at], cost[k, at] = node, self.cost[node]
        nodes[np.isinf(cost)] = -1
        cost[0, np.isinf(cost[0])] = self.model.unknown
        return cost, nodes

    def _laid(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches by length downwards: their order, begins, lengths, how many have n letters or more, costs and nodes."""
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        points = np.frombuffer("".join(stretches[i] for i in order.tolist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.cumsum(size) - size
        left = np.repeat(begins + size, size) - np.arange(len(points))
        active = np.searchsorted(-size, -np.arange(size.max(initial=0) + 2), "right")
        return order, begins, size, active, *self.edges(points, left)

    def _ahead(self, begins: np.ndarray, active: np.ndarray, cost: np.ndarray, e: int, before: list[np.ndarray]) -> np.ndarray:
        """Costs of the words that end at the e-th letter, longest first, each with what `before` has at its begin."""
        n = active[e]
        return np.stack([before[e - k][:n] + cost[k - 1, begins[:n] + e - k] for k in range(min(self.longest, e), 0, -1)])

    def best(self, stretches: list[str]) -> list[list[tuple[int, int]]]:
        """`Words.best` of each stretch."""
        out: list = [None] * len(stretches)
        for part in _in_parts(stretches):
            short = [i for i in part if len(stretches[i]) <= LONG]
            for i in part:
                if len(stretches[i]) > LONG:
                    out[i] = self.model.best(stretches[i])
            if not short:
                continue
            order, begins, size, active, cost, _ = self._laid([stretches[i] for i in short])
            total, back = [np.zeros(len(order))], np.zeros(cost.shape[1], np.int64)
            for e in range(1, int(size[0]) + 1):
                every = self._ahead(begins, active, cost, e, total)
                least = every.argmin(0)
                total.append(np.take_along_axis(every, least[None], 0)[0])
                back[begins[: active[e]] + e - 1] = len(every) - least
            back = back.tolist()
            for i, b, end in zip(order.tolist(), begins.tolist(), size.tolist(), strict=True):
                spans = []
                while end:
                    n = back[b + end - 1]
                    spans.append((end - n, end))
                    end -= n
                out[short[i]] = spans[::-1]
        return out

    def expected(self, stretches: list[str], times: list[float]) -> tuple[list[str], list[float]]:
        """What `Words.expected` adds up over the stretches, of the model's words."""
        sums, seen, alone = np.zeros(len(self.words)), np.zeros(len(self.words), bool), Counter()
        for part in _in_parts(stretches):
            short = [i for i in part if len(stretches[i]) <= LONG]
            for i in part:
                if len(stretches[i]) > LONG:
                    self.model.expected(stretches[i], times[i], alone)
            if not short:
                continue
            order, begins, size, active, cost, nodes = self._laid([stretches[i] for i in short])
            n = np.array([times[i] for i in short], np.float64)[order]
            ahead, last = [np.zeros(len(order))], int(size[0])  # minus the log probability of the letters up to a place
            for e in range(1, last + 1):
                every = self._ahead(begins, active, cost, e, ahead)
                top = every.min(0)
                ahead.append(top - np.log(np.exp(top - every).sum(0)))
            whole = np.concatenate([ahead[e][active[e + 1] : active[e]] for e in range(last, -1, -1)])
            got, rest = np.zeros(cost.shape), {last: np.zeros(active[last])}
            for a in range(last - 1, -1, -1):
                m = active[a + 1]
                every = np.full((self.longest, m), math.inf)
                for k in range(1, min(self.longest, last - a) + 1):
                    j = active[a + k]
                    at = begins[:j] + a
                    every[k - 1, :j] = rest[a + k][:j] + cost[k - 1, at]
                    got[k - 1, at] = n[:j] * np.exp(whole[:j] - ahead[a][:j] - every[k - 1, :j])
                top = every.min(0)
                rest[a] = np.zeros(active[a])
                rest[a][:m] = top - np.log(np.exp(top - every).sum(0))
                rest.pop(a + self.longest, None)
            some = nodes >= 0
            sums += np.bincount(nodes[some], got[some], len(self.words))
            seen[nodes[some]] = True
        words = [self.words[i] for i in np.flatnonzero(seen)]  # a sum may be 0, its word stays
        both = Counter(dict(zip(words, sums[seen].tolist(), strict=True)))
        for w, x in alone.items():
            both[w] += x
        return list(both), list(both.values())


def substring_counts(stretches: list[str], times: list[float], longest: int) -> tuple[list[str], list[float]]:
    """How often each substring of up to `longest` letters comes, for some stretches at a time."""
    words: list[str] = []
    sums: list[float] = []
    for part in _in_parts(stretches):
        text = "".join(stretches[part.start : part.stop])
        size = np.array([len(stretches[i]) for i in part], np.int64)
        points, left = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), np.repeat(np.cumsum(size), size) - np.arange(len(text))
        n = np.repeat(np.array([times[i] for i in part], np.float64), size)
        letter = np.unique(points, return_inverse=True)[1]
        at, of = np.arange(len(text)), np.zeros(len(text), np.int64)
        for k in range(longest):
            some = left[at] > k
            at, of = at[some], of[some]
            if not len(at):
                break
            _, first, of = np.unique(of * (letter.max() + 1) + letter[at + k], return_index=True, return_inverse=True)
            words += [text[i : i + k + 1] for i in at[first].tolist()]
            sums += np.bincount(of, n[at]).tolist()
    return words, sums


def stretches(texts: DataFrame, text: str = "text") -> DataFrame:
    """(s, n): the distinct stretches of Japanese letters and how often each comes."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}+"), F.lit(0))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


def _summed(rows: DataFrame, count) -> DataFrame:  # noqa: ANN001
    """(w, x): what count(stretches, times) gives for some thousand of them, (words, sums), added up over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sums = count(b.column(0).to_pylist(), b.column(1).to_pylist())
            for i in range(0, len(words), HELD):
                yield pa.RecordBatch.from_pydict({"w": pa.array(words[i : i + HELD], pa.string()), "x": pa.array(sums[i : i + HELD], pa.float64())})

    return rows.mapInArrow(run, "w string, x double").groupBy("w").agg(F.sum("x").alias("x"))


def train(texts: DataFrame, text: str = "text", longest: int = 8, size: int = 50_000, least: int = 5, rounds: int = 4) -> Words:
    """The words of a corpus. Null texts count as empty; a corpus without Japanese letters gives a model without words.

    Seeds are all letters and the `size` substrings of 2 to `longest` letters that cover most and come `least` times or more.
    `size` bounds what is gathered, not what is read: every stretch counts in every round, equal ones together.
    """
    rows = cut(stretches(texts, text))
    rows = cut(rows.repartition(partitions(rows), "s"))

    seeds = cut(_summed(rows, lambda s, n: substring_counts(s, n, longest)).filter((F.length("w") == 1) | (F.col("x") >= least)))
    letters = seeds.filter("length(w) = 1")
    many = seeds.filter("length(w) > 1").orderBy(F.desc(F.col("x") * F.length("w")), "w").limit(size)
    found = {r.w: r.x for r in letters.unionByName(many).collect()}
    total = sum(found.values())
    model = Words({w: round(math.log(total / x), 9) for w, x in found.items()}, longest)
    for _ in range(rounds if found else 0):
        got = {r.w: r.x for r in _summed(rows, lambda s, n, model=model: model.lattice().expected(s, n)).collect()}
        model = estimated(got, model, least)
    return model


def estimated(expected: dict[str, float], model: Words, least: int) -> Words:
    """The model of the expected counts: words of one letter stay, longer ones if they are expected `least` / 2 times."""
    # where two letters are a word's only use, half the seeds' limit keeps it; what falls below is explained by others
    left = {w: x for w, x in expected.items() if w in model.cost and (len(w) == 1 or 2 * x >= least)}
    whole = digamma(sum(left.values()))
    return Words({w: round(whole - digamma(max(x, 1e-3)), 9) for w, x in left.items()}, model.longest)


def words_of(text: Column, model: Words) -> Column:
    """array<struct<term, pos, start, end>> of a text by a trained model; null has no tokens."""
    from ..functions.analyzers import tokens_by

    return tokens_by(text, model.tokens, model.tokens_of)


def word_count(text: Column, model: Words) -> Column:
    return F.size(words_of(text, model))
