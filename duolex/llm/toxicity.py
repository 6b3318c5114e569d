"""Toxicity by weak supervision.

Lexicon and pattern voters look at a text and vote toxic, clean or not at all. A generative model of the true class and the votes
(the labels at hand are one more, fallible voter) is fitted by expectation maximisation on the counts of vote patterns: it
gives each voter's accuracy, and from what is left unexplained the correlation of each pair given the class, by which
dependent voters are discounted. A linear classifier on counts and votes is then trained on the posterior labels, put on the
scale of the labels by slope and intercept, and scores all texts. What leaves the executors: counts of vote patterns, the induced lexicon, and a bounded sample of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, cut, few, table, tidied

# Common insults and threats, lower-case, by kind.
LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles cretin dimwit halfwit nitwit dunce dolt brainless braindead retard retarded fool foolish simpleton airhead",
    "contempt": "scum scumbag trash garbage filth filthy vermin worthless pathetic loser losers disgusting clown clowns creep creeps freak freaks parasite parasites repulsive despicable contemptible lowlife degenerate sleazebag spineless gutless useless",
    "profanity": "fuck fucking fucker fucked shit shitty bullshit bitch bitches bastard bastards asshole assholes arsehole dick dickhead prick cunt twat wanker slut whore douchebag jackass motherfucker piss",
    "hate": "hate hated hateful loathe despise subhuman savages inferior bigot racist nazi terrorist traitor",
    "threat": "kill murder strangle stab slaughter exterminate lynch hang beat destroy annihilate rape",
    "other": "idiota idiotas imbécil estúpido estúpida tonto tonta pendejo basura asqueroso patético mierda puta cabrón idioten dumm dummkopf blöd trottel depp arschloch scheiße abschaum widerlich versager dreckig stupide imbécile débile connard connasse salope merde ordure minable dégoûtant crétin abruti",
}
LEET = str.maketrans("013457@$!*", "oieastasi ")
YOU = re.compile(r"\b(?:you|your|youre|u|ur)(?:'re| are|r)?\s+(?:(?:a|an|such|so|all|really|just|fucking|the|are|is)\s+){0,3}([^\W\d_]+)")
OBSCURED = re.compile(r"[^\W\d_]+[013457@$!*]+[^\W\d_]+")
WORD = re.compile(r"[^\W\d_]+")
VOTERS = (*LEXICONS, "induced_several", "induced_three", "two_kinds", "you_are", "obscured", "shouting", "nothing", "long_nothing")
COUNTS = ("n_listed", "n_distinct_listed", "n_induced", "n_distinct_induced", "listed_share", "induced_share", "evidence")
#: Labelled rows that the classifier is fitted on, at most; chosen by a hash of the id.
SAMPLE = 20_000
#: An induced word or stem occurs in this share of the distinct toxic texts, and this many times as often as in clean ones.
INDUCED_SHARE, INDUCED_LIFT, STEMS = 0.01, 30.0, (4, 5, 6, 7)


def lexicon() -> dict[str, str]:
    return {w: kind for kind, ws in LEXICONS.items() for w in ws.split()}


def looked_at(text: str, listed: dict[str, str], induced: dict[str, float], heads: frozenset[str]) -> list[float]:
    """Votes of VOTERS (1 toxic, -1 clean, 0 none) and COUNTS of a whole text; heads: the first letters of all that is induced."""
    low = text.lower()
    words = WORD.findall(low)
    hits = [w for w in words if w in listed]
    found = {w: v for w in {w for w in words if w[:3] in heads} if (v := max([induced.get(w, 0.0), *(induced.get(w[:k] + "*", 0.0) for k in STEMS if len(w) > k)]))}
    n_found = sum(w in found for w in words) if found else 0
    kinds = {listed[w] for w in hits}
    you = any(m[1] in listed or m[1] in found for m in YOU.finditer(low)) if hits or found else False
    obscured = any(m[0].translate(LEET) in listed for m in OBSCURED.finditer(low)) if re.search("[013457@$!*]", low) else False
    letters = sum(map(len, words))
    shouting = letters > 20 and sum(map(str.isupper, text)) > 0.6 * letters and "!" in text
    several = len(found) > 1 or n_found >= 0.02 * len(words) and n_found > 0  # one word of many may be chance
    nothing = not hits and not several and not obscured
    votes = [float(k in kinds) for k in LEXICONS]
    votes += [float(several), float(len(found) > 2), float(len(set(hits)) > 1), float(you), float(obscured), float(shouting), -float(nothing), -float(nothing and len(words) >= 50)]
    n = max(len(words), 1)
    return [*votes, np.log1p(len(hits)), np.log1p(len(set(hits))), np.log1p(n_found), np.log1p(len(found)), len(hits) / n, n_found / n, sum(found.values()) / 5]


def features(docs: DataFrame, induced: dict[str, float]) -> DataFrame:
    """docs (doc_id, text) to (doc_id, x array<float>), a row for each row; null is the empty text."""
    listed, heads = lexicon(), frozenset(w[:3] for w in induced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [looked_at(t or "", listed, induced, heads) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, x array<float>")


def induce(docs: DataFrame, known: DataFrame) -> dict[str, float]:
    """Words, and stems (a beginning of STEMS letters, written with a star), that mark toxic texts among all labelled rows.

    docs (doc_id, text), known (doc_id, toxic). The value is the log of how many times as often a unit occurs in toxic texts
    as in others. Equal texts count once. Texts stay where they are: units of toxic texts are counted first, and in the other
    texts only those that enough toxic ones have.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    labelled = docs.select("doc_id", text.alias("text")).join(few(known), "doc_id")
    same = labelled.select("doc_id", F.xxhash64("text").alias("h"), "toxic").groupBy("h", "doc_id").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"))
    one = same.groupBy("h").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("r"), F.max("toxic").alias("toxic"))
    one = cut(one.select("h", "r.doc_id", (1 / F.col("r.n")).alias("part"), "toxic"))
    total = one.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not total[0] or not total[1]:
        return {}

    def units(toxic: int) -> DataFrame:
        own = docs.select("doc_id", text.alias("text")).join(few(one.filter(F.col("toxic") == toxic).select("doc_id", "h", "part")), "doc_id").filter(F.xxhash64("text") == F.col("h"))
        words = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))
        return own.select("part", F.explode(F.array_distinct(F.concat(words, *[F.transform(words, _stem(k)) for k in STEMS]))).alias("w")).filter("w is not null and length(w) > 2")

    often = cut(units(1).groupBy("w").agg(F.round(F.sum("part"), 6).alias("p")).filter(F.col("p") >= max(5, INDUCED_SHARE * total[0])))
    clean = units(0).join(few(often.select("w")), "w", "left_semi").groupBy("w").agg(F.round(F.sum("part"), 6).alias("q"))
    count = often.join(clean, "w", "left").na.fill(0.0, ["q"])
    lift = (F.col("p") / total[0]) / ((F.col("q") + 0.5) / (total[1] + 1))
    return {r[0]: float(r[1]) for r in count.filter(lift >= INDUCED_LIFT).select("w", F.log(lift)).collect()}


def _stem(k: int):  # noqa: ANN202
    return lambda w: F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*")))


class LabelModel:
    """P(class), P(vote | class) for each voter, weights that discount dependent voters, and pairwise correlations given the class."""

    def __init__(self, votes: np.ndarray, count: np.ndarray, start: np.ndarray, rounds: int = 30):
        """votes (patterns, voters) in -1, 0, 1; count of each pattern; start: first guess of P(toxic) for each."""
        seen = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
        self.weight = np.ones(votes.shape[1])
        post = start
        for turn in range(4):
            for _ in range(rounds):
                w = np.stack([(1 - post) * count, post * count])
                self.prior = (w.sum(1) + 1) / (count.sum() + 2)
                # voters are held to be better than chance: a little prior weight on their own direction
                self.table = (np.einsum("cp,pvk->cvk", w, seen) + 0.5) / (w.sum(1)[:, None, None] + 1.5)
                post = self.posterior(votes)
            w = np.stack([(1 - post) * count, post * count])
            both = np.zeros((votes.shape[1],) * 2)
            for c in range(2):
                mean = (w[c] @ votes) / max(w[c].sum(), 1e-9)
                d = votes - mean
                cov = (d * w[c][:, None]).T @ d
                both += cov
            scale = np.sqrt(np.maximum(np.diag(both), 1e-9))
            self.correlation = both / np.outer(scale, scale)
            off = np.abs(self.correlation - np.diag(np.diag(self.correlation)))
            off[off < 0.1] = 0
            self.weight = 1 / (1 + off.sum(1)) if turn < 3 else self.weight
        self.accuracy = self.table

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        k = votes.astype(int) + 1
        v = np.arange(votes.shape[1])
        score = [np.log(self.prior[c]) + (np.log(self.table[c][v, k]) * self.weight).sum(1) for c in range(2)]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the first weight is the intercept, which isn't shrunk."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> DataFrame:  # noqa: ANN001
    """docs (doc_id, text), labels (doc_id, toxic 0/1) to (doc_id, score), a row for each row.

    train: a boolean column over doc_id; labels and votes of other rows teach nothing. Null and empty texts are scored as
    texts in which no voter finds anything. Without usable labels the voters alone teach; with no training row the score is
    a half where a listed word occurs and 0.1 elsewhere. Rows that repeat are scored each; other columns are ignored.
    """
    known = labels.filter("toxic in (0, 1)").filter(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most `sample` rows, whatever the input
    some = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    induced = induce(docs, known)
    made = cut(features(docs, induced))
    nv = len(VOTERS)
    learned = made.filter(train).join(known, "doc_id", "left")
    votes = F.transform(F.slice("x", 1, nv), lambda v: v.cast("tinyint"))
    patterns = learned.select(votes.alias("v"), F.coalesce(2 * F.col("toxic") - 1, F.lit(0)).cast("tinyint").alias("label")).groupBy("v", "label").count().collect()
    if not patterns:
        return made.select("doc_id", F.when(F.get("x", nv) > 0, 0.5).otherwise(0.1).alias("score"))
    v = np.array([[*p["v"], p["label"]] for p in patterns], float)
    count = np.array([p["count"] for p in patterns], float)
    toxic_votes = (v[:, :-1] > 0).sum(1)
    model = LabelModel(v, count, np.clip(0.05 + 0.4 * (toxic_votes > 0) + 0.3 * (toxic_votes > 1) + 0.2 * v[:, -1], 0.02, 0.98))
    rows = learned.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").select("x", F.coalesce(2 * F.col("toxic") - 1, F.lit(0)).alias("label"))
    rows = rows.orderBy(F.xxhash64("x", "label")).limit(sample).collect()
    if rows:
        x = np.array([r["x"] for r in rows], float)
        y = model.posterior(np.concatenate([x[:, :nv], np.array([[r["label"]] for r in rows], float)], 1))
    else:  # no labels: every pattern counts by its rows
        x = np.concatenate([v[:, :-1], np.zeros((len(v), len(COUNTS)))], 1)
        y = model.posterior(v)
    w = fit_linear(x, y)
    if rows and (r01 := np.array([r["label"] for r in rows])).min() < 0 < r01.max():
        # the score on the scale of the labels: slope and intercept over the labelled rows of the sample
        z = w[0] + x @ w[1:]
        at = fit_linear(z[r01 != 0, None], (r01[r01 != 0] > 0).astype(float), ridge=1e-2)
        if at[1] > 0:
            w = w * at[1]
            w[0] += at[0]
    total = F.lit(float(w[0]))
    for i, c in enumerate(w[1:]):
        total = total + F.get("x", i) * float(c)
    return made.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_fold(F.col("doc_id"), 5) == 0
    got = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
