"""Word alignment learned from sentence pairs: IBM Model 1, then an HMM over jumps, by EM as joins with a sparse table.

The table (source, target, p) has a row for each two words that stand in one pair. A round joins it to the links of the pairs,
gathers each pair's small matrix (both sides are quotes of at most about a hundred words; the matrix has their product), runs
forward and backward over it, and sums expected counts by words and by jump. Equal pairs are one row with a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.analyzers import analyzed
from ..session import cut, partitions
from .align import THRESHOLD

#: Jumps beyond count as this far; a pair of words that training didn't see; the word of Model 1 that stands for none.
FAR, UNSEEN, NOTHING = 6, 1e-9, ""


@dataclass
class Lexicon:
    """p(target | source) as a table, and how likely a jump of each width is."""

    table: DataFrame
    jumps: dict[int, float]


def uniform_jumps() -> dict[int, float]:
    return dict.fromkeys(range(-FAR, FAR + 1), 1.0)


def jump_matrix(jumps: dict[int, float], n: int) -> np.ndarray:
    """p(to | from) between n places."""
    d = np.clip(np.arange(n)[None, :] - np.arange(n)[:, None], -FAR, FAR)
    w = np.vectorize(jumps.__getitem__, otypes=[float])(d) if n else np.zeros((0, 0))
    return w / w.sum(1, keepdims=True)


def posteriors(p: np.ndarray, jumps: dict[int, float] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """p(target j | source i) as a matrix (j, i) to the probability that j comes from i, and the expected jumps (from, to).

    Without jumps every place is as likely: Model 1.
    """
    if jumps is None:
        return p / p.sum(1, keepdims=True), None
    m, n = p.shape
    step = jump_matrix(jumps, n)
    ahead, scale = np.zeros((m, n)), np.zeros(m)
    for j in range(m):
        ahead[j] = p[j] * (1 / n if j == 0 else ahead[j - 1] @ step)
        scale[j] = ahead[j].sum()
        ahead[j] /= scale[j]
    behind = np.ones((m, n))
    for j in range(m - 2, -1, -1):
        behind[j] = step @ (p[j + 1] * behind[j + 1]) / scale[j + 1]
    moves = np.zeros((n, n))
    for j in range(1, m):
        moves += ahead[j - 1][:, None] * step * (p[j] * behind[j])[None, :] / scale[j]
    return ahead * behind, moves


def matrices(pairs: DataFrame, table: DataFrame | None, nothing: bool) -> DataFrame:
    """pairs (id, n, source, target) with p: the table's values by target place, then source place."""
    source = F.concat(F.array(F.lit(NOTHING)), F.col("source")) if nothing else F.col("source")
    rows = pairs.withColumn("source", source)
    if table is None:
        return rows.withColumn("p", F.array_repeat(F.lit(1.0), F.size("source") * F.size("target")))
    links = rows.select("id", F.posexplode("target").alias("j", "target"), "source").select("id", "j", "target", F.posexplode("source").alias("i", "source"))
    known = links.join(table, ["source", "target"], "left").withColumn("p", F.coalesce("p", F.lit(UNSEEN)))
    got = known.repartition(partitions(pairs), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", "i", "p"))).alias("m"))
    return rows.join(got, "id").withColumn("p", F.transform("m", lambda x: x["p"])).drop("m")


def _sums(rows: DataFrame, jumps: dict[int, float] | None) -> DataFrame:
    """(source, target, jump, x): expected counts of word pairs (jump null) and of jumps (words null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter = Counter()
            for n, s, t, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                got, moves = posteriors(np.array(p).reshape(len(t), len(s)), jumps)
                for w, r in zip(t, got, strict=True):
                    for e, x in zip(s, r.tolist(), strict=True):
                        held[e, w, None] += n * x
                if moves is not None:
                    for d in range(-len(s) + 1, len(s)):
                        held[None, None, max(-FAR, min(FAR, d))] += n * float(np.trace(moves, d))
            keys = list(held)
            yield pa.RecordBatch.from_pydict({"source": pa.array([k[0] for k in keys], pa.string()), "target": pa.array([k[1] for k in keys], pa.string()), "jump": pa.array([k[2] for k in keys], pa.int32()), "x": pa.array([held[k] for k in keys], pa.float64())})

    got = rows.select("n", "source", "target", "p").mapInArrow(run, "source string, target string, jump int, x double")
    return cut(got.groupBy("source", "target", "jump").agg(F.sum("x").alias("x")))


def _shares(sums: DataFrame) -> DataFrame:
    """p(target | source) from expected counts; the word for none is left out by the caller."""
    words = sums.filter("source is not null").select("source", "target", "x")
    whole = words.groupBy("source").agg(F.sum("x").alias("t"))
    return words.join(whole, "source").select("source", "target", (F.col("x") / F.col("t")).alias("p"))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(id, n, source, target): pairs with words on both sides, equal ones once."""
    some = pairs.filter((F.size("source") > 0) & (F.size("target") > 0))
    return cut(some.groupBy("source", "target").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()).select("id", "n", "source", "target"))


def train(pairs: DataFrame, simple: int = 4, jumping: int = 3) -> Lexicon:
    """pairs (source, target: arrays of words) to a lexicon: `simple` rounds of Model 1, then `jumping` rounds of the HMM.

    Pairs without words on a side, null ones included, teach nothing. The lineage is cut each round.
    """
    rows = distinct_pairs(pairs)
    table, jumps = None, uniform_jumps()
    for _ in range(simple):
        table = _shares(_sums(matrices(rows, table, nothing=True), None))
    table = None if table is None else table.filter(F.col("source") != NOTHING)
    for _ in range(jumping):
        sums = _sums(matrices(rows, table, nothing=False), jumps)
        table = _shares(sums)
        moved = {r.jump: r.x for r in sums.filter("jump is not null").select("jump", "x").collect()}  # 2 FAR + 1 rows
        jumps = {d: max(moved.get(d, 0.0), 1e-9) for d in jumps}
    return Lexicon(table, jumps)


def linked(pairs: DataFrame, lexicon: Lexicon, least: float = THRESHOLD) -> DataFrame:
    """(id, i, j, score) of pairs (id, source, target): target word j comes from source word i with probability `least` or more."""
    rows = matrices(pairs.filter((F.size("source") > 0) & (F.size("target") > 0)).select("id", F.lit(1).alias("n"), "source", "target"), lexicon.table, nothing=False)
    jumps, kind = lexicon.jumps, dict(pairs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, i, j, score = [], [], [], []
            for k, (s, t, p) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                got = posteriors(np.array(p).reshape(len(t), len(s)), jumps)[0]
                y, x = np.nonzero(got >= least)
                at += [k] * len(x)
                i += x.tolist()
                j += y.tolist()
                score += got[y, x].tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(score, pa.float64())], names=["id", "i", "j", "score"])

    return rows.select("id", "source", "target", "p").mapInArrow(run, f"id {kind}, i int, j int, score double")


def terms(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t["term"]))


def aligned(pairs: DataFrame, simplify: bool = True, en_tokens: Column | None = None, ja_tokens: Column | None = None, simple: int = 4, jumping: int = 3) -> DataFrame:
    """pairs (id, en, ja) to (id, alignment_data), by lexicons trained on these pairs in both directions.

    Links of one direction and the other, turned round, are taken together and simplified. A pair without words on a side has
    none. Word places become places of the texts; tokens are those of the usual analyzers unless given.
    """
    en = analyzed(F.col("en"), "english_words") if en_tokens is None else en_tokens
    ja = analyzed(F.col("ja"), "japanese_words") if ja_tokens is None else ja_tokens
    rows = cut(pairs.select("id", "en", "ja", en.alias("s"), ja.alias("t")))
    there = rows.select("id", terms(F.col("s")).alias("source"), terms(F.col("t")).alias("target"))
    back = rows.select("id", terms(F.col("t")).alias("source"), terms(F.col("s")).alias("target"))
    with ThreadPoolExecutor(2) as both:  # the rounds of one direction fill the gaps of the other
        one, two = both.map(lambda d: linked(d, train(d, simple, jumping)), (there, back))
    one, two = one.select("id", "i", "j"), two.select("id", F.col("j").alias("i"), F.col("i").alias("j"))
    links = one.unionByName(two).groupBy("id").agg(F.collect_set(F.struct("i", "j")).alias("l"))
    place = lambda x: F.struct(F.col("s")[x["i"]]["start"].alias("from_start"), F.col("s")[x["i"]]["end"].alias("from_end"), F.col("t")[x["j"]]["start"].alias("to_start"), F.col("t")[x["j"]]["end"].alias("to_end"))
    got = rows.join(links, "id", "left").withColumn("a", F.coalesce(F.array_sort(F.transform("l", place)), F.array().cast(spans.ALIGNMENTS)))
    return got.select("id", (spans.simplified(F.col("a"), F.col("en"), F.col("ja")) if simplify else F.col("a")).alias("alignment_data"))
