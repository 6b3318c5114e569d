"""Word alignment: questions, a pluggable scorer, snapping to tokens, symmetry and simplification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.analyzers import analyzed

MARK, THRESHOLD, BATCH = " ¶ ", 0.1, 32
#: (question, context) pairs to (score, start, end) of the answer in the context.
Scorer = Callable[[list[tuple[str, str]]], list[tuple[float, int, int]]]


def questions(text: Column, tokens: Column) -> Column:
    """For each token the text with the token between marks."""
    return F.transform(tokens, lambda t: F.concat(spans.between(text, F.lit(0), t["start"]), F.lit(MARK), spans.between(text, t["start"], t["end"]), F.lit(MARK), spans.between(text, t["end"], F.length(text))))


def predicted(rows: DataFrame, scorer: Scorer, batch: int = BATCH) -> DataFrame:
    """rows (id, n, question, context) with score, start and end, in batches for the scorer. A batch that comes back with
    another number of answers is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got: list[tuple[float, int, int]] = []
            for i in range(0, len(p), batch):
                ask = list(zip(p.question[i : i + batch], p.context[i : i + batch], strict=True))
                answers = scorer(ask)
                answers = [answers] if isinstance(answers, tuple) else answers
                if len(answers) != len(ask):
                    raise ValueError("the scorer gave another number of answers")
                got += answers
            yield p[["id", "n"]].assign(score=[float(g[0]) for g in got], start=[int(g[1]) for g in got], end=[int(g[2]) for g in got])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(run, f"id {kind}, n int, score double, start int, end int")


def one_way(pairs: DataFrame, scorer: Scorer, source: str, target: str) -> DataFrame:
    """pairs (id, {source}, {target}, {source}_tokens, {target}_tokens) to (id, alignments) from source to target."""
    asked = pairs.select("id", F.posexplode(questions(F.col(source), F.col(f"{source}_tokens"))).alias("n", "question"), F.col(target).alias("context"))
    good = predicted(asked.select("id", F.col("n").cast("int").alias("n"), "question", "context"), scorer).filter(F.col("score") >= THRESHOLD)
    both = good.join(pairs.select("id", f"{source}_tokens", f"{target}_tokens"), "id")
    hit = both.select("id", F.col(f"{source}_tokens")[F.col("n")].alias("s"), F.explode(spans.snapped(F.col("start"), F.col("end"), F.col(f"{target}_tokens"))).alias("t"))
    a = F.struct(F.col("s.start").alias("from_start"), F.col("s.end").alias("from_end"), F.col("t.start").alias("to_start"), F.col("t.end").alias("to_end"))
    return hit.groupBy("id").agg(F.array_sort(F.collect_list(a)).alias("alignments"))


def align_symmetric(pairs: DataFrame, scorer: Scorer, simplify: bool = True) -> DataFrame:
    """pairs (id, en, ja) to (id, alignment_data): forward, and reverse turned round, together and simplified."""
    t = pairs.select("id", "en", "ja", analyzed(F.col("en"), "english_words").alias("en_tokens"), analyzed(F.col("ja"), "japanese_words").alias("ja_tokens"))
    there = one_way(t, scorer, "en", "ja")
    back = one_way(t, scorer, "ja", "en").select("id", spans.reversed_alignments(F.col("alignments")).alias("alignments"))
    every = there.unionByName(back).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("alignments")))).alias("a"))
    out = pairs.select("id", "en", "ja").join(every, "id", "left").withColumn("a", F.coalesce("a", F.array().cast(spans.ALIGNMENTS)))
    return out.select("id", (spans.simplified(F.col("a"), F.col("en"), F.col("ja")) if simplify else F.col("a")).alias("alignment_data"))


def same_place(ask: list[tuple[str, str]]) -> list[tuple[float, int, int]]:
    """A scorer without a model, for tests and as a default: the answer lies where the marked token lies, in proportion."""
    out = []
    for q, c in ask:
        a, rest = q.index(MARK), q.rindex(MARK) - len(MARK)
        n = max(len(q) - 2 * len(MARK), 1)
        out.append((1.0, a * len(c) // n, max(a * len(c) // n + 1, rest * len(c) // n)))
    return out
