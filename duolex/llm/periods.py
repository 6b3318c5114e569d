"""Periodic runs of words by harmonic grid probing.

A run of period p holds at least 2p words, so it holds two neighbours of the grid 0, p, 2p, ... and the words there are equal.
All words of a block of texts lie in one array of numbers, longest text first and a separator of its own after each, so that
the grid of period p has to cover the texts of 2p words or more only: n log n probes in all. Places that pass are extended to
both sides by comparing chunks of doubling size, as far as the neighbouring grid places, and stretches that meet are joined.

Periods are taken in blocks [p, 2p). Two runs of least periods q < p share fewer than p + q words. So a grid place that lies,
together with the next, at least q words inside a run found before is skipped, and a stretch that lies in such a run isn't one
of least period p. No period of a block divides another, so the runs of earlier blocks are all that matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import blocks
from .common import SPACES, body, fresh, table, tidied

#: Grid places probed at once, and words compared at once.
PROBES, CELLS = 1 << 20, 1 << 21
#: Low bits of a place's entry: the number of the run that reaches furthest of those that begin before it; the end is above.
SHIFT = 32
LOW = (1 << SHIFT) - 1


def reach(words: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, way: int, owner: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """How many words are equal from places left and right on in direction way, at most `most`, by chunks of doubling size.

    Where both places lie in runs of one period and a period's words have been found equal, all are up to an end of the runs.
    """
    got = np.zeros(len(left), np.int64)
    one, two = runs[owner[left] & LOW], runs[owner[right] & LOW]
    sure = np.minimum(one[:, 1] - left, two[:, 1] - right) if way > 0 else np.minimum(left - one[:, 0], right - two[:, 0]) + 1
    sure[(one[:, 2] != two[:, 2]) | (one[:, 1] <= left) | (two[:, 1] <= right)] = 0
    alive, chunk = np.arange(len(left)), 8
    while len(alive):
        go_on = []
        for part in np.array_split(alive, -(-len(alive) * chunk // CELLS)):
            step = got[part][:, None] + np.arange(chunk)
            inside = step < most[part][:, None]
            step = np.where(inside, step, 0) * way
            same = (words[left[part][:, None] + step] == words[right[part][:, None] + step]) & inside
            ended = ~same.all(1)
            got[part] += np.where(ended, same.argmin(1), chunk)
            part = part[~ended]
            jump = part[(got[part] >= one[part, 2]) & (got[part] < sure[part])]
            got[jump] = np.minimum(sure[jump], most[jump])
            go_on.append(part)
        alive, chunk = np.concatenate(go_on), min(2 * chunk, 1 << 16)
    return got


def runs_of(words: np.ndarray, lens: np.ndarray, shortest: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs. words: numbers >= 0, texts behind each other, longest first; lens: of each text.

    A run is a maximal stretch of a text with least period p and at least max(shortest, 2p) words.
    """
    texts = len(lens)
    ends = np.cumsum(lens + 1)
    flat = np.full(int(ends[-1]) if texts else 0, -1, np.int64)
    own = np.ones(len(flat), bool)
    own[ends - 1] = False
    flat[own] = words
    flat[ends - 1] = -1 - np.arange(texts)  # no two separators are equal
    owner, inside = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    found = np.zeros((1, 3), np.int64)  # the first is no run
    last = int(lens[0]) // 2 if texts else 0
    p = 1
    while p <= last:
        # periods p to q - 1, below 2p, of PROBES places in all or one period
        periods = np.arange(p, min(2 * p, last + 1))
        rows = np.searchsorted(-lens, -2 * periods, side="right")  # texts that are long enough
        span = ends[rows - 1]
        places = (span - 1) // periods
        q = max(1, int(np.searchsorted(np.cumsum(places), PROBES, side="right")))
        periods, places = periods[:q], places[:q]
        p += q
        # the grid; one period's places at a time where they are more than PROBES
        hits = []
        for a in range(0, int(places[0]), PROBES) if q == 1 else [None]:
            if a is None:
                per = np.repeat(periods, places)
                at = (np.arange(len(per)) - np.repeat(np.cumsum(places) - places, places)) * per
            else:
                at = np.arange(a, min(a + PROBES, int(places[0]))) * periods[0]
                per = np.full(len(at), periods[0])
            ok = flat[at] == flat[at + per]
            at, per = at[ok], per[ok]
            ok = inside[at] < at + per  # not within a run found before
            hits.append((at[ok], per[ok]))
        at, per = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(at):
            continue
        room = np.minimum(per, len(flat) - at - per)
        ahead = reach(flat, at, at + per, room, 1, owner, found)
        linked = np.zeros(len(at), bool)  # to the place before
        linked[1:] = (per[1:] == per[:-1]) & (at[1:] == at[:-1] + per[1:]) & (ahead[:-1] == per[:-1])
        heads = np.flatnonzero(~linked)
        tails = np.append(heads[1:], len(at)) - 1
        per, stop = per[heads], at[tails] + ahead[tails]
        # a stretch that is long enough even if the words before it are all equal
        need = np.maximum(per, shortest - per)
        ok = stop - at[heads] + per - 1 >= need
        heads, per, stop, need = heads[ok], per[ok], stop[ok], need[ok]
        behind = np.minimum(per, at[heads])
        start = at[heads] - (reach(flat, at[heads] - 1, at[heads] + per - 1, behind, -1, owner, found) if len(heads) else 0)
        ok = stop - start >= need
        start, stop, per = start[ok], stop[ok] + per[ok], per[ok]
        ok = owner[start] >> SHIFT < stop  # else a multiple of a run's period
        if not ok.any():
            continue
        new = np.unique(np.stack([start[ok], stop[ok], per[ok]], 1), axis=0)
        start, stop, per = new.T
        np.maximum.at(owner, start, stop << SHIFT | np.arange(len(found), len(found) + len(new)))
        np.maximum.at(inside, start + per - 1, stop - per)
        owner, inside = np.maximum.accumulate(owner), np.maximum.accumulate(inside)
        found = np.concatenate((found, new))
    return found[1:]


def text_runs(texts: list[bytes], shortest: int = 12) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words of each text and its runs (start, length, period), by start, then period."""
    split = [t.split() for t in texts]  # bytes are split at the six ASCII white space characters
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for i in order for w in split[i]], np.int64)
    lens = np.array([len(split[i]) for i in order], np.int64)
    out: list = [(w, []) for w in split]
    got = runs_of(flat, lens, shortest)
    if len(got):
        begins = np.cumsum(lens + 1) - lens - 1
        got = got[np.lexsort((got[:, 2], got[:, 0]))]
        of = np.searchsorted(begins, got[:, 0], side="right") - 1
        for k, s, e, p in zip(of.tolist(), (got[:, 0] - begins[of]).tolist(), (got[:, 1] - begins[of]).tolist(), got[:, 2].tolist(), strict=True):
            out[order[k]][1].append((s, e - s, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, p in runs:
        keep[s + p : s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", shortest: int = 12) -> DataFrame:
    """docs with the periodic runs of `text` and the text without their repetitions, a row for a row, without a shuffle.

    `runs` is array<struct<start, length, period: bigint>> by start, then period: maximal stretches of words that repeat with
    least period `period` and have at least max(shortest, 2 * period) words. `collapsed` is the words joined by one space,
    without those that a run holds after its first `period` words. Words are parted by ASCII white space. Null, empty and
    blank texts have no runs and collapse to the empty text. Whole texts of any length are searched, rows that repeat alike.
    All columns of docs stay; those named like a new one are replaced.
    """
    keep = [c for c in docs.columns if c not in (runs, collapsed)]
    own = fresh(docs, "__text")
    source = docs.select(*keep, body(text).alias(own))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [*keep, runs, collapsed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in blocks(batches, len(keep)):
            got = text_runs(b.column(len(keep)).to_pylist(), shortest)
            found = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in got], kind)
            rest = pa.array([collapse(w, r) for w, r in got], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], found, rest], names=names)

    schema = ", ".join([*[f"`{n}` {t}" for n, t in docs.select(*keep).dtypes], f"`{runs}` array<struct<start: bigint, length: bigint, period: bigint>>", f"`{collapsed}` string"])
    return source.mapInArrow(tidied(run), schema)


def tailed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail where h = crc32(doc_id) ends in 0, as the query's contract has it.

    With g = floor(h / 10) and n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", f"{SPACES}+"), lambda w: w != "")
    rows = docs.withColumn("h", h).withColumn("g", F.expr("h div 10")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("w").cast("bigint")).withColumn("a", F.expr("if(n > 0, g % n, 0L)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(w, cast(1 + if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find(tailed(docs))
    best = F.expr("array_sort(runs, (x, y) -> case when x.length != y.length then if(x.length > y.length, -1, 1) when x.start != y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, 1) end)[0]")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return got.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periods": op11_periods}
ORACLES: dict[str, str] = {}
