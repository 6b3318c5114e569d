"""Benchmark decontamination: rare n-gram seeds joined to documents, then Smith-Waterman alignment.

Documents' n-grams are joined with those of the items, by equality of hashes; what joins is counted, so each gram of an item has
its frequency in the corpus. Of every STRETCH grams of an item that occur, the RAREST ones (all that are as rare as the last)
are its seeds: stop phrases go, yet any part of an item, however much that part leaked, keeps seeds. The places of seeds in a
document, gathered by document and item, are joined to the texts, and the item is aligned with the words around them, unless
the words that both have, counted without their order, can't reach the score. An alignment that scores `share` of a perfect
one or more is a link, so copies with replaced, added or dropped words are found and chance n-grams aren't. Documents are read
twice, however many items there are: for their grams, and those that hold seeds for their words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import memo
from .common import cut, few, fresh, row_tag, table, tidied

#: Words of a seed; neighbouring grams of an item of which the rarest ones are seeds; scores of equal words, of unequal ones and of a gap.
SEED, STRETCH, RAREST, EQUAL, UNEQUAL, GAP = 3, 6, 4, 2, -1, -1
#: Share of a perfect score, and equal words at least, of a link.
SHARE, LEAST_WORDS = 0.4, 8
#: Rows of an alignment between two that are kept.
KEPT = 256
#: ASCII letters to lower case; everything else in ASCII but digits separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def align(item: tuple, text: tuple) -> tuple[int, int, int, int]:
    """(score, equal words, begin, end) of the best local alignment of two word sequences; begin and end are places in text.

    The recurrence runs over the words of text; along the item it is a running maximum. Of equal scores the first end wins.
    Every KEPT-th row is kept; on the way back the rows between two of them are worked out again, so memory is that of a few
    hundred rows however long both are.
    """
    number: dict = {}
    a = np.array([number.setdefault(w, len(number)) for w in item])
    b = [number.get(w, -1) for w in text]
    n = len(a)
    slope = (-GAP * np.arange(n + 1)).astype(np.int32)

    def after(above: np.ndarray, w: int) -> np.ndarray:
        row = np.zeros(n + 1, np.int32)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(a == w, EQUAL, UNEQUAL), above[1:] + GAP), 0)
        return np.maximum.accumulate(row + slope) - slope

    row = np.zeros(n + 1, np.int32)
    kept, score, i, j = [row], 0, 0, 0
    for k, w in enumerate(b, 1):
        row = after(row, w)
        if (top := int(row.max())) > score:
            score, i, j = top, k, int(row.argmax())
        if k % KEPT == 0:
            kept.append(row)
    end, equal, rows, first = i, 0, [kept[0]], 0
    while True:
        if i and not first <= i - 1 < i < first + len(rows):
            first = (i - 1) // KEPT * KEPT
            rows = [kept[first // KEPT]]
            for w in b[first : min(first + KEPT, len(b))]:
                rows.append(after(rows[-1], w))
        here = rows[i - first]
        if here[j] <= 0:
            return score, int(equal), i, end
        above = rows[i - 1 - first]
        if here[j] == above[j - 1] + (EQUAL if a[j - 1] == b[i - 1] else UNEQUAL):
            i, j, equal = i - 1, j - 1, equal + (a[j - 1] == b[i - 1])
        elif here[j] == above[j] + GAP:
            i -= 1
        else:
            j -= 1


@memo(2_000)
def _remembered(item: tuple, text: tuple) -> tuple[int, int, int, int]:
    return align(item, text)


def _aligned(item: tuple, text: tuple) -> tuple[int, int, int, int]:
    if len(item) == len(text) and item == text:
        return EQUAL * len(item), len(item), 0, len(text)
    return _remembered(item, text) if len(text) <= 500 else align(item, text)


def windows(hits: list[tuple[int, int, int]], size: int, n_words: int) -> list[tuple[int, int]]:
    """Stretches of a text around hits (place in the text, first and last place in an item of `size` words), merged where they meet."""
    slack = size // 2 + 2
    out: list[list[int]] = []
    for a, b in sorted((max(0, at - high - slack), min(n_words, at - low + size + slack)) for at, low, high in hits):
        if out and a <= out[-1][1] and b - out[-1][0] <= 4 * size + 64:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shared(item: Counter, text: list[bytes]) -> int:
    """Words that an item and a text both have, each as often as both have it: no alignment has more equal words."""
    there = Counter(filter(item.__contains__, text))
    return sum(min(n, item[w]) for w, n in there.items())


def words_column(text: Column) -> Column:
    """`words_of` for a column, but for letters beyond ASCII, which are put in lower case too: grams by it are a few more, not fewer."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7F]+"), "")


def exploded_grams(rows: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """rows (keys, words) to (keys, at, gram): the hash of every run of each of the sizes, and where it begins."""
    parts = []
    for n in sizes:
        every = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.xxhash64(F.lit(n), *[F.element_at("words", i + k) for k in range(n)]))  # noqa: B023
        parts.append(rows.filter(F.size("words") >= n).select(*keys, F.posexplode(every).alias("at", "gram")))
    return reduce(DataFrame.unionByName, parts)


def seeds_of(grams: DataFrame, hits: DataFrame) -> DataFrame:
    """(gram, item, low, high): the rarest grams of each stretch of an item that occur at all, and their first and last place in it."""
    seen = grams.join(hits.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rank = F.rank().over(Window.partitionBy("item", F.floor(F.col("at") / STRETCH)).orderBy("n"))
    kept = seen.withColumn("r", rank).filter(F.col("r") <= RAREST)
    return kept.groupBy("gram", "item").agg(F.min("at").alias("low"), F.max("at").alias("high"))


def links(docs: DataFrame, items: DataFrame, share: float = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) to (doc_id, item_id, score, identity, begin, end), distinct.

    score: the best alignment's share of a perfect score; identity: its equal words as a share of the item's; begin, end: its
    words in the document. Items of fewer words than `least` are links only where they occur word for word. Words are
    ASCII-lower-cased and split at all other ASCII than letters and digits. Null and blank documents and items have no
    link. Rows that repeat give one link. Other columns are ignored.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, score double, identity double, begin bigint, end bigint"
    clean_text = F.coalesce(F.col("text"), F.lit(""))
    known = cut(items.select("item_id", clean_text.alias("own")).distinct().withColumn("words", words_column(F.col("own"))).filter(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in known.select(F.least(F.size("words"), F.lit(SEED))).distinct().collect())  # three at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    short = F.size("words") < SEED
    grams = cut(reduce(DataFrame.unionByName, [exploded_grams(known.filter(F.size("words") == n if n < SEED else ~short), [n], "item") for n in sizes]))
    rows = docs.select("doc_id", clean_text.alias("t")).withColumn("tag", row_tag("doc_id", "t"))
    every = exploded_grams(rows.select("tag", words_column(F.col("t")).alias("words")), sizes, "tag")
    hits = cut(every.join(few(grams.select("gram").distinct()), "gram"))
    places = hits.join(few(seeds_of(grams, hits)), "gram").distinct()
    pairs = places.groupBy("tag", "item").agg(F.collect_list(F.struct("at", "low", "high")).alias("hits"))
    asked = cut(pairs.join(known, "item").groupBy("tag").agg(F.collect_list(F.struct("item_id", "own", "hits")).alias("asked")))
    # texts without seeds go before any move, where the tags of the others may be broadcast
    found = rows.join(few(asked.select("tag")), "tag", "left_semi").join(asked, "tag").select("doc_id", F.col("t").cast("binary").alias("t"), "asked")
    return found.mapInArrow(tidied(_aligner(share, least)), schema).distinct()


def _aligner(share: float, least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, t, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                w = words_of(t.as_py())
                for ask in asked.as_py():
                    item = words_of(ask["own"].encode())
                    count, best, top = Counter(item), None, EQUAL * len(item)
                    for a, b in windows([(h["at"], h["low"], h["high"]) for h in ask["hits"]], len(item), len(w)):
                        if EQUAL * shared(count, w[a:b]) < share * top:
                            continue
                        score, equal, i, j = _aligned(tuple(item), tuple(w[a:b]))
                        if best is None or score > best[0]:
                            best = (score, equal, a + i, a + j)
                    if best is not None and best[0] >= share * top and best[1] >= min(least, len(item)):
                        out.append((doc, ask["item_id"], best[0] / top, best[1] / len(item), best[2], best[3]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (batch.schema.field(0).type, None, pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if t is not None else pa.array(c, pa.int64() if not c else None) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "score", "identity", "begin", "end"])

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, with all its columns, without the rows that are linked to an item. Each row is judged by its own text, whatever its doc_id."""
    tag = fresh(docs, "row_tag")
    marked = docs.withColumn(tag, row_tag("doc_id", "text"))
    own = marked.select(F.col(tag).alias("doc_id"), "text")
    bad = few(links(own, items).select(F.col("doc_id").alias(tag)).distinct())
    return marked.join(bad, tag, "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES: dict[str, str] = {}
