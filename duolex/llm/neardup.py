"""One row of each group of near duplicates, by the Jaccard similarity of shingle sets.

Two sources of candidates, each verified on the shingles themselves:

1. SimHash: a fingerprint of each text's distinct words, indexed by deletion variants (`simhash.links`). A changed word moves one
   of the words but five of the five-word shingles, so fingerprints of words find most pairs. Their verified links make the
   first components; what they miss or leave out is taken up by 2.
2. A prefix filter, which misses none: two sets of similarity s share one of the first n - s n + 1 shingles of each in any fixed
   order. A sample of texts sets the order, frequent shingles last; it only changes the cost. Sets that share such a shingle
   meet in a run. Pairs that are in one component by then are decided; all others are looked at.

Before a pair is verified, sizes and parities of both sets (three bits or more for each shingle) rule out nearly all that aren't
similar. In a long run, as large families of copies make, rows propose their nearest partners first; most of a family is then
one component, and what is left to look at is little. Only runs of up to SMALL sets give all pairs that sizes allow.
Verification works the shingles out again from packed texts, which are smaller than the hashes of their shingles, and only of
texts that have a candidate left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, cut, cut_lean, few, fresh, row_tag, slim, sorted_runs, tidied
from .graph import components
from .simhash import links, shingle_hashes, signed, simhash

#: Bits by which fingerprints of linked candidates differ at most.
BITS = 5
#: Texts looked at for frequent shingles; how many of these come last in a prefix.
SAMPLE, FREQUENT = 20_000, 100_000
#: Forests of a long run of fingerprints; rows of a run of shingles that are paired directly; partners that a row of a longer run
#: proposes before all that are left are looked at; bytes of parities at most.
TREES, SMALL, BEST, PARITIES = 3, 16, 2, 8192


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def parities(s: np.ndarray) -> bytes:
    """How many hashes fall on each of a power of two of places, modulo two, in bits; three places or more for each hash."""
    size = 64
    while size < 3 * len(s) and size < 8 * PARITIES:
        size *= 2
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(m: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities over as few places as `width` bytes have."""
    while m.shape[-1] > width:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def apart(x: bytes, y: bytes) -> int:
    """Places at which parities differ: never more than the shingles that just one of the sets has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def close_in_run(n: np.ndarray, root: np.ndarray, par: list[bytes], least: float, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows of a run with different roots that sizes and parities don't rule out; best: just the nearest of each row.

    Rows of the run's commonest root aren't compared with each other.
    """
    roots, count = np.unique(root, return_counts=True)
    main = root == roots[count.argmax()]
    width = np.array(list(map(len, par)))
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    table = {w: np.frombuffer(b"".join([par[i] for i in at]), np.uint64).reshape(len(at), -1) for w, at in rows.items()}
    share, found = (1 - least) / (1 + least), []
    for i in np.flatnonzero(~main):
        for w, at in rows.items():
            j = np.flatnonzero((root[at] != root[i]) & (main[at] | (at > i)) & (np.minimum(n[at], n[i]) >= least * np.maximum(n[at], n[i]) - 1e-6))
            if len(j):
                own, other = np.frombuffer(par[i], np.uint64), table[w][j]
                short = min(len(own), other.shape[1])
                x = np.bitwise_count(folded(other, short) ^ folded(own, short)).sum(axis=1, dtype=np.int64)
                both = n[at[j]] + n[i]
                ok = x <= both * share + 1e-6
                found.append(np.stack((np.full(ok.sum(), i), at[j[ok]], (x[ok] << 20) // both[ok]), 1))
    m = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if best is not None and len(m):
        keep = np.zeros(len(m), bool)
        for side in (0, 1):  # the first `best` of each row in order of distance
            order = np.lexsort((m[:, 2], m[:, side]))
            first = np.flatnonzero(np.diff(m[order, side], prepend=-1))
            rank = np.arange(len(m)) - np.repeat(first, np.diff(np.append(first, len(m))))
            keep[order[rank < best]] = True
        m = m[keep]
    return m[:, 0], m[:, 1]


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat among about SAMPLE texts, ascending, and their ranks from the rarest. They only set an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, n = np.unique(np.concatenate([shingle_set(t.as_py(), words) for t in b.column(0)] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    texts = docs.select(body("text").alias("t"))
    part = texts.filter(F.pmod(F.xxhash64("t"), F.lit(max(1, docs.count() // SAMPLE))) == 0).distinct()
    got = part.mapInArrow(tidied(run), "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "g").limit(FREQUENT).collect()
    g = np.array([r.g for r in got], np.int64).view(np.uint64)
    order = np.argsort(g)
    return g[order], len(g) - np.arange(len(g))[order]


def node_of(s: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(s.tobytes(), 7))


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """(key, tag, text) to (key, tag, node, n, fp, par) for each row.

    node: 64-bit hash of the set of shingles; n: its size; fp: SimHash of the distinct words; par: the parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for t in b.column(2):
                s = shingle_set(t.as_py(), words)
                for column, x in zip(out, (node_of(s), len(s), signed(simhash(shingle_set(t.as_py(), 1))), parities(s)), strict=True):
                    column.append(x)
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["key", "tag", "node", "n", "fp", "par"])

    return rows.select(F.col("key").cast("bigint"), "tag", "t").mapInArrow(tidied(run), "key bigint, tag string, node bigint, n int, fp bigint, par binary")


def prefix_runs(rows: DataFrame, words: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows (t, root) to sets that share a shingle of their prefixes and have different roots (a null root is that of the set alone):
    pairs (null, a, b, null) of sizes that fit, or rows (k, node, null, n) of long runs.

    A task sends the prefix of a set once, however many of its rows have the set.
    """
    common, rank = frequent

    def prefix(s: np.ndarray) -> np.ndarray:
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            often = common[at] == s
            s = np.concatenate((s[~often], s[often][np.argsort(rank[at[often]])]))
        return s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, len(whole), 500):
                b = whole.slice(start, 500)
                columns: tuple[list, ...] = ([], [], [], [])
                for t, root in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    s = shingle_set(t.as_py(), words)
                    own = node_of(s)
                    if own not in seen:
                        seen.add(own)
                        p = prefix(s)
                        for c, x in zip(columns, (p.view(np.int64), *[np.full(len(p), x, np.int64) for x in (own, len(s), own if root is None else root)]), strict=True):
                            c.append(x)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["k", "node", "n", "root"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in sorted_runs(batches):
            m = m[np.lexsort((m[:, 1], m[:, 2], m[:, 0]))]
            m = m[np.concatenate(([True], (m[1:, :2] != m[:-1, :2]).any(axis=1)))]  # a set may come from several tasks
            k, node, n, root = m.T
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            size, mixed = np.repeat(sizes, sizes), np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), sizes)
            found = []
            for o in range(1, int(min(SMALL, sizes.max()))):
                i = np.flatnonzero((k[:-o] == k[o:]) & (root[:-o] != root[o:]) & (size[:-o] <= SMALL))
                i = i[n[i] >= least * n[i + o] - 1e-6]
                found.append(np.stack((np.minimum(node[i], node[i + o]), np.maximum(node[i], node[i + o])), 1))
            both = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            big = (size > SMALL) & mixed
            none = lambda count: pa.nulls(count, pa.int64())
            yield pa.RecordBatch.from_arrays([none(len(both)), pa.array(both[:, 0]), pa.array(both[:, 1]), none(len(both))], names=["k", "a", "b", "n"])
            if big.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[big]), pa.array(node[big]), none(int(big.sum())), pa.array(n[big])], names=["k", "a", "b", "n"])

    keyed = rows.select("t", "root").mapInArrow(tidied(first), "k bigint, node bigint, n bigint, root bigint")
    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(tidied(pairs), "k bigint, a bigint, b bigint, n bigint")


def sizes_fit(x: Column, y: Column, least: float) -> Column:
    return F.least(x, y) >= least * F.greatest(x, y) - 1e-6


def parities_fit(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, n, x, y), n the sizes' sum and x, y the parities, to the (a, b) that may be similar. Pairs are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - least) / (1 + least)
        for b in batches:
            keep = [apart(x.as_buffer(), y.as_buffer()) <= n * share + 1e-6 for n, x, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return pairs.select("a", "b", "n", "x", "y").mapInArrow(tidied(run), "a bigint, b bigint")


def fitting_in_runs(rows: DataFrame, least: float, best: int | None) -> DataFrame:
    """rows (k, node, n, root, par) of long runs to the distinct pairs (a, b) of `close_in_run`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches):
            node, n, root = (t.column(c).to_numpy() for c in ("node", "n", "root"))
            i, j = close_in_run(n, root, t.column("par").to_pylist(), least, best)
            a, b = node[i], node[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = rows.select("k", "node", F.col("n").cast("bigint").alias("n"), "root", "par").repartition("k").sortWithinPartitions("k", "node")
    return dealt.mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as a table for each run of equal `k` that has different roots."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.Table]:
        if held:
            t = pa.Table.from_batches(held)
            held.clear()
            if pa.compute.count_distinct(t.column("root")).as_py() > 1:
                yield t

    for b in batches:
        k = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if held and held[-1].column(0)[0].as_py() != int(k[i]):
                    yield from done()
                held.append(b.slice(i, j - i))
    yield from done()


def fitting(pairs: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out."""
    x = first.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("par").alias("x"))
    y = first.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("par").alias("y"))
    both = pairs.join(x, "a").join(y, "b").filter(sizes_fit(F.col("n1"), F.col("n2"), least))
    return parities_fit(both.withColumn("n", F.col("n1") + F.col("n2")), least)


def packed(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(node, p) of the tags in `of` (tag, node): the words of a text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            at = [i for i, x in enumerate(b.column(0).to_pylist()) if not (x in seen or seen.add(x))]
            out = [press.compress(b" ".join(b.column(1)[i].as_py().lower().split())) for i in at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], names=["node", "p"])

    texts = rows.select("tag", "t").join(few(of.select("tag", "node")), "tag").select("node", "t")
    return cut_lean(texts.mapInArrow(tidied(run), "node bigint, p binary").groupBy("node").agg(F.first("p").alias("p")))


def jaccard_links(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts, of (node, p), have a Jaccard similarity of `least` or more."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, last = zstandard.ZstdDecompressor(), {}

        def of(p: bytes) -> np.ndarray:
            if p not in last:
                if len(last) >= 32:
                    last.clear()
                last[p] = shingle_set(unpress.decompress(p), words)
            return last[p]

        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    x, y = texts.select(F.col("node").alias("a"), F.col("p").alias("x")), texts.select(F.col("node").alias("b"), F.col("p").alias("y"))
    return cut_lean(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(alike), "a bigint, b bigint"))


def similar(rows: DataFrame, light: DataFrame, first: DataFrame, words: int, least: float) -> DataFrame:
    """rows (tag, t), light (tag, node, ...) and first (node, tag, n, fp, par) to (node, root): the components of all pairs of
    similarity `least` or more."""
    nodes = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts_of = lambda pairs: packed(rows, first.select("node", "tag").join(nodes(pairs), "node", "left_semi"))
    linked = lambda pairs: slim(jaccard_links(pairs, texts_of(pairs), words, least))
    joined = lambda root, more: components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    root = components(linked(slim(cut(fitting(links(first.select(F.col("node").alias("id"), "fp"), BITS, TREES), first, least)))))
    of_row = few(light.join(few(root), "node").select("tag", "root").distinct())
    runs = cut_lean(prefix_runs(rows.join(of_row, "tag", "left"), words, least, frequent_shingles(rows.withColumnRenamed("t", "text"), words)))
    pairs = fitting(slim(cut(runs.filter("k is null").select("a", "b").distinct())), first, least)
    long = slim(cut(runs.filter("k is not null").select("k", F.col("a").alias("node"), "n").join(first.select("node", "par"), "node")))
    in_runs = lambda root, best: fitting_in_runs(long.join(few(root), "node", "left").withColumn("root", F.coalesce("root", "node")), least, best)
    pairs = slim(cut(pairs.unionByName(in_runs(root, BEST)).distinct()))
    root = root if pairs.isEmpty() else joined(root, linked(pairs))
    pairs = slim(cut(in_runs(root, None)))  # all that are still in two components
    return root if pairs.isEmpty() else joined(root, linked(pairs))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row of each group of near duplicates; the row with the smallest doc_id stays.

    Equal texts are one group. Different texts are linked if the Jaccard similarity of their sets of `words`-word shingles
    is `similarity` or more; no such pair is left out. Texts without a word are one group, like any equal shingle sets. Of
    rows that are equal in doc_id and text one stays. Rows with a null doc_id are compared like all others and stay only
    where no row of their group has an id, one for each group. Where different texts share a doc_id each is judged alone.
    An empty table gives an empty one. All columns of docs come back as they were, whatever they are called.
    """
    names, tag = docs.columns, fresh(docs, "row_tag")
    marked = docs.withColumn(tag, row_tag("doc_id", "text"))
    rows = marked.select(F.col("doc_id").alias("key"), F.col(tag).alias("tag"), body("text").alias("t"))
    light = cut_lean(signatures(rows, words))
    first = slim(cut(light.groupBy("node").agg(F.min("tag").alias("tag"), *[F.first(c).alias(c) for c in ("n", "fp", "par")])))
    root = similar(rows.select("tag", "t"), light, first, words, similarity)
    placed = light.select("key", "tag", "node").join(few(root), "node", "left")
    stay = placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tag")).alias("s")).select("s.tag")
    # texts stay where they are unless very much goes: what is sent are the tags of rows that go or that repeat
    counts = light.groupBy("tag").agg(F.count("*").alias("n"))
    drop = few(counts.join(stay, "tag", "left_anti").select(F.col("tag").alias(tag)))
    again = few(counts.filter("n > 1").join(stay, "tag", "left_semi").select(F.col("tag").alias(tag)))
    kept = marked.join(drop, tag, "left_anti")
    single = kept.join(again, tag, "left_anti")
    return single.unionByName(kept.join(again, tag, "left_semi").dropDuplicates([tag])).select(*names)
