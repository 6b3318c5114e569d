"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into m segments, m the least with bits <= 2m - 1: if two fingerprints differ in at most
`bits` bits, one of their segments differs in at most one. Every segment is indexed once for each of its positions with that
position blanked (64 keys for a fingerprint), so segments at distance one or none share a key. Rows with equal keys meet in
one sorted run; each pair is verified on the whole fingerprint, and taken up under one of the keys that it shares. Runs of up to
SMALL rows give all their verified pairs. Longer runs, as large families of near copies make, give a spanning forest of the
verified links instead: it has the same components and at most a few edges a row. Runs of over LONG rows are cut once more, by
pieces of the other bits of which a linked pair has one in common. Nothing is capped or dropped.

`neardup` uses these links as the candidates of its Jaccard links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, cut, cut_lean, sorted_runs, table, tidied
from .graph import components

#: Rows of a run that are paired directly, and rows from which a run is cut once more.
SMALL, LONG = 16, 2048


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the space-joined windows of lower-cased words; fewer words: of all of them; none: no hash."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hash: zero. Worked in blocks, so long texts need no more memory."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp bigint) of every text of column `text`; null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [signed(simhash(shingle_hashes(t.as_py(), words))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body("text").alias("t")).mapInArrow(tidied(run), "doc_id bigint, fp bigint")


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the least number of segments of which one differs by a bit at most."""
    m = (bits + 2) // 2
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fp, bits: int):
    """The 64 keys of a fingerprint: segment with one position blanked, under the number of that position."""
    out = []
    for shift, width in segments(bits):
        part = F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)
        for i in range(width):
            out.append(part.bitwiseAND(((1 << width) - 1) ^ (1 << i)).bitwiseOR(F.lit((shift + i) << 32)))
    return F.array(*out)


def home(x: np.ndarray, bits: int) -> np.ndarray:
    """The one position under which a pair with the differences x is taken up, of all those under which it shares a key.

    In the first segment with one difference at most: that of the difference, or else the segment's first.
    """
    at = np.full(x.shape, 255, np.uint8)
    for shift, width in reversed(segments(bits)):
        part = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        one = np.log2(np.maximum(part, np.uint64(1)).astype(float)).astype(np.uint8)
        at = np.where(np.bitwise_count(part) <= 1, shift + one, at)
    return at


def close(x: np.ndarray, bits: int, position: int) -> np.ndarray:
    """Which differences are a link that is taken up at the position."""
    near = np.bitwise_count(x) <= bits
    near[near] = home(x[near], bits) == position
    return near


def spanning(f: np.ndarray, bits: int, position: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from, to) of a spanning forest of the links among f."""
    left, a, b = np.arange(len(f)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = close(f[left] ^ f[at], bits, position)
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                front.extend(hit.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(f: np.ndarray, bits: int, position: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from, to) of edges with the components of all links among f, which share the key of the position.

    Of bits + 1 pieces of the bits outside the key's segment, a linked pair has one in common; in each piece only rows with
    the same value are compared.
    """
    if len(f) <= LONG:
        return spanning(f, bits, position)
    shift, width = next((s, w) for s, w in segments(bits) if s <= position < s + w)
    rest = [i for i in range(64) if not shift <= i < shift + width]
    a, b = [], []
    for k in range(bits + 1):
        mask = np.uint64(sum(1 << i for i in rest[k :: bits + 1]))
        part = f & mask
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, edges):
            if len(group) > 1:
                x, y = spanning(f[group], bits, position)
                a.append(group[x])
                b.append(group[y])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def linked(keys: np.ndarray, f: np.ndarray, ids: np.ndarray, bits: int, trees: int = 1) -> np.ndarray:
    """Verified links (n, 2) of ids within runs of equal keys (sorted), each where it is at home; of long runs `trees` forests."""
    found = []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    run_size = np.repeat(sizes, sizes)
    for o in range(1, SMALL):
        i = np.flatnonzero((keys[:-o] == keys[o:]) & (run_size[:-o] <= SMALL)) if len(keys) > o else []
        if not len(i):
            break
        i = i[np.bitwise_count(f[i] ^ f[i + o]) <= bits]
        i = i[home(f[i] ^ f[i + o], bits) == (keys[i] >> np.uint64(32)) & np.uint64(0xFF)]
        found.append(np.stack((ids[i], ids[i + o]), 1))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for turn in range(trees):
            order = s + np.argsort(ids[s : s + n] if not turn else ids[s : s + n] * np.int64(0x9E3779B97F4A7C15 * turn % (1 << 63) | 1))
            a, b = forest(f[order], bits, int(keys[s]) >> 32 & 0xFF)
            found.append(np.stack((ids[order[a]], ids[order[b]]), 1))
    both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return np.unique(np.sort(both, 1), axis=0) if len(both) else both


def links(prints: DataFrame, bits: int, trees: int = 1) -> DataFrame:
    """(id, fp) to distinct links (a, b), a < b, of ids whose fingerprints are at most `bits` bits apart.

    Long runs give a spanning forest, or several in other orders, for callers that put a link to a further test.
    """
    rows = prints.select(F.explode(variants(F.col("fp"), bits)).alias("k"), "fp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in sorted_runs(batches):
            got = linked(m[:, 0].view(np.uint64), m[:, 1].view(np.uint64), m[:, 2], bits, trees)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """docs (doc_id, text, any more columns) to (doc_id, fingerprint, component_id), a row for each row of docs.

    Fingerprints at most `bits` bits apart are linked; component_id is the smallest doc_id reachable. Null and blank texts
    have fingerprint zero and link like any other; rows with equal fingerprints are one component without a pair being
    made; rows with a null doc_id keep their component and never name it unless all its ids are null. An empty table gives
    an empty one. Other columns are ignored, whatever they are called.
    """
    prints = cut_lean(fingerprints(docs, words))
    per = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = cut(links(per.select(F.col("fp").alias("id"), "fp"), bits))
    root = components(edges)
    placed = per.join(root, per.fp == root.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
