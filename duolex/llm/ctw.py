"""Context-tree weighting over bytes, by binary decomposition, with a model that is spread over the cluster.

A text is its lower-cased words with single spaces and a final line feed: the bytes of the tokens whose probability is asked.
Each byte is eight binary decisions; each of the 255 decision nodes has a context tree over the last DEPTH bytes. A context
holds counts of zeros and ones and the Krichevsky-Trofimov estimate of both, and the weighted probability of a context mixes
its own estimate with the product of its children's, each with weight one half. That mixture makes a stop weight for every
context: the posterior that the tree ends there. The probability of a bit mixes the estimates along the path of its context
by these weights; a context that wasn't seen in training is a fresh node, which gives every bit one half.

How it is spread: successive texts of a task make blocks of about BLOCK bytes. A block sends its distinct (context, byte) grams and words
with their training counts, packed, to buckets by the last two bytes of context (words: by hash). A bucket holds the distinct
grams of some contexts of two bytes; it builds their trees from depth 2 down and sends up what depth 1 and 0 need: sums for at
most 256 * 255 nodes, the only thing that the driver sees. A bucket then answers each block with the log probabilities of
just the grams and words that the block asked for, and the block scores its texts. Nothing that grows with the corpus is
broadcast or collected. The number of blocks and buckets grows with the bytes. A context that all blocks have doesn't bring all
their rows to one task: beyond MERGED blocks a bucket's rows are split by block, each part is summed on its own, the bucket
learns from the sums, and every part gets what it has learned. A bucket's memory is that of its distinct grams (16 bytes
each), of which those of one context of two bytes stay together.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, crc_fold, cut, cut_dealt, pack_sorted, squeeze, table, unpack_sorted, unsqueeze

#: Blocks whose rows for a bucket meet in a task; grams in a row of what a bucket has learned.
MERGED, LEARNED = 512, 1 << 22
#: UTF-8 bytes of a block, positions worked on at once, grams of a bucket (on average, at most), bytes of context.
BLOCK, SLICE, BUCKET, DEPTH = 16 << 20, 1 << 20, 1 << 17, 6
END = b"\n"


def canonical(text: bytes) -> bytes:
    """Lower-cased words with single spaces, and the end."""
    return b" ".join(text.lower().split()) + END


def slices(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text number) of successive positions of canonical texts. A gram: context from the last byte back, then the byte, in a uint64."""
    i = 0
    while i < len(texts):
        parts, lens = [], []
        begin = i
        while i < len(texts) and (not lens or sum(lens) < SLICE):
            s = texts[i]
            parts.append(END * depth + s)
            lens.append(len(s))
            i += 1
            if len(s) > SLICE:
                break
        buf = np.frombuffer(b"".join(parts), np.uint8)
        n = np.array(lens)
        of = np.repeat(np.arange(begin, i), n)
        at = np.arange(len(of)) + depth * (of - begin + 1)
        for j in range(0, len(at), SLICE):
            p = at[j : j + SLICE]
            key = buf[p].astype(np.uint64)
            for d in range(1, depth + 1):
                key |= buf[p - d].astype(np.uint64) << np.uint64(8 * (depth - d + 1))
            yield key, of[j : j + SLICE]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of the values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *[np.add.reduceat(v[order], first) for v in values]


def gram_bucket(keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    last_two = keys >> np.uint64(8 * (depth - 2) + 8)
    return ((last_two * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(u: np.ndarray, buckets: int, depth: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions) of ascending keys; positions ascend."""
    b = gram_bucket(u, buckets, depth)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))).tolist()
    return [(int(b[i]), order[i:j]) for i, j in zip(cuts, [*cuts[1:], len(b)], strict=True)]


def words_by_bucket(texts: list[bytes], buckets: int) -> list[tuple[int, list[bytes]]]:
    """(bucket, distinct words) of canonical texts, the end token among them, in the order of their first place."""
    parts: dict[int, list[bytes]] = {}
    for w in dict.fromkeys(chain(chain.from_iterable(map(bytes.split, texts)), [END])):
        parts.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return list(parts.items())


class Lookup:
    """Values by uint64 key in an open-addressed table; all keys that are asked for must be there."""

    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits, np.float32)
        at = self.first(keys)
        while len(keys):
            free = self.keys[at] == self.NONE
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first(keys)
        out = self.values[at]
        left = np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            here = self.keys[at] == keys[left]
            out[left[here]] = self.values[at[here]]
            left, at = left[~here], at[~here]
        return out


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return squeeze(np.frombuffer(sink.getvalue(), np.uint8))


def unpacked(b: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(unsqueeze(b, np.uint8).tobytes()).read_next_batch()


#: Log gamma of i + 1/2 and of i + 1 for small i.
HALVES, WHOLES = (np.array([math.lgamma(i + x) for i in range(1024)]) for x in (0.5, 1.0))


def log_gamma(n: np.ndarray, small: np.ndarray, add: float) -> np.ndarray:
    """Log gamma of n + add: from the table of small n, or by Stirling's series, which is exact to a double's precision beyond it."""
    out = small[np.minimum(n, len(small) - 1)]
    large = np.flatnonzero(n >= len(small))
    x = n[large] + add
    out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0, HALVES, 0.5) + log_gamma(n1, HALVES, 0.5) - log_gamma(n0 + n1, WHOLES, 1.0) - math.log(math.pi)


def nodes_of(grams: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes (context << 8 | node), with the zeros and ones that they saw."""
    byte, context = grams & np.uint64(255), grams >> np.uint64(8)
    keys, ones, zeros = [], [], []
    for j in range(8):
        bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
        keys.append(context << np.uint64(8) | np.uint64(1 << j) | byte >> np.uint64(8 - j))
        ones.append(np.where(bit == 1, count, 0))
        zeros.append(np.where(bit == 1, 0, count))
    return summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def shorter(keys: np.ndarray) -> np.ndarray:
    """The same keys with the oldest byte of context dropped."""
    return (keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(255))


class Level:
    """The nodes of one depth: keys, estimate of a one, stop weight, and log weighted probability."""

    def __init__(self, keys, n0, n1, below: Level | None = None, child: np.ndarray | None = None):
        kt = log_kt(n0, n1)
        if below is not None:
            child = np.bincount(np.searchsorted(keys, shorter(below.keys)), below.weighted, len(keys))
        self.keys, self.n0, self.n1, self.one = keys, n0, n1, (n1 + 0.5) / (n0 + n1 + 1.0)
        self.weighted = kt if child is None else np.logaddexp(kt, child) - math.log(2)
        self.stop = np.ones(len(keys)) if child is None else 1 / (1 + np.exp(np.clip(child - kt, -700, 700)))


def tree(grams: np.ndarray, count: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels depth, depth - 1, ... top of the trees of all nodes, from the grams seen in training."""
    grams, count = grams[count > 0], count[count > 0]
    out: list[Level] = []
    for d in range(depth, top - 1, -1):
        out.append(Level(*nodes_of(grams, count), below=out[-1] if out else None))
        if d > top:
            grams, count = summed(shorter(grams), count)
    return out


def log10_probability(grams: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context; levels: from the root down, depth 0 first.

    What a context passes down to one that training didn't see meets a fresh node there, whose estimate is a half at all depths.
    """
    total = np.zeros(len(grams))
    byte = grams & np.uint64(255)
    for j in range(8):
        node = np.uint64(1 << j) | byte >> np.uint64(8 - j)
        one, left, alive = np.zeros(len(grams)), np.ones(len(grams)), np.ones(len(grams), bool)
        for d, level in enumerate(levels):
            if not len(level.keys):
                break
            key = (grams >> np.uint64(8 * (depth - d) + 8)) << np.uint64(8) | node
            i = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            alive &= level.keys[i] == key
            one += np.where(alive, left * level.stop[i] * level.one[i], 0)
            left = np.where(alive, left * (1 - level.stop[i]), left)
        one += left / 2
        total += np.log10(np.where((byte >> np.uint64(7 - j)) & np.uint64(1) == 1, one, 1 - one))
    return total


def score(docs: DataFrame, train, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:  # noqa: ANN001
    """docs (doc_id, text) to a row for each row: doc_id, n_tokens, n_known, train_tokens, vocabulary, base_score, score, n_bytes, bits_per_byte.

    train: a boolean column of docs, true for the rows to learn from (null: false). Null and empty texts are their end
    token. base_score is the add-one unigram log10 probability of the tokens, score that of the context trees; without a
    training row every token counts one in one and every bit one half. Depth is 3 to 7, as a gram is eight bytes at most.
    Rows that repeat are scored each; other columns are ignored.
    """
    if not 3 <= depth <= 7:
        raise ValueError("depth must be 3 to 7")
    rows = docs.select("doc_id", body("text").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.length("t") + 1)).first()[0] or 0
    buckets = max(32, -(-size // (16 * BUCKET)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), np.int64) + 1) // block
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield asked_by(batch.slice(i, j - i))

    def asked_by(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = packed(batch.select([0, 1]))
        name = -1 - (zlib.crc32(own) << 31 ^ zlib.adler32(own))  # below the numbers of buckets
        texts, learn = [canonical(t.as_py()) for t in batch.column(1)], np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        seen, count = [], []
        for g, of in slices(texts, depth):
            yes = learn[of]
            for some, w in ((g[yes], 1), (g[~yes], 0)):
                if len(some):
                    u, n = np.unique(some, return_counts=True)
                    seen.append(u), count.append(n * w)
            if len(seen) > 4:
                u, n = summed(np.concatenate(seen), np.concatenate(count))
                seen, count = [u], [n]
        u, n = summed(np.concatenate(seen), np.concatenate(count))
        del seen, count
        out = [(name, 2, name, own, b"")]
        for b, at in by_bucket(u, buckets, depth):
            out.append((b, 0, name, pack_sorted(u[at]), squeeze(n[at])))
        vocabulary: Counter = Counter()
        for t, yes in zip(texts, learn.tolist(), strict=True):
            if yes:
                vocabulary.update(t.split())
        vocabulary[END] = int(learn.sum())
        for b, ws in words_by_bucket(texts, buckets):
            out.append((buckets + b, 1, name, squeeze(np.frombuffer(b" ".join(ws), np.uint8)), squeeze(np.array([vocabulary[w] for w in ws], np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "block", "keys", "counts"])

    # dealt once: the rows of buckets by bucket, texts by block. Both passes over the buckets and the scoring find them in place.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // (256 << 20)))
    # where there are many blocks, a bucket's rows are split by block (part), so that a common context is no single task
    split = max(1, -(-size // (block * MERGED)))
    by = ["bucket", "part"] if split > 1 else ["bucket"]
    made = rows.mapInArrow(ask, "bucket bigint, kind int, block bigint, keys binary, counts binary").withColumn("part", F.pmod("block", F.lit(split)))
    everything = cut_dealt(made, parts, *by)
    asked = everything.filter("kind < 2")

    def all_grams(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        u, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for i in range(0, len(pdf), 64):
            part = pdf.iloc[i : i + 64]
            u, n = summed(np.concatenate([u, *map(unpack_sorted, part["keys"])]), np.concatenate([n, *[unsqueeze(c, np.int64) for c in part["counts"]]]))
        return u, n

    def all_words(pdf: pd.DataFrame) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for keys, counts in zip(pdf["keys"], pdf["counts"], strict=True):
            for w, c in zip(unsqueeze(keys, np.uint8).tobytes().split(b" "), unsqueeze(counts, np.int64).tolist(), strict=True):
                out[w] = out.get(w, 0) + c
        return out

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of a part of a bucket as one."""
        if pdf.kind.iloc[0]:
            c = all_words(pdf)
            keys, counts = squeeze(np.frombuffer(b" ".join(c), np.uint8)), squeeze(np.fromiter(c.values(), np.int64, len(c)))
        else:
            u, n = all_grams(pdf)
            keys, counts = pack_sorted(u), squeeze(n)
        return pdf.iloc[:1].assign(keys=[keys], counts=[counts])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.kind.iloc[0]:
            c = all_words(pdf).values()
            return pd.DataFrame({"k": [-1], "n0": [sum(c)], "n1": [sum(x > 0 for x in c)], "child": [0.0]})
        u, n = all_grams(pdf)
        two = tree(u, n, depth, 2)[-1]
        k, n0, n1, child = summed(shorter(two.keys), two.n0, two.n1, two.weighted)
        return pd.DataFrame({"k": k.astype(np.int64), "n0": n0, "n1": n1, "child": child.astype(float)})

    # at most 256 * 255 rows, whatever the corpus
    merged = cut(asked.groupBy(*by).applyInPandas(merge, asked.schema)) if split > 1 else asked
    tops = merged.groupBy("bucket").applyInPandas(sums, "k bigint, n0 bigint, n1 bigint, child double").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("child").alias("child")).toPandas()
    words, tops = tops[tops.k < 0], tops[tops.k >= 0].sort_values("k")
    n_train, v_train = (int(words.n0.iloc[0]), int(words.n1.iloc[0])) if len(words) else (0, 0)
    one = Level(tops.k.to_numpy().astype(np.uint64), tops.n0.to_numpy(), tops.n1.to_numpy(), child=tops.child.to_numpy(float))
    root = Level(*summed(one.keys & np.uint64(255), one.n0, one.n1), below=one) if len(one.keys) else one

    def known_to(pdf: pd.DataFrame):  # noqa: ANN202
        """A bucket's answers: asked keys to squeezed counts of words, or log probabilities of grams."""
        if pdf.kind.iloc[0]:
            c = all_words(pdf)
            return lambda keys: squeeze(np.array([c[w] for w in unsqueeze(keys, np.uint8).tobytes().split(b" ")], np.int64))
        u, n = all_grams(pdf)
        p = log10_probability(u, [root, one, *reversed(tree(u, n, depth, 2))], depth).astype(np.float32)
        return lambda keys: squeeze(p[np.searchsorted(u, unpack_sorted(keys))])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        of = known_to(pdf)
        return pd.DataFrame({"bucket": pdf.block, "kind": pdf.kind, "keys": pdf["keys"], "given": [of(k) for k in pdf["keys"]]})

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a bucket has learned, as rows of at most LEARNED grams, or all its words."""
        if pdf.kind.iloc[0]:
            return merge(pdf)[["bucket", "kind", "keys", "counts"]]
        u, n = all_grams(pdf)
        p = log10_probability(u, [root, one, *reversed(tree(u, n, depth, 2))], depth).astype(np.float32)
        rows = [(pdf.bucket.iloc[0], 0, pack_sorted(u[i : i + LEARNED]), squeeze(p[i : i + LEARNED])) for i in range(0, len(u), LEARNED)]
        return pd.DataFrame(rows, columns=["bucket", "kind", "keys", "counts"])

    def reply(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": [], "kind": [], "keys": [], "given": []})
        if pdf.kind.iloc[0]:
            of = known_to(known)
        else:
            some = sorted(((unpack_sorted(k), unsqueeze(g, np.float32)) for k, g in zip(known["keys"], known.counts, strict=True)), key=lambda x: x[0][0])
            u, p = np.concatenate([k for k, _ in some]), np.concatenate([g for _, g in some])
            of = lambda keys: squeeze(p[np.searchsorted(u, unpack_sorted(keys))])
        return pd.DataFrame({"bucket": pdf.block, "kind": pdf.kind, "keys": pdf["keys"], "given": [of(k) for k in pdf["keys"]]})

    given = "bucket bigint, kind int, keys binary, given binary"
    if split > 1:  # each part of a bucket gets what the whole bucket has learned
        known = merged.groupBy("bucket").applyInPandas(learned, "bucket bigint, kind int, keys binary, counts binary")
        known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)).cast("array<bigint>")))
        answers = asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(reply, given)
    else:
        answers = asked.groupBy("bucket").applyInPandas(answer, given)

    def scored(key, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        grams = [(unpack_sorted(k), unsqueeze(g, np.float32)) for kind, k, g in zip(got.kind, got["keys"], got.given, strict=True) if not kind]
        lookup = Lookup(np.concatenate([k for k, _ in grams]), np.concatenate([g for _, g in grams]))
        del grams
        count: dict[bytes, int] = {}
        for kind, k, g in zip(got.kind, got["keys"], got.given, strict=True):
            if kind:
                count.update(zip(unsqueeze(k, np.uint8).tobytes().split(b" "), unsqueeze(g, np.int64).tolist(), strict=True))
        return pd.concat([scored_block(unpacked(x), lookup, count) for x in own["keys"]], ignore_index=True)

    def scored_block(docs: pa.RecordBatch, lookup: Lookup, count: dict[bytes, int]) -> pd.DataFrame:
        texts = [canonical(t.as_py()) for t in docs.column(1)]
        total, n_bytes = np.zeros(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
        for g, of in slices(texts, depth):
            first = of[0]
            total[first : of[-1] + 1] += np.bincount(of - first, lookup(g))
        n_tokens, known, logs = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64), np.empty(len(texts))
        for i, t in enumerate(texts):
            c = list(map(count.__getitem__, t.split()))
            c.append(count[END])
            n_tokens[i] = len(c)
            c = np.array(c)
            known[i] = (c > 0).sum()
            logs[i] = np.log10(c + 1.0).sum()
        base = logs - n_tokens * math.log10(n_train + v_train + 1)
        return pd.DataFrame({"doc_id": docs.column(0).to_pandas(), "n_tokens": n_tokens, "n_known": known, "base_score": base, "score": total, "n_bytes": n_bytes, "bits_per_byte": -total / math.log10(2) / n_bytes})

    kind = dict(docs.dtypes)["doc_id"]
    texts = everything.filter("kind = 2").select("bucket", "keys")
    got = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(scored, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint, bits_per_byte double")
    return got.withColumns({"train_tokens": F.lit(n_train).cast("bigint"), "vocabulary": F.lit(v_train).cast("bigint")})


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, crc_fold(F.col("doc_id"), 7) != 2)
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary", "n_bytes", "bits_per_byte")


QUERIES = {"op2_ctw": op2_ctw}
# The counts and the base have a statement in SQL; the context trees have none, so the whole query has none.
ORACLES: dict[str, str] = {}
