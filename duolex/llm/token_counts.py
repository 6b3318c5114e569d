"""Exact token counts by overlap resynchronisation.

Texts up to CHUNK characters are encoded at once. A longer text is cut into chunks that overlap, each is encoded by itself
with offsets, and neighbours are spliced at a common start of a pre-token:

* The splitting pattern scans to the right and never looks back, so from a true start of a pre-token on, the split depends
  on what follows only. Merges stay inside a pre-token. Hence if p is a true start and a chunk has a start at p, the chunk
  is right from p on, but for its last MARGIN characters, which a longer match or a special string might change.
* The first chunk begins at a true start. By induction each chunk is right from the last splice to its own margin, so a
  start that both have there is a true one: the left chunk counts up to it, the right one from it on.

If two chunks have no common start in their overlap, as within one very long word, the overlap is widened to twice its size
by moving the right chunk's begin to the left and the left chunk's end to the right, until they do or the left chunk reaches
the end of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

#: Characters of a chunk and of its overlap with the next; characters before a chunk's end that aren't relied on: more than
#: the longest special string and the longest fixed alternative of the pattern.
CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 64


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make():
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return t

    return kept(f"tokenizer {path}", make)


def starts(t, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Offsets in the text at which pre-tokens of text[begin:end] start, the tokens before each, and all tokens."""
    e = t.encode(text[begin:end], add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (words[1:] < 0))))
    at = np.array([o[0] for o in e.offsets], np.int64)[first] + begin
    return at, first, len(words)


def count_long(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of a text of any length from overlapping chunks."""
    total, at, end = 0, 0, min(chunk, len(text))  # right from `at` on; the current chunk reaches `end`
    pos, before, n = starts(t, text, 0, end)
    done = 0  # tokens of the current chunk that come before `at`
    while end < len(text):
        width = overlap
        while True:
            begin = max(at, end - width)
            reach = min(len(text), begin + max(chunk, 2 * width))
            pos2, before2, n2 = starts(t, text, begin, reach)
            common = np.intersect1d(pos[(pos >= max(at, begin)) & (pos <= end - margin)], pos2[pos2 <= reach - margin])
            common = common[common > at]
            if len(common):
                break
            width *= 2
            if begin == at or width > end - at:  # nothing more to the left: widen the left chunk to the right
                begin_left = int(pos[0]) if len(pos) else at
                end = min(len(text), end + max(chunk, width))
                pos, before, n = starts(t, text, min(begin_left, at), end)
                done = int(before[np.searchsorted(pos, at)]) if len(pos) and at in pos else 0
                if end == len(text):
                    break
        if end == len(text) and not len(common):
            break
        p = int(common[len(common) // 2])
        total += int(before[np.searchsorted(pos, p)]) - done
        done = int(before2[np.searchsorted(pos2, p)])
        at, end, pos, before, n = p, reach, pos2, before2, n2
    return total + n - done


def counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of docs, a row for a row, without a shuffle.

    Null and empty texts have no bytes and no tokens. Special strings inside texts count as the library counts them by
    default. Other columns are ignored, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = library(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [0] * len(texts)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            for i in range(0, len(short), 256):
                part = short[i : i + 256]
                for j, e in zip(part, t.encode_batch_fast([texts[j] for j in part], add_special_tokens=False), strict=True):
                    out[j] = len(e)
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    out[i] = count_long(t, x, chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    clean = F.coalesce(F.col(text), F.lit(""))
    kind = dict(docs.dtypes)[key]
    got = docs.select(F.col(key).alias("key"), clean.alias("t"), F.octet_length(clean).cast("bigint").alias("n_bytes")).mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return got.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
