"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of one byte total for each shard, ascending. Differencing takes the two partial partitions with
the largest spread and adds them oppositely ordered: the largest part of one meets the smallest of the other. It starts
with a group alone in a vector and ends with one vector.

The GROUPS largest groups are differenced first, together. The others are dealt to buckets of about GROUPS, which are
differenced side by side. Each bucket starts with one vector more: its share of what the largest groups left uneven. So it
evens that out too, and its parts belong to the shards of that vector: nothing has to be put together afterwards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Groups differenced in one task, rows numbered in one sorted run.
GROUPS, RUN = 4000, 5000


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (rows of `vectors`): the final totals, ascending, and for each row the shard of each of its parts."""
    n, k = vectors.shape
    order = np.argsort(vectors, 1, kind="stable")
    live = {i: np.take_along_axis(vectors[i], order[i], 0) for i in range(n)}
    heap = [(-(int(v[-1]) - int(v[0])), i) for i, v in live.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        v = live.pop(a) + live.pop(b)[::-1]
        o = np.argsort(v, kind="stable")
        made.append((a, b, o))
        i = n + len(made) - 1
        live[i] = v = v[o]
        heapq.heappush(heap, (-(int(v[-1]) - int(v[0])), i))
    top = heap[0][1]
    shard = {top: np.arange(k)}
    for i in range(len(made) - 1, -1, -1):
        a, b, o = made[i]
        at = np.empty(k, np.int64)
        at[o] = shard.pop(n + i)
        shard[a], shard[b] = at, at[::-1]
    parts = np.empty((n, k), np.int64)
    for i in range(n):
        parts[i, order[i]] = shard[i]
    return live[top], parts


def alone(sizes, shards: int) -> np.ndarray:  # noqa: ANN001
    """Each size as the last part of a vector of its own."""
    v = np.zeros((len(sizes), shards), np.int64)
    v[:, -1] = sizes
    return v


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """(g, bytes) with distinct g to (g, shard). Ties go by size and then by g, so the result doesn't depend on the order of rows."""
    spark, kind = groups.sparkSession, dict(groups.dtypes)["g"]
    buckets = -(-(groups.count() - GROUPS) // GROUPS)
    first = groups.orderBy(F.desc("bytes"), "g").limit(GROUPS).collect()  # at most GROUPS rows
    if not first:
        return groups.select("g", F.lit(0).alias("shard"))
    totals, parts = difference(alone([r["bytes"] for r in first], shards))
    out = spark.createDataFrame([(r["g"], int(p)) for r, p in zip(first, parts[:, -1], strict=True)], f"g {kind}, shard int")
    if buckets <= 0:
        return out
    share = totals // buckets

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True], ignore_index=True)
        _, parts = difference(np.concatenate([share[None, :], alone(pdf.bytes, shards)]))
        shard = np.empty(shards, np.int64)
        shard[parts[0]] = np.arange(shards)  # the place of the vector of the largest groups that a part has
        return pd.DataFrame({"g": pdf.g, "shard": shard[parts[1:, -1]].astype(np.int32)})

    last = first[-1]
    rest = groups.filter((F.col("bytes") < last["bytes"]) | ((F.col("bytes") == last["bytes"]) & (F.col("g") > F.lit(last["g"]))))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket")
    return out.unionByName(dealt.applyInPandas(fill, f"g {kind}, shard int"))


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """docs (doc_id, text) to (doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row.

    The law is `bytes`: equal texts are one group that stays together (null counts as the empty text), and shards get near
    equal totals of size = UTF-8 bytes + overhead. A group larger than a shard's share makes its shard larger than the rest.
    Slots count from 0 without a gap in each shard: rows are numbered in runs of about RUN by a hash of the row, and each
    run starts where the counts of the runs before it end. Rows that repeat get different slots. An empty table gives an
    empty one; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = cut(docs.select("doc_id", (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")))
    groups = cut(light.groupBy("g").agg(F.sum("size").alias("bytes")))
    runs = max(1, -(-light.count() // RUN))
    rows = light.join(assign(groups, shards), "g").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).alias("run"))
    rows = cut(rows)
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "run").count().select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(first, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
