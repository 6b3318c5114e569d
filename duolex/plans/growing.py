"""An inverted index that takes up, changes and drops documents without being built anew.

Documents that come in are a segment of their own, with the same tables as a whole index. What an older segment holds of a
document that is replaced or dropped isn't touched: the document's id goes into a table of what is gone from segments up to a
number, and the document frequencies that it had into a table of corrections. Statistics and weights are summed over segments
and corrections when they are read, so scores are those of an index built anew. `compact` writes the live documents as one
segment. A manifest names segments and corrections; it is put in place as a whole, by `operators.versions`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..session import cut, remove
from .index import FIELDS, Index, checked_quotes, postings_of, stored_table, write_tables


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    at = versions.version(spark, path)
    return at, versions.manifest(spark, path, at) if at else {"segments": [], "gone": []}


def live(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of all segments, without the rows of documents that are gone from a segment."""
    _, m = _state(spark, path)
    every = _union([stored_table(spark, f"{path}/{s}", table).withColumn("_s", F.lit(i)) for i, s in enumerate(m["segments"])])
    if not m["gone"]:
        return every.drop("_s")
    gone = _union([spark.read.parquet(f"{path}/{g}/ids") for g in m["gone"]]).groupBy("id").agg(F.max("below").alias("below"))
    kept = every.join(gone.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("_s") < F.col("below")), "left_anti")
    return kept.drop("_s")


def read(spark: SparkSession, path: str) -> Index:
    """The index of the live documents: docs with their weights, postings, and statistics summed over segments and corrections."""
    _, m = _state(spark, path)
    places = [*m["segments"], *m["gone"]]
    summed = lambda table, by, n: _union([spark.read.parquet(f"{path}/{p}/{table}") for p in places]).groupBy(*by).agg(F.sum(n).alias(n)).filter(F.col(n) > 0)
    groups = summed("sources", ["source"], "n")
    whole = groups.agg(F.sum("n").alias("all"), F.count("*").alias("groups"))  # a row
    weight = groups.join(F.broadcast(whole)).select(F.col("source").alias("_g"), (F.col("all") / (F.col("n") * F.col("groups"))).alias("weight"))
    docs = live(spark, path, "docs")
    docs = docs.join(weight, docs["source"].eqNullSafe(weight["_g"])).drop("_g")
    return Index(docs, live(spark, path, "postings"), summed("stats", ["field", "term"], "df"), summed("sizes", ["field"], "n"), live(spark, path, "counts"))


def _commit(spark: SparkSession, path: str, at: int, segments: list[str], gone: list[str], fields) -> int:  # noqa: ANN001
    return versions._commit(spark, path, at, {"segments": segments, "gone": gone, "fields": [list(f) for f in fields]})


def _segment(quotes: DataFrame, path: str, name: str, fields) -> None:  # noqa: ANN001
    write_tables(checked_quotes(quotes), f"{path}/{name}", fields)
    docs = quotes.sparkSession.read.parquet(f"{path}/{name}/docs")
    docs.groupBy("source").agg(F.count("*").alias("n")).write.parquet(f"{path}/{name}/sources")


def _corrections(spark: SparkSession, path: str, name: str, ids: DataFrame, below: int, fields) -> bool:  # noqa: ANN001
    """What the live documents of the ids take from the statistics, under a name. False if no such document lives."""
    old = cut(live(spark, path, "docs").join(ids.select("id").distinct(), "id", "left_semi"))
    if old.isEmpty():
        return False
    old.select("id", F.lit(below).alias("below")).write.parquet(f"{path}/{name}/ids")
    old.groupBy("source").agg((-F.count("*")).alias("n")).write.parquet(f"{path}/{name}/sources")
    made = cut(postings_of(old, fields).groupBy("field", "term").agg((-F.sum("df")).alias("n")))
    made.filter("term is not null").withColumnRenamed("n", "df").write.parquet(f"{path}/{name}/stats")
    made.filter("term is null").select("field", "n").write.parquet(f"{path}/{name}/sizes")
    return True


def _fields(m: dict, fields):  # noqa: ANN001, ANN202
    return tuple(tuple(f) for f in m["fields"]) if "fields" in m else fields


def put(quotes: DataFrame, path: str, fields=FIELDS) -> int:
    """Takes documents up, in place of those of the same id. An id that comes twice fails. Returns the version.

    The first call makes the index; later ones keep its fields.
    """
    spark = quotes.sparkSession
    at, m = _state(spark, path)
    fields, name, gone = _fields(m, fields), f"segment-{uuid.uuid4().hex}", f"gone-{uuid.uuid4().hex}"
    try:
        _segment(quotes, path, name, fields)
        new = spark.read.parquet(f"{path}/{name}/docs")
        if not new.groupBy("id").count().filter("count > 1").isEmpty():
            raise ValueError("an id twice among the documents")
        replaced = bool(m["segments"]) and _corrections(spark, path, gone, new, len(m["segments"]), fields)
        return _commit(spark, path, at, [*m["segments"], name], [*m["gone"], *([gone] if replaced else [])], fields)
    except BaseException:
        remove(spark, f"{path}/{name}")
        remove(spark, f"{path}/{gone}")
        raise


def drop(ids: DataFrame, path: str) -> int:
    """Drops the documents of the ids; ids without a document don't matter. Returns the version."""
    spark = ids.sparkSession
    at, m = _state(spark, path)
    gone = f"gone-{uuid.uuid4().hex}"
    if not m["segments"] or not _corrections(spark, path, gone, ids, len(m["segments"]), _fields(m, FIELDS)):
        return at
    return _commit(spark, path, at, m["segments"], [*m["gone"], gone], _fields(m, FIELDS))


def compact(spark: SparkSession, path: str) -> int:
    """The live documents as one segment; earlier segments and corrections are removed once no manifest needs them."""
    at, m = _state(spark, path)
    name, fields = f"segment-{uuid.uuid4().hex}", _fields(m, FIELDS)
    _segment(live(spark, path, "docs"), path, name, fields)
    done = _commit(spark, path, at, [name], [], fields)
    for old in [*m["segments"], *m["gone"]]:
        remove(spark, f"{path}/{old}")
    return done
