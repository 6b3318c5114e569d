"""A stored table whose writes are transactions: a source is replaced, emptied or added by one new manifest.

A table is a folder. Data files are written first, where no reader looks; then a manifest that names them, numbered one above
the last, is put in place by a rename that fails if it is there already. So a write that fails leaves the table as it was, of
two writers that began at one version the second fails, and a reader sees whole versions only. A manifest names a base, laid
out by source, and the folders of sources written since; only what is replaced is written anew. `compact` makes a new base.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove


class Conflict(RuntimeError):
    """Another write has made the expected next version."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """(Hadoop Path class, file context) for a table's store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf), at.getFileSystem(conf)


def version(spark: SparkSession, path: str) -> int:
    """Number of the newest version; 0 if there is no table."""
    make, _, fs = _files(spark, path)
    folder = make(f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)


def manifest(spark: SparkSession, path: str, number: int) -> dict:
    make, _, fs = _files(spark, path)
    stream = fs.open(make(f"{path}/manifests/{number}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, after: int, what: dict) -> int:
    """what as the version after `after`."""
    make, context, fs = _files(spark, path)
    staged, final = make(f"{path}/manifests/{uuid.uuid4().hex}.staged"), make(f"{path}/manifests/{after + 1}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = getattr(kind, "NONE")
    try:
        context.rename(staged, final, options)
    except Exception as e:
        fs.delete(staged, False)
        if version(spark, path) > after:
            raise Conflict(f"version {after + 1} of {path} is there already") from e
        raise
    return after + 1


def create(rows: DataFrame, path: str, by: str = "source") -> int:
    """A new table of all rows, laid out by source. Rows without a source are refused."""
    spark = rows.sparkSession
    if version(spark, path):
        raise Conflict(f"{path} is there already")
    base = f"data/{uuid.uuid4().hex}"
    _owned(rows, F.col(by).isNotNull(), "a row without a source").write.partitionBy(by).parquet(f"{path}/{base}")
    return _commit(spark, path, 0, {"by": by, "schema": rows.schema.json(), "base": base, "sources": {}})


def _owned(rows: DataFrame, ok, reason: str) -> DataFrame:  # noqa: ANN001
    return rows.withColumn("_own", F.assert_true(F.coalesce(ok, F.lit(False)), reason)).filter(F.col("_own").isNull()).drop("_own")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table at a version, the newest by default."""
    m = manifest(spark, path, number or version(spark, path))
    schema, by = T.StructType.fromJson(json.loads(m["schema"])), m["by"]
    base = spark.read.schema(schema).parquet(f"{path}/{m['base']}")
    if m["sources"]:  # pruned by partition
        base = base.filter(~F.col(by).isin(list(m["sources"])))
    out = base.select(*schema.names)
    written = [f"{path}/{folder}" for folder in m["sources"].values() if folder]
    return out.unionByName(spark.read.schema(schema).parquet(*written)) if written else out


def replace_source(incoming: DataFrame, path: str, source: str, expected: int | None = None, key: str = "id") -> int:
    """The rows of one source become the incoming ones: new keys are added, others updated, absent ones deleted; none empties it.

    A row of another source, a null key and a key that comes twice fail before anything is put in place. `expected` is the version
    that the caller has read (by default the newest); if another write came since, Conflict is raised. Returns the version.
    """
    spark = incoming.sparkSession
    after = version(spark, path) if expected is None else expected
    m = manifest(spark, path, after)
    schema, by = T.StructType.fromJson(json.loads(m["schema"])), m["by"]
    folder = f"data/{uuid.uuid4().hex}"
    try:
        _owned(_owned(incoming.select(*schema.names), F.col(by) == source, "a row of another source"), F.col(key).isNotNull(), "a row without a key").write.parquet(f"{path}/{folder}")
        staged = spark.read.schema(schema).parquet(f"{path}/{folder}")
        if not staged.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError("a key twice in a source")
        empty = staged.isEmpty()
        done = _commit(spark, path, after, m | {"sources": m["sources"] | {source: None if empty else folder}})
    except BaseException:
        remove(spark, f"{path}/{folder}")
        raise
    if empty:
        remove(spark, f"{path}/{folder}")
    return done


def compact(spark: SparkSession, path: str) -> int:
    """The same rows as a new base by source."""
    after = version(spark, path)
    m = manifest(spark, path, after)
    base = f"data/{uuid.uuid4().hex}"
    read(spark, path, after).write.partitionBy(m["by"]).parquet(f"{path}/{base}")
    return _commit(spark, path, after, m | {"base": base, "sources": {}})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes data and manifests that only versions before the newest `keep` name. No write may be under way."""
    newest = version(spark, path)
    make, _, fs = _files(spark, path)
    numbers = range(max(1, newest - keep + 1), newest + 1)
    named = {x for n in numbers for m in [manifest(spark, path, n)] for x in [m["base"], *m["sources"].values()] if x}
    gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(make(f"{path}/data"))]
    gone = sorted({*gone} - named)
    for x in gone:
        remove(spark, f"{path}/{x}")
    for s in fs.listStatus(make(f"{path}/manifests")):
        name = s.getPath().getName()
        if name.endswith(".json") and int(name[:-5]) not in numbers:
            remove(spark, f"{path}/manifests/{name}")
    return gone
