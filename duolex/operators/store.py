"""Store maintenance: reconciling a source, caches by content and address, orphans, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import audio_format
from ..functions.text import base_name, sha1_path
from ..session import cut, remove


def reconcile(stored: DataFrame, incoming: DataFrame, source, key: str = "id", by: str = "source") -> DataFrame:  # noqa: ANN001
    """(key, action I/U/D) that makes the stored rows of one source equal to the incoming ones; other sources are untouched."""
    a = stored.filter(F.col(by) == source).select(F.col(key), F.lit(True).alias("_s"))
    b = incoming.select(F.when(F.col(by) == source, F.col(key)).otherwise(F.raise_error(F.lit("a row of another source"))).alias(key), F.lit(True).alias("_i"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("_s").isNull(), "I").when(F.col("_i").isNull(), "D").otherwise("U").alias("action"))


def replaced(stored: DataFrame, incoming: DataFrame, source, by: str = "source") -> DataFrame:  # noqa: ANN001
    """The table after the merge: the other sources' rows and the incoming ones."""
    ok = incoming.withColumn("_e", F.assert_true(F.col(by) == source, "a row of another source")).filter(F.col("_e").isNull()).drop("_e")
    return stored.filter(F.col(by) != source).unionByName(ok)


def save_source(incoming: DataFrame, path: str, source, by: str = "source") -> None:  # noqa: ANN001
    """The rows of one source in a plain folder laid out by source become the incoming ones; none empties it.

    One task commit for the source's folder, no more: `operators.versions` has transactions, with keys checked as well.
    """
    spark = incoming.sparkSession
    own = incoming.withColumn("_e", F.assert_true(F.coalesce(F.col(by) == source, F.lit(False)), "a row of another source")).filter(F.col("_e").isNull()).drop("_e")
    if (own := cut(own)).isEmpty():  # nothing comes in, so no partition would be overwritten
        remove(spark, f"{path}/{by}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(source))}")
    else:
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes whose Japanese text has kanji or hiragana."""
    from ..functions.text import has_kanji_or_hiragana

    return spark.read.parquet(path).filter(has_kanji_or_hiragana(F.col("japanese.text")))


def dump_json(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nulls left out; a folder that is there already is an error."""
    rows.write.mode("errorifexists").json(path)


def copy_table(spark: SparkSession, path: str, to: str) -> None:
    """A table copied whole, in the files' own schema; a folder that is there already is an error."""
    spark.read.parquet(path).write.mode("errorifexists").parquet(to)


def import_audio(stored: DataFrame, files: DataFrame) -> DataFrame:
    """New objects of files (data, uri) by content address, with size; what is stored already isn't returned. Unknown formats fail."""
    ext = audio_format(F.col("data"))
    named = files.withColumn("ext", F.when(ext.isNull(), F.raise_error(F.lit("unsupported audio format"))).otherwise(ext)).withColumn("name", sha1_path(F.col("data"), F.col("ext")))
    return named.select("name", "data", F.length("data").alias("sz")).dropDuplicates(["name"]).join(stored.select("name"), "name", "left_anti")


def upsert_cache(cache: DataFrame, new: DataFrame, key: str = "original_uri", order: str = "ord") -> DataFrame:
    """cache with the latest row of each key of new in place of its own; both have (key, object_name, order)."""
    both = cache.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*cache.columns), F.struct("_n", order)).alias("r")).select("r.*")


def cached_or_missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (uri) with its object name by exact address, fragment included; null where it has to be fetched."""
    return wanted.join(cache.select(F.col("original_uri").alias("uri"), "object_name"), "uri", "left")


def not_uploaded(files: DataFrame, objects: DataFrame, bucket) -> DataFrame:  # noqa: ANN001
    """Files that a bucket's object cache lacks."""
    return files.join(objects.filter(F.col("bucket") == bucket).select(F.col("object_name").alias("name")), "name", "left_anti")


def upload_manifest(files: DataFrame) -> DataFrame:
    """(name, target, content_type): each file, and an .m4a variant of all but .mp3."""
    from ..functions.text import content_type, fallback_name

    targets = F.filter(F.array(F.col("name"), fallback_name(F.col("name"))), lambda x: x.isNotNull())
    return files.select("name", F.explode(targets).alias("target")).withColumn("content_type", content_type(F.col("target")))


def stale_objects(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Cached objects whose base name, up to the first dot, no file has."""
    return objects.withColumn("_b", base_name(F.col("object_name"))).join(files.select(base_name(F.col("name")).alias("_b")).distinct(), "_b", "left_anti").drop("_b")


def referenced(quotes: DataFrame) -> DataFrame:
    return quotes.select(F.explode(F.array("english.audio_file", "japanese.audio_file")).alias("name")).filter("name is not null").distinct()


def orphans(files: DataFrame, quotes: DataFrame) -> DataFrame:
    """Audio that no quote refers to in either language."""
    return files.join(referenced(quotes), "name", "left_anti")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with the number of their batch of `size` in the order of a column."""
    from .corpus import running_index

    return running_index(rows, order, "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().filter("count > 1")


def first_extension(wanted: DataFrame, listing: DataFrame, endings: tuple[str, ...] = ("", ".opus", ".ogg", ".mp3")) -> DataFrame:
    """wanted (path) with the first of path, path.opus, path.ogg, path.mp3 that the listing (path) has; null if none."""
    tries = wanted.select("path", F.posexplode(F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(F.col("path"), e))).alias("n", "candidate"))
    hit = tries.join(listing.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path").agg(F.min_by("candidate", "n").alias("found"))
    return wanted.join(hit, "path", "left")

