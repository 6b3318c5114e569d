"""Session helpers shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duolex")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, `spark.checkpoint.dir`.

    Where the session names none it is one under the warehouse, as in tests, but on a local master only: on a cluster a path that
    nobody chose may be a local disk.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "_checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder (`spark.checkpoint.dir`), where a lost executor's successor finds it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame, each: int = 20_000, rows: int | None = None) -> int:
    """Partitions for work that is heavy for each row of a counted table: the session's number, more for many rows.

    The table is counted unless the number of rows is given.

    A number that is asked for is kept, where adaptive execution would put small rows together in one task.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(df.count() if rows is None else rows) // each))


def memo(most: int = 100_000):  # noqa: ANN201
    """Results kept by arguments, up to a number. Unlike the library's cache it travels to executors by value."""

    def around(f):  # noqa: ANN001, ANN202
        seen: dict = {}

        def kept(*args):  # noqa: ANN002, ANN202
            if args not in seen:
                if len(seen) >= most:
                    seen.clear()
                seen[args] = f(*args)
            return seen[args]

        kept.__doc__ = f.__doc__
        return kept

    return around
