"""Tables written once because several stages read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A folder for written tables: the shared one, or in local tests a temporary one that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clausegraph-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the scratch folder, removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone first; the folder is scratch space
            pass

    atexit.register(drop)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


#: Buckets for each shuffle partition of the session: a bucket is sorted in a task's memory, and can't be parted later.
BUCKETS = 4
#: Buckets are by a document or a question; a join on that and more columns must not shuffle them anew.
_ALIGNED = "spark.sql.requireAllClusterKeysForCoPartition"
#: Joins are planned by the rows that `sized` counted, not by the size of packed files.
_SIZED = "spark.sql.cbo.planStats.enabled"


def buckets(spark: SparkSession) -> int:
    return BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def aligned(spark: SparkSession) -> None:
    spark.conf.set(_ALIGNED, "false")
    spark.conf.set(_SIZED, "true")


def bucketed(df: DataFrame, name: str, by: str, n: int, more: str | None = None, order: tuple[str, ...] = ()) -> str:
    """Name of a table of the rows in the scratch folder, in n buckets by a column; with `more`, rows are put to the table of that name.

    With `order`, the rows of a file are sorted by the column and these, which makes it smaller.

    The rows should lie in n partitions by that column, or a bucket gets many files. Files of their shuffles go at once."""
    spark = df.sparkSession
    aligned(spark)
    table = more or f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{table}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        writer = df.write.mode("append" if more else "errorifexists").format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, by)
        (writer.sortBy(by, *order) if order else writer).saveAsTable(table)
    finally:
        spark.conf.set(clean, before)
    if not more:

        def drop() -> None:
            try:
                remove(spark, path)
            except Exception:  # the JVM may have gone first; the folder is scratch space
                pass

        atexit.register(drop)
    return table


def sized(spark: SparkSession, table: str) -> str:
    """The table's name, when its rows are counted: sorted and packed, 100 bytes of rows take 2 to 3 of a file, so that by its files a
    table of millions of rows would be small enough to be sent to the driver and broadcast. Rows put to it later unmake this."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    return table


def dropped(spark: SparkSession, table: str) -> None:
    """The table that `bucketed` made goes, with its files."""
    spark.sql(f"DROP TABLE {table}")
    remove(spark, f"{scratch(spark)}/{table}")


def stamp(spark: SparkSession, paths: list[str]) -> tuple[int, ...]:
    """When files or folders were changed last; 0 for those that aren't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        out.append(fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0)
    return tuple(out)
