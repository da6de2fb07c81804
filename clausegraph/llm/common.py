"""What the corpus operators share: sessions' shared folder, words, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every other ASCII byte that is no digit or letter to a space. Bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clausegraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone first; the folder is scratch space
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def forget(table: DataFrame) -> None:
    """Removes a table made by `written` that nothing reads any more."""
    remove(table.sparkSession, table.scratch_path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The table (of short rows) marked for broadcast if it is counted to have at most so many; otherwise as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of unsigned 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as UTF-8 bytes; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def per_document(docs: DataFrame, schema: str, work: Callable[[list[int | None], list[bytes | None]], dict[str, list]]) -> DataFrame:
    """One output row per document: `work` gets a batch of ids and texts and returns the other columns."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in out}
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column(0), part.column(1).to_pylist()
                made = work(ids.to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([ids if n == "doc_id" else pa.array(made[n], types[n]) for n in names], names=names)

    out = arrow_schema(schema)
    return id_and_bytes(docs).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about `most` bytes of text (a longer text is a part of its own)."""
    col = batch.column(1)
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(","))])


def keep_rows(docs: DataFrame, keep: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows whose text `keep` tells to keep, whole and with all their columns, without a shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            both = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts], names=["at", "text"])
            kept = [k for part in slices(both) for k in keep(part.column(1).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
