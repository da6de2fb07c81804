"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder of immutable shard files and a folder of manifests, one for each version:
  data/<commit>/run=<run>/file=<file>/part-*.parquet   (one column, `doc`: the row as it came)
  manifest/v00000001, v00000002, ... (run, file, tier, rows, bytes, least and greatest id, commit)

Arrivals are appended as small runs, written where they are read. Runs below the target size whose sizes fall in the same
tier (powers of FAN_IN) are merged FAN_IN at a time, oldest first, until no tier has so many; the plan follows that
cascade over the sizes alone, so each row is moved once, into files of about the target size, dealt by a hash of id and
text. Files are numbered, and a task writes one. A version is committed by renaming its written manifest to the next free
name, which fails if another writer took it: readers see a version whole or not at all. That rests on a rename that doesn't
overwrite, which HDFS and local folders have; over an object store a conditional put has to take its place. Files that no
version names go by `vacuum`, which leaves alone what is younger than its age.

Cases: null ids are dealt to runs below zero by the hash of their text; null texts have 0 bytes. Repeated rows stay
repeated. An empty table gives a version without shards. Texts of any length stay whole: a file holds at least one row.
Other columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, shared_dir, small, written

ARRIVAL_ROWS = 256  #: ids of an arrival; bulk loads take more
TARGET_BYTES = 128 << 20  #: text of a shard file
TIER_BYTES = 4 << 20  #: runs up to FAN_IN times this are the lowest tier
FAN_IN = 4
VACUUM_AGE = 24 * 3600  #: seconds for which files that no version names are left to writers and readers

TEXT_BYTES = "coalesce(octet_length(text), 0)"


def arrival(rows: int = ARRIVAL_ROWS) -> str:
    return f"coalesce(CAST(floor(doc_id / {rows}) AS long), -1 - pmod(xxhash64(text), 1024))"


def tier(bytes_: str = "bytes", lowest: int = TIER_BYTES, fan_in: int = FAN_IN) -> str:
    """SQL of a run's tier: 0 below lowest * fan_in, one more for each power of fan_in."""
    return " + ".join(f"CASE WHEN {bytes_} >= {lowest * fan_in**k} THEN 1 ELSE 0 END" for k in range(1, 12))


def share(doc_id: str = "doc_id", text: str = "text") -> str:
    """SQL (Spark's and DuckDB's) of the 32 hexadecimal digits by which a row is dealt to the files of its run."""
    return f"md5(coalesce(CAST({doc_id} AS STRING), '') || ':' || CAST(length(coalesce({text}, '')) AS STRING) || substr(coalesce({text}, ''), 1, 64))"


def with_before(rows: DataFrame, keys: list[str], order: str, value, name: str) -> DataFrame:
    """Column `name`: the sum of `value` over the rows of equal keys that come before by `order`.

    Sums run within range partitions; what the partitions before hold is a row for each partition and key."""
    dealt = written(rows.withColumn("_value", value).repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    above = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_start"))
    within = F.sum("_value").over(Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    found = dealt.withColumn("_within", F.coalesce(within, F.lit(0))).join(small(starts), ["_part", *keys])
    return found.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_value", "_sum", "_start", "_within")


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, lowest: int = TIER_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.lowest, self.fan_in = spark, path, target, lowest, fan_in
        shared_dir(spark)

    # versions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest/v{version or self.version():08d}")

    def commit(self, manifest: DataFrame, version: int) -> int:
        """Makes `manifest` that version; raises if the version exists."""
        temp = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(temp)
        jvm, fs = self._fs()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        p = jvm.org.apache.hadoop.fs.Path
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files.rename(p(temp), p(f"{self.path}/manifest/v{version:08d}"), none)
        return version

    # rows

    def placed(self, version: int | None = None) -> DataFrame | None:
        """run, file and doc (the row) of a version's rows; None if it has none."""
        held = self.manifest(version)
        commits = [r[0] for r in held.select("commit").distinct().sort("commit").collect()]  # a commit is a write
        found = None
        for c in commits:
            rows = self.spark.read.option("basePath", f"{self.path}/data/{c}").parquet(f"{self.path}/data/{c}")
            rows = rows.withColumns({"run": F.col("run").cast("long"), "file": F.col("file").cast("long")})
            own = held.where(F.col("commit") == c).select("run", "file")
            rows = rows.join(small(own), ["run", "file"], "left_semi").select("run", "file", "doc")
            found = rows if found is None else found.union(rows)
        return found

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with the columns they came with; None if it has none."""
        rows = self.placed(version)
        return None if rows is None else rows.select("doc.*")

    def _written(self, rows: DataFrame, commit: str) -> DataFrame:
        """Writes rows (run, file, doc) by run and file; what the manifest says of them."""
        rows.write.option("compression", "zstd").partitionBy("run", "file").parquet(f"{self.path}/data/{commit}")
        back = self.spark.read.schema(rows.select("doc", "run", "file").schema).parquet(f"{self.path}/data/{commit}")
        text, doc_id = F.coalesce(F.octet_length("doc.text"), F.lit(0)), F.col("doc.doc_id").cast("long")
        found = back.groupBy("run", "file").agg(F.count(F.lit(1)).alias("rows"), F.sum(text).cast("long").alias("bytes"), F.min(doc_id).alias("min_id"), F.max(doc_id).alias("max_id"))
        whole = found.groupBy("run").agg(F.sum("bytes").alias("whole"))
        return found.join(whole, "run").select("run", "file", F.expr(tier("whole", self.lowest, self.fan_in)).cast("long").alias("tier"), "rows", "bytes", "min_id", "max_id", F.lit(commit).alias("commit"))

    def append(self, docs: DataFrame, arrival_sql: str | None = None) -> int:
        """Each arrival becomes a run of one small shard; the rows aren't shuffled."""
        version, commit = self.version(), uuid.uuid4().hex
        whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
        rows = docs.select(F.expr(arrival_sql or arrival()).cast("long").alias("run"), F.lit(0).cast("long").alias("file"), whole)
        new = self._written(rows, commit)
        return self.commit(self.manifest(version).unionByName(new) if version else new, version + 1)

    def plan(self, version: int | None = None) -> DataFrame:
        """run, into, files, moved: the run that each run ends up in, how many files that has, and whether rows move.

        A run that is still one file but larger than the target is split as well."""
        runs = self.manifest(version).groupBy("run").agg(F.sum("bytes").alias("bytes"), (F.count(F.lit(1)) == 1).alias("whole"))
        state = written(runs.select("run", F.col("run").alias("into"), "bytes", "whole", F.lit(False).alias("moved")), "plan")
        while True:
            now = state.groupBy("into").agg(F.sum("bytes").alias("bytes"))
            open_ = now.where(F.col("bytes") < self.target).withColumn("tier", F.expr(tier("bytes", self.lowest, self.fan_in)))
            placed = with_before(open_, ["tier"], "into", F.lit(1), "nth").withColumn("batch", F.floor(F.col("nth") / self.fan_in))
            full = placed.groupBy("tier", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("into").alias("new")).where(F.col("n") == self.fan_in)
            moves = written(placed.join(full, ["tier", "batch"]).select("into", "new"), "moves")
            if moves.isEmpty():
                break
            state = written(state.join(moves, "into", "left").select("run", F.coalesce("new", "into").alias("into"), "bytes", "whole", (F.col("moved") | F.col("new").isNotNull()).alias("moved")), "plan")
        files = state.groupBy("into").agg(F.greatest(F.lit(1), F.round(F.sum("bytes") / self.target)).cast("long").alias("files"))
        return state.join(files, "into").select("run", "into", "files", (F.col("moved") | (F.col("whole") & (F.col("files") > 1))).alias("moved"))

    def compact(self) -> int:
        """Merges the runs that the plan moves into target-sized files; runs that stay aren't rewritten."""
        version, commit = self.version(), uuid.uuid4().hex
        moves = written(self.plan(version).where("moved"), "moved")
        if moves.isEmpty():
            return version
        # Files are numbered over all runs, in the order of the runs, so that each is a task's own.
        runs = written(with_before(moves.select("into", "files").distinct(), [], "into", F.col("files"), "first"), "files")
        total = runs.agg(F.sum("files")).first()[0]
        at = moves.join(small(runs.drop("files")), "into").select(F.col("run").alias("from"), "into", "files", "first")
        rows = self.placed(version).select(F.col("run").alias("from"), "doc").join(small(at), "from")
        number = F.conv(F.substring(F.expr(share("doc.doc_id", "doc.text")), 1, 8), 16, 10).cast("long")
        # Rows without an id may all be equal, so they are dealt as they come.
        nth = F.pmod(F.when(F.col("doc.doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(number), F.col("files"))
        rows = rows.select(F.col("into").alias("run"), nth.alias("file"), "doc", (F.col("first") + nth).cast("int").alias("task"))
        new = self._written(rows.repartitionById(int(total), "task").drop("task"), commit)
        stay = self.manifest(version).join(moves.select("run"), "run", "left_anti")
        return self.commit(stay.unionByName(new), version + 1)

    def vacuum(self, age: float = VACUUM_AGE) -> None:
        """Removes the data of commits that the last version doesn't name and that are older than `age` seconds.

        Younger ones may be a writer's that hasn't committed yet, or read by those who opened the version before."""
        named = {r[0] for r in self.manifest().select("commit").distinct().collect()}
        jvm, fs = self._fs()
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")):
            if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - age:
                remove(self.spark, s.getPath().toString())


def sharded(docs: DataFrame, path: str, arrival_rows: int = ARRIVAL_ROWS, **sizes: int) -> DataFrame:
    """Appends the documents to a store, compacts it, and tells where each row ended: doc_id, run, file, shard_rows, shard_bytes, tier."""
    store = ShardStore(docs.sparkSession, path, **sizes)
    store.append(docs, arrival(arrival_rows))
    store.compact()
    held = store.manifest().select("run", "file", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier")
    rows = store.placed()
    if rows is None:
        return docs.sparkSession.createDataFrame([], "doc_id long,run long,file long,shard_rows long,shard_bytes long,tier long")
    return rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "run", "file").join(small(held), ["run", "file"]).select("doc_id", "run", "file", "shard_rows", "shard_bytes", "tier")


def placement_sql(arrival_rows: int = ARRIVAL_ROWS, target: int = TARGET_BYTES, lowest: int = TIER_BYTES, fan_in: int = FAN_IN, rounds: int = 14) -> str:
    """DuckDB SQL for `sharded` over documents whose ids aren't null."""
    bytes_ = "coalesce(octet_length(encode(text)), 0)"
    steps = [f"d AS (SELECT doc_id, CAST(floor(doc_id / {arrival_rows}) AS BIGINT) AS a, {bytes_} AS b, CAST('0x' || substr({share()}, 1, 8) AS BIGINT) AS h FROM documents)", "s0 AS (SELECT a, a AS i, CAST(sum(b) AS BIGINT) AS b FROM d GROUP BY a)"]
    for k in range(rounds):
        steps += [
            f"r{k} AS (SELECT i, CAST(sum(b) AS BIGINT) AS b FROM s{k} GROUP BY i HAVING sum(b) < {target})",
            f"p{k} AS (SELECT i, t, (row_number() OVER (PARTITION BY t ORDER BY i) - 1) // {fan_in} AS g FROM (SELECT i, {tier('b', lowest, fan_in)} AS t FROM r{k}))",
            f"m{k} AS (SELECT i, CASE WHEN count(*) OVER w = {fan_in} THEN min(i) OVER w ELSE i END AS n FROM p{k} WINDOW w AS (PARTITION BY t, g))",
            f"s{k + 1} AS (SELECT a, coalesce(n, s{k}.i) AS i, b FROM s{k} LEFT JOIN m{k} ON s{k}.i = m{k}.i)",
        ]
    last = f"s{rounds}"
    steps += [f"f AS (SELECT i, CAST(greatest(1, round(sum(b) / {target})) AS BIGINT) AS files, CAST({tier('sum(b)', lowest, fan_in)} AS BIGINT) AS tier FROM {last} GROUP BY i)"]
    steps += [f"x AS (SELECT doc_id, {last}.i AS run, h % files AS file, d.b, tier FROM d JOIN {last} USING (a) JOIN f USING (i))"]
    return "WITH " + ", ".join(steps) + " SELECT doc_id, run, file, count(*) OVER w AS shard_rows, CAST(sum(b) OVER w AS BIGINT) AS shard_bytes, tier FROM x WINDOW w AS (PARTITION BY run, file)"
