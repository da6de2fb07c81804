"""Connected components over edge tables: local contraction, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

EDGES = 1 << 20  #: edges that a task contracts


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the least node of each of their components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    stars = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for k in range(0, len(stars), 1 << 16):
        some = np.array(stars[k : k + (1 << 16)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["hi", "lo"])


def components(edges: DataFrame, u: str = "a", v: str = "b", most: int = 60, share: int = EDGES) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches.

    Edges are dealt to as many tasks as bound their number in a task, and each contracts its own to stars; what one task
    holds alone is done then. Otherwise star steps join the stars: least neighbours are aggregated before the shuffle and
    joined back, so no node's neighbours are gathered in one place, and each round's edges are a table in the shared folder
    that goes when the next one stands. Rounds grow as the logarithm of the longest path."""
    given = written(edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where("hi > lo"), "edges")
    tasks = max(1, -(-given.count() // share))
    now = written(given.repartition(tasks).mapInArrow(contracted, "hi long,lo long"), "edges")
    forget(given)
    mark = None
    for _ in range(most if tasks > 1 else 0):
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "near")
        least = both.groupBy("node").agg(F.min("near").alias("m")).select(anew("node"), F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("near > node AND near > m").select(F.col("near").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least.select(anew("hi"), "m"), "hi")
        shrunk = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        last, now = now, written(shrunk.distinct(), "edges")
        before, mark = mark, _mark(now)
        forget(last)
        if mark == before:
            break
    else:
        if tasks > 1:
            raise RuntimeError(f"components didn't settle in {most} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())


def anew(key: str):
    """A long key, computed anew, so that a join deals out both sides itself and a key's rows can go to several tasks."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first())
