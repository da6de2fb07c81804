"""Exact dedup by distributed MSD radix partitioning.

Level r splits the groups left open by level r - 1 by the next bytes, up to byte FIRST * GROWTH**r: the key is the number
of the group and those bytes, and what goes on to the next level is the rest of the text. A group is closed when it is a
single document or its texts have ended, so equality is decided on the bytes themselves, never on a digest. Rows are
numbered in a table written first, so a row is found again by its number. Sizes and keepers of groups are aggregated before
the shuffle; the join that tells each row its group has one small row a group on the other side, so a group of any size can
be split between tasks.

Texts are equal when identical after lower-casing A-Z only. Cases: a null text counts as empty. Null ids sort first, so
a group's keeper has a null id only if all its ids are null. One row of a group stays, also where several rows share its
largest id. Empty tables give empty results; other columns, whatever their names, are kept by `exact_dedup` and ignored by
`exact_groups`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

FIRST, GROWTH = 64, 8


def numbered(docs: DataFrame, *columns) -> DataFrame:
    """The columns and a row number `row`, written, so that numbers stay the same whenever they are read."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "numbered")


def _normal(digest: bool, most: int | None = None):
    """Texts of column 1 in lower case (their first `most` bytes), after their digest if that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [(t or b"").lower() for t in part.column(1).to_pylist()]
                columns, names = [part.column(0)], ["row"]
                if digest:
                    columns, names = [*columns, pa.array([hashlib.sha256(t).hexdigest() for t in texts])], [*names, "text_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([t[:most] for t in texts], pa.binary()), part.column(2)], names=[*names, "rest", "doc_id"])

    return run


def _levels(src: DataFrame, first: int, growth: int, digest: bool) -> DataFrame:
    """row, doc_id, text_sha256 (null without `digest`), group_size, keep_id and kept, for src with row, text (binary) and doc_id."""
    short = "row long,rest binary,doc_id long"
    root, src = F.lit(0).cast("long").alias("root"), src.select("row", "text", "doc_id")
    keys = src.mapInArrow(_normal(False, first), short).select("*", root)
    rows = src.mapInArrow(_normal(digest), short.replace(",", ",text_sha256 string,", 1) if digest else short).select("*", root)
    if not digest:
        rows = rows.withColumn("text_sha256", F.lit(None).cast("string"))
    size, levels = first, []
    while True:
        head = F.substring("rest", 1, size)
        groups = keys.groupBy("root", head.alias("head")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("last"), F.min("row").alias("next")).where("n > 1")
        # The keys are computed anew, so that the join deals out both sides itself and a group's rows can go to several tasks.
        groups = groups.select(F.col("root").bitwiseXOR(F.lit(0).cast("long")).alias("at"), F.substring("head", 1, (1 << 31) - 1).alias("head"), "n", "last", "next")
        found = rows.join(groups, (rows["root"] == groups["at"]) & (head == groups["head"]), "left")
        alone, open_ = F.col("n").isNull(), F.col("n").isNotNull() & (F.octet_length("rest") >= size)
        level = written(
            found.select(
                "row", "doc_id", "text_sha256", F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), (alone | (F.col("row") == F.col("last.row"))).alias("kept"),
                F.when(open_, F.col("next")).alias("root"), F.when(open_, F.substring("rest", size + 1, (1 << 31) - 1)).alias("rest"),
            ), "radix",
        )
        levels.append(level.where("root IS NULL").drop("root", "rest"))
        keys = rows = level.where("root IS NOT NULL").select("row", "doc_id", "text_sha256", "root", "rest")
        if rows.isEmpty():
            break
        size = size * growth - size if len(levels) == 1 else size * growth
    done = levels[0]
    for level in levels[1:]:
        done = done.union(level)
    return done


def exact_groups(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    src = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return _levels(src, first, growth, True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The rows that stay, with all their columns."""
    src = numbered(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    own = src.select("row", F.col("doc.text").cast("binary").alias("text"), F.col("doc.doc_id").cast("long").alias("doc_id"))
    gone = _levels(own, first, growth, False).where("NOT kept").select("row")
    return src.join(gone, "row", "left_anti").select("doc.*")
