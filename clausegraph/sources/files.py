"""Readers and writers of the library's artefacts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.schema import NODE_DDL

EVALUATION = ("Q", "Expected", "Slot type", "Slot score", "Path exists", "Path bottleneck", "N targets", "N well-conn", "H0 life", "Chain str", "Trig wt", "Sheaf cons", "Wt sheaf", "Wt Ricci μ", "Bridge scr", "Type H", "Path cov", "Mismatch", "SS frac", "Role inv", "Match frac", "Placeholder frac", "KwTrap")


def pdf_pages(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """doc_id (the path), page_no, text of PDF files. Needs a PDF library on the executors; raises at run time without one."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                pages = PdfReader(io.BytesIO(content)).pages
                texts = [p.extract_text() or "" for p in (pages if most is None else pages[:most])]
                yield pd.DataFrame({"doc_id": name, "page_no": range(len(texts)), "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(read, "doc_id string, page_no long, text string")


def pdf_glyphs(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """doc_id (the path), page_no, text, x0, x1, top of each glyph of PDF files, for `ingest.glyph_lines`; pages without glyphs have no rows.

    Needs a library that gives glyph positions on the executors; raises at run time without one."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for k, page in enumerate(pdf.pages if most is None else pdf.pages[:most]):
                        glyphs = page.chars
                        yield pd.DataFrame({"doc_id": name, "page_no": k, **{c: [g[c] for g in glyphs] for c in ("text", "x0", "x1", "top")}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(read, "doc_id string, page_no long, text string, x0 double, x1 double, top double")


def page_counts(spark: SparkSession, path: str, otherwise: int = 12) -> DataFrame:
    """doc_id (the path), pages of PDF files, at least 1; `otherwise` for a file that can't be read."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            pages = []
            for content in frame["content"]:
                try:
                    from pypdf import PdfReader

                    pages.append(max(1, len(PdfReader(io.BytesIO(content)).pages)))
                except Exception:  # a broken file, or no library: an estimate needs some number
                    pages.append(otherwise)
            yield pd.DataFrame({"doc_id": frame["path"], "pages": pages})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(count, "doc_id string, pages long")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), page_no, text of text files; a form feed ends a page."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return rows.select("doc_id", F.posexplode(F.split("value", "\f", -1)).alias("page_no", "text"))


def questions(spark: SparkSession, path: str, most: int = 40) -> DataFrame:
    """question_id, question: one for each line that isn't blank, up to `most` of a file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.slice(F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != ""), 1, most)).alias("question_id", "question"))
    return rows.select("file", "question_id", "question")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Typed nodes of documents: `[{chunk_id, chunk_text, nodes: [..]}]`, one file for each document."""
    ddl = "chunk_id long, chunk_text string, nodes array<struct<" + ", ".join(f"{n}: {t}" for n, t in (c.rsplit(" ", 1) for c in NODE_DDL.split(", ")[2:])) + ">>"
    rows = spark.read.schema(ddl).option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), "chunk_id", F.explode("nodes").alias("n")).select("doc_id", "chunk_id", "n.*")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of `{nodes: [..], edges: [{from, to, type, weight}]}`; a file without edges gives none."""
    rows = spark.read.schema("nodes array<string>, edges array<struct<`from`: string, `to`: string, type: string, weight: double>>").option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.explode("edges").alias("e")).select("doc_id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.type").alias("etype"), F.col("e.weight").alias("weight"))


def write_tables(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Document tables as Parquet, dealt by document, so that a reader of few documents reads few files."""
    for name, df in tables.items():
        df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("bucket")


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions, all columns as strings."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in EVALUATION)).csv(path, header=True, enforceSchema=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_events(df: DataFrame, path: str) -> None:
    """Telemetry events as JSON lines, beside those that are there."""
    df.write.mode("append").json(path)
