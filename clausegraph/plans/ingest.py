"""Queries over pages: a document is a stretch of ids of a source, so documents keep their size as tables grow; its pages are rows of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.operators import ingest

from .registry import query

#: The document of a row of `documents`, in DuckDB's SQL and in Spark's.
DOCUMENT = "concat(source, '/', doc_id // 512)"
SPARK_DOCUMENT = DOCUMENT.replace("//", "DIV")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(SPARK_DOCUMENT).alias("doc_id"), F.col("doc_id").alias("page_no"), "text")


_LINES = rf"""lines AS (SELECT document AS doc_id, doc_id AS page_no, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM
  (SELECT {DOCUMENT} AS document, doc_id, string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS ls FROM documents))"""
_REPEATED = "repeated AS (SELECT doc_id, trim(line) AS stripped, count(DISTINCT page_no) AS pages FROM lines WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT page_no) >= 3)"


@query(f"WITH {_LINES}, {_REPEATED} SELECT * FROM repeated")
def repeating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.repeating_lines(pages(spark, sf_dir))


@query(f"""WITH {_LINES}, {_REPEATED}, kept AS (SELECT * FROM lines ANTI JOIN repeated ON lines.doc_id = repeated.doc_id AND trim(line) = stripped)
  SELECT d.document AS doc_id, d.doc_id AS page_no, coalesce(t, '') AS text FROM (SELECT *, {DOCUMENT} AS document FROM documents) d LEFT JOIN (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY pos) AS t FROM kept GROUP BY ALL) k ON k.doc_id = d.document AND k.page_no = d.doc_id""")
def strip_repeating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.strip_repeating_lines(pages(spark, sf_dir))


#: Re2 has no look-behind, so breaks are marked first.
_SENTENCES = rf"""sents AS (SELECT doc_id, page_no, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM (SELECT {DOCUMENT} AS doc_id, doc_id AS page_no, list_filter(list_transform(
  string_split(regexp_replace(text, '([.!?;])[)\]”"'']*\s+([A-Z"“”(\d])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32))), lambda x: x <> '') AS ss FROM documents))"""


@query(f"WITH {_SENTENCES} SELECT doc_id, page_no, pos, sentence FROM sents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sentence_rows(pages(spark, sf_dir)).drop("boilerplate")


@query(rf"""WITH {_SENTENCES}, t AS (SELECT doc_id, trim(sentence, chr(32)) AS s FROM sents)
  SELECT doc_id, count(*) AS n, count(*) FILTER (s = '' OR (length(s) < 40 AND NOT ends_with(s, ':')) OR (upper(s) = s AND regexp_matches(s, '[A-Z]{{3,}}'))
    OR regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:docusign|envelope\s+id)(?:[^\p{{L}}\p{{N}}_]|$)|\+?\d[\d\s().\-]{{6,}}\d|https?://|www\.|[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}|(?:^|[^\p{{L}}\p{{N}}_])(?:suite|ste|floor|fl|blvd|ave|st|rd|dr|ln|pkwy)(?:[^\p{{L}}\p{{N}}_]|$)')) AS n_boilerplate FROM t GROUP BY doc_id""")
def boilerplate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.sentence_rows(pages(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("boilerplate").alias("n_boilerplate"))


@query(rf"SELECT {DOCUMENT} AS doc_id, min(documents.doc_id) AS chunk_id FROM documents GROUP BY {DOCUMENT}, trim(regexp_replace(lower(text), '\s+', ' ', 'g'))")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_of_equal(pages(spark, sf_dir).selectExpr("doc_id", "page_no AS chunk_id", "text AS chunk_text")).select("doc_id", "chunk_id")


_HEADS = r"regexp_matches(line, '(?i)^\s*(?:\d+(?:\.\d+)*\.?\s|SECTION\s+\d+|Article\s+[A-Z\d]+|Schedule\s+[A-Z])') OR regexp_matches(line, '(?i)^([a-z])\.\s+([A-Z][^.]{2,50})\.\s*')"


@query(f"""WITH {_LINES}, s AS (SELECT *, coalesce(last_value(CASE WHEN ({_HEADS}) AND length(trim(line)) < 60 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no, pos), 'General') AS section FROM lines)
  SELECT doc_id, section, count(*) AS n_lines, min(page_no) AS first_page FROM s GROUP BY ALL""")
def section_parent_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.section_of_lines(pages(spark, sf_dir)).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("page_no").alias("first_page"))


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, page_no, pos, trim(line) AS line FROM lines),
  p AS (SELECT *, sum(CASE WHEN ({_HEADS}) OR before = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS para FROM (SELECT *, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS before FROM t))
  SELECT doc_id, CAST(para AS BIGINT) AS para, length(string_agg(line, ' ' ORDER BY page_no, pos)) AS n_chars, count(*) AS n_lines FROM p WHERE line <> '' GROUP BY ALL""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.paragraph_rows(pages(spark, sf_dir))
    return made.select("doc_id", "para", F.length("text").alias("n_chars"), "n_lines")


@query("SELECT doc_id, regexp_matches(text, '\\*\\*|___|\\[BLANK\\]') AS blank FROM documents")
def blank_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.blank_fields(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "blank")


@query()
def long_paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pack_paragraphs(pages(spark, sf_dir).selectExpr("doc_id", "page_no AS para", "text"))


@query("""WITH p AS (SELECT p_partkey AS para, p_name || ' includes: (a) ' || p_type || ' (b) ' || p_brand || ' (c) size ' || CAST(p_size AS STRING) AS text, p_name || ' includes:' AS h, [p_type, p_brand, 'size ' || CAST(p_size AS STRING)] AS b FROM part)
  SELECT para, unnest([0, 1, 2]) AS item, unnest([h || ' (a) ' || b[1], h || ' (b) ' || b[2], h || ' (c) ' || b[3]]) AS text FROM p""")
def enumerated_list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat("p_name", F.lit(" includes: (a) "), "p_type", F.lit(" (b) "), "p_brand", F.lit(" (c) size "), F.col("p_size").cast("string"))
    return ingest.split_lists(part.select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("para"), text.alias("text"))).drop("doc_id")


@query("""WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS para, CASE WHEN o_orderstatus = 'F' THEN 'Provided that order ' ELSE 'Order ' END || CAST(o_orderkey AS STRING) AS text, o_orderstatus = 'F' AS g FROM orders),
  q AS (SELECT *, sum(CASE WHEN g AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS rn FROM p))
  SELECT doc_id, min(para) AS para, string_agg(text, ' ' ORDER BY para) AS text FROM q GROUP BY doc_id, k""")
def guard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.when(F.col("o_orderstatus") == "F", "Provided that order ").otherwise("Order "), F.col("o_orderkey").cast("string"))
    return ingest.merge_guards(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("para"), text.alias("text")))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_documents(pages(spark, sf_dir))


@query("""WITH g AS (SELECT o_custkey AS doc_id, l_linenumber AS page_no, CAST(l_quantity AS INT) AS q, l_orderkey, l_returnflag AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  b AS (SELECT doc_id, page_no, round_even(q * 1.0 / 4, 0) * 4 AS band, l_orderkey * 10.0 AS x0, l_orderkey * 10.0 + 8 - l_orderkey % 3 AS x1, t FROM g),
  s AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 2.5 THEN ' ' ELSE '' END || t AS u FROM b WINDOW w AS (PARTITION BY doc_id, page_no, band ORDER BY x0, x1, t)),
  l AS (SELECT doc_id, page_no, band, string_agg(u, '' ORDER BY x0, x1, u) AS line FROM s GROUP BY ALL) SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY band, line) AS text FROM l GROUP BY ALL""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.expr("o_orderkey = l_orderkey"))
    return ingest.glyph_lines(rows.selectExpr("o_custkey AS doc_id", "l_linenumber AS page_no", "l_returnflag AS text", "l_orderkey * 10.0D AS x0", "l_orderkey * 10.0D + 8 - l_orderkey % 3 AS x1", "CAST(l_quantity AS INT) AS top"))
