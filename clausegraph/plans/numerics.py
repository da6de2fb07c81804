"""Queries over numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions import numerics as nx
from clausegraph.operators import numerics

from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def extract_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.extract_numerics(read(spark, sf_dir, "documents"))


#: All spellings of units and some that are none; a line picks one, and how it is written.
_SPELLINGS = (*nx.UNIT_OF, "fortnights", "Daily", "", "day s")
_RAW = f"[{', '.join(repr(x) for x in _SPELLINGS)}]"
_KNOWN = ", ".join(f"('{raw}', '{unit}')" for raw, unit in nx.UNIT_OF.items())


@query(f"""WITH t(spelled, unit) AS (VALUES {_KNOWN}), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN upper({_RAW}[1 + l_partkey % {len(_SPELLINGS)}]) WHEN 1 THEN '  ' || {_RAW}[1 + l_partkey % {len(_SPELLINGS)}] || ' ' ELSE {_RAW}[1 + l_partkey % {len(_SPELLINGS)}] END AS raw FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(unit, trim(lower(raw))) AS unit FROM r LEFT JOIN t ON spelled = trim(lower(raw))""")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, _SPELLINGS)), (F.col("l_partkey") % len(_SPELLINGS)).cast("int"))
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.upper(word)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("  "), word, F.lit(" "))).otherwise(word)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nx.unit(raw).alias("unit"))


#: Keywords of all categories and words of none; a line's context holds two of them.
_HINTS = (*[w for _, words in nx.CATEGORIES for w in words], "goods", "of the", "Anvil", "nothing")
_HINT_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _HINTS) + "]"
_NAMED = "CASE " + " ".join("WHEN " + " OR ".join("contains(low, '" + w.replace("'", "''") + "')" for w in words) + f" THEN '{name}'" for name, words in nx.CATEGORIES) + " ELSE 'general' END"


@query(f"""WITH c AS (SELECT lower('The ' || {_HINT_LIST}[1 + l_partkey % {len(_HINTS)}] || ' x' || l_returnflag || ' ' || upper({_HINT_LIST}[1 + l_suppkey % {len(_HINTS)}])) AS low FROM lineitem) SELECT {_NAMED} AS category, count(*) AS n FROM c GROUP BY category""")
def category_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = lambda c: F.get(F.array(*map(F.lit, _HINTS)), (F.col(c) % len(_HINTS)).cast("int"))
    context = F.concat(F.lit("The "), hint("l_partkey"), F.lit(" x"), "l_returnflag", F.lit(" "), F.upper(hint("l_suppkey")))
    return read(spark, sf_dir, "lineitem").groupBy(nx.category(context).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST(p_size * 1000 + p_partkey % 100 AS DOUBLE) AS value FROM part")
def word_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spoken(n):
        ones, tens = F.array(*map(F.lit, nx.ONES)), F.array(*map(F.lit, nx.TENS))
        last = F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("-"), F.get(ones, n % 10)))
        return F.when(n < 20, F.get(ones, n)).otherwise(F.concat(F.get(tens, (n / 10).cast("int") - 2), last))

    part = read(spark, sf_dir, "part")
    phrase = F.concat_ws(" ", spoken(F.col("p_size")), F.lit("thousand and"), spoken((F.col("p_partkey") % 100).cast("int")))
    return part.select("p_partkey", nx.word_number(phrase).alias("value"))


_FACTS = "l_suppkey AS doc_id, l_returnflag AS category, l_quantity AS value, l_linestatus AS unit, repeat('x', CAST(l_linenumber AS INT)) AS context, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS position"
_MAP = f"m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category, value, unit ORDER BY length(context) DESC, position) AS nth FROM (SELECT {_FACTS} FROM lineitem)) WHERE nth = 1)"


@query(f"WITH {_MAP} SELECT doc_id, category, value, unit, context, position FROM m")
def numeric_map_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.numeric_map(read(spark, sf_dir, "lineitem").selectExpr(*_split(_FACTS)))


@query(f"WITH {_MAP} SELECT doc_id, category, value, unit, context, position, CAST(k AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY value, position) AS k FROM m) WHERE k <= 5")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.numeric_summary(read(spark, sf_dir, "lineitem").selectExpr(*_split(_FACTS)))


def _split(columns: str) -> list[str]:
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND abs(CAST(o_totalprice AS INT) % 1000 - CAST(l_extendedprice AS INT) % 1000) < 60)""")
def band_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey", "CAST(rint(o_totalprice) AS INT) % 1000 AS pos")
    right = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "CAST(rint(l_extendedprice) AS INT) % 1000 AS sp")
    return numerics.band_anti_join(left, right, "k", "pos", "sp", 60).select(F.col("k").alias("o_orderkey"), "o_custkey")
