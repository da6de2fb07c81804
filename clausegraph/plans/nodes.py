"""Queries over nodes of the star-schema graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions import nodes as nx
from clausegraph.operators import nodes

from .fixture import ctes, fixture
from .ingest import DOCUMENT, SPARK_DOCUMENT
from .registry import query


@query(f"{ctes('keyed')} SELECT doc_id, type, count(*) AS n, count(DISTINCT node_key) AS n_keys, min(node_key) AS first_key, max(node_key) AS last_key FROM keyed GROUP BY doc_id, type")
def node_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "nodes").withColumn("node_key", nx.node_key())
    return rows.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_key").alias("n_keys"), F.min("node_key").alias("first_key"), F.max("node_key").alias("last_key"))


@query(f"{ctes('unodes')} SELECT doc_id, node_key, chunk_id, source_text FROM unodes")
def node_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "nodes")
    return nodes.unique_nodes(rows, ("chunk_id", "source_text", "question_id", "score", "definition", "modal")).select("doc_id", "node_key", "chunk_id", "source_text")


@query(f"""{ctes('nodes')}, r AS (SELECT doc_id, question_id, chunk_id, CASE WHEN chunk_id % 9 = 0 THEN 'NOTE' ELSE type END AS type, CASE WHEN chunk_id % 4 = 0 THEN '  ' ELSE ' ' || coalesce(term, party) || ' ' END AS a, coalesce(definition, action, right_text) AS b, upper(modal) AS m FROM nodes WHERE type IN ('DEFINITION', 'OBLIGATION', 'RIGHT'))
  SELECT doc_id, type, count(*) AS n, min(trim(a)) AS first_name, max(lower(m)) AS modal FROM r WHERE type <> 'NOTE' AND trim(a) <> '' GROUP BY doc_id, type""")
def node_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "nodes").where("type IN ('DEFINITION', 'OBLIGATION', 'RIGHT')")
    name = lambda c: F.when(F.col("chunk_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), c, F.lit(" ")))
    rows = rows.withColumns({"type": F.when(F.col("chunk_id") % 9 == 0, "note").otherwise(F.lower("type")), "term": name("term"), "party": name("party"), "modal": F.upper("modal")})
    got = nodes.clean_nodes(rows)
    return got.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("term", "party")).alias("first_name"), F.max("modal").alias("modal"))


@query(f"""{ctes('unodes')}, p AS (SELECT doc_id, chunk_id, term, definition, source_text FROM unodes WHERE type = 'DEFINITION')
  SELECT doc_id, chunk_id, 'DEFINITION' AS type, term, definition, source_text FROM p""")
def node_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of three shapes: an object, a bare list, and a list within prose that has a comma too many."""
    rows = fixture(spark, sf_dir, "unodes").where("type = 'DEFINITION'").select("doc_id", "chunk_id", F.to_json(F.struct("type", "term", "definition", "source_text")).alias("j"))
    shape = F.pmod(F.xxhash64("j"), F.lit(3))
    reply = F.when(shape == 0, F.concat(F.lit('{"nodes": ['), "j", F.lit("]}"))).when(shape == 1, F.concat(F.lit("["), "j", F.lit("]"))).otherwise(F.concat(F.lit("Here they are: ["), "j", F.lit(", ] as asked.")))
    return nodes.clean_nodes(nodes.parse_nodes(rows.select("doc_id", "chunk_id", reply.alias("reply")))).select("doc_id", "chunk_id", "type", "term", "definition", "source_text")


_ALIAS = f"""d AS (SELECT doc_id, chunk_id, term, source_text, definition || ' ("' || substring(term, 1, 3) || '")' AS definition, trim(substring(term, 1, 3)) AS short FROM nodes WHERE type = 'DEFINITION'),
  amap AS (SELECT doc_id, lower(CASE WHEN regexp_matches(term, '^[a-zA-Z0-9 _]{{3}}') THEN short ELSE term END) AS alias, max_by(CASE WHEN regexp_matches(term, '^[a-zA-Z0-9 _]{{3}}') THEN term ELSE definition END, (chunk_id, source_text, definition)) AS name FROM d GROUP BY ALL)"""


@query(f"{ctes('nodes')}, {_ALIAS} SELECT doc_id, alias, name FROM amap")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.alias_map(_quoted(spark, sf_dir))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "nodes")
    return rows.withColumn("definition", F.concat("definition", F.lit(' ("'), F.substring("term", 1, 3), F.lit('")')))


@query(f"""{ctes('nodes')}, {_ALIAS}, n AS (SELECT n.doc_id, chunk_id, coalesce(a.name, n.party3) AS party FROM (SELECT doc_id, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN ' ' || upper(substring(party, 1, 3)) ELSE party END AS party3 FROM nodes WHERE type IN ('OBLIGATION', 'RIGHT')) n
  LEFT JOIN amap a ON a.doc_id = n.doc_id AND a.alias = trim(lower(n.party3))) SELECT doc_id, party, count(*) AS n FROM n GROUP BY ALL""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "nodes").where("type IN ('OBLIGATION', 'RIGHT')")
    rows = rows.withColumn("party", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit(" "), F.upper(F.substring("party", 1, 3)))).otherwise(F.col("party")))
    got = nodes.resolve_parties(rows, nodes.alias_map(_quoted(spark, sf_dir)), ("party",))
    return got.groupBy("doc_id", "party").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{ctes('nodes')}, f AS (SELECT DISTINCT doc_id, chunk_id, source_text, trim(term) || ': ' || trim(definition) AS fact FROM nodes WHERE type = 'DEFINITION' AND lower(term) LIKE '%customer%')
  SELECT doc_id, string_agg(fact, ' | ' ORDER BY chunk_id, source_text, fact) AS definition FROM f GROUP BY doc_id""")
def contract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.contract_summary(fixture(spark, sf_dir, "nodes"))


@query(f"""{ctes('nodes')}, c AS (SELECT doc_id, chunk_id, source_text, trigger, consequence, lower(trigger || ' ' || consequence) AS t FROM nodes WHERE type = 'CONDITION'),
  x AS (SELECT *, regexp_extract(trigger, '(\\d+) days', 1) AS value, 'days' AS unit, substring(trigger, 1, 120) AS applies_to, 2 AS place FROM c),
  k AS (SELECT *, 'NUM::' || value || '::' || unit || '::' || substring(lower(applies_to), 1, 60) AS node_key FROM x WHERE value <> ''),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node_key ORDER BY chunk_id, source_text, trigger, place) AS nth FROM k) WHERE nth = 1)
  SELECT doc_id, unit, count(*) AS n, min(node_key) AS first_key, sum(CAST(value AS INT)) AS total FROM f GROUP BY ALL""")
def condition_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nodes.condition_numerics(fixture(spark, sf_dir, "nodes"))
    return got.where("unit IN ('days', '%')").groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("node_key").alias("first_key"), F.sum(F.expr("CAST(value AS INT)")).alias("total"))


#: Words that name tags and words that don't; a line's text holds three of them.
_TAGGED = (*[w for words, _ in nodes.TAG_RULES for w in words], "goods", "anvil", "nothing")
_TAG_LIST = "[" + ", ".join(f"'{w}'" for w in _TAGGED) + "]"
_TAG_TEXT = " || ' and ' || ".join(f"upper({_TAG_LIST}[1 + ({c}) % {len(_TAGGED)}])" for c in ("l_partkey", "l_suppkey", "l_orderkey // 7"))
_TAG_ROWS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(low, '{w}')" for w in words)} THEN [{', '.join(f"'{t}'" for t in tags)}] ELSE [] END" for words, tags in nodes.TAG_RULES)


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower({_TAG_TEXT}) AS low FROM lineitem), a AS (SELECT *, flatten([['days'], {_TAG_ROWS}]) AS tags FROM t)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i)[1:6], ',') AS tags FROM a""")
def value_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.upper(F.get(F.array(*map(F.lit, _TAGGED)), (k % len(_TAGGED)).cast("int")))
    text = F.concat_ws(" and ", pick(F.col("l_partkey")), pick(F.col("l_suppkey")), pick(F.floor(F.col("l_orderkey") / 7)))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(nodes.value_tags(text, ("days",)), ",").alias("tags"))


@query(f"""WITH t AS (SELECT unnest(['eanthe onthor', 'thing with', 'edition']) AS topic), w AS (SELECT DISTINCT topic, unnest(string_split(topic, ' ')) AS word FROM t),
  h AS (SELECT {DOCUMENT} AS doc_id, topic, documents.doc_id AS chunk_id, count(*) AS hits FROM documents, w WHERE length(word) > 3 AND contains(lower(text), word) GROUP BY ALL)
  SELECT doc_id, topic, chunk_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY hits DESC, chunk_id DESC) AS nth FROM h) WHERE nth <= 3""")
def gap_audit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{SPARK_DOCUMENT} AS doc_id", "doc_id AS chunk_id", "text AS chunk_text")
    topics = chunks.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, ("eanthe onthor", "thing with", "edition")))).alias("topic"))
    return nodes.topic_chunks(chunks, topics)


@query(f"{ctes('nodes')} SELECT DISTINCT n.doc_id, n.source_text FROM nodes n WHERE chunk_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.doc_id = n.doc_id AND m.source_text = n.source_text AND m.chunk_id % 2 = 0)")
def new_nodes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "nodes")
    return nodes.new_by_source(rows.where("chunk_id % 2 = 1"), rows.where("chunk_id % 2 = 0")).select("doc_id", "source_text").distinct()


@query(f"""{ctes('unodes')} SELECT doc_id, node_key, CASE type WHEN 'DEFINITION' THEN 'What does ' || term || ' mean? ' || term || ' means ' || definition WHEN 'OBLIGATION' THEN 'What must ' || party || ' do? ' || party || ' ' || modal || ' ' || action
  WHEN 'RIGHT' THEN 'Can ' || party || ' ' || right_text || '? ' || party || ' may ' || right_text WHEN 'NUMERIC' THEN 'What is the ' || applies_to || '? ' || applies_to || ': ' || value || ' ' || unit
  WHEN 'CONDITION' THEN 'What happens if ' || trigger || '? If ' || trigger || ' then ' || consequence WHEN 'BLANK' THEN 'What is the ' || field || '? ' || field || ' ' || context || ' is blank unfilled' ELSE 'reference to ' || ref_to || ' which describes ' || describes END AS search_text FROM unodes""")
def node_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "unodes").withColumns({n: F.lit(None).cast("string") for n in ("condition", "qualifiers", "limit_text")})
    return rows.select("doc_id", "node_key", nx.search_text().alias("search_text"))


@query(f"""{ctes('unodes')} SELECT doc_id, node_key, CAST(CASE type WHEN 'BLANK' THEN 0 WHEN 'NUMERIC' THEN 1 WHEN 'REFERENCE' THEN 0.75 WHEN 'DEFINITION' THEN CASE WHEN length(definition) > 20 THEN 1 ELSE 0.65 END
  WHEN 'OBLIGATION' THEN CASE WHEN modal LIKE '%not%' OR action LIKE 'not %' OR action LIKE 'no %' THEN 0.7 WHEN length(action) > 20 THEN 1 ELSE 0.8 END WHEN 'RIGHT' THEN CASE WHEN length(right_text) > 20 THEN 1 ELSE 0.8 END ELSE CASE WHEN length(consequence) > 20 THEN 1 ELSE 0.8 END END AS DOUBLE) AS specificity FROM unodes""")
def node_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "unodes").select("doc_id", "node_key", nx.specificity().alias("specificity"))


_CHUNKS = f"SELECT {DOCUMENT} AS doc_id, row_number() OVER (PARTITION BY {DOCUMENT} ORDER BY documents.doc_id) - 1 AS chunk_id, text AS chunk_text FROM documents"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{SPARK_DOCUMENT} AS doc_id", f"row_number() OVER (PARTITION BY {SPARK_DOCUMENT} ORDER BY doc_id) - 1L AS chunk_id", "text AS chunk_text")


@query(f"WITH c AS ({_CHUNKS}) SELECT doc_id, chunk_id FROM c WHERE chunk_id % 3 <> 0")
def zero_node_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return nodes.chunks_without_nodes(chunks, chunks.where("chunk_id % 3 = 0")).select("doc_id", "chunk_id")


@query(f"WITH c AS ({_CHUNKS}) SELECT doc_id, CAST(chunk_id // 3 AS BIGINT) AS batch, string_agg('[CHUNK ' || CAST(chunk_id AS VARCHAR) || ']' || chr(10) || substring(chunk_text, 1, 1500), chr(10) || chr(10) ORDER BY chunk_id) AS text FROM c GROUP BY ALL")
def extraction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.extraction_batches(_chunks(spark, sf_dir))


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id DESC) AS back FROM ({_CHUNKS}))
  SELECT doc_id, substring(string_agg(chunk_text, chr(10) ORDER BY chunk_id) FILTER (chunk_id < 2), 1, 3000) AS header, right(string_agg(chunk_text, chr(10) ORDER BY chunk_id) FILTER (back <= 2), 1200) AS signature FROM c GROUP BY doc_id""")
def header_and_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.edge_text(_chunks(spark, sf_dir))
