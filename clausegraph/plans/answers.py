"""Queries from questions to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions import questions as qx
from clausegraph.functions.layers import apply, as_sql
from clausegraph.operators import coverage as cv
from clausegraph.operators import evidence as ev
from clausegraph.operators import retrieval as rt
from clausegraph.operators import scoring

from . import api
from .fixture import ctes, fixture, questions
from .registry import query
from .topology import SLOTS, World

#: Questions that orders ask in turn.
TEXTS = (
    "What is the notice period?", "When does the term end?", "Can the customer return goods?", "What will happen if it fails next month?", "Which reports are listed in Exhibit A?", "What is the total value of the order form discount?",
    "Who is the current CEO of the vendor?", "What does the DPA say about security measures?", "Where is the pricing page located?", "What is the principal address of the customer?", "How often may audit reports be requested?",
    "How many items have been returned since the Effective Date?", "What are the exact terms of the appendix table?", "Must the vendor notify the Customer Group within 30 days?", "What is the percentage of the late fee per month?",
    "Is this customer entitled to a discount percentage?", "What does 'delivery date' mean?", "What is the legal name of the signed customer organization?", "What confidential emails did the parties exchange?", "What right does the Buyer have?",
    "What arbitration fee amount is in the schedule?", "Does the policy say about refunds?", "What are all obligations of each party?", "What happens if payment is overdue?",
)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


_ASKED = f"(SELECT o_orderkey AS question_id, {_list(TEXTS)}[1 + o_orderkey % {len(TEXTS)}] AS question, {_list(SLOTS)}[1 + o_orderkey % 7] AS slot FROM orders)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("question_id"), _pick(TEXTS, k % len(TEXTS)).alias("question"), _pick(SLOTS, k % 7).alias("slot"))


_INTENT_OUT = ("question_id", "exact_intent", "simple_extract", "speculative", "outside_document", "missing_artifact", "instance_missing", "external_reference", "expects_rule", "external_doc", "outside_needed", "answer_form", "proof")


@query(f"SELECT {', '.join(_INTENT_OUT)} FROM ({as_sql(_ASKED, qx.INTENT)})")
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qx.intent(asked(spark, sf_dir)).select(*_INTENT_OUT)


@query(f"SELECT {', '.join(f'CAST(count(*) FILTER (asks_{n}) AS BIGINT) AS {n}' for n in qx.WORDS)} FROM ({as_sql(_ASKED, qx.INTENT[:2])})")
def intent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qx.intent(asked(spark, sf_dir)).agg(*[F.count_if(f"asks_{n}").alias(n) for n in qx.WORDS])


#: Parts of parsed questions; an order's number picks one of each, so that all of them meet.
VERBS = ("must pay", "means", "ends", "returns", "is", "requires to comply", "exists", "Define the", "shall be defined", "demeaning", "", "may audit")
ENTITIES = ("the Customer", "", "Vendor Group", "goods", "Licensee", "either party", "Wipro")
OBJECTS = ("fees", "order", "meaning of goods", "term", "", "the definition", "spare parts")


def _any(text: str, words) -> str:
    """SQL of whether a text holds one of the words."""
    return "(" + " OR ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"


_PARTS = f"SELECT o_orderkey, lower({_list(VERBS)}[1 + o_orderkey % {len(VERBS)}]) AS v, lower({_list(ENTITIES)}[1 + o_custkey % {len(ENTITIES)}]) AS e, lower({_list(OBJECTS)}[1 + (o_orderkey // 3) % {len(OBJECTS)}]) AS o, o_orderkey % 11 = 0 AS number FROM orders"


@query(f"""SELECT o_orderkey, CASE WHEN number THEN 'NUMERIC' WHEN len(list_intersect(string_split_regex(v, '\\W+'), {_list(qx.DEFINITION_VERBS)})) > 0 OR contains(o, 'definition') OR contains(o, 'meaning') THEN 'DEFINITION'
  WHEN {_any('v', qx.DUTY_VERBS)} THEN 'OBLIGATION' WHEN e <> '' AND {_any('e', qx.PARTIES)} THEN 'PARTY_SPECIFIC' ELSE 'GENERAL' END AS question_type FROM ({_PARTS})""")
def question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rows = F.col("o_orderkey"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = _pick(VERBS, k % len(VERBS)), _pick(ENTITIES, F.col("o_custkey") % len(ENTITIES)), _pick(OBJECTS, F.floor(k / 3) % len(OBJECTS))
    return rows.select("o_orderkey", qx.question_type(*parts, k % 11 == 0).alias("question_type"))


@query(f"""SELECT question_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(question, '[''"]([^''"]{{3,}})[''"]', 1), lambda x: lower(x)), list_transform(regexp_extract_all(question, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1), lambda x: lower(x)),
  list_filter(regexp_extract_all(question, '\\b([a-z]{{6,}})\\b', 1), lambda w: NOT list_contains({_list(qx.GENERIC)}, w))))), ',') AS terms FROM {_ASKED}""")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("question_id", F.array_join(F.array_sort(qx.keywords("question")), ",").alias("terms"))




_KINDS = ("GENERAL", "NUMERIC", "RIGHT", "OBLIGATION", "GENERAL", "CONDITION", "DEFINITION")
_MODALS = ("shall not", "shall", "", "cannot", "may")
_WORDED = f"""SELECT question_id, question, lower(question) AS q, {_list(_KINDS)}[1 + question_id % 7] AS kind, question_id % 9 = 0 AS number, {_list(_MODALS)}[1 + (question_id // 2) % 5] AS modal, lower({_list(VERBS)}[1 + (question_id // 3) % {len(VERBS)}]) AS v FROM {_ASKED}"""
_BY_WORDS = (
    ("VALUE", "number"), ("MEANING", f"({_any('v', qx.DEFINING)} OR {_any('q', qx.SLOT_WORDS['MEANING'])})"), ("PERMISSION", _any("q", qx.SLOT_WORDS["PERMISSION"])), ("ACTOR", _any("q", qx.SLOT_WORDS["ACTOR"])),
    ("CONSEQUENCE", _any("q", qx.SLOT_WORDS["CONSEQUENCE"])), ("REQUIREMENT", f"(regexp_matches(q, '\\b(must|shall|should)\\b') OR {_any('q', qx.SLOT_WORDS['REQUIREMENT'])})"),
)


@query(f"""WITH w AS ({_WORDED}), s AS (SELECT *, CASE WHEN kind = 'NUMERIC' OR (number AND kind <> 'GENERAL') THEN ['VALUE'] WHEN kind = 'DEFINITION' THEN ['MEANING'] WHEN kind = 'RIGHT' THEN ['PERMISSION']
    WHEN kind = 'OBLIGATION' AND (contains(modal, 'not') OR contains(modal, 'cannot')) THEN ['PERMISSION'] WHEN kind = 'OBLIGATION' THEN ['REQUIREMENT'] WHEN kind = 'CONDITION' THEN ['CONSEQUENCE']
    ELSE list_filter([{', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _BY_WORDS)}], lambda x: x IS NOT NULL) END AS slots FROM w),
  d AS (SELECT *, CASE WHEN regexp_matches(question, '{qx.DATE_QUESTION}') AND NOT list_contains(slots, 'VALUE') THEN list_append(slots, 'VALUE') ELSE slots END AS dated FROM s)
  SELECT question_id, kind, CASE WHEN len(dated) = 0 THEN 'GENERAL' ELSE array_to_string(dated, ',') END AS slots FROM d""")
def required_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("question_id")
    rows = asked(spark, sf_dir).withColumns({"kind": _pick(_KINDS, k % 7), "modal": _pick(_MODALS, F.floor(k / 2) % 5), "v": _pick(VERBS, F.floor(k / 3) % len(VERBS))})
    return rows.select("question_id", "kind", F.array_join(qx.required_slots("question", "kind", k % 9 == 0, "modal", "v"), ",").alias("slots"))


_ACTIONS = (("be entitled to receive version upgrades", "receive", "version upgrades"), ("Sublicense to affiliates", "sublicense", "affiliates"), ("is allowed to audit Wipro", "audit", "wipro"), ("terminate", "terminate", ""), ("not sublicense to third parties", "not", "sublicense to third parties"))


@query(f"SELECT o_orderkey, {_list([a[1] for a in _ACTIONS])}[1 + o_orderkey % 5] AS verb, {_list([a[2] for a in _ACTIONS])}[1 + o_orderkey % 5] AS object FROM orders")
def action_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb, obj = qx.verb_and_object(_pick([a[0] for a in _ACTIONS], F.col("o_orderkey") % 5))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", verb.alias("verb"), obj.alias("object"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'licensee' WHEN 1 THEN 'wipro' WHEN 2 THEN 'vendor' ELSE '' END AS party FROM orders")
def question_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("What are Wipro and the Licensee's rights to audit?", "What rights does Wipro have over the licensee?", "Does the vendor owe wipro?", "Is it so?")
    parties = F.array(F.lit("wipro"), F.lit("licensee"), F.lit("vendor"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", qx.asked_party(_pick(texts, F.col("o_orderkey") % 4), parties).alias("party"))


# retrieval

_TYPES = ("DEFINITION", "OBLIGATION", "RIGHT", "NUMERIC", "CONDITION", "BLANK", "REFERENCE", "DEFINITION", "OBLIGATION", "NUMERIC")
_QTYPES = ("DEFINITION", "NUMERIC", "OBLIGATION", "PARTY_SPECIFIC", "GENERAL")
_COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(n.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[]))))"
_SIM = f"sim AS (SELECT q.vec_id AS question_id, n.vec_id AS node_no, {_COS} AS score, {_list(_TYPES)}[1 + n.label] AS type, {_list(_QTYPES)}[1 + (q.vec_id // 20) % 5] AS qtype FROM embeddings q, embeddings n WHERE q.vec_id % 20 = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit(0).alias("doc_id"), F.col("vec_id").alias("node_no"), F.col("embedding").alias("vector"), _pick(_TYPES, F.col("label")).alias("type"))
    asks = e.where("node_no % 20 = 0").select(F.col("node_no").alias("question_id"), "doc_id", "vector", _pick(_QTYPES, F.floor(F.col("node_no") / 20) % 5).alias("qtype"))
    return asks, e


@query(f"WITH {_SIM} SELECT question_id, node_no, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_no) AS rank FROM sim) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, e = _vectors(spark, sf_dir)
    return rt.nearest(asks, e, 10).select("question_id", "node_no", "rank")


_OK = "(" + " OR ".join(f"(qtype = '{q}' AND type IN ({', '.join(repr(k) for k in kinds)}))" for q, kinds in rt.BUCKETS.items()) + ")"


@query(f"""WITH {_SIM}, o AS (SELECT *, {_OK} AS ok, count(*) FILTER ({_OK}) OVER (PARTITION BY question_id) AS n_ok FROM sim), s AS (SELECT question_id, node_no, CASE WHEN ok THEN score ELSE score * 0.8 END AS score FROM o WHERE ok OR n_ok < 120)
  SELECT question_id, node_no, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_no) AS rank FROM s) WHERE rank <= 120""")
def type_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, e = _vectors(spark, sf_dir)
    scored = rt.similarities(asks, e).join(asks.select("question_id", "qtype"), "question_id").join(e.select("node_no", "type"), "node_no")
    return rt.bucket_top_k(scored, 120).select("question_id", "node_no", "rank")


#: Terms of a customer's question: its name and two words of part names.
_TERMS = "['customer#' || lpad(CAST(c_custkey AS STRING), 9, '0'), ['red', 'cold', 'small', 'new', 'hot', 'blue'][1 + c_custkey % 6], 'order ' || CAST(c_custkey % 10 AS STRING)]"
_ASKS = f"asks AS (SELECT c_custkey AS question_id, c_custkey // 20 AS doc_id, {_TERMS} AS terms FROM customer)"
_NUMBERED = "numbered AS (SELECT doc_id, node_key, source_text || ' ' || node_key AS text, row_number() OVER (PARTITION BY doc_id ORDER BY node_key) AS node_no FROM unodes)"


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = fixture(spark, sf_dir, "unodes").selectExpr("doc_id", "node_key", "source_text || ' ' || node_key AS text", "row_number() OVER (PARTITION BY doc_id ORDER BY node_key) AS node_no")
    terms = "array('customer#' || lpad(CAST(c_custkey AS STRING), 9, '0'), array('red', 'cold', 'small', 'new', 'hot', 'blue')[CAST(c_custkey % 6 AS INT)], 'order ' || CAST(c_custkey % 10 AS STRING))"
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS question_id", "c_custkey DIV 20 AS doc_id", f"{terms} AS terms"), nodes


_HITS = "len(list_filter(terms, lambda t: contains(lower(text), t)))"


@query(f"""{ctes('unodes')}, {_ASKS}, {_NUMBERED}, h AS (SELECT question_id, node_no, {_HITS} AS hits FROM asks JOIN numbered USING (doc_id) WHERE node_no > 20)
  SELECT question_id, node_no, CAST(hits AS INT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, node_no DESC) AS nth FROM h WHERE hits > 0) WHERE nth <= 12""")
def keyword_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, nodes = _numbered(spark, sf_dir)
    top = asks.join(nodes.where("node_no <= 20"), "doc_id").select("question_id", "node_no")
    return rt.keyword_augment(asks, nodes, top).select("question_id", "node_no", "hits")


@query(f"""{ctes('unodes')}, {_ASKS}, {_NUMBERED}, h AS (SELECT question_id, node_no, (node_no * 7 % 100) / 100.0 AS score, {_HITS} AS hits FROM asks JOIN numbered USING (doc_id) WHERE node_no <= 20),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_no) AS r0 FROM h) SELECT question_id, node_no, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CAST(score AS DOUBLE) + CAST(0.02 AS DOUBLE) * hits DESC, r0) AS INT) AS rank FROM r""")
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, nodes = _numbered(spark, sf_dir)
    top = asks.join(nodes.where("node_no <= 20"), "doc_id").selectExpr("question_id", "node_no", "text", "terms", "CAST(node_no * 7 % 100 AS DOUBLE) / 100 AS score")
    top = top.selectExpr("*", "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_no) AS rank")
    return rt.keyword_boost(top).select("question_id", "node_no", "rank")


_VOTED = f"{ctes('survivors')}, f AS (SELECT s.question_id, s.node_key, s.type, v, s.score - v / 100.0 AS score FROM survivors s, (SELECT unnest(range(0, 7)) AS v) WHERE (s.idx + s.question_id + v * (1 + s.idx % 4)) % 5 = 0), v AS (SELECT question_id, node_key, any_value(type) AS type, count(DISTINCT v) AS votes, round(max(score), 6) AS score, count(DISTINCT v) / 7.0 AS vote_frac FROM f GROUP BY question_id, node_key)"


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "survivors")
    found = s.select("question_id", "node_key", "idx", "score", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("variant")).where("(idx + question_id + variant * (1 + idx % 4)) % 5 = 0").withColumn("score", F.col("score") - F.col("variant") / 100)
    return rt.votes(found, F.lit(7.0)).withColumn("score", F.round("score", 6)).join(s.select("question_id", "node_key", "type"), ["question_id", "node_key"])


@query(f"{_VOTED} SELECT question_id, node_key, votes, score, vote_frac FROM v")
def vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).drop("type")


@query(f"""{_VOTED}, t AS (SELECT *, CASE WHEN votes >= 2 OR (score >= 0.82 AND type <> 'BLANK') THEN 1 WHEN type = 'BLANK' THEN 2 WHEN type = 'DEFINITION' AND score >= 0.65 THEN 3 END AS tier FROM v),
  n AS (SELECT *, row_number() OVER (PARTITION BY question_id, tier ORDER BY score DESC, node_key) AS nth FROM t WHERE tier IS NOT NULL)
  SELECT question_id, node_key, tier, CAST(row_number() OVER (PARTITION BY question_id ORDER BY tier, CASE WHEN tier = 1 THEN vote_frac ELSE 0 END DESC, score DESC, node_key) AS INT) AS rank FROM n WHERE tier <> 2 OR nth <= 5""")
def tier_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.tiers(_voted(spark, sf_dir)).select("question_id", "node_key", "tier", "rank")


@query(f"{_VOTED} SELECT u.question_id, u.node_key, CAST(0 AS BIGINT) AS votes, CAST(0.5 AS DOUBLE) AS score FROM (SELECT DISTINCT question_id, node_key FROM survivors WHERE type IN ('DEFINITION', 'BLANK')) u ANTI JOIN (SELECT * FROM v WHERE votes >= 2) v USING (question_id, node_key)")
def priority_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = fixture(spark, sf_dir, "survivors").where("type IN ('DEFINITION', 'BLANK')").select("question_id", "node_key").distinct()
    return rt.injected(_voted(spark, sf_dir).where("votes >= 2"), extra, rt.PRIORITY_SCORE).select("question_id", "node_key", "votes", "score")


@query(f"{ctes('unodes')} SELECT doc_id, type, count(*) AS n FROM unodes WHERE source_text <> '' AND ((type = 'NUMERIC' AND lower(unit) <> 'section') OR (type = 'DEFINITION' AND chunk_id % 2 = 0) OR type = 'BLANK') GROUP BY ALL")
def numeric_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fixture(spark, sf_dir, "unodes").withColumn("value_tags", F.when(F.col("chunk_id") % 2 == 0, F.array(F.lit("Rate"))).otherwise(F.array(F.lit("other"))))
    return rt.numeric_index(nodes).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{ctes('survivors')}, b AS (SELECT question_id, idx AS node_no, type, CASE WHEN type = 'BLANK' THEN 0.95 ELSE least(0.95, score) - (question_id % 5) / 10.0 END AS s FROM survivors WHERE question_id % 11 > 0),
  m AS (SELECT question_id, max(s) AS top, max(s) FILTER (type <> 'BLANK') AS other FROM b GROUP BY ALL), w AS (SELECT b.question_id, min(b.node_no) AS node_no FROM b JOIN m ON m.question_id = b.question_id AND b.s = m.top GROUP BY ALL)
  SELECT w.question_id, w.node_no, b.type = 'BLANK' AS is_blank FROM w JOIN b ON b.question_id = w.question_id AND b.node_no = w.node_no JOIN m ON m.question_id = w.question_id WHERE CASE WHEN b.type = 'BLANK' THEN top >= 0.70 AND coalesce(other, 0) < 0.62 ELSE top >= 0.74 END""")
def numeric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("question_id") % 11 == 0, "What has happened to date?").otherwise("What is the price?")
    s = F.when(F.col("type") == "BLANK", 0.95).otherwise(F.least(F.lit(0.95), F.col("score")) - F.col("question_id") % 5 / 10.0)
    rows = fixture(spark, sf_dir, "survivors").select("question_id", text.alias("question"), F.col("idx").alias("node_no"), "type", s.alias("score"))
    return rt.numeric_lookup(rows).select("question_id", "node_no", "is_blank")


@query("""WITH r AS (SELECT l_orderkey AS question_id, l_linenumber AS run, bool_or(l_returnflag = 'A') AS yes, max(l_discount) AS s FROM lineitem GROUP BY ALL), b AS (SELECT question_id, avg(yes::INT) AS vote_fraction, min(run) FILTER (yes) AS first_yes, max(s) AS top FROM r GROUP BY ALL)
  SELECT b.question_id, vote_fraction, CAST(coalesce(first_yes, (SELECT min(run) FROM r WHERE r.question_id = b.question_id AND r.s = b.top)) AS INT) AS primary_run FROM b""")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("run")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("answerable"), F.max("l_discount").alias("slot_score"))
    return rt.ensemble(runs)


# coverage


@query(f"{ctes('unodes')} SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(party), '\\b([a-z]{{4,}})\\b', 1)) AS word FROM unodes) GROUP BY ALL HAVING count(*) >= 10")
def party_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.party_tokens(fixture(spark, sf_dir, "unodes"))


_ANCHORED = "anch AS (SELECT question_id, doc_id, CASE WHEN question_id % 4 = 0 THEN [] ELSE [['deliver', 'insuran', 'returnx'][1 + question_id % 3], 'widget'] END AS a FROM (SELECT DISTINCT question_id, doc_id FROM survivors))"
_CONCEPT = "lower(concat_ws(' ', source_text, action, right_text, term, definition, trigger, consequence, applies_to))"


def _anchored(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    words = ("delivery", "insurance", "returnxx")
    text = F.when(F.col("question_id") % 4 == 0, "Is it so?").otherwise(F.concat(F.lit("Which "), _pick(words, F.col("question_id") % 3), F.lit(" has the Customer of the widget agreement?")))
    return questions(spark, sf_dir, by).withColumn("anchors", cv.anchors(text, F.array(F.lit("customer"))))


@query(f"{ctes('survivors')}, {_ANCHORED} SELECT a.question_id, len(any_value(a.a)) = 0 OR bool_or(len(list_filter(a.a, lambda x: contains({_CONCEPT}, x))) > 0) AS passes FROM anch a JOIN survivors s ON s.question_id = a.question_id GROUP BY a.question_id")
def pivot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.pivot_gate(_anchored(spark, sf_dir, "c_custkey"), fixture(spark, sf_dir, "survivors"))


@query(f"{ctes('survivors')}, {_ANCHORED} SELECT a.question_id, len(any_value(a.a)) = 0 OR bool_or(len(list_filter(a.a, lambda x: contains({_CONCEPT}, x))) > 0) AS present FROM anch a JOIN unodes n ON n.doc_id = a.doc_id GROUP BY a.question_id")
def concept_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.concept_presence(_anchored(spark, sf_dir, "doc_id"), fixture(spark, sf_dir, "unodes", write=False))


_SLOTTED = f"""sl AS (SELECT s.question_id, s.idx, s.type, s.votes, s.modal, s.definition, s.action, s.right_text, s.consequence, s.party, s.value, s.source_text, s.unit, {_list(SLOTS)}[1 + s.question_id % 7] AS slot, (s.idx * 13 % 50 + 50) / 100.0 AS sim FROM survivors s),
  sp AS (SELECT *, CASE type WHEN 'BLANK' THEN 0 WHEN 'NUMERIC' THEN 1 WHEN 'REFERENCE' THEN 0.75 WHEN 'DEFINITION' THEN CASE WHEN length(definition) > 20 THEN 1 ELSE 0.65 END WHEN 'OBLIGATION' THEN CASE WHEN modal LIKE '%not%' OR action LIKE 'not %' OR action LIKE 'no %' THEN 0.7 WHEN length(action) > 20 THEN 1 ELSE 0.8 END WHEN 'RIGHT' THEN CASE WHEN length(right_text) > 20 THEN 1 ELSE 0.8 END ELSE CASE WHEN length(consequence) > 20 THEN 1 ELSE 0.8 END END AS spec FROM sl),
  pv(type, slot) AS (VALUES {', '.join(f"('{k}', '{s}')" for k, ss in cv.PROVIDES.items() for s in ss)}),
  sc AS (SELECT sp.*, CASE WHEN sp.type = 'BLANK' THEN 0 WHEN sp.slot = 'GENERAL' THEN 0.5 * sim * spec WHEN pv.slot IS NULL THEN 0 WHEN sp.slot = 'PERMISSION' AND question_id % 2 = 0 AND sp.type = 'OBLIGATION' AND (modal LIKE '%not%' OR action LIKE 'not %' OR action LIKE 'no %') THEN 0 ELSE sim * spec END AS slot_score FROM sp LEFT JOIN pv ON pv.type = sp.type AND pv.slot = sp.slot)"""


def _slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "survivors").withColumns({"slot": _pick(SLOTS, F.col("question_id") % 7), "subject_sim": (F.col("idx") * 13 % 50 + 50) / 100, "open_ended": F.col("question_id") % 2 == 0, "is_date": F.lit(False), "focus": F.lit("generic")})
    none = {n: F.lit(None).cast("string") for n in ("beneficiary", "question_entity", "object_party")} | {n: F.lit(None).cast("double") for n in ("verb_sim", "object_sim")}
    return cv.node_slot_score(s.withColumns(none))


@query(f"{ctes('survivors')}, {_SLOTTED} SELECT question_id, idx, slot, slot_score FROM sc")
def node_slot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slotted(spark, sf_dir).select("question_id", "idx", "slot", "slot_score")


_EXPECT = ", ".join(f"('{s}', '{k}')" for s, ks in cv.EXPECTED.items() for k in ks)


@query(f"""{ctes('survivors')}, {_SLOTTED}, ep(slot, type) AS (VALUES {_EXPECT}), tt AS (SELECT *, slot_score * (0.85 + 0.15 * votes / greatest(1, max(votes) OVER (PARTITION BY question_id))) AS s FROM sc WHERE idx < 20),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, idx) AS nth FROM tt) WHERE nth = 1),
  c AS (SELECT b.question_id, CASE WHEN s >= 0.65 AND b.question_id % 3 = 0 AND ep.slot IS NOT NULL THEN s * 0.6 WHEN s >= 0.65 AND b.question_id % 3 = 0 THEN 0 WHEN s >= 0.65 AND b.question_id % 5 = 0 THEN 0 ELSE s END AS coverage FROM b LEFT JOIN ep ON ep.slot = b.slot AND ep.type = b.type)
  SELECT question_id, coverage, CASE WHEN coverage >= 0.65 THEN 'answerable' WHEN coverage <= 0.35 THEN 'unanswerable' ELSE 'uncertain' END AS verdict FROM c""")
def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slotted(spark, sf_dir).withColumn("first_slot", F.col("slot"))
    gates = rows.select("question_id").distinct().selectExpr("question_id", "question_id % 3 <> 0 AS passes", "question_id % 5 <> 0 AS present")
    return cv.coverage(rows, gates)


# scores and verdicts

#: Measures of a record, dealt by the order's number so that all branches are taken.
_DEAL = {
    "lane": "CASE k % 13 WHEN 0 THEN 'dependency_risk' WHEN 1 THEN 'speculative_outside' WHEN 2 THEN 'direct_rule' WHEN 3 THEN 'exact_value' ELSE 'mixed' END", "said_source": "CASE k % 5 WHEN 0 THEN 'base_clause' WHEN 1 THEN 'external_artifact' WHEN 2 THEN 'base_clause' END",
    "said_sufficiency": "CASE k % 6 WHEN 0 THEN 'clause_quote_enough' WHEN 1 THEN 'artifact_contents_required' WHEN 2 THEN 'explicit_value_required' END", "said_inline": "(k % 21) / 20.0", "said_reference_only": "(k % 7) / 10.0", "said_instance_missing": "(k % 3) / 10.0", "said_runtime_missing": "(k % 4) / 10.0",
    "n_slots": "CAST(1 + k % 2 AS INT)", "n_matched": "CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE 1 + k % 2 END AS INT)", "n_direct": "CAST(k % 2 AS INT)", "slot_score": "(k % 11) / 10.0", "path_exists": "k % 10 > 0", "path_bottleneck": "CASE WHEN k % 10 > 0 THEN (k % 17) / 20.0 END",
    "h0": "CASE WHEN k % 8 > 0 THEN (k % 19) / 25.0 END", "trigger_weight": "CASE WHEN k % 3 > 0 THEN (k % 23) / 30.0 END", "sheaf": "(k % 29) / 28.0", "w_sheaf": "(k % 31) / 30.0", "w_ricci": "0.0 - (k % 37) / 36.0", "bridge": "0.0 - (k % 41) / 40.0", "exact_frac": "(k % 43) / 42.0", "distant_frac": "(k % 47) / 100.0",
    "sequence_frac": "(k % 3) / 2.0", "n_targets": "CAST(k % 14 AS INT)", "n_well": "CAST((k % 14) // 2 AS INT)", "n_nodes": "CAST(20 AS INT)", "chain": "CASE WHEN k % 4 > 0 THEN (k % 53) / 52.0 END", "type_entropy": "(k % 59) / 20.0", "placeholder_frac": "CASE WHEN k % 6 = 0 THEN (k % 5) / 10.0 END", "party_mismatch": "CASE WHEN k % 2 = 0 THEN (k % 61) / 120.0 END",
    "role_inversion": "CASE WHEN k % 5 = 0 THEN 0.1 END", "trap": "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END", "trap_confidence": "(k % 4) / 10.0", "support": "CASE WHEN k % 12 > 0 THEN (k % 67) / 66.0 END", "support_explicit": "CASE WHEN k % 3 = 0 THEN 0.35 ELSE 1.0 END", "support_match": "(k % 20) / 20.0",
    "support_type": "CASE k % 3 WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'OBLIGATION' ELSE 'RIGHT' END", "support_text": "CASE WHEN k % 2 = 0 THEN 'the customer shall pay' ELSE 'goods of the order' END", "n_reference": "CAST(k % 4 AS INT)", "n_blank": "CAST(k % 2 AS INT)", "n_content": "CAST(15 AS INT)", "has_tags": "k % 2 = 0", "ref_only_ratio": "(k % 10) / 20.0",
    "inline_ratio": "(k % 9) / 20.0", "doc_match_ratio": "(k % 8) / 20.0", "related_ratio": "(k % 6) / 20.0", "n_vote_ge2": "CAST(k % 4 AS INT)",
}
_DEALT = f"(SELECT a.question_id, question, slot, {', '.join(f'{e} AS {n}' for n, e in _DEAL.items())} FROM (SELECT *, question_id AS k FROM {_ASKED}) a)"
_VERDICT_OUT = ("question_id", "round(score, 9) AS score", "round(threshold, 9) AS threshold", "reasons", "answerable", "confidence")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = lambda e: e.replace("//", "DIV").replace(".0", ".0D")
    # Scoring a row takes far longer than moving it, and a small file is one partition.
    rows = asked(spark, sf_dir).withColumn("k", F.col("question_id")).repartition("question_id")
    return qx.intent(rows.select("question_id", "question", "slot", *[F.expr(spell(e)).alias(n) for n, e in _DEAL.items()]))


@query(f"SELECT {', '.join(_VERDICT_OUT)} FROM ({as_sql(_DEALT, qx.INTENT + scoring.LAYERS)})")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(records(spark, sf_dir)).selectExpr(*_VERDICT_OUT)


@query(f"SELECT question_id, round(t, 9) AS topic, round(risk, 9) AS risk, round(a, 9) AS answer, round(d, 9) AS disagreement, round(q2, 9) AS dependency, route, source FROM ({as_sql(_DEALT, qx.INTENT + scoring.LAYERS)})")
def answer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(records(spark, sf_dir)).selectExpr("question_id", "round(t, 9) AS topic", "round(risk, 9) AS risk", "round(a, 9) AS answer", "round(d, 9) AS disagreement", "round(q2, 9) AS dependency", "route", "source")


_READERS = {"n_runs": "3", "vote_fraction": "(question_id % 4) / 3.0", "reader_confidence": "CASE question_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END", "coverage": "(question_id % 10) / 10.0", "runtime_check": "question_id % 17 = 0", "has_blank": "question_id % 7 = 0", "retry_yes": "question_id % 19 = 0"}


@query(f"SELECT question_id, final, failures, final_confidence FROM ({as_sql(_DEALT, qx.INTENT + scoring.LAYERS + [_READERS] + scoring.ARBITRATION)})")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.arbitrate(apply(scoring.score(records(spark, sf_dir)), [_READERS])).select("question_id", "final", "failures", "final_confidence")


@query(f"SELECT question_id, retry_wide, retry_chunks, number_bypass FROM ({as_sql(_DEALT, qx.INTENT + scoring.LAYERS + [_READERS] + scoring.ARBITRATION + [scoring.RETRIES])})")
def retry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.retries(scoring.arbitrate(apply(scoring.score(records(spark, sf_dir)), [_READERS]))).select("question_id", "retry_wide", "retry_chunks", "number_bypass")


@query(f"""SELECT question_id, least(1.0, greatest(0.0, CASE WHEN question_id % 3 = 0 THEN exact_intent ELSE 0.2 * exact_intent + 0.8 * (question_id % 10) / 5.0 END)) AS exact_intent, CASE WHEN question_id % 3 = 0 THEN proof WHEN question_id % 3 = 1 THEN 'definition' ELSE 'mixed' END AS proof FROM ({as_sql(_ASKED, qx.INTENT)})""")
def intent_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = {"said_exact_intent": F.when(F.col("question_id") % 3 > 0, F.col("question_id") % 10 / 5), "said_proof": F.when(F.col("question_id") % 3 == 1, " Definition ").when(F.col("question_id") % 3 == 2, "unheard of")}
    return qx.blend(qx.intent(asked(spark, sf_dir)).withColumns(said)).select("question_id", "exact_intent", "proof")


@query(f"SELECT question_id, CASE WHEN question_id % 2 = 0 THEN ['Is it so?', 'Or so?', question] ELSE [question, question, question] END AS variants, NOT regexp_matches(question, '(?i)^(can|does|do|is|are|has|have|did|was|were|will|would|could|should|may|shall|must|ought|need) ') AS open_ended FROM {_ASKED}")
def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("question_id") % 2 == 0, "Here are some:\n Is it so?\r\nOr so?")
    return asked(spark, sf_dir).select("question_id", qx.variants("question", reply, 3).alias("variants"), qx.is_open("question").alias("open_ended"))


# evidence


def _clauses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = World(spark, sf_dir)
    named = F.col("question_id") % 3 == 0
    answer = F.when(named, F.concat(F.lit("Customer#"), F.lpad(F.col("question_id").cast("string"), 9, "0"))).otherwise("return order goods delivery")
    asks = w.questions.select("question_id", F.lit("What orders may the customer return, and which goods are late?").alias("question"), answer.alias("answer"), named.alias("is_definition"))
    text = F.concat(F.regexp_replace("source_text", r"^\[PARENT: [^\]]*\] -> ", "Note that "), F.lit(" as agreed."))
    return w.survivors.select("question_id", "idx", "type", text.alias("source_text"), F.concat(F.lit("Chunk "), "chunk_id").alias("section"), "score", (F.col("votes") / 7).alias("vote_frac")), asks


@query()
def supporting_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, asks = _clauses(spark, sf_dir)
    return ev.pick_clauses(candidates, asks)


_LINE = """CASE type WHEN 'DEFINITION' THEN '[DEFINITION] "' || term || '" means: ' || definition WHEN 'OBLIGATION' THEN '[OBLIGATION] ' || party || ' ' || upper(modal) || ' ' || action WHEN 'RIGHT' THEN '[RIGHT] ' || party || ' MAY ' || right_text WHEN 'NUMERIC' THEN '[NUMERIC] ' || value || ' ' || unit || ' — ' || applies_to
  WHEN 'CONDITION' THEN '[CONDITION] IF ' || trigger || ' THEN ' || consequence WHEN 'BLANK' THEN '[BLANK] "' || field || '" is not filled in — context: ' || context ELSE '[REFERENCE] → ' || ref_to || ': ' || describes END"""


@query(f"""{ctes('survivors')} SELECT question_id, string_agg(CAST(idx + 1 AS VARCHAR) || '. ' || {_LINE} || chr(10) || '   Source: "' || source_text || '"', chr(10) ORDER BY idx) AS facts FROM survivors WHERE idx < 23 GROUP BY question_id""")
def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fact_lines(fixture(spark, sf_dir, "survivors"))


@query()
def shaped_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, asks = _clauses(spark, sf_dir)
    verdicts = asks.select("question_id", (F.col("question_id") % 4 > 0).alias("answerable"), "answer", F.lit("").alias("reasoning"), F.lit("medium").alias("confidence"))
    return ev.response(verdicts, ev.pick_clauses(candidates, asks))


@query()
def ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked from end to end, without a reader: one for each document of the graph, which names a customer of it."""
    nodes = fixture(spark, sf_dir, "unodes").drop("question_id", "score")
    docs = api.Documents(None, nodes, fixture(spark, sf_dir, "edges"))
    asks = nodes.select("doc_id").distinct().select(F.col("doc_id").alias("question_id"), "doc_id", F.concat(F.lit("May Customer#"), F.lpad((F.col("doc_id") * 20).cast("string"), 9, "0"), F.lit(" return the goods of the order?")).alias("question"))
    return api.ask(docs, asks).drop("supporting_clauses")
