"""Queries over the survivor graphs: one question for each customer, its slot dealt by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.operators import kernels
from clausegraph.operators import topology as tp
from clausegraph.operators.graph import edge_weight
from clausegraph.schema import TERMINAL

from .fixture import ctes, fixture, questions
from .registry import query

SLOTS = ("VALUE", "MEANING", "REQUIREMENT", "PERMISSION", "CONSEQUENCE", "ACTOR", "GENERAL")


class World:
    """The tables that the metrics read; edges are made when a metric asks for them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.of = spark, sf_dir
        self.survivors = fixture(spark, sf_dir, "survivors").withColumn("idx", F.col("idx").cast("int"))
        slot = F.get(F.array(*map(F.lit, SLOTS)), (F.col("question_id") % len(SLOTS)).cast("int"))
        party = F.concat(F.lit("customer#"), F.lpad(F.col("question_id").cast("string"), 9, "0"))
        self.questions = questions(spark, sf_dir).select("question_id", slot.alias("slot"), party.alias("party"), F.array(party).alias("values"))

    @property
    def edges(self) -> DataFrame:
        raw = fixture(*self.of, "dir_edges")
        return raw.select("question_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "etype", edge_weight(F.col("si"), F.col("sj"), F.col("etype")).alias("w"))

    @property
    def marked(self) -> DataFrame:
        return tp.anchors(self.survivors, self.questions)


_PAIRS = ", ".join(f"('{s}', '{t}')" for s, ts in TERMINAL.items() for t in ts)
_W = "(si + sj) / 2 * CASE etype WHEN 'TRIGGERS' THEN CAST(0.9 AS DOUBLE) WHEN 'USES_TERM' THEN CAST(0.82 AS DOUBLE) WHEN 'PARTY_HAS' THEN CAST(0.82 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END"
_TEXT = "lower(concat_ws(' ', source_text, action, party, term, right_text, definition, trigger, consequence, applies_to))"
WITH = f"""{ctes('dir_edges')}, tt(slot, type) AS (VALUES {_PAIRS}),
  m AS (SELECT *, target OR matches AS anchor FROM (SELECT s.*, q.slot, q.asked, EXISTS (SELECT 1 FROM tt WHERE tt.slot = q.slot AND tt.type = s.type) AS target, contains({_TEXT.replace('party', 's.party')}, q.asked) AS matches FROM survivors s
    JOIN (SELECT DISTINCT question_id, ['{"', '".join(SLOTS)}'][1 + question_id % 7] AS slot, 'customer#' || lpad(CAST(question_id AS STRING), 9, '0') AS asked FROM survivors) q ON q.question_id = s.question_id)),
  de AS (SELECT question_id, i, j, etype, ti, tj, {_W} AS w FROM dir_edges), und AS (SELECT question_id, least(i, j) AS i, greatest(i, j) AS j, etype, max(w) AS w FROM de GROUP BY ALL),
  sim AS (SELECT DISTINCT question_id, i, j FROM und), nb AS (SELECT question_id, i AS v, j AS u FROM sim UNION ALL SELECT question_id, j, i FROM sim),
  dg AS (SELECT question_id, v, count(*) AS d FROM nb GROUP BY ALL), md AS (SELECT question_id, v, count(*) AS d FROM (SELECT question_id, i AS v FROM und UNION ALL SELECT question_id, j FROM und) GROUP BY ALL)"""
_KAPPA = """k AS (SELECT u.question_id, u.i, u.j, u.etype, coalesce(s.n, 0) * (1.0 / a.d + 1.0 / b.d) - 1 AS kappa FROM und u JOIN dg a ON a.question_id = u.question_id AND a.v = u.i JOIN dg b ON b.question_id = u.question_id AND b.v = u.j
  LEFT JOIN (SELECT x.question_id, x.i, x.j, count(*) AS n FROM sim x JOIN nb p ON p.question_id = x.question_id AND p.v = x.i JOIN nb r ON r.question_id = x.question_id AND r.v = x.j AND r.u = p.u GROUP BY ALL) s ON s.question_id = u.question_id AND s.i = u.i AND s.j = u.j)"""


@query(f"""{WITH}, t AS (SELECT DISTINCT de.question_id FROM de JOIN m ON m.question_id = de.question_id AND m.idx = de.i WHERE (slot = 'VALUE' AND ti = 'CONDITION' AND etype = 'TRIGGERS' AND tj = 'NUMERIC') OR (slot IN ('REQUIREMENT', 'CONSEQUENCE') AND ti = 'CONDITION' AND etype = 'TRIGGERS' AND tj = 'OBLIGATION') OR (slot = 'MEANING' AND ti IN ('OBLIGATION', 'RIGHT') AND etype = 'USES_TERM' AND tj = 'DEFINITION'))
  SELECT question_id, slot, direct, direct OR question_id IN (SELECT question_id FROM t) AS matched FROM (SELECT question_id, slot, bool_or(target) AS direct FROM m GROUP BY ALL)""")
def path_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.path_coverage(w.marked, w.edges)


_CHECK = "lower(concat_ws(' ', {0}.source_text, {0}.action, {0}.right_text, {0}.definition, {0}.trigger, {0}.consequence, {0}.applies_to, {0}.term))"


@query(f"""{WITH} SELECT de.question_id, count(*) AS n_edges, count(*) FILTER (CASE etype WHEN 'USES_TERM' THEN coalesce(b.term, '') <> '' AND contains({_CHECK.format('a')}, lower(trim(b.term)))
    WHEN 'TRIGGERS' THEN len(list_filter(string_split(lower(coalesce(a.trigger, '')), ' '), lambda w: length(w) >= 5 AND contains({_CHECK.format('b')}, w))) > 0 WHEN 'SAME_SECTION' THEN a.chunk_id = b.chunk_id
    WHEN 'PARTY_HAS' THEN coalesce(a.party, '') <> '' AND coalesce(b.party, '') <> '' AND (contains(lower(a.party), lower(b.party)) OR contains(lower(b.party), lower(a.party))) END) AS n_consistent
  FROM de JOIN survivors a ON a.question_id = de.question_id AND a.idx = de.i JOIN survivors b ON b.question_id = de.question_id AND b.idx = de.j GROUP BY de.question_id""")
def sheaf_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.sheaf(w.survivors, w.edges)


_OK_EDGE = f"""CASE WHEN (CASE etype WHEN 'USES_TERM' THEN coalesce(b.term, '') <> '' AND contains({_CHECK.format('a')}, lower(trim(b.term)))
    WHEN 'TRIGGERS' THEN len(list_filter(string_split(lower(coalesce(a.trigger, '')), ' '), lambda w: length(w) >= 5 AND contains({_CHECK.format('b')}, w))) > 0 WHEN 'SAME_SECTION' THEN a.chunk_id = b.chunk_id
    WHEN 'PARTY_HAS' THEN coalesce(a.party, '') <> '' AND coalesce(b.party, '') <> '' AND (contains(lower(a.party), lower(b.party)) OR contains(lower(b.party), lower(a.party))) END) THEN 1 ELSE 0 END"""


@query(f"{WITH} SELECT de.question_id, sum((a.score + b.score) / 2 * {_OK_EDGE}) / sum((a.score + b.score) / 2) AS weighted_frac FROM de JOIN survivors a ON a.question_id = de.question_id AND a.idx = de.i JOIN survivors b ON b.question_id = de.question_id AND b.idx = de.j GROUP BY de.question_id")
def weighted_sheaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.weighted_sheaf(w.survivors, w.edges, w.survivors.select("question_id", "idx", "score"))


@query(f"""{WITH}, r AS (SELECT question_id, type, trim(lower(concat_ws(' ', coalesce(source_text, ''), coalesce(ref_to, ''), coalesce(describes, '')))) AS t, len(list_filter(string_split_regex(lower(coalesce(source_text, '')), '\\s+'), lambda w: w <> '')) >= 16 AS long FROM survivors),
  f AS (SELECT *, {' OR '.join(f"contains(t, '{w}')" for ws in tp.OUTSIDE.values() for w in ws)} AS rel, type = 'REFERENCE' OR (({' OR '.join(f"contains(t, '{w}')" for w in tp.POINTERS)}) AND NOT ({' OR '.join(f"contains(' ' || t || ' ', '{w}')" for w in tp.DETAILS)})) AS refs, {' OR '.join(f"contains(' ' || t || ' ', '{w}')" for w in tp.DETAILS)} AS detail FROM r),
  g AS (SELECT question_id, count(*) AS n, count(*) FILTER (rel) AS related, count(*) FILTER (rel AND refs) AS o, count(*) FILTER (rel AND NOT refs AND type <> 'REFERENCE' AND (detail OR long)) AS i, count(*) FILTER (rel AND question_id % 2 = 0 AND contains(t, 'schedule')) AS d FROM f GROUP BY question_id)
  SELECT question_id, related, related / n AS related_ratio, CASE WHEN related > 0 THEN o / related ELSE 0 END AS ref_only_ratio, CASE WHEN related > 0 THEN i / related ELSE 0 END AS inline_ratio, CASE WHEN related > 0 THEN d / related ELSE 0 END AS doc_match_ratio FROM g""")
def outside_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    asks = w.questions.select("question_id", F.when(F.col("question_id") % 2 == 0, "schedule").otherwise("none").alias("external_doc"), F.lit(False).alias("wants_contents"))
    return tp.outside_dependency(w.survivors, asks)


@query(f"""{WITH}, raw AS (SELECT question_id, idx, score, trim(concat_ws(' ', coalesce(source_text, ''), coalesce(action, ''), coalesce(party, ''), coalesce(term, ''), coalesce(right_text, ''), coalesce(definition, ''), coalesce(trigger, ''), coalesce(consequence, ''), coalesce(applies_to, ''), coalesce(value, ''), coalesce(unit, ''))) AS raw FROM survivors),
  o AS (SELECT *, len(list_intersect(['goods', 'price', 'order'], list_distinct(regexp_extract_all(lower(raw), '([a-z0-9]+)', 1)))) / 3 AS r FROM raw),
  k AS (SELECT *, greatest(CASE WHEN regexp_matches(raw, '\\b\\d{{1,3}}(?:\\.\\d+)?\\s*%') THEN 1.0 ELSE 0 END, CASE WHEN regexp_matches(raw, '\\d') THEN 0.9 ELSE 0 END) AS kind, CASE WHEN {' OR '.join(f"contains(lower(raw), '{x}')" for x in tp.STATED)} THEN 1.0 ELSE 0.35 END AS stated FROM o),
  s AS (SELECT question_id, idx, greatest(0, least(1, 0.45 * r + 0.35 * CASE WHEN kind = 0 THEN least(0.75, 0.65 * r) ELSE kind END + 0.15 * stated + 0.05 * least(1, score))) AS support FROM k)
  SELECT question_id, max(support) AS support FROM s GROUP BY question_id""")
def direct_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    flags = {f"asks_{n}": F.lit(n in ("percent", "value")) for n in ("date", "percent", "value", "name", "list", "rule")}
    return tp.direct_support(w.survivors, w.questions.select("question_id", F.lit("What is the goods price of the order?").alias("question")).withColumns(flags)).select("question_id", "support")


@query(f"{WITH}, k AS (SELECT question_id, count(*) AS n FROM und GROUP BY ALL) SELECT c_custkey AS question_id, n AS n_edges FROM customer LEFT JOIN k ON k.question_id = c_custkey")
def complete_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tp.ricci(World(spark, sf_dir).edges).select("question_id", "n_edges")
    return tp.complete(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("question_id")), edges)


@query(f"""{WITH}, b AS (SELECT doc_id, src AS node, dst AS near FROM edges UNION ALL SELECT doc_id, dst, src FROM edges)
  SELECT s.question_id, count(*) FILTER (t.node_key IS NULL) AS cut, count(*) AS vol FROM b JOIN survivors s ON s.doc_id = b.doc_id AND s.node_key = b.node LEFT JOIN survivors t ON t.question_id = s.question_id AND t.node_key = b.near GROUP BY s.question_id""")
def conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.conductance(fixture(spark, sf_dir, "survivors"), fixture(spark, sf_dir, "edges"))


@query(f"{WITH}, {_KAPPA} SELECT question_id, avg(kappa) AS ricci_mean, min(kappa) AS ricci_min, max(kappa) AS ricci_max, stddev_pop(kappa) AS ricci_std, count(*) FILTER (kappa < 0) AS n_negative, count(*) AS n_edges FROM k GROUP BY question_id")
def ollivier_ricci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.ricci(World(spark, sf_dir).edges)


@query(f"""{WITH}, {_KAPPA}, x AS (SELECT k.*, (a.score + b.score) / 2 AS w FROM k JOIN survivors a ON a.question_id = k.question_id AND a.idx = k.i JOIN survivors b ON b.question_id = k.question_id AND b.idx = k.j)
  SELECT question_id, sum(kappa * w) / sum(w) AS weighted_mean, min(kappa * w) * count(*) / (sum(w) + 1e-10) AS weighted_min, sum(kappa * w) FILTER (kappa < 0) / sum(w) FILTER (kappa < 0) AS bridge_score FROM x GROUP BY question_id""")
def weighted_ricci(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.weighted_ricci(w.edges, w.survivors.select("question_id", "idx", "score"))


@query(f"{WITH} SELECT u.question_id, avg(4 - a.d - b.d) AS forman_mean, min(4 - a.d - b.d) AS forman_min, max(4 - a.d - b.d) AS forman_max FROM und u JOIN md a ON a.question_id = u.question_id AND a.v = u.i JOIN md b ON b.question_id = u.question_id AND b.v = u.j GROUP BY u.question_id")
def forman_ricci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.forman(World(spark, sf_dir).edges)


@query(f"""{WITH}, c AS (SELECT question_id, type, count(*) AS n FROM survivors GROUP BY ALL), p AS (SELECT question_id, n / sum(n) OVER (PARTITION BY question_id) AS p FROM c), h AS (SELECT question_id, -sum(p * log2(p)) AS type_entropy, count(*) AS kinds FROM p GROUP BY ALL)
  SELECT h.*, f.n, f.obligation_frac FROM h JOIN (SELECT question_id, count(*) AS n, count(*) FILTER (type = 'OBLIGATION') / count(*) AS obligation_frac FROM survivors GROUP BY ALL) f USING (question_id)""")
def type_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.type_metrics(World(spark, sf_dir).survivors)


@query(f"{WITH}, c AS (SELECT question_id, ti, tj, count(*) AS n FROM de GROUP BY ALL), p AS (SELECT question_id, n / sum(n) OVER (PARTITION BY question_id) AS p FROM c) SELECT question_id, -sum(p * log2(p)) AS entropy, count(*) AS kinds FROM p GROUP BY ALL")
def transition_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.transition_entropy(w.survivors, w.edges)


@query(f"""{WITH}, l AS (SELECT DISTINCT question_id, i AS e, j AS t FROM de WHERE etype = 'USES_TERM' AND ti IN ('OBLIGATION', 'RIGHT', 'CONDITION') AND tj IN ('DEFINITION', 'REFERENCE')),
  p AS (SELECT question_id, count(*) AS n FROM (SELECT DISTINCT a.question_id, a.e, b.e AS f FROM l a JOIN l b ON a.question_id = b.question_id AND a.t = b.t AND a.e < b.e) GROUP BY ALL)
  SELECT s.question_id, s.n_entity, s.n_term, coalesce(p.n, 0) AS projected FROM (SELECT question_id, count(*) FILTER (type IN ('OBLIGATION', 'RIGHT', 'CONDITION')) AS n_entity, count(*) FILTER (type IN ('DEFINITION', 'REFERENCE')) AS n_term FROM survivors GROUP BY ALL) s LEFT JOIN p USING (question_id)""")
def bipartite_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.bipartite(w.survivors, w.edges)


@query(f"""{WITH}, t AS (SELECT a.question_id, a.i AS x, a.j AS y, b.j AS z FROM sim a JOIN sim b ON a.question_id = b.question_id AND a.i = b.i AND a.j < b.j JOIN sim c ON c.question_id = a.question_id AND c.i = a.j AND c.j = b.j),
  c AS (SELECT question_id, v, count(*) AS n FROM (SELECT question_id, unnest([x, y, z]) AS v FROM t) GROUP BY ALL)
  SELECT dg.question_id, CAST(sum(coalesce(c.n, 0)) // 3 AS BIGINT) AS n_triangles, CAST(sum(d * (d - 1) // 2) AS BIGINT) AS n_triples, avg(coalesce(c.n, 0) * 2.0 / (d * (d - 1))) AS mean_local FROM dg LEFT JOIN c ON c.question_id = dg.question_id AND c.v = dg.v WHERE d >= 2 GROUP BY dg.question_id""")
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.clustering(World(spark, sf_dir).edges)


@query(f"""{WITH}, a AS (SELECT question_id, idx FROM m WHERE anchor), p AS (SELECT a.question_id, a.idx AS x, b.idx AS y FROM a JOIN a b ON a.question_id = b.question_id AND a.idx < b.idx),
  n AS (SELECT question_id, v, list(u) AS near FROM nb GROUP BY ALL),
  j AS (SELECT p.question_id, list_filter(coalesce(n1.near, []), lambda z: z <> p.y) AS na, list_filter(coalesce(n2.near, []), lambda z: z <> p.x) AS nc FROM p LEFT JOIN n n1 ON n1.question_id = p.question_id AND n1.v = p.x LEFT JOIN n n2 ON n2.question_id = p.question_id AND n2.v = p.y),
  s AS (SELECT question_id, len(list_intersect(na, nc)) AS i, len(na) + len(nc) - len(list_intersect(na, nc)) AS u FROM j)
  SELECT question_id, count(*) AS n_pairs, avg(CASE WHEN u > 0 THEN i / u ELSE 0 END) AS mean_jaccard, min(CASE WHEN u > 0 THEN i / u ELSE 0 END) AS min_jaccard FROM s GROUP BY question_id""")
def anchor_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.anchor_jaccard(w.marked, w.edges)


@query(f"""{WITH} SELECT m.question_id, count(*) FILTER (target) AS n_targets, avg(coalesce(d, 0)) FILTER (target) AS mean_degree, min(coalesce(d, 0)) FILTER (target) AS min_degree, avg(CASE WHEN coalesce(d, 0) <= 1 THEN 1 ELSE 0 END) FILTER (target) AS orphan_frac, avg(CASE WHEN target THEN 1 ELSE 0 END) AS target_frac
  FROM m LEFT JOIN md ON md.question_id = m.question_id AND md.v = m.idx GROUP BY m.question_id""")
def target_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.target_centrality(w.marked, w.edges)


@query(f"""{WITH}, e AS (SELECT DISTINCT question_id, i, j FROM de) SELECT a.question_id, count(*) AS n_ffl, count(*) FILTER (s.type IN ('OBLIGATION', 'RIGHT', 'NUMERIC', 'DEFINITION')) AS typed_ffl
  FROM de a JOIN e b ON a.question_id = b.question_id AND a.i = b.i AND b.j <> a.j JOIN e c ON c.question_id = a.question_id AND c.i = b.j AND c.j = a.j JOIN survivors s ON s.question_id = a.question_id AND s.idx = b.j GROUP BY a.question_id""")
def feedforward_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.feed_forward(w.survivors, w.edges)


#: Conditions that trigger are triggered in turn by the edges turned round, or there would be no whole chain here.
@query(f"""{WITH}, t AS (SELECT question_id, i, j FROM de WHERE etype = 'TRIGGERS' UNION ALL SELECT question_id, j, i FROM de WHERE etype = 'TRIGGERS' AND i % 2 = 0), pr AS (SELECT DISTINCT question_id, j AS v FROM t),
  go AS (SELECT DISTINCT t.question_id, t.i AS v FROM t JOIN m ON m.question_id = t.question_id AND m.idx = t.j AND m.target)
  SELECT m.question_id, count(*) AS n_conditions, count(*) FILTER (pr.v IS NOT NULL AND go.v IS NOT NULL) AS complete, count(*) FILTER (pr.v IS NOT NULL AND go.v IS NULL) AS dangling FROM m LEFT JOIN pr ON pr.question_id = m.question_id AND pr.v = m.idx LEFT JOIN go ON go.question_id = m.question_id AND go.v = m.idx WHERE type = 'CONDITION' GROUP BY m.question_id""")
def chain_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    t = w.edges.where("etype = 'TRIGGERS'")
    turned = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return tp.chain_completeness(w.marked, t.select("question_id", "etype", "w", F.inline(F.when(F.expr("i % 2 = 0"), turned).otherwise(F.array(F.struct("i", "j"))))))


def _steps(levels: dict[str, tuple[str, ...]]) -> str:
    return " OR ".join(f"(type = '{k}' AND EXISTS (SELECT 1 FROM tt WHERE tt.slot = m.slot AND tt.type IN ({', '.join(repr(x) for x in v)})))" for k, v in levels.items() if v)


_TWO = {k: tuple(b for a in v for b in tp.LEADS_TO.get(a, ())) for k, v in tp.LEADS_TO.items()}


@query(f"{WITH} SELECT question_id, avg(CASE WHEN target THEN 1.0 WHEN {_steps(tp.LEADS_TO)} THEN 0.6 WHEN {_steps(_TWO)} THEN 0.3 ELSE 0 END) AS score, count(DISTINCT type) / count(*) AS diversity FROM m WHERE anchor GROUP BY question_id")
def anchor_type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.anchor_type_match(World(spark, sf_dir).marked)


_DIST = ", ".join(f"('{a}', '{b}', {d}), ('{b}', '{a}', {d})" for (a, b), d in tp.DISTANCE.items()) + ", ('REFERENCE', 'OBLIGATION', 1), ('REFERENCE', 'RIGHT', 1)"


@query(f"""{WITH}, ds(a, b, d) AS (VALUES {_DIST}), far AS (SELECT tt.slot, ds.a AS type, min(d) AS d FROM tt JOIN ds ON ds.b = tt.type GROUP BY ALL),
  r AS (SELECT m.question_id, CASE WHEN target THEN 0 ELSE coalesce(far.d, 3) END AS d, target OR (m.slot = 'VALUE' AND regexp_matches(lower(concat_ws(' ', source_text, action, right_text, trigger, consequence, applies_to, value, unit)), '\\d')) AS rel FROM m LEFT JOIN far ON far.slot = m.slot AND far.type = m.type),
  u AS (SELECT *, bool_or(rel) OVER (PARTITION BY question_id) AS found FROM r) SELECT question_id, avg(d) AS depth, avg((d = 0)::INT) AS exact, avg((d = 1)::INT) AS adjacent, avg((d >= 2)::INT) AS distant FROM u WHERE rel OR NOT found GROUP BY question_id""")
def slot_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.slot_mismatch(World(spark, sf_dir).marked)


_SEQ = ", ".join(f"('{s}', '{a}', '{e}', '{b}')" for s, seqs in tp.SEQUENCES.items() for a, e, b in seqs)


@query(f"""{WITH}, sq(slot, a, e, b) AS (VALUES {_SEQ}), s AS (SELECT DISTINCT question_id, slot FROM m), st AS (SELECT DISTINCT question_id, ti, etype, tj FROM de)
  SELECT s.question_id, CAST(count(st.ti) AS INT) AS present, CAST(count(*) AS INT) AS total FROM s JOIN sq USING (slot) LEFT JOIN st ON st.question_id = s.question_id AND st.ti = sq.a AND st.etype = sq.e AND st.tj = sq.b GROUP BY s.question_id""")
def required_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.required_sequence(w.marked, w.edges)


@query(f"""{WITH}, p AS (SELECT question_id, idx, lower(party) AS own, asked FROM m WHERE anchor AND coalesce(party, '') <> ''),
  h AS (SELECT a.question_id, count(*) AS n_has, count(*) FILTER ((contains(b.own, a.asked) OR contains(a.asked, b.own)) AND NOT (contains(a.own, a.asked) OR contains(a.asked, a.own))) AS n_inverted FROM de JOIN p a ON a.question_id = de.question_id AND a.idx = de.i JOIN p b ON b.question_id = de.question_id AND b.idx = de.j WHERE etype = 'PARTY_HAS' GROUP BY ALL)
  SELECT p.question_id, count(*) AS n_parties, count(*) FILTER (contains(own, asked) OR contains(asked, own)) AS n_match, coalesce(any_value(n_has), 0) AS n_has, coalesce(any_value(n_inverted), 0) AS n_inverted FROM p LEFT JOIN h ON h.question_id = p.question_id GROUP BY p.question_id""")
def directional_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.directional_mismatch(w.marked, w.questions, w.edges)


@query(f"""{WITH}, {_KAPPA}, r AS (SELECT question_id, avg(kappa) AS r FROM k GROUP BY ALL), a AS (SELECT question_id, avg(anchor::INT) AS a FROM m GROUP BY ALL)
  SELECT question_id, a AS anchor_frac, r AS ricci_mean, a > 0.5 AND r < -0.55 AS flagged, CASE WHEN r IS NOT NULL THEN least(1.0, (greatest(0.0, a - 0.5) / (0.5 + 1e-6) + greatest(0.0, -r - 0.55) / (1 + 1e-6)) / 2) END AS confidence FROM a LEFT JOIN r USING (question_id)""")
def keyword_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.keyword_trap(w.marked, w.edges)


@query("""SELECT event_id, user_id, event_type, value AS score, avg(value) OVER w AS session_mean, value - avg(value) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def contrastive_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("slot"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("score"))
    return tp.contrastive(e).select("event_id", F.col("session").alias("user_id"), F.col("slot").alias("event_type"), "score", "session_mean", "gap")


@query(f"""{WITH}, f AS (SELECT question_id, votes / 7.0 AS f, votes FROM survivors) SELECT question_id, avg(f) AS mean_frac, quantile_cont(f, 0.75) AS p75_frac, avg((f >= 0.6)::INT) AS high_frac, max(f) AS max_frac, count(*) FILTER (votes >= 2) AS n_ge2, count(*) FILTER (votes >= 3) AS n_ge3, avg(votes) AS mean_votes FROM f GROUP BY question_id""")
def vote_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.vote_stats(World(spark, sf_dir).survivors.withColumn("vote_frac", F.col("votes") / F.lit(7.0)))


@query(f"""{WITH}, r AS (SELECT s.question_id, s.idx, coalesce(d, 0) * 1.0 AS d FROM survivors s LEFT JOIN md ON md.question_id = s.question_id AND md.v = s.idx),
  w AS (SELECT *, sum(d) OVER p AS t, avg(d) OVER p AS mu, stddev_pop(d) OVER p AS sd, row_number() OVER (PARTITION BY question_id ORDER BY d, idx) AS rk, count(*) OVER p AS n FROM r WINDOW p AS (PARTITION BY question_id))
  SELECT question_id, -sum(CASE WHEN d > 0 THEN d / t * log2(d / t) ELSE 0 END) AS deg_entropy, avg((d > mu + sd)::INT) AS hub_frac, avg((d = 0)::INT) AS isolated_frac, CASE WHEN max(t) > 0 THEN 2 * sum(rk * d) / (max(n) * max(t)) - (max(n) + 1) / max(n) ELSE 0 END AS gini FROM w GROUP BY question_id""")
def degree_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return tp.degree_entropy(w.survivors, w.edges)


@query(f"""{WITH}, v AS (SELECT question_id, type, CASE WHEN idx % 5 = 0 THEN 'x number' WHEN idx % 5 = 1 THEN 'n' ELSE value END AS v FROM survivors),
  h AS (SELECT *, regexp_matches(trim(coalesce(v, '')), '^[a-zA-Z](\\s+\\w+)?$') AS held FROM v) SELECT question_id, count(*) FILTER (type = 'NUMERIC') AS n_numeric, count(*) FILTER (type = 'NUMERIC' AND held) AS n_placeholder, avg(held::INT) FILTER (type = 'NUMERIC') AS placeholder_frac FROM h GROUP BY question_id""")
def placeholder_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("idx") % 5 == 0, "x number").when(F.col("idx") % 5 == 1, "n").otherwise(F.col("value"))
    return tp.placeholders(World(spark, sf_dir).survivors.withColumn("value", v))


@query(f"""{WITH}, s AS (SELECT question_id, CASE unit WHEN 'USD' THEN ['currency', 'price'] WHEN 'days' THEN ['days', 'count'] END AS tags FROM survivors WHERE type = 'NUMERIC'),
  q AS (SELECT DISTINCT question_id, CASE question_id % 3 WHEN 0 THEN ['cost', 'currency', 'payment', 'price'] WHEN 1 THEN ['count', 'number', 'quantity'] END AS want FROM survivors)
  SELECT q.question_id, CAST(len(want) AS INT) AS n_required, max(CASE WHEN tags IS NOT NULL THEN CAST(len(list_intersect(want, tags)) AS INT) END) AS best_overlap, least(1.0, max(CASE WHEN tags IS NOT NULL THEN len(list_intersect(want, tags)) END) / len(want)) AS match_score FROM q LEFT JOIN s ON s.question_id = q.question_id WHERE want IS NOT NULL GROUP BY q.question_id, want""")
def value_tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    tags = F.when(F.col("unit") == "USD", F.array(F.lit("currency"), F.lit("price"))).when(F.col("unit") == "days", F.array(F.lit("days"), F.lit("count")))
    text = F.when(F.col("question_id") % 3 == 0, "What is the Price of it?").when(F.col("question_id") % 3 == 1, "the count?").otherwise("When is it due?")
    return tp.tag_match(w.survivors.withColumn("value_tags", F.when(F.col("type") == "NUMERIC", tags)), w.questions.withColumn("question", text))


def _kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = World(spark, sf_dir)
    return kernels.topology(w.marked, w.edges)


@query()
def topology_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the grouped kernel."""
    return _kernel(spark, sf_dir)


#: Least labels over 12 steps are enough for these graphs, whose components are narrower.
@query(f"{WITH}, l0 AS (SELECT question_id, idx AS v, idx AS l FROM survivors)"
  + "".join(f", l{k + 1} AS (SELECT a.question_id, a.v, least(a.l, coalesce(min(b.l), a.l)) AS l FROM l{k} a LEFT JOIN nb ON nb.question_id = a.question_id AND nb.v = a.v LEFT JOIN l{k} b ON b.question_id = nb.question_id AND b.v = nb.u GROUP BY a.question_id, a.v, a.l)" for k in range(12))
  + """ SELECT s.question_id, CAST(s.n AS INT) AS n, CAST(coalesce(e.m, 0) AS INT) AS n_edges, CAST(s.b AS INT) AS beta0, CAST(greatest(0, coalesce(e.m, 0) - s.n + s.b) AS INT) AS beta1 FROM (SELECT question_id, count(*) AS n, count(DISTINCT l) AS b FROM l12 GROUP BY ALL) s LEFT JOIN (SELECT question_id, count(*) AS m FROM und GROUP BY ALL) e USING (question_id)""")
def betti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir).select("question_id", "n", "n_edges", "beta0", "beta1")
