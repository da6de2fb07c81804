"""Topology of survivor graphs as joins and aggregates, all questions at once.

Survivors are (question_id, idx, ...node columns, score), questions (question_id, slot, values), directed edges
(question_id, i, j, etype, w), undirected ones one for each pair and kind. Every result has one row for each question
that has something to measure; `complete` adds the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import nodes as nx
from clausegraph.functions.numerics import has_any
from clausegraph.operators.graph import both_ways, simple_edges, undirected
from clausegraph.schema import TERMINAL, TYPED_STEPS

Q = "question_id"

#: Node types that lead to others by one step.
LEADS_TO = {"CONDITION": ("OBLIGATION", "RIGHT"), "OBLIGATION": ("NUMERIC", "DEFINITION"), "RIGHT": ("NUMERIC", "DEFINITION"), "REFERENCE": ("OBLIGATION", "RIGHT")}

#: Steps between node types, both ways but for references; others are 3 apart.
DISTANCE = {("CONDITION", "OBLIGATION"): 1, ("CONDITION", "RIGHT"): 1, ("OBLIGATION", "RIGHT"): 1, ("OBLIGATION", "NUMERIC"): 1, ("RIGHT", "NUMERIC"): 1, ("OBLIGATION", "DEFINITION"): 1, ("RIGHT", "DEFINITION"): 1, ("CONDITION", "NUMERIC"): 2, ("CONDITION", "DEFINITION"): 2}

#: Typed steps that a slot's answer needs.
SEQUENCES = {
    "REQUIREMENT": (("CONDITION", "TRIGGERS", "OBLIGATION"),),
    "CONSEQUENCE": (("CONDITION", "TRIGGERS", "OBLIGATION"), ("CONDITION", "TRIGGERS", "RIGHT")),
    "PERMISSION": (("CONDITION", "TRIGGERS", "RIGHT"), ("OBLIGATION", "PARTY_HAS", "RIGHT")),
    "VALUE": (("CONDITION", "TRIGGERS", "NUMERIC"), ("OBLIGATION", "USES_TERM", "NUMERIC")),
    "MEANING": (("OBLIGATION", "USES_TERM", "DEFINITION"), ("RIGHT", "USES_TERM", "DEFINITION")),
    "ACTOR": (("CONDITION", "PARTY_HAS", "OBLIGATION"),),
    "GENERAL": (("CONDITION", "TRIGGERS", "OBLIGATION"), ("CONDITION", "TRIGGERS", "RIGHT")),
}

#: Tags that words of a question ask for.
CONCEPTS = {
    "revenue": ("revenue", "income", "earnings", "currency"), "profit": ("profit", "earnings", "income", "currency"), "income": ("income", "revenue", "earnings", "currency"),
    "cost": ("cost", "currency", "payment", "fee"), "price": ("price", "currency", "cost", "payment"), "fee": ("fee", "payment", "currency"), "salary": ("salary", "compensation", "currency"),
    "payment": ("payment", "currency", "fee"), "viewer": ("viewer", "subscriber", "count", "audience"), "subscriber": ("subscriber", "viewer", "count", "household"), "audience": ("audience", "viewer", "subscriber", "count"),
    "market": ("market", "share", "percent"), "share": ("share", "percent", "market"), "rate": ("rate", "percent", "interest"), "percent": ("percent", "rate", "share"),
    "number": ("count", "quantity", "number"), "count": ("count", "number", "quantity"), "total": ("total", "aggregate", "sum"), "aggregate": ("aggregate", "total", "sum"),
    "mean": ("definition", "term"), "define": ("definition", "term"), "definition": ("definition", "term"), "means": ("definition", "term"),
}


def among(kind: Column, slot: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether the type is one of the slot's; slots not listed count as GENERAL."""
    test = kind.isin(*table["GENERAL"]) & ~slot.isin(*[s for s in table if s != "GENERAL"])
    for s, kinds in table.items():
        if s != "GENERAL":
            test = test | ((slot == s) & kind.isin(*kinds))
    return test


def entropy(rows: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """question_id, entropy (bits) of the counts n of each question, and how many there are."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(Q))
    return rows.select(Q, share.alias("p")).groupBy(Q).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count(F.lit(1)).alias("kinds"))


def degrees(undir: DataFrame) -> DataFrame:
    """question_id, idx, degree: edges at each node, parallel ones counted each."""
    ends = undir.select(Q, F.explode(F.array("i", "j")).alias("idx"))
    return ends.groupBy(Q, "idx").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(dir_edges: DataFrame) -> DataFrame:
    """question_id, v, u: distinct neighbours, both ways."""
    ends = F.array(F.struct(F.col("i").alias("v"), F.col("j").alias("u")), F.struct(F.col("j").alias("v"), F.col("i").alias("u")))
    return simple_edges(dir_edges).select(Q, F.inline(ends))


def anchors(survivors: DataFrame, questions: DataFrame) -> DataFrame:
    """Survivors with slot, target (of a type that ends a path), matches (a value of the question of 4 letters or more stands in the text), anchor (either)."""
    rows = survivors.join(questions.select(Q, "slot", "values"), Q)
    text = nx.joined("source_text", "action", "party", "term", "right_text", "definition", "trigger", "consequence", "applies_to")
    match = F.exists("values", lambda v: (F.length(v) >= 4) & F.contains(text, F.lower(v)))
    rows = rows.withColumns({"target": among(F.col("type"), F.col("slot"), TERMINAL), "matches": F.coalesce(match, F.lit(False))})
    return rows.withColumn("anchor", F.col("target") | F.col("matches")).drop("values")


def path_coverage(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """Whether a survivor ends a path for the slot by its type, or a typed step does."""
    types = marked.select(Q, "idx", "type")
    step = F.lit(False)
    for slot, a, kind, b in TYPED_STEPS:
        step = step | ((F.col("slot") == slot) & (F.col("ta") == a) & (F.col("etype") == kind) & (F.col("tb") == b))
    ends = dir_edges.join(types.toDF(Q, "i", "ta"), [Q, "i"]).join(types.toDF(Q, "j", "tb"), [Q, "j"]).join(marked.select(Q, "slot").distinct(), Q)
    typed = ends.groupBy(Q).agg(F.bool_or(step).alias("typed"))
    direct = marked.groupBy(Q, "slot").agg(F.bool_or("target").alias("direct"))
    return direct.join(typed, Q, "left").select(Q, "slot", "direct", (F.col("direct") | F.coalesce("typed", F.lit(False))).alias("matched"))


def consistent(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, i, j, etype, ok: whether an edge's ends agree in the fields that the kind of edge speaks of."""
    side = lambda p: marked.select(Q, F.col("idx").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("term", "party", "chunk_id")], nx.check_text().alias(f"{p}_text"), F.lower(F.coalesce("trigger", F.lit(""))).alias(f"{p}_trigger"))
    rows = dir_edges.join(side("i"), [Q, "i"]).join(side("j"), [Q, "j"])
    a, b = F.coalesce(F.lower("i_party"), F.lit("")), F.coalesce(F.lower("j_party"), F.lit(""))
    term = F.trim(F.coalesce(F.lower("j_term"), F.lit("")))
    long = F.filter(F.split("i_trigger", r"\s+"), lambda w: F.length(w) >= 5)
    ok = (
        F.when(F.col("etype") == "USES_TERM", (term != "") & F.contains(F.col("i_text"), term))
        .when(F.col("etype") == "TRIGGERS", F.exists(long, lambda w: F.contains(F.col("j_text"), w)))
        .when(F.col("etype") == "SAME_SECTION", F.col("i_chunk_id") == F.col("j_chunk_id"))
        .when(F.col("etype") == "PARTY_HAS", (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))
        .otherwise(F.col("etype") != "CONTRADICTS")
    )
    return rows.select(Q, "i", "j", "etype", F.coalesce(ok, F.lit(False)).alias("ok"))


def sheaf(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, n_edges, n_consistent."""
    return consistent(marked, dir_edges).groupBy(Q).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("ok").alias("n_consistent"))


def weighted_sheaf(marked: DataFrame, dir_edges: DataFrame, weights: DataFrame) -> DataFrame:
    """question_id, weighted_frac: the consistent share of edges, each by the mean weight (question_id, idx, weight) of its ends."""
    rows = consistent(marked, dir_edges).join(weights.toDF(Q, "i", "wi"), [Q, "i"]).join(weights.toDF(Q, "j", "wj"), [Q, "j"]).withColumn("w", (F.col("wi") + F.col("wj")) / 2)
    return rows.groupBy(Q).agg(F.try_divide(F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0)), F.sum("w")).alias("weighted_frac"))


def conductance(survivors: DataFrame, edges: DataFrame) -> DataFrame:
    """question_id, cut, vol: edges of the whole graph that leave the survivors, and all that touch them, from both ends."""
    own = survivors.select(Q, "doc_id", F.col("node_key").alias("node"))
    inside = own.select(Q, F.col("node").alias("near"), F.lit(1).alias("inside"))
    rows = both_ways(edges).select("doc_id", "node", "near").join(own, ["doc_id", "node"]).join(inside, [Q, "near"], "left")
    return rows.groupBy(Q).agg(F.count_if(F.col("inside").isNull()).alias("cut"), F.count(F.lit(1)).alias("vol"))


def curvature(dir_edges: DataFrame) -> DataFrame:
    """question_id, i, j, etype, kappa: shared neighbours over both degrees, less one, for each undirected edge."""
    near = neighbours(dir_edges).groupBy(Q, "v").agg(F.collect_set("u").alias("n"))  # at most a question's survivors
    rows = undirected(dir_edges).where("i < j").join(near.toDF(Q, "i", "ni"), [Q, "i"]).join(near.toDF(Q, "j", "nj"), [Q, "j"])
    return rows.select(Q, "i", "j", "etype", (F.size(F.array_intersect("ni", "nj")) * (1 / F.size("ni") + 1 / F.size("nj")) - 1).alias("kappa"))


def ricci(dir_edges: DataFrame) -> DataFrame:
    k = F.col("kappa")
    return curvature(dir_edges).groupBy(Q).agg(F.avg(k).alias("ricci_mean"), F.min(k).alias("ricci_min"), F.max(k).alias("ricci_max"), F.stddev_pop(k).alias("ricci_std"), F.count_if(k < 0).alias("n_negative"), F.count(k).alias("n_edges"))


def weighted_ricci(dir_edges: DataFrame, weights: DataFrame) -> DataFrame:
    """As `ricci`, each edge by the mean weight (question_id, idx, weight) of its ends."""
    rows = curvature(dir_edges).join(weights.toDF(Q, "i", "wi"), [Q, "i"]).join(weights.toDF(Q, "j", "wj"), [Q, "j"]).withColumn("w", (F.col("wi") + F.col("wj")) / 2)
    k, w = F.col("kappa"), F.col("w")
    negative = F.when(k < 0, w)
    return rows.groupBy(Q).agg((F.sum(k * w) / F.sum(w)).alias("weighted_mean"), (F.min(k * w) * F.count(k) / (F.sum(w) + 1e-10)).alias("weighted_min"), F.try_divide(F.sum(k * negative), F.sum(negative)).alias("bridge_score"))


def forman(dir_edges: DataFrame) -> DataFrame:
    undir = undirected(dir_edges)
    d = degrees(undir)
    rows = undir.join(d.toDF(Q, "i", "di"), [Q, "i"]).join(d.toDF(Q, "j", "dj"), [Q, "j"])
    f = F.lit(4) - F.col("di") - F.col("dj")
    return rows.groupBy(Q).agg(F.avg(f).alias("forman_mean"), F.min(f).alias("forman_min"), F.max(f).alias("forman_max"))


def type_metrics(survivors: DataFrame) -> DataFrame:
    counts = survivors.groupBy(Q, "type").agg(F.count(F.lit(1)).alias("n"))
    share = survivors.groupBy(Q).agg((F.count_if(F.col("type") == "OBLIGATION") / F.count(F.lit(1))).alias("obligation_frac"), F.count(F.lit(1)).alias("n"))
    return share.join(entropy(counts).withColumnRenamed("entropy", "type_entropy"), Q)


def transition_entropy(survivors: DataFrame, dir_edges: DataFrame) -> DataFrame:
    types = survivors.select(Q, "idx", "type")
    pairs = dir_edges.join(types.toDF(Q, "i", "a"), [Q, "i"]).join(types.toDF(Q, "j", "b"), [Q, "j"]).groupBy(Q, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return entropy(pairs)


def bipartite(survivors: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, n_entity, n_term, projected: clauses, terms, and pairs of clauses that use a term together."""
    entity, term = F.col("type").isin("OBLIGATION", "RIGHT", "CONDITION"), F.col("type").isin("DEFINITION", "REFERENCE")
    clauses, terms = survivors.where(entity).select(Q, "idx"), survivors.where(term).select(Q, "idx")
    uses = dir_edges.where("etype = 'USES_TERM'")
    links = uses.select(Q, F.col("i").alias("e"), F.col("j").alias("t")).union(uses.select(Q, "j", "i")).distinct()
    links = links.join(clauses.toDF(Q, "e"), [Q, "e"]).join(terms.toDF(Q, "t"), [Q, "t"])
    pairs = links.join(links.select(Q, "t", F.col("e").alias("f")), [Q, "t"]).where("e < f").select(Q, "e", "f").distinct().groupBy(Q).agg(F.count(F.lit(1)).alias("projected"))
    sizes = survivors.groupBy(Q).agg(F.count_if(entity).alias("n_entity"), F.count_if(term).alias("n_term"))
    return sizes.join(pairs, Q, "left").select(Q, "n_entity", "n_term", F.coalesce("projected", F.lit(0)).alias("projected"))


def clustering(dir_edges: DataFrame) -> DataFrame:
    """question_id, n_triangles, n_triples, mean_local: triangles found once by their numbers in order, then dealt to their corners."""
    e, near = simple_edges(dir_edges), neighbours(dir_edges)
    degree = near.groupBy(Q, "v").agg(F.count(F.lit(1)).alias("d")).where("d >= 2")
    triangles = e.toDF(Q, "a", "b").join(e.toDF(Q, "a", "c"), [Q, "a"]).where("b < c").join(e.toDF(Q, "b", "c"), [Q, "b", "c"])
    corners = triangles.select(Q, F.explode(F.array("a", "b", "c")).alias("v")).groupBy(Q, "v").agg(F.count(F.lit(1)).alias("closed"))
    rows = degree.join(corners, [Q, "v"], "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return rows.groupBy(Q).agg((F.sum("closed") / 3).cast("long").alias("n_triangles"), F.sum(pairs).cast("long").alias("n_triples"), F.avg(F.col("closed") / pairs).alias("mean_local"))


def anchor_jaccard(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, n_pairs, mean_jaccard, min_jaccard of the neighbourhoods of anchor pairs, without each other.

    Pairs are those of one question's survivors, which are few."""
    near = neighbours(dir_edges).groupBy(Q, "v").agg(F.collect_set("u").alias("near"))
    own = marked.where("anchor").select(Q, F.col("idx").alias("v")).join(near, [Q, "v"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    pairs = own.toDF(Q, "a", "na").join(own.toDF(Q, "b", "nb"), Q).where("a < b")
    na, nb = F.array_except("na", F.array("b")), F.array_except("nb", F.array("a"))
    j = F.coalesce(F.try_divide(F.size(F.array_intersect(na, nb)), F.size(F.array_union(na, nb))), F.lit(0.0))
    return pairs.groupBy(Q).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(j).alias("mean_jaccard"), F.min(j).alias("min_jaccard"))


def target_centrality(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    d = degrees(undirected(dir_edges))
    rows = marked.select(Q, "idx", "target").join(d, [Q, "idx"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    own = F.when(F.col("target"), F.col("degree"))
    return rows.groupBy(Q).agg(F.count_if("target").alias("n_targets"), F.avg(own).alias("mean_degree"), F.min(own).alias("min_degree"), F.avg(F.when(F.col("target"), (F.col("degree") <= 1).cast("int"))).alias("orphan_frac"), F.avg(F.col("target").cast("int")).alias("target_frac"))


def feed_forward(survivors: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, n_ffl, typed_ffl: for each edge i to j, the nodes k other than j with i to k and k to j."""
    e = dir_edges.select(Q, "i", "j")
    simple = e.distinct()
    loops = e.join(simple.toDF(Q, "i", "k"), [Q, "i"]).where("k <> j").join(simple.toDF(Q, "k", "j"), [Q, "k", "j"])
    loops = loops.join(survivors.select(Q, F.col("idx").alias("k"), "type"), [Q, "k"])
    return loops.groupBy(Q).agg(F.count(F.lit(1)).alias("n_ffl"), F.count_if(F.col("type").isin("OBLIGATION", "RIGHT", "NUMERIC", "DEFINITION")).alias("typed_ffl"))


def chain_completeness(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, n_conditions, complete, dangling: conditions that something triggers, with or without a target that they trigger."""
    t = dir_edges.where("etype = 'TRIGGERS'")
    premise = t.select(Q, F.col("j").alias("idx")).distinct().withColumn("premise", F.lit(True))
    goal = t.join(marked.where("target").select(Q, F.col("idx").alias("j")), [Q, "j"]).select(Q, F.col("i").alias("idx")).distinct().withColumn("goal", F.lit(True))
    rows = marked.where("type = 'CONDITION'").select(Q, "idx").join(premise, [Q, "idx"], "left").join(goal, [Q, "idx"], "left")
    return rows.groupBy(Q).agg(F.count(F.lit(1)).alias("n_conditions"), F.count_if(F.col("premise") & F.col("goal")).alias("complete"), F.count_if(F.col("premise") & F.col("goal").isNull()).alias("dangling"))


def anchor_type_match(marked: DataFrame) -> DataFrame:
    """question_id, score, diversity: whether anchors are of a target type (1), one step from one (.6), two (.3) or neither."""
    one, two = F.lit(False), F.lit(False)
    for kind, nexts in LEADS_TO.items():
        far = [b for a in nexts for b in LEADS_TO.get(a, ())]
        step = lambda kinds: F.exists(F.array(*map(F.lit, kinds or ("-",))), lambda k: among(k, F.col("slot"), TERMINAL))
        one = one | ((F.col("type") == kind) & step(nexts))
        two = two | ((F.col("type") == kind) & step(far))
    score = F.when(F.col("target"), 1.0).when(one, 0.6).when(two, 0.3).otherwise(0.0)
    return marked.where("anchor").groupBy(Q).agg(F.avg(score).alias("score"), (F.count_distinct("type") / F.count(F.lit(1))).alias("diversity"))


def slot_mismatch(marked: DataFrame) -> DataFrame:
    """question_id, depth, exact, adjacent, distant: how far the types of targets, or else of all survivors, are from the slot's."""
    far = F.lit(3)
    for (a, b), steps in sorted(DISTANCE.items(), key=lambda x: -x[1]):
        for x, y in ((a, b), (b, a)):
            far = F.when((F.col("type") == x) & among(F.lit(y), F.col("slot"), TERMINAL), steps).otherwise(far)
    far = F.when((F.col("type") == "REFERENCE") & (among(F.lit("OBLIGATION"), F.col("slot"), TERMINAL) | among(F.lit("RIGHT"), F.col("slot"), TERMINAL)), 1).otherwise(far)
    text = nx.joined("source_text", "action", "right_text", "trigger", "consequence", "applies_to", "value", "unit")
    relevant = F.col("target") | ((F.col("slot") == "VALUE") & text.rlike(r"\d"))
    rows = marked.withColumn("relevant", relevant).withColumn("d", F.when(F.col("target"), 0).otherwise(far))
    rows = rows.withColumn("any", F.max(F.col("relevant").cast("int")).over(Window.partitionBy(Q))).where("relevant OR any = 0")
    share = lambda test: F.avg(test.cast("int"))
    return rows.groupBy(Q).agg(F.avg("d").alias("depth"), share(F.col("d") == 0).alias("exact"), share(F.col("d") == 1).alias("adjacent"), share(F.col("d") >= 2).alias("distant"))


def required_sequence(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, present, total: typed steps that the slot needs, and those that are there."""
    types = marked.select(Q, "idx", "type")
    steps = dir_edges.join(types.toDF(Q, "i", "a"), [Q, "i"]).join(types.toDF(Q, "j", "b"), [Q, "j"]).select(Q, F.concat_ws(">", "a", "etype", "b").alias("step")).distinct()
    had = steps.groupBy(Q).agg(F.collect_set("step").alias("had"))
    table = F.create_map(*[x for s, seqs in SEQUENCES.items() for x in (F.lit(s), F.array(*[F.lit(">".join(q)) for q in seqs]))])
    need = F.coalesce(F.try_element_at(table, F.col("slot")), table["GENERAL"])
    rows = marked.select(Q, "slot").distinct().join(had, Q, "left")
    return rows.select(Q, F.size(F.array_intersect(need, F.coalesce("had", F.array().cast("array<string>")))).alias("present"), F.size(need).alias("total"))


def directional_mismatch(marked: DataFrame, questions: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, n_parties, n_match, n_has, n_inverted: anchors with the question's party, and party edges that only end in it."""
    rows = marked.where("anchor").join(questions.select(Q, F.lower(F.trim("party")).alias("asked")), Q).where("asked <> ''").withColumn("own", F.trim(F.lower(F.coalesce("party", F.lit(""))))).where("own <> ''")
    like = lambda p: F.contains(p, F.col("asked")) | F.contains(F.col("asked"), p)
    counts = rows.groupBy(Q).agg(F.count(F.lit(1)).alias("n_parties"), F.count_if(like(F.col("own"))).alias("n_match"))
    side = rows.select(Q, "idx", "own", "asked")
    has = dir_edges.where("etype = 'PARTY_HAS'").join(side.toDF(Q, "i", "oi", "asked"), [Q, "i"]).join(side.select(Q, F.col("idx").alias("j"), F.col("own").alias("oj")), [Q, "j"])
    turned = has.groupBy(Q).agg(F.count(F.lit(1)).alias("n_has"), F.count_if(like(F.col("oj")) & ~like(F.col("oi"))).alias("n_inverted"))
    return counts.join(turned, Q, "left").select(Q, "n_parties", "n_match", F.coalesce("n_has", F.lit(0)).alias("n_has"), F.coalesce("n_inverted", F.lit(0)).alias("n_inverted"))


def keyword_trap(marked: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, anchor_frac, ricci_mean, flagged, confidence: many matches on a graph of bridges."""
    rows = marked.groupBy(Q).agg(F.avg(F.col("anchor").cast("int")).alias("anchor_frac")).join(ricci(dir_edges).select(Q, "ricci_mean"), Q, "left")
    a, r = F.col("anchor_frac"), F.col("ricci_mean")
    deep = (F.greatest(F.lit(0.0), a - 0.5) / (0.5 + 1e-6) + F.greatest(F.lit(0.0), -r - 0.55) / (1 + 1e-6)) / 2
    return rows.select(Q, "anchor_frac", "ricci_mean", ((a > 0.5) & (r < -0.55)).alias("flagged"), F.when(r.isNotNull(), F.least(F.lit(1.0), deep)).alias("confidence"))


def contrastive(scores: DataFrame) -> DataFrame:
    """Scores (session, slot, seq, score) with the mean of the session's earlier scores of the slot and the gap to it."""
    w = Window.partitionBy("session", "slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return scores.withColumn("session_mean", F.avg("score").over(w)).withColumn("gap", F.col("score") - F.col("session_mean"))


def vote_stats(survivors: DataFrame) -> DataFrame:
    """Spread of survivors' shares of votes (vote_frac) and counts (votes)."""
    f = F.least(F.greatest(F.col("vote_frac"), F.lit(0.0)), F.lit(1.0))
    return survivors.groupBy(Q).agg(F.avg(f).alias("mean_frac"), F.percentile(f, F.lit(0.75)).alias("p75_frac"), F.avg((f >= 0.6).cast("int")).alias("high_frac"), F.max(f).alias("max_frac"), F.count_if(F.col("votes") >= 2).alias("n_ge2"), F.count_if(F.col("votes") >= 3).alias("n_ge3"), F.avg("votes").alias("mean_votes"))


def degree_entropy(survivors: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """question_id, deg_entropy, hub_frac, isolated_frac, gini of the degrees."""
    rows = survivors.select(Q, "idx").join(degrees(undirected(dir_edges)), [Q, "idx"], "left").withColumn("d", F.coalesce("degree", F.lit(0)).cast("double"))
    whole = Window.partitionBy(Q)
    rows = rows.withColumns({"total": F.sum("d").over(whole), "m": F.avg("d").over(whole), "s": F.stddev_pop("d").over(whole), "rank": F.row_number().over(whole.orderBy("d", "idx")), "n": F.count(F.lit(1)).over(whole)})
    p = F.try_divide(F.col("d"), F.col("total"))
    gini = 2 * F.sum(F.col("rank") * F.col("d")) / (F.first("n") * F.first("total")) - (F.first("n") + 1) / F.first("n")
    return rows.groupBy(Q).agg((-F.sum(F.when(F.col("d") > 0, p * F.log2(p)).otherwise(0.0))).alias("deg_entropy"), F.avg((F.col("d") > F.col("m") + F.col("s")).cast("int")).alias("hub_frac"), F.avg((F.col("d") == 0).cast("int")).alias("isolated_frac"), F.when(F.first("total") > 0, gini).otherwise(0.0).alias("gini"))


#: What a stated value and a placeholder look like.
REAL_VALUE = r"(?i)^[\$£€]?\s*\d[\d,\.]*\s*(%|k|m|bn|million|billion|days?|months?|years?|mbps|usd)?$"
PLACEHOLDER = r"^[a-zA-Z](\s+\w+)?$"


def placeholders(survivors: DataFrame) -> DataFrame:
    """question_id, n_numeric, n_placeholder, placeholder_frac of the numerics' values."""
    v = F.trim(F.coalesce("value", F.lit("")))
    held = v.rlike(PLACEHOLDER) & ~v.rlike(REAL_VALUE)
    numeric = F.col("type") == "NUMERIC"
    return survivors.groupBy(Q).agg(F.count_if(numeric).alias("n_numeric"), F.count_if(numeric & held).alias("n_placeholder"), F.avg(F.when(numeric, held.cast("int"))).alias("placeholder_frac"))


def wanted_tags(question: Column) -> Column:
    """Tags that the question asks for, by the words in it."""
    low, empty = F.lower(question), F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.when(F.contains(low, F.lit(w)), F.array(*map(F.lit, tags))).otherwise(empty) for w, tags in CONCEPTS.items()])))


def tag_match(survivors: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, n_required, best_overlap, match_score: the most wanted tags that one survivor has."""
    rows = questions.select(Q, wanted_tags(F.col("question")).alias("want")).where("size(want) > 0")
    own = survivors.where(F.col("type").isin("NUMERIC", "DEFINITION") & (F.size("value_tags") > 0)).select(Q, "value_tags")
    overlap = F.size(F.array_intersect("want", "value_tags"))
    got = rows.join(own, Q, "left").groupBy(Q, F.size("want").alias("n_required")).agg(F.max(F.when(F.col("value_tags").isNotNull(), overlap)).alias("best_overlap"))
    return got.withColumn("match_score", F.least(F.lit(1.0), F.col("best_overlap") / F.col("n_required")))


#: Words without weight in a question, and signs of a stated answer.
STOP = ("the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "by", "with", "what", "which", "is", "are", "was", "were", "does", "do", "did", "under", "this", "that", "it", "as", "at", "from")
DATE = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}|\d{1,2}/\d{1,2}/\d{2,4}"
PERCENT = r"\b\d{1,3}(?:\.\d+)?\s*%"
RULE_WORDS = ("shall", "must", "may not", "shall not", "no fees", "not pay", "agrees to")
STATED = (" shall ", " must ", " is ", " means ", " will ", " shall not ", " no ")


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP)))


def direct_support(survivors: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, support, best_idx: the survivor that most directly states what is asked; the first of equals.

    Questions are (question_id, question, asks_date, asks_percent, asks_value, asks_name, asks_list, asks_rule)."""
    raw = F.trim(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("source_text", "action", "party", "term", "right_text", "definition", "trigger", "consequence", "applies_to", "value", "unit")]))
    rows = survivors.select(Q, "idx", "score", raw.alias("raw")).where("raw <> ''").join(questions, Q).withColumns({"low": F.lower("raw"), "asked": content_words(F.col("question"))})
    r = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", content_words(F.col("raw")))) / F.size("asked")).otherwise(0.0)
    gives = lambda asks, test, worth: F.when(F.col(asks) & test, worth).otherwise(0.0)
    count = lambda ch: F.length("raw") - F.length(F.replace(F.col("raw"), F.lit(ch), F.lit("")))
    kind = F.greatest(
        gives("asks_date", F.col("raw").rlike(DATE), 1.0), gives("asks_percent", F.col("raw").rlike(PERCENT), 1.0), gives("asks_value", F.col("raw").rlike(r"\d"), 0.9),
        gives("asks_name", has_any(F.col("low"), ("this agreement", "means", "defined as")), 0.8), gives("asks_list", count(";") + count(",") >= 2, 0.8), gives("asks_rule", has_any(F.col("low"), RULE_WORDS), 0.85),
    )
    rows = rows.withColumns({"r": r, "kind": kind})
    kind = F.when(F.col("kind") == 0, F.least(F.lit(0.75), 0.65 * F.col("r"))).otherwise(F.col("kind"))
    stated = F.when(has_any(F.col("low"), STATED), 1.0).otherwise(0.35)
    support = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * F.col("r") + 0.35 * kind + 0.15 * stated + 0.05 * F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))))
    best = F.max(F.struct(support.alias("s"), (-F.col("idx")).alias("k")))
    return rows.groupBy(Q).agg(best.alias("b")).select(Q, F.col("b.s").alias("support"), (-F.col("b.k")).alias("best_idx"))


# Names of outside documents, words that only point to them, words that state something.
OUTSIDE = {
    "dpa": ("dpa", "data processing addendum"), "security_measures": ("security measures",), "pricing_page": ("pricing page",), "service_specific_terms": ("service-specific terms", "service specific terms"), "healthcare_addendum": ("healthcare addendum",),
    "audit_reports": ("audit report", "audit reports"), "supported_countries": ("supported countries", "territories"), "order_form": ("order form",), "exhibit": ("exhibit",), "schedule": ("schedule",), "appendix": ("appendix",), "annex": ("annex",),
}
POINTERS = ("incorporated by reference", "available at", "located at", "at:", "see ", "as set forth in", "according to", "will comply with", "comply with the", "provided by", "provided in")
DETAILS = (" must ", " shall ", " may ", " may not ", " cannot ", " prohibited ", " means ", " includes ", " no more than ", " at least ", "within ", "%", "$")


def outside_dependency(survivors: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, related, related_ratio, ref_only_ratio, inline_ratio, doc_match_ratio: survivors that name outside documents, and
    whether they only point to them or state something themselves. Questions are (question_id, external_doc, wants_contents)."""
    rows = survivors.join(questions.select(Q, "external_doc", "wants_contents"), Q)
    text = F.trim(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in ("source_text", "ref_to", "describes")])))
    rows = rows.withColumn("text", text)
    t = F.col("text")
    named = F.lit(False)
    for name, words in OUTSIDE.items():
        named = named | ((F.col("external_doc") == name) & has_any(t, words))
    detail, ref = has_any(F.concat(F.lit(" "), t, F.lit(" ")), DETAILS), F.col("type") == "REFERENCE"
    related = has_any(t, [w for words in OUTSIDE.values() for w in words])
    only = ref | (has_any(t, POINTERS) & ~detail) | (F.col("wants_contents") & has_any(t, ("comply with", "incorporated by reference")))
    long = F.size(F.filter(F.split(F.lower(F.coalesce("source_text", F.lit(""))), r"\s+"), lambda w: w != "")) >= 16
    got = rows.groupBy(Q).agg(F.count(F.lit(1)).alias("n"), F.count_if(related).alias("related"), F.count_if(related & only).alias("only"), F.count_if(related & ~only & ~ref & (detail | long)).alias("inline"), F.count_if(related & named).alias("named"))
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("related")), F.lit(0.0))
    return got.select(Q, "related", (F.col("related") / F.col("n")).alias("related_ratio"), share("only").alias("ref_only_ratio"), share("inline").alias("inline_ratio"), share("named").alias("doc_match_ratio"))


def complete(questions: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for each question: nulls where there was nothing to measure."""
    return questions.select(Q).join(metrics, Q, "left")
