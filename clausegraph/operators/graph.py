"""The document graph: edges between nodes by five rules, and walks over it. An edge is (doc_id, src, dst, etype, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import nodes as nx
from clausegraph.functions.numerics import has_any
from clausegraph.functions.text import long_words, parent_label
from clausegraph.schema import EDGE_SCALE, OTHER_SCALE, STORED_WEIGHT


def _edge(src: str, dst: str, etype: str) -> list[Column]:
    return [F.col("doc_id"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(etype).alias("etype"), F.lit(STORED_WEIGHT[etype]).alias("weight")]


def uses_term(nodes: DataFrame, least: int = 3) -> DataFrame:
    """From clauses to the defined terms (longer than `least`) that stand in their text.

    Only texts that hold a term's longest word as a word or part of one can hold the term, but parts of words defeat an
    equality join; so a document's distinct terms are one array, and each clause is scanned once against it."""
    terms = nodes.where("type = 'DEFINITION'").select("doc_id", F.lower("term").alias("term")).where(F.length("term") > least)
    table = terms.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    clauses = nodes.where("type IN ('OBLIGATION', 'RIGHT', 'CONDITION', 'NUMERIC')").select("doc_id", "node_key", nx.all_text().alias("text")).distinct()
    found = clauses.join(table, "doc_id").select("doc_id", "node_key", F.explode(F.filter("terms", lambda t: F.contains(F.col("text"), t))).alias("term"))
    return found.withColumn("to", F.concat(F.lit("DEF::"), F.col("term"))).select(*_edge("node_key", "to", "USES_TERM")).distinct()


#: Words that clauses share without being about the same thing.
COMMON = ("party", "parties", "agreement", "shall", "must")


def triggers(nodes: DataFrame, least: int = 2) -> DataFrame:
    """From conditions to what shares `least` distinct words of four letters or more with their consequence.

    Only words of the document's consequences count, and by those many clauses of a document are the same. So sets of words
    are compared, each once: two sets that share `least` words share one that isn't among the `least` - 1 most frequent of
    either, which pairs them, and their words decide. Clauses are put in the place of their sets at the end."""
    own = lambda text: F.array_except(long_words(text), F.array(*map(F.lit, COMMON)))
    united = F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")
    a = nodes.where("type = 'CONDITION'").select("doc_id", F.col("node_key").alias("a"), own(F.coalesce("consequence", F.lit(""))).alias("words"))
    a = a.groupBy("doc_id", "a").agg(united).where(F.size("words") >= least)
    said = a.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(F.array_sort("words")))).alias("said"))
    b = nodes.where("type IN ('OBLIGATION', 'RIGHT', 'NUMERIC')").select("doc_id", F.col("node_key").alias("b"), own(nx.all_text()).alias("words"))
    b = b.join(said, "doc_id").select("doc_id", "b", F.array_intersect("words", "said").alias("words")).where(F.size("words") >= 1)
    b = b.groupBy("doc_id", "b").agg(united).where(F.size("words") >= least).withColumn("words", F.array_sort("words"))
    a = a.withColumn("words", F.array_sort("words"))
    sets = b.groupBy("doc_id", "words").agg(F.count(F.lit(1)).alias("n"))
    often = sets.select("doc_id", "n", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.sum("n").alias("often"))
    heads = lambda side, name: (
        side.select("doc_id", F.col("words").alias(name), F.explode("words").alias("word")).join(often, ["doc_id", "word"], "left")
        .groupBy("doc_id", name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("ranked"))
        .select("doc_id", name, F.explode(F.slice("ranked", 1, F.greatest(F.lit(1), F.size("ranked") - least + 1))).alias("head")).select("doc_id", name, F.col("head.word").alias("word"))
    )
    met = heads(a.select("doc_id", "words").distinct(), "x").join(heads(sets, "y"), ["doc_id", "word"]).select("doc_id", "x", "y").distinct()
    met = met.where(F.size(F.array_intersect("x", "y")) >= least)
    found = met.join(a.withColumnRenamed("words", "x"), ["doc_id", "x"]).join(b.withColumnRenamed("words", "y"), ["doc_id", "y"])
    return found.select(*_edge("a", "b", "TRIGGERS"))


def _together(rows: DataFrame, place: str) -> DataFrame:
    """Between all nodes of a place of a document, both ways; rows are (doc_id, place, node_key), each once.

    A pair comes from the least place that both have, so none is repeated and pairs, which are far more than nodes, are neither
    sorted nor kept."""
    w = Window.partitionBy("doc_id", "node_key")
    a = rows.where(F.col(place).isNotNull()).withColumn("places", F.collect_set(place).over(w)).withColumn("places", F.when(F.size("places") > 1, F.col("places")))
    b = a.select("doc_id", place, F.col("node_key").alias("other"), F.col("places").alias("others"))
    first = F.col("places").isNull() | F.col("others").isNull() | (F.col(place) == F.array_min(F.array_intersect("places", "others")))
    return a.join(b, ["doc_id", place]).where((F.col("node_key") != F.col("other")) & first).select(*_edge("node_key", "other", "SAME_SECTION"))


def same_chunk(nodes: DataFrame) -> DataFrame:
    """Between all nodes of a chunk, both ways (a chunk's nodes are few: a chunk is at most 1800 characters)."""
    return _together(nodes.select("doc_id", "chunk_id", "node_key").distinct(), "chunk_id")


def same_label(nodes: DataFrame, most: int = 30, order: tuple[str, ...] = ("chunk_id", "node_key")) -> DataFrame:
    """Between the first `most` nodes under a section label, both ways."""
    rows = nodes.withColumn("label", parent_label("source_text")).where("label IS NOT NULL").select("doc_id", "label", "chunk_id", "node_key").distinct()
    w = Window.partitionBy("doc_id", "label").orderBy(*order)
    return _together(rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).select("doc_id", "label", "node_key").distinct(), "label")


#: Words that make a defined term a party.
PARTY_WORDS = ("licensee", "licensor", "company", "vendor", "client", "party", "distributor", "customer")


def party_has(nodes: DataFrame) -> DataFrame:
    """From defined parties to their obligations and rights."""
    parties = nodes.where("type = 'DEFINITION'").where(has_any(F.lower("term"), PARTY_WORDS)).select("doc_id", F.lower("term").alias("party_key"), F.col("node_key").alias("a")).distinct()
    own = nodes.where("type IN ('OBLIGATION', 'RIGHT')").select("doc_id", F.lower("party").alias("party_key"), "node_key").distinct()
    return parties.join(own, ["doc_id", "party_key"]).select(*_edge("a", "node_key", "PARTY_HAS"))


def build_graph(nodes: DataFrame) -> DataFrame:
    """All edges, each once by its ends and kind. `nodes` has node_key."""
    every = uses_term(nodes).unionByName(triggers(nodes)).unionByName(same_chunk(nodes)).unionByName(same_label(nodes)).unionByName(party_has(nodes))
    return every.dropDuplicates(["doc_id", "src", "dst", "etype"])


def both_ways(edges: DataFrame) -> DataFrame:
    """doc_id, node, near, etype, back: each edge as seen from both of its ends."""
    out = edges.select("doc_id", F.col("src").alias("node"), F.col("dst").alias("near"), "etype", F.lit(0).alias("back"))
    return out.unionByName(edges.select("doc_id", F.col("dst").alias("node"), F.col("src").alias("near"), "etype", F.lit(1).alias("back")))


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 25) -> DataFrame:
    """question_id, doc_id, node_key, hop: the first `most` nodes within `hops` steps of a question's seeds (question_id, doc_id, node_key, rank).

    Nearer nodes first, then those of better seeds, then by key."""
    near = both_ways(edges).select("doc_id", "node", "near").distinct()
    ring = seeds.select("question_id", "doc_id", "node_key", "rank")
    found = None
    for hop in range(1, hops + 1):
        step = ring.join(near, (ring["doc_id"] == near["doc_id"]) & (ring["node_key"] == near["node"]))
        ring = step.groupBy("question_id", ring["doc_id"], F.col("near").alias("node_key")).agg(F.min("rank").alias("rank"))
        known = seeds.select("question_id", "node_key")
        ring = ring.join(known, ["question_id", "node_key"], "left_anti")
        if found is not None:
            ring = ring.join(found.select("question_id", "node_key"), ["question_id", "node_key"], "left_anti")
        level = ring.select("question_id", "doc_id", "node_key", "rank", F.lit(hop).alias("hop"))
        found = level if found is None else found.unionByName(level)
    w = Window.partitionBy("question_id").orderBy("hop", "rank", "node_key")
    return found.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def chain_annotations(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """question_id, node_key, notes: what each survivor is told of its edges to other survivors, in order."""
    ends = survivors.select("question_id", "doc_id", "node_key")
    a, b = ends.alias("a"), ends.alias("b")
    inside = edges.join(a, (F.col("src") == F.col("a.node_key")) & (edges["doc_id"] == F.col("a.doc_id"))).join(b, (F.col("a.question_id") == F.col("b.question_id")) & (F.col("dst") == F.col("b.node_key")))
    return annotations(inside.where("etype <> 'SAME_SECTION'").select(F.col("a.question_id"), "src", "dst", "etype"))


def annotations(rows: DataFrame) -> DataFrame:
    """question_id, node_key, notes of edges (question_id, src, dst, etype) between survivors."""
    there = F.when(F.col("etype") == "USES_TERM", "uses term: ").when(F.col("etype") == "TRIGGERS", "triggers: ").otherwise(F.concat(F.lower("etype"), F.lit(": ")))
    out = F.struct(F.col("src").alias("node_key"), F.concat(there, "dst").alias("note"))
    back = F.struct(F.col("dst").alias("node_key"), F.concat(F.lit("triggered by: "), F.col("src")).alias("note"))
    told = rows.select("question_id", F.inline(F.when(F.col("etype") == "TRIGGERS", F.array(out, back)).otherwise(F.array(out))))
    return told.groupBy("question_id", "node_key").agg(F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("notes"))


def contradictions(nodes: DataFrame) -> DataFrame:
    """doc_id, a, b: obligations of one party to one action (by its first 40 characters) with different modals."""
    rows = nodes.where("type = 'OBLIGATION'").select("doc_id", F.lower("party").alias("p"), F.substring(F.lower("action"), 1, 40).alias("act"), "node_key", F.lower("modal").alias("modal")).distinct()
    other = rows.select("doc_id", "p", "act", F.col("node_key").alias("b"), F.col("modal").alias("m"))
    return rows.join(other, ["doc_id", "p", "act"]).where("modal < m").select("doc_id", F.col("node_key").alias("a"), "b", "modal", F.col("m").alias("other_modal"))


def nodes_of_party(nodes: DataFrame, party: str) -> DataFrame:
    return nodes.where(F.col("type").isin("OBLIGATION", "RIGHT") & (F.lower("party") == party.lower()))


def edge_weight(a: Column, b: Column, etype: Column) -> Column:
    """Mean score of both ends, scaled by how reliable the kind of edge is."""
    scale = F.lit(OTHER_SCALE)
    for name, s in EDGE_SCALE.items():
        scale = F.when(etype == name, s).otherwise(scale)
    return (F.coalesce(a, F.lit(0.5)) + F.coalesce(b, F.lit(0.5))) / 2 * scale


def subgraph(survivors: DataFrame, edges: DataFrame) -> DataFrame:
    """question_id, i, j, etype, w: directed edges between survivors (question_id, doc_id, node_key, idx, score), by their numbers."""
    a = survivors.select("question_id", "doc_id", F.col("node_key").alias("src"), F.col("idx").alias("i"), F.col("score").alias("si"))
    b = survivors.select("question_id", F.col("node_key").alias("dst"), F.col("idx").alias("j"), F.col("score").alias("sj"))
    inside = edges.select("doc_id", "src", "dst", "etype").join(a, ["doc_id", "src"]).join(b, ["question_id", "dst"])
    return inside.select("question_id", "i", "j", "etype", edge_weight(F.col("si"), F.col("sj"), F.col("etype")).alias("w")).distinct()


def undirected(dir_edges: DataFrame) -> DataFrame:
    """question_id, i, j, etype, w with i < j: one edge for each pair and kind."""
    pair = dir_edges.select("question_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "etype", "w")
    return pair.groupBy("question_id", "i", "j", "etype").agg(F.max("w").alias("w"))


def simple_edges(dir_edges: DataFrame) -> DataFrame:
    """question_id, i, j with i < j: pairs with an edge of any kind."""
    return dir_edges.select("question_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i < j").distinct()
