"""Questions from their text to survivors, measures and a record for the scorer, all questions in one table.

A question is (question_id, doc_id, question); `parsed` adds what it asks about, `asked` its wordings. Each distinct wording
is searched once, and counts as often as it was said. Readers are providers (clausegraph.sources.providers): without one
every reply is null, and what a reader would have told falls back to what follows from the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import nodes as nx
from clausegraph.functions import questions as qx
from clausegraph.functions import vectors as vx
from clausegraph.operators import coverage, graph, kernels, retrieval
from clausegraph.operators import topology as tp
from clausegraph.operators.scoring import MEASURES
from clausegraph.schema import NODE_TEXT
from clausegraph.sources import scratch
from clausegraph.sources.providers import Provider

Q = "question_id"

PARSE = """Parse the question into one JSON object with node_type, party, action, object_party, beneficiary, modal, term, applies_to, trigger, entity, verb, object, condition, requires_numeric and intent.

Question: """
REWORD = "Word the question in other ways, one on each line, each with a question mark.\n\nQuestion: "
READ = "Does the evidence answer the question? Reply as one JSON object with answerable, answer, confidence, reasoning.\n\n"
CONFIRM = "Does the text state the value that the question asks for? Reply yes or no.\n\n"

FIELDS = ("party", "action", "object_party", "beneficiary", "modal", "term", "applies_to", "trigger", "condition", "entity", "verb", "object")
#: The reader's names for the scores of an intent.
SAID = {
    "exact_intent": "exact_intent", "simple_extract": "simple_extract_intent", "speculative": "speculative_intent", "outside_document": "outside_document_intent", "missing_artifact": "missing_artifact_intent",
    "instance_missing": "instance_missing_field", "external_reference": "external_reference_intent", "expects_rule": "expects_direct_rule_clause", "outside_needed": "outside_doc_needed",
}
_PARSED = "node_type string, requires_numeric boolean, " + ", ".join(f"{f} string" for f in FIELDS) + ", intent struct<proof_type: string, answer_form: string, lane: string, " + ", ".join(f"{n}: double" for n in SAID.values()) + ">"


def cleaned(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def parsed(questions: DataFrame, provider: Provider) -> DataFrame:
    """Adds node_type, the fields of the question's own node, requires_numeric, qtype, slots, slot (the first), and said_* of its intent.

    A reply that is no object leaves a general question about its own words."""
    rows = provider(questions.withColumn("prompt", F.concat(F.lit(PARSE), F.col("question")))).withColumn("n", F.from_json("reply", _PARSED))
    got = {f: cleaned(F.col(f"n.{f}")) for f in FIELDS}
    got["modal"] = F.lower(got["modal"])
    got["entity"] = F.coalesce(got["entity"], got["party"], F.when(F.col("n").isNull(), F.col("question")), F.lit(""))
    got["verb"] = F.coalesce(got["verb"], got["action"], F.lit(""))
    got["object"] = F.coalesce(got["object"], got["applies_to"], F.lit(""))
    rows = rows.withColumns(got | {"node_type": F.coalesce(F.upper(cleaned(F.col("n.node_type"))), F.lit("GENERAL")), "requires_numeric": F.coalesce("n.requires_numeric", F.lit(False))})
    said = {f"said_{n}": F.col(f"n.intent.{given}") for n, given in SAID.items()} | {"said_proof": F.col("n.intent.proof_type"), "said_answer_form": F.col("n.intent.answer_form")}
    lane = F.when(F.col("n.intent").isNotNull(), qx.one_of("n.intent.lane", qx.LANES))
    rows = rows.withColumns(said | {"lane": lane}).drop("prompt", "reply", "n")
    rows = rows.withColumns({"qtype": qx.question_type("verb", "entity", "object", "requires_numeric"), "slots": qx.required_slots("question", "node_type", "requires_numeric", "modal", "verb")})
    return rows.withColumn("slot", F.get("slots", F.lit(0)))


def asked(questions: DataFrame, provider: Provider, n: int = 6) -> DataFrame:
    """question_id, doc_id, text, times, qtype, about, terms: each distinct wording of a question and how often it was said."""
    replies = provider(questions.withColumn("prompt", F.concat(F.lit(REWORD), F.col("question"))))
    words = replies.withColumn("texts", F.concat(F.array("question"), qx.variants("question", F.col("reply"), n)))
    about = F.concat_ws(" ", F.nullif("entity", "question"), F.nullif("verb", F.lit("")), F.nullif("object", F.lit("")))
    rows = words.select(Q, "doc_id", "qtype", about.alias("about"), qx.keywords("question").alias("own"), F.explode("texts").alias("text"))
    rows = rows.groupBy(Q, "doc_id", "qtype", "about", "own", "text").agg(F.count(F.lit(1)).alias("times"))
    return rows.select(Q, "doc_id", "text", "times", "qtype", "about", F.array_union("own", qx.keywords("text")).alias("terms"))


def searchable(nodes: DataFrame) -> DataFrame:
    """Nodes with all columns that a node may have, a number within the library, a vector, and the text that keywords are looked for in."""
    none = {c: F.lit(None).cast("string") for c in (*NODE_TEXT, "priority", "source_text") if c not in nodes.columns}
    none |= {} if "value_tags" in nodes.columns else {"value_tags": F.lit(None).cast("array<string>")}
    rows = nodes.withColumns(none).withColumn("search", nx.search_text())
    rows = vx.embed(rows, "search").withColumn("node_no", F.xxhash64("doc_id", "node_key"))
    return rows.withColumn("text", F.lower(F.concat_ws(" ", "source_text", "search"))).drop("search")


def retrieved(wordings: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 100) -> DataFrame:
    """question_id, variant, node_key, score: for each wording its nearest nodes by kind, those with its keywords, and their neighbours."""
    one = wordings.withColumn("variant", F.concat_ws("#", F.col(Q).cast("string"), "text"))
    search = vx.embed(one.withColumn("said", F.concat_ws(" ", "text", F.nullif("about", F.lit("")))), "said").withColumn("asker", F.col(Q)).withColumn(Q, F.col("variant"))
    search = scratch.kept(search, "search")
    pairs = nodes.select("doc_id", "node_no", "type", F.col("vector").alias("_v")).join(retrieval.small(search.select(Q, "doc_id", "qtype", F.col("vector").alias("_q"))), "doc_id")
    top = scratch.kept(retrieval.bucket_top_k(pairs.select(Q, "node_no", "type", "qtype", vx.dot("_q", "_v").alias("score")), k).select(Q, "node_no", "score", "rank"), "top")
    more = retrieval.keyword_augment(search, nodes, top)
    order = F.row_number().over(Window.partitionBy(Q).orderBy(F.col("hits").desc(), F.col("node_no").desc()))
    both = top.unionByName(more.select(Q, "node_no", "score", (F.lit(k) + order).alias("rank")))
    both = both.join(nodes.select("node_no", "doc_id", "node_key", "text"), "node_no").join(search.select(Q, "terms", "asker"), Q)
    boosted = scratch.kept(retrieval.keyword_boost(both).drop("text", "terms"), "boosted")
    far = retrieval.expanded(boosted.select(Q, "doc_id", "node_key", "rank"), edges).join(nodes.select("doc_id", "node_key"), ["doc_id", "node_key"], "left_semi")
    every = boosted.select(Q, "node_key", "score").unionByName(far.select(Q, "node_key", "score"))
    return every.join(search.select(Q, "asker", "times"), Q).select(F.col("asker").alias(Q), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"), F.col(Q).alias("text"), "node_key", "score").select(Q, F.struct("text", "time").alias("variant"), "node_key", "score")


def survivors(questions: DataFrame, found: DataFrame, nodes: DataFrame, n_queries: int = 7) -> DataFrame:
    """Node columns with question_id, votes, score, vote_frac, rank, idx: what stays after the vote, and what always joins."""
    held = nodes.drop("vector", "text", "node_no", "score", "votes")
    ask = questions.select(Q, "doc_id", "question")
    voted = retrieval.votes(found, F.lit(n_queries)).join(ask.select(Q, "doc_id"), Q).join(held, ["doc_id", "node_key"])
    stay = scratch.kept(retrieval.tiers(voted).drop("tier"), "stay")
    high = ask.select(Q, "doc_id").join(held.where("priority = 'high'"), "doc_id")
    first = retrieval.injected(stay, high, retrieval.PRIORITY_SCORE)
    parties = held.where("type IN ('OBLIGATION', 'RIGHT') AND length(trim(party)) > 0").groupBy("doc_id").agg(F.collect_set(F.trim(F.lower("party"))).alias("parties"))
    named = ask.join(parties, "doc_id").select(Q, "doc_id", retrieval.named_party(F.col("question"), F.col("parties")).alias("named")).where("named IS NOT NULL")
    own = named.join(held.where("type IN ('OBLIGATION', 'RIGHT')"), "doc_id").where("trim(lower(party)) = named").drop("named")
    stages = [stay, first, retrieval.injected(stay.select(Q, "node_key").unionByName(first.select(Q, "node_key")), own, retrieval.PARTY_SCORE)]
    names = [Q, *held.columns, "votes", "score", "vote_frac"]
    rows = None
    for k, stage in enumerate(stages):
        part = stage.withColumn("_rank", F.col("rank") if k == 0 else F.lit(0)).select(*names, "_rank", F.lit(k).alias("_stage"))
        rows = part if rows is None else rows.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(Q).orderBy("_stage", "_rank", "node_key"))
    return rows.withColumn("rank", rank).withColumn("idx", F.col("rank") - 1).drop("_rank", "_stage")


def covered(questions: DataFrame, kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, coverage, verdict: how well the survivors fill the slots."""
    about = F.concat_ws(" ", F.nullif("entity", "question"), F.nullif("verb", F.lit("")), F.nullif("object", F.lit("")))
    subject = vx.embed(questions.withColumn("subject", F.when(about == "", F.col("question")).otherwise(about)), "subject", "_s")
    ask = subject.select(Q, "_s", "question", F.col("entity").alias("question_entity"), F.col("object_party").alias("asked_party"), F.col("slot").alias("first_slot"), F.explode("slots").alias("slot"))
    rows = vx.embed(kept.withColumn("key", nx.key_text()), "key", "_k").drop("key").join(ask, Q)
    none = {n: F.lit(None).cast("double") for n in ("verb_sim", "object_sim")}
    rows = rows.withColumns(none | {"subject_sim": vx.dot("_s", "_k"), "object_party": F.col("asked_party"), "question_entity": F.nullif("question_entity", "question"), "open_ended": qx.is_open("question"), "is_date": F.col("question").rlike(qx.DATE_QUESTION), "focus": qx.value_focus("question")})
    words = coverage.party_tokens(nodes).groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    anchored = questions.select(Q, "doc_id", "question").join(words, "doc_id", "left").select(Q, "doc_id", coverage.anchors(F.col("question"), F.coalesce("words", F.array().cast("array<string>"))).alias("anchors"))
    gates = coverage.pivot_gate(anchored, kept).join(coverage.concept_presence(anchored, nodes), Q)
    return coverage.coverage(coverage.node_slot_score(rows.drop("_s", "_k")), gates)


def triggered(marked: DataFrame, inside: DataFrame) -> DataFrame:
    """question_id, trigger_weight: the mean weight of TRIGGERS edges with an anchor at either end."""
    ends = marked.select(Q, "idx", "anchor")
    rows = inside.where("etype = 'TRIGGERS'").join(ends.toDF(Q, "i", "at_i"), [Q, "i"]).join(ends.toDF(Q, "j", "at_j"), [Q, "j"])
    return rows.where("at_i OR at_j").groupBy(Q).agg(F.avg("w").alias("trigger_weight"))


def snapshot(measures: DataFrame) -> DataFrame:
    """question_id, topology_snapshot: the measures as JSON, for a telemetry event; nulls are left out."""
    return measures.select(Q, F.to_json(F.struct(*[F.col(n) for n in MEASURES if n not in ("support_text", "lane")])).alias("topology_snapshot"))


def measured(questions: DataFrame, kept: DataFrame, edges: DataFrame, covers: DataFrame) -> DataFrame:
    """question_id and the scorer's MEASURES, computed: `edges` are the documents' edges, `questions` have their intent."""
    values = F.filter(F.array(*[F.col(f) for f in ("entity", "object", "party", "term", "applies_to")]), lambda v: F.coalesce(v, F.lit("")) != "")
    terms = F.transform(qx.keywords("question"), lambda t: t)
    ask = questions.withColumn("values", F.when(F.size(F.array_except(values, F.array("question"))) > 0, F.array_except(values, F.array("question"))).otherwise(terms)).withColumn("party", F.coalesce("party", F.lit("")))
    inside = graph.subgraph(kept, edges)
    # Some fifteen measures read these two.
    inside = scratch.kept(inside.withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")}), "inside")
    marked = scratch.kept(tp.anchors(kept.withColumn("idx", F.col("idx").cast("int")), ask.select(Q, "slot", "values")), "marked")
    weights = marked.select(Q, "idx", F.col("score").alias("weight"))
    kernel = kernels.topology(marked, inside)
    part = {
        "kernel": kernel.select(Q, "path_exists", "path_bottleneck", F.col("h0_mean_lifetime").alias("h0"), F.col("chain_strength").alias("chain"), "n_targets", F.col("n_well_connected").alias("n_well")),
        "sheaf": tp.sheaf(marked, inside).select(Q, F.try_divide("n_consistent", "n_edges").alias("sheaf")),
        "weighted": tp.weighted_sheaf(marked, inside, weights).select(Q, F.col("weighted_frac").alias("w_sheaf")),
        "curved": tp.weighted_ricci(inside, weights).select(Q, F.col("weighted_mean").alias("w_ricci"), F.col("bridge_score").alias("bridge")),
        "mismatch": tp.slot_mismatch(marked).select(Q, F.col("exact").alias("exact_frac"), F.col("distant").alias("distant_frac")),
        "sequence": tp.required_sequence(marked, inside).select(Q, F.try_divide("present", "total").alias("sequence_frac")),
        "triggers": triggered(marked, inside),
        "types": tp.type_metrics(kept).select(Q, F.col("n").cast("int").alias("n_nodes"), "type_entropy"),
        "counts": kept.groupBy(Q).agg(F.count_if(F.col("type") == "REFERENCE").cast("int").alias("n_reference"), F.count_if(F.col("type") == "BLANK").cast("int").alias("n_blank"), F.count_if(~F.col("type").isin("REFERENCE", "BLANK")).cast("int").alias("n_content"), F.bool_or(F.coalesce(F.size("value_tags"), F.lit(0)) > 0).alias("has_tags")),
        "placeholder": tp.placeholders(kept).select(Q, "placeholder_frac"),
        "direction": tp.directional_mismatch(marked, ask, inside).select(Q, (1 - F.try_divide("n_match", "n_parties")).alias("party_mismatch"), F.try_divide("n_inverted", "n_has").alias("role_inversion")),
        "trap": tp.keyword_trap(marked, inside).select(Q, F.col("flagged").alias("trap"), F.col("confidence").alias("trap_confidence")),
        "votes": tp.vote_stats(kept).select(Q, F.col("n_ge2").cast("int").alias("n_vote_ge2")),
        "outside": tp.outside_dependency(kept, ask.select(Q, "external_doc", F.col("asks_external_contents").alias("wants_contents"))).select(Q, "related_ratio", "ref_only_ratio", "inline_ratio", "doc_match_ratio"),
        "coverage": covers.select(Q, F.col("coverage").alias("slot_score")),
    }
    # Each slot of a question is covered by itself.
    by_slot = ask.select(Q, "values", F.explode("slots").alias("slot")).withColumn("pair", F.concat_ws("#", F.col(Q).cast("string"), "slot"))
    own = tp.anchors(kept.join(by_slot.select(Q, "pair"), Q).withColumn(Q, F.col("pair")).drop("pair"), by_slot.select(F.col("pair").alias(Q), "slot", "values"))
    steps = inside.join(by_slot.select(Q, "pair"), Q).withColumn(Q, F.col("pair")).drop("pair")
    fits = tp.path_coverage(own, steps).withColumnRenamed(Q, "pair").join(by_slot.select(Q, "pair"), "pair")
    part["slots"] = fits.groupBy(Q).agg(F.count(F.lit(1)).cast("int").alias("n_slots"), F.count_if("matched").cast("int").alias("n_matched"), F.count_if("direct").cast("int").alias("n_direct"))
    best = tp.direct_support(kept, ask.select(Q, "question", *[f"asks_{n}" for n in ("date", "percent", "value", "name", "list")], F.col("asks_yesno").alias("asks_rule")))
    raw = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("source_text", "action", "party", "term", "right_text", "definition", "trigger", "consequence", "applies_to", "value", "unit")]))
    told = best.join(kept.select(Q, F.col("idx").cast("int").alias("best_idx"), F.col("type").alias("support_type"), raw.alias("support_text")), [Q, "best_idx"]).join(ask.select(Q, "question"), Q)
    overlap = F.size(F.array_intersect(tp.content_words(F.col("question")), tp.content_words(F.col("support_text")))) / F.greatest(F.lit(1), F.size(tp.content_words(F.col("question"))))
    stated = F.when(tp.has_any(F.col("support_text"), tp.STATED), 1.0).otherwise(0.35)
    part["support"] = told.select(Q, "support", stated.alias("support_explicit"), overlap.alias("support_match"), "support_type", "support_text")
    out = ask.select(Q, "lane")
    for rows in part.values():
        out = out.join(rows, Q, "left")
    missing = {n: F.lit(None).cast(t) for n, t in MEASURES.items() if n not in out.columns}
    return out.withColumns(missing).select(Q, *[F.col(n).cast(t).alias(n) for n, t in MEASURES.items()])


def read(questions: DataFrame, facts: DataFrame, covers: DataFrame, provider: Provider, runs: int = 3, weak: float = 0.30) -> DataFrame:
    """question_id, vote_fraction, answer, reasoning, reader_confidence: what `runs` readings of the facts say.

    Without survivors the answer is no; where a reply is no object, the coverage decides, with low confidence. A yes on
    coverage of `weak` or less is noted, and isn't of high confidence."""
    rows = questions.select(Q, "question").join(facts, Q, "left").join(covers.select(Q, "coverage"), Q, "left").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    prompt = F.concat(F.lit(READ), F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), F.coalesce("facts", F.lit("")), F.lit("\n\nReading "), F.col("run").cast("string"))
    rows = provider(rows.withColumn("prompt", prompt)).withColumn("r", F.from_json("reply", "answerable boolean, answer string, confidence string, reasoning string"))
    none, silent = F.col("facts").isNull(), F.col("r.answerable").isNull()
    cover, thin = F.coalesce("coverage", F.lit(0.0)), F.concat(F.lit("slot coverage "), F.format_number(F.coalesce("coverage", F.lit(0.0)), 3), F.lit(f" is not above {weak:.3f}"))
    sure = qx.one_of("r.confidence", ("high", "medium", "low"), "medium")
    low = cover <= weak
    yes = F.when(none, False).when(silent, cover >= 0.65).otherwise(F.col("r.answerable"))
    rows = rows.withColumns({
        "yes": yes,
        "sure": F.when(none, "high").when(silent, "low").when(low & yes & (sure == "high"), "medium").otherwise(sure),
        "why": F.when(none, "Nothing in the document bears on it.").when(silent, F.concat(F.lit("no reading; slot coverage "), F.format_number(cover, 3))).when(low, F.concat_ws(" | ", cleaned(F.col("r.reasoning")), thin)).otherwise(F.col("r.reasoning")),
    })
    first = F.min(F.struct((~F.col("yes")).alias("no"), "run", F.col("r.answer").alias("answer"), F.col("sure").alias("sure"), F.col("why").alias("why")))
    return rows.groupBy(Q).agg(F.avg(F.col("yes").cast("int")).alias("vote_fraction"), first.alias("p")).select(Q, "vote_fraction", F.col("p.answer").alias("answer"), F.col("p.why").alias("reasoning"), F.col("p.sure").alias("reader_confidence"))


def looked_up(questions: DataFrame, nodes: DataFrame, provider: Provider, least: float = 0.82) -> DataFrame:
    """question_id, answer, source_text: questions whose value an indexed fact states, if a reader confirms it."""
    index = retrieval.numeric_index(nodes)
    ask = vx.embed(questions.select(Q, "doc_id", "question"), "question", "_q")
    scored = ask.join(index.select("doc_id", "node_no", "type", F.col("vector").alias("_v")), "doc_id").select(Q, "question", "node_no", "type", vx.dot("_q", "_v").alias("score"))
    hit = retrieval.numeric_lookup(scored).where((F.col("score") >= least) & ~F.col("is_blank"))
    facts = hit.join(index.select("node_no", "source_text", "value", "unit"), "node_no").join(questions.select(Q, "question"), Q)
    told = provider(facts.withColumn("prompt", F.concat(F.lit(CONFIRM), F.lit("Question: "), "question", F.lit("\nText: "), "source_text")))
    return told.where(F.trim(F.lower("reply")).startswith("yes")).select(Q, F.concat_ws(" ", cleaned(F.col("value")), cleaned(F.col("unit"))).alias("answer"), "source_text")
