"""Documents prepared and asked from end to end, with a reader made of rules."""

import json

import pytest
from clausegraph.operators import asking, evidence
from clausegraph.plans import api
from clausegraph.sources import providers
from pyspark.sql import functions as F

TEXT = """1. Returns
The customer may return all of the goods within thirty (30) days after they were delivered to it.

2. Price
The customer shall pay the price of the goods to the vendor before they are delivered to it anywhere.

3. Notices of both parties
Either party shall give written notice of any change of its address to the other within ten days."""

NODES = [
    {"type": "right", "party": "Customer", "right": "return the goods within thirty days", "source_text": "The customer may return all of the goods within thirty (30) days."},
    {"type": "OBLIGATION", "party": "Customer", "modal": "SHALL", "action": "pay the price of the goods to the vendor", "source_text": "The customer shall pay the price of the goods to the vendor."},
    {"type": "NUMERIC", "value": "30", "unit": "days", "applies_to": "return of goods", "source_text": "The customer may return all of the goods within thirty (30) days."},
    {"type": "CONDITION", "trigger": "an address changes", "consequence": "the party gives written notice within ten days", "source_text": "Either party shall give written notice of any change of its address."},
    {"type": "NUMERIC", "value": "", "unit": "days", "applies_to": "x"},
]


def reader(prompts):
    out = []
    for p in prompts:
        if p.startswith(api.EXTRACT):
            words = p.lower()
            out.append(json.dumps({"nodes": [n for n in NODES if n.get("source_text", "The customer shall pay")[:28].lower() in words]}))
        elif p.startswith(api.HEADER):
            out.append(json.dumps({"nodes": [{"type": "DEFINITION", "term": "Effective Date", "definition": "the first day of May of the year", "source_text": "as of the first day of May"}]}))
        elif p.startswith(asking.PARSE):
            out.append(json.dumps({"node_type": "RIGHT", "entity": "customer", "verb": "return", "object": "goods", "requires_numeric": False, "intent": {"exact_intent": 0.1}} if "return" in p else {"node_type": "general"}))
        elif p.startswith(asking.REWORD):
            out.append("May the goods be returned?\nIs a return of goods possible?" if "return" in p else None)
        elif p.startswith(asking.READ):
            out.append(json.dumps({"answerable": "return the goods" in p and "spacecraft" not in p, "answer": "within thirty days", "confidence": "high", "reasoning": "as stated"}))
        elif p.startswith(asking.CONFIRM):
            out.append("no")
        else:
            out.append(None)
    return out


QUESTIONS = [(1, "d1", "Can the customer return the goods within thirty days?"), (2, "d1", "Who insures spacecraft in orbit?"), (3, "none", "Is there anything?")]


@pytest.fixture(scope="module")
def docs(spark):
    pages = spark.createDataFrame([("d1", 0, TEXT)], "doc_id string, page_no long, text string")
    return api.prepare(pages, providers.called(reader))


def test_prepare_runs_all_passes(docs):
    rows = docs.nodes.collect()
    assert {"RIGHT", "OBLIGATION", "NUMERIC", "CONDITION", "DEFINITION"} == {r.type for r in rows}
    assert [r.definition for r in rows if r.term == "contract summary"] == ["Effective Date: the first day of May of the year"]
    assert {r.priority for r in rows if r.term} == {"high"}
    assert docs.edges.where("etype = 'SAME_SECTION'").count() > 0
    assert (30.0, "days", "mixed") in {(r.value, r.unit, r.source) for r in docs.numbers.collect()}


def test_asked_with_a_reader(spark, docs):
    questions = spark.createDataFrame(QUESTIONS, "question_id long, doc_id string, question string")
    got = {r.question_id: r for r in api.ask(docs, questions, providers.called(reader), 5).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].vote_fraction == 1 and got[1].coverage > (got[2].coverage or 0) and got[1].n_survivors > 0
    assert not got[2].answerable and "llm_unanswerable" in got[2].failures and got[2].supporting_clauses is None
    assert not got[3].answerable and got[3].n_survivors is None
    assert all(r.threshold > 0 and 0 <= r.score <= 1 for r in got.values())


def test_asked_without_a_reader(spark, docs):
    """A wording that is said seven times is searched once and counts seven times."""
    questions = spark.createDataFrame(QUESTIONS, "question_id long, doc_id string, question string")
    asks = asking.parsed(questions, providers.silent)
    words = asking.asked(asks, providers.silent)
    assert sorted((r.question_id, r.times) for r in words.collect()) == [(1, 7), (2, 7), (3, 7)]
    nodes = asking.searchable(docs.nodes)
    held = asking.survivors(asks, asking.retrieved(words, nodes, docs.edges, 5), nodes)
    assert {r.votes for r in held.where("score > 0.5").collect()} <= {0, 7}


def test_values_looked_up(spark, docs):
    nodes = asking.searchable(docs.nodes)
    ask = spark.createDataFrame([(1, "d1", "What is the return of goods? return of goods: 30 days"), (2, "d1", "Has any return of goods ever happened?")], "question_id long, doc_id string, question string")
    yes = providers.called(lambda ps: ["Yes."] * len(ps))
    assert [(r.question_id, r.answer) for r in asking.looked_up(ask, nodes, yes).collect()] == [(1, "30 days")]
    assert asking.looked_up(ask, nodes, providers.silent).count() == 0


def test_definition_questions(spark):
    rows = spark.createDataFrame([("DEFINITION", ["VALUE"], "mixed", True), ("GENERAL", ["ACTOR"], None, True), ("GENERAL", ["VALUE"], "definition", True), ("GENERAL", ["VALUE"], "mixed", False)], "t string, s array<string>, p string, want boolean")
    assert rows.where(evidence.asks_definition(F.col("t"), F.col("s"), F.col("p")) != F.col("want")).count() == 0
