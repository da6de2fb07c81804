import hashlib
import json

import pytest
from clausegraph.plans import api
from clausegraph.sources import files, providers
from clausegraph.streaming import telemetry
from pyspark.sql import functions as F


def test_text_pages_and_questions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\nlines")
    (tmp_path / "q.txt").write_text("Is it?\n\n What? \r\nWho?\n")
    assert [(r.page_no, r.text) for r in files.text_pages(spark, str(tmp_path / "a.txt")).orderBy("page_no").collect()] == [(0, "one"), (1, "two\nlines")]
    assert [r.question for r in files.questions(spark, str(tmp_path / "q.txt"), 2).orderBy("question_id").collect()] == ["Is it?", "What?"]


def test_nodes_and_graphs(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"chunk_id": 3, "chunk_text": "c", "nodes": [{"type": "DEFINITION", "term": "T", "definition": "d", "value_tags": ["a"]}]}]))
    (tmp_path / "g.json").write_text(json.dumps({"nodes": ["a"], "edges": [{"from": "a", "to": "b", "type": "TRIGGERS", "weight": 0.9}]}))
    (tmp_path / "e.json").write_text(json.dumps({"nodes": ["a"]}))
    node = files.read_nodes(spark, str(tmp_path / "n.json")).first()
    assert (node.chunk_id, node.term, node.value_tags) == (3, "T", ["a"])
    edge = files.read_graph(spark, str(tmp_path / "g.json")).first()
    assert (edge.src, edge.dst, edge.etype, edge.weight) == ("a", "b", "TRIGGERS", 0.9)
    assert files.read_graph(spark, str(tmp_path / "e.json")).count() == 0


def test_tables_go_round(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("x"))
    files.write_tables({"t": df}, str(tmp_path / "w"), 4)
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "w"), "t").select("doc_id", "x").collect())) == sorted(map(tuple, df.collect()))


def test_evaluation_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text(",".join(files.EVALUATION) + "\nWhy?,answerable,VALUE,-" + ",0.5" * (len(files.EVALUATION) - 4) + "\n", encoding="utf-8")
    row = files.evaluation_rows(spark, str(tmp_path / "e.csv")).first()
    assert row["Expected"] == "answerable" and row["Slot score"] == "-" and row["KwTrap"] == "0.5"


def test_events_append_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", 7, "ask", 1.0, "{}"), (2, "2024-01-01 00:00:02", 7, "ask", 2.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string")
    for _ in range(2):
        files.append_events(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("not json\n")
    got = telemetry.collect(telemetry.requests(spark, str(tmp_path / "log")), str(tmp_path / "out"))
    assert got.where("event_id IS NOT NULL").count() == 4 and got.where("event_id IS NULL").count() == 1


def test_providers(spark):
    df = spark.createDataFrame([("p",), ("q",), ("p",)], "prompt string")
    assert providers.silent(df).where("reply IS NOT NULL").count() == 0
    table = spark.createDataFrame([(hashlib.sha256(b"p").hexdigest(), "yes")], "prompt_hash string, reply string")
    assert sorted(str(r.reply) for r in providers.recorded(table)(df).collect()) == ["None", "yes", "yes"]
    assert sorted(r.reply for r in providers.called(lambda ps: [p.upper() for p in ps], 1)(df).collect()) == ["P", "P", "Q"]


def test_page_counts_of_unreadable_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no such thing")
    assert [r.pages for r in files.page_counts(spark, str(tmp_path)).collect()] == [12]


def test_reports_become_records(spark, tmp_path):
    from clausegraph.operators import evaluation as ev
    from clausegraph.operators import scoring

    row = dict.fromkeys(files.EVALUATION, "n/a") | {"Q": "Is it so?", "Expected": "Unanswerable", "Slot type": "", "Slot score": "0.5", "Path exists": "0", "N targets": "3", "Mismatch": "0.25"}
    (tmp_path / "r.csv").write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    got = ev.report_records(files.evaluation_rows(spark, str(tmp_path / "r.csv")), scoring.MEASURES).first()
    assert (got.expected, got.slot, got.slot_score, got.path_exists, got.n_targets, got.n_well, got.distant_frac, got.h0) == (0, "GENERAL", 0.5, False, 3, 0, 0.25, None)


def test_pdf_reader_says_what_it_needs(spark, tmp_path):
    pytest.importorskip("pypdf", reason="no PDF library here")
    assert files.pdf_pages(spark, str(tmp_path)).count() == 0
