"""What a review found: each test fails on the code before."""

import datetime

import pytest
from clausegraph.plans import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, name, path):
    """Sorted rows of the query and of its SQL over the tables in the folder."""
    con = duckdb.connect()
    for f in path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'" if f.is_dir() else f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(path))
    return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()))


def test_band_anti_join_rounds_halves_as_sql(spark, tmp_path):
    at = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(1, 1, 100.5, at), (2, 1, 101.5, at), (3, 2, 300.0, at)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 160.0), (2, 42.5), (3, 359.5)], "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = against_sql(spark, "band_anti_join", tmp_path)
    assert got == want and want


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["survivor_subgraph", "target_centrality", "ollivier_ricci", "clustering", "chain_completeness", "chain_annotations", "supporting_clauses", "tier_survivors"])
def test_questions_are_not_shuffled_anew(spark, name):
    """All of a question lies in one bucket, so its survivors and edges, which are many, are never written to shuffles."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("shared", [False, True])
def test_survivors_of_shared_and_own_orders(spark, tmp_path, shared):
    """An order of two customers gives edges between keys of both; then tables are made for whole documents, as the SQL does."""
    from clausegraph.plans import fixture

    for name, rows, schema in (
        ("customer", [(1, "Same", 5.0, "AUTO"), (2, "Same" if shared else "Other", -5.0, "AUTO")], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"),
        ("supplier", [(1,)], "s_suppkey long"),
        ("part", [(1, "red nut", "TYPE", "BRAND", 3), (2, "blue nut", "TYPE", "BRAND", 4)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        ("orders", [(7, 1, "O", "1-URGENT"), (7 if shared else 8, 2, "O", "1-URGENT"), (9, 2, "F", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        ("lineitem", [(7, 1, 1, 1, 5.0, 0.1, 0.0, "A"), (7, 2, 1, 2, 6.0, 0.0, 0.02, "N"), (8, 1, 1, 1, 5.0, 0.1, 0.0, "A"), (9, 2, 1, 1, 5.0, 0.09, 0.0, "R")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"),
    ):
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.selectExpr("*", "10.0D AS o_totalprice")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert fixture._apart(spark, str(tmp_path)) is not shared
    for query in ("survivor_subgraph", "chain_annotations"):
        got, want = against_sql(spark, query, tmp_path)
        assert len(got) == len(want) > 0 and got == want


def tables_made(spark, name, tmp_path, monkeypatch):
    """Kinds of tables that the query leaves in the scratch folder when none were made before."""
    from clausegraph.plans import fixture
    from clausegraph.sources import scratch

    monkeypatch.setattr(scratch, "scratch", lambda _: f"{tmp_path}/tables")
    monkeypatch.setattr(fixture, "_kept", {})
    (tmp_path / "tables").mkdir()
    QUERIES[name](spark, SF).collect()
    return {f.name.rsplit("_", 1)[0].rsplit("-", 1)[0] for f in (tmp_path / "tables").iterdir()}


@pytest.mark.parametrize("name", ["survivor_subgraph", "target_centrality", "tier_survivors", "ollivier_ricci", "outside_dependency", "required_sequence", "forman_ricci", "keyword_trap", "type_metrics", "value_tag_match", "chain_completeness", "clustering", "anchor_jaccard", "chain_annotations", "degree_entropy"])
def test_survivors_take_no_disk(spark, name, tmp_path, monkeypatch):
    """Survivors with their texts take more disk than lines and edges together; only those two are written."""
    assert tables_made(spark, name, tmp_path, monkeypatch) <= {"lines_c_custkey", "dir_edges"}


@pytest.mark.parametrize("name", ["concept_presence", "edges_same_label", "edges_same_section"])
def test_nodes_of_documents_take_no_disk(spark, name, tmp_path, monkeypatch):
    assert tables_made(spark, name, tmp_path, monkeypatch) == {"lines_doc_id"}


def test_pairs_of_several_places_are_neither_repeated_nor_sorted(spark):
    """Pairs come out of the join for good: nothing above it removes repeated ones, which needs all of them at once."""
    from clausegraph.operators import graph

    rows = [(1, c, k, f"[PARENT: {s}] x") for c, k, s in ((1, "a", "S"), (1, "b", "S"), (2, "a", "T"), (2, "b", "T"), (2, "c", "T"), (3, "c", "S"), (3, "c", "S"), (None, "a", "S"), (1, None, "S"))] + [(2, 1, "a", "no label"), (2, 1, "d", "[PARENT: S] x")]
    nodes = spark.createDataFrame(rows, "doc_id long, chunk_id long, node_key string, source_text string")
    both = lambda doc, *pairs: sorted((doc, x, y) for p in pairs for x, y in (p, p[::-1]))
    for made, want in ((graph.same_chunk(nodes), both(1, "ab", "ac", "bc") + both(2, "ad")), (graph.same_label(nodes), both(1, "ab", "ac", "bc"))):
        assert sorted(tuple(r) for r in made.select("doc_id", "src", "dst").collect()) == want
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("name", ["edges_same_label", "edges_same_section"])
def test_pairs_of_a_document_are_digested_in_the_order_of_the_join(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    above = plan[: plan.index("SortMergeJoin")]
    assert "Sort [" not in above and "HashAggregate" not in above and "Exchange" not in plan


def test_parts_are_not_shuffled_for_every_pass(spark, tmp_path, monkeypatch):
    """Lines that are joined in several parts are whole, and the table of parts is in no shuffle of theirs and is gone afterwards."""
    from clausegraph.plans import fixture
    from clausegraph.sources import scratch

    plans, bucketed = [], fixture.bucketed
    monkeypatch.setattr(fixture, "bucketed", lambda df, name, *more, **kw: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or bucketed(df, name, *more, **kw))
    monkeypatch.setattr(scratch, "scratch", lambda _: f"{tmp_path}/tables")
    monkeypatch.setattr(fixture, "_kept", {})
    monkeypatch.setattr(fixture, "PASS_LINES", 2000)
    (tmp_path / "tables").mkdir()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fixture._lines(spark, SF, "c_custkey").select("o_orderkey", "p_name", "qty", "disc", "tax", "l_suppkey")
        joins = [plan for name, plan in plans if name == "lines_c_custkey"]
        assert len(joins) > 2 and not any("hashpartitioning(p_partkey" in plan for plan in joins)
        assert {f.name.rsplit("_", 1)[0] for f in (tmp_path / "tables").iterdir()} == {"lines_c_custkey"}
        want = fixture._sql(spark, fixture._LINES, {t: (lambda t=t: spark.read.parquet(f"{SF}/{t}.parquet")) for t in fixture.TABLES}).select(*got.columns)
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
