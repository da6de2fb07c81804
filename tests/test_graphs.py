import numpy as np
from clausegraph.operators import graph, nodes, retrieval
from clausegraph.operators import topology as tp
from clausegraph.operators.kernels import Graph


def graph_of(n, pairs, types=None, slot="GENERAL", weight=0.5, kind="TRIGGERS"):
    return Graph(types or ["CONDITION"] * n, np.zeros(n, bool), slot, [(i, j, kind, weight) for i, j in pairs])


def test_triangle():
    got = graph_of(3, [(0, 1), (1, 2), (2, 0)]).all()
    assert got["beta0"] == 1 and got["beta1"] == 1 and got["n_edges"] == 3
    assert np.allclose(graph_of(3, [(0, 1), (1, 2), (2, 0)]).values, [0, 3, 3])
    assert got["diameter"] == 1 and got["lcc_efficiency"] == 1 and got["true_max_core"] == 2 and np.isclose(got["nb_radius"], 1)
    assert np.isclose(got["gradient_frac"] + got["harmonic_frac"], 1) and np.isclose(got["gradient_frac"], 0, atol=1e-9)
    assert got["n_scc"] == 1 and got["n_back_edges"] == 1


def test_path_and_star():
    path = graph_of(4, [(0, 1), (1, 2), (2, 3)]).all()
    assert path["diameter"] == 3 and path["beta1"] == 0 and path["nb_radius"] == 0 and path["n_back_edges"] == 0 and np.isclose(path["gradient_frac"], 1)
    assert np.isclose(path["frustration"], 0, atol=1e-9)
    star = graph_of(5, [(0, k) for k in range(1, 5)]).all()
    assert star["diameter"] == 2 and star["top_core_frac"] > 0 and star["beta0"] == 1


def test_two_components_and_parallel_edges():
    g = Graph(["CONDITION"] * 4, np.zeros(4, bool), "GENERAL", [(0, 1, "TRIGGERS", 0.9), (0, 1, "SAME_SECTION", 0.3), (2, 3, "TRIGGERS", 0.5)])
    got = g.all()
    assert got["beta0"] == 2 and got["beta1"] == 1 and got["h0_count"] == 2 and np.isclose(got["h0_mean_lifetime"], 0.7) and np.isclose(got["h1_mean_birth"], 0.3)


def test_answer_path_prefers_strong_edges():
    types = ["REFERENCE", "CONDITION", "NUMERIC", "RIGHT"]
    g = Graph(types, np.array([True, False, False, False]), "VALUE", [(0, 2, "SAME_SECTION", 0.1), (0, 1, "TRIGGERS", 0.9), (1, 2, "TRIGGERS", 0.8)])
    got = g.all()
    assert got["path_exists"] and got["path_length"] == 2 and np.isclose(got["path_bottleneck"], 0.8) and np.isclose(got["path_score"], 0.72) and got["same_section_frac"] == 0
    assert got["n_targets"] == 1 and got["n_conditions"] == 1


def test_weights_decay_by_kind():
    g = Graph(["NUMERIC", "CONDITION", "CONDITION", "CONDITION"], np.zeros(4, bool), "VALUE", [(0, 1, "TRIGGERS", 0.9), (1, 2, "SAME_SECTION", 0.3)])
    assert np.allclose(g.anchor_weight, [1.0, 0.8, 0.2, 0.01])


def test_ricci_and_clustering_of_a_triangle(spark):
    edges = spark.createDataFrame([(1, 0, 1, "TRIGGERS", 0.5), (1, 1, 2, "TRIGGERS", 0.5), (1, 2, 0, "TRIGGERS", 0.5), (2, 0, 1, "TRIGGERS", 0.5), (2, 1, 2, "TRIGGERS", 0.5)], "question_id long, i int, j int, etype string, w double")
    got = {r.question_id: r for r in tp.ricci(edges).collect()}
    assert got[1].ricci_mean == 0 and got[2].ricci_mean == -1 and got[2].n_negative == 2
    assert {(r.question_id, r.n_triangles, r.mean_local) for r in tp.clustering(edges).collect()} == {(1, 1, 1.0), (2, 0, 0.0)}


def test_graph_rules(spark):
    rows = [
        (1, 1, "DEFINITION", "Licensee", "Acme (\"Acme\")", None, None, None, None, None, "[PARENT: A] -> x"), (1, 1, "OBLIGATION", None, None, "licensee", "shall", "deliver goods quickly", None, None, "[PARENT: A] -> y"),
        (1, 2, "CONDITION", None, None, None, None, None, "late", "must deliver goods to licensee", "z"), (2, 1, "OBLIGATION", None, None, "licensee", "shall", "deliver goods quickly", None, None, "w"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id long, type string, term string, definition string, party string, modal string, action string, trigger string, consequence string, source_text string")
    for c in ("right_text", "value", "unit", "applies_to", "field", "context", "ref_to", "describes", "qualifiers", "condition", "limit_text", "beneficiary", "object_party"):
        df = df.selectExpr("*", f"CAST(NULL AS STRING) AS {c}")
    edges = {(r.doc_id, r.src[:3], r.dst[:3], r.etype) for r in graph.build_graph(nodes.unique_nodes(df)).collect()}
    assert {(1, "OBL", "DEF", "USES_TERM"), (1, "CON", "DEF", "USES_TERM"), (1, "CON", "OBL", "TRIGGERS"), (1, "DEF", "OBL", "PARTY_HAS"), (1, "DEF", "OBL", "SAME_SECTION")} <= edges
    assert not [e for e in edges if e[0] == 2]
    assert [(r.alias, r.name) for r in nodes.alias_map(df).collect()] == [("acme", "Licensee")]


def test_empty_tables_give_empty_results(spark):
    s = spark.createDataFrame([], "question_id long, node_key string, type string, votes long, score double, vote_frac double")
    assert retrieval.tiers(s).count() == 0
    e = spark.createDataFrame([], "question_id long, i int, j int, etype string, w double")
    assert tp.ricci(e).count() == 0 and tp.clustering(e).count() == 0
