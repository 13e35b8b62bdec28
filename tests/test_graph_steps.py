"""Graph loops read their edges once and stop when they are settled."""

from tallyloom.operators import graph as gr
from tallyloom.session import Steps


def counted(spark, rows, schema):
    """Edges, and how often one of them was computed."""
    acc = spark.sparkContext.accumulator(0)

    def tick(it):
        for b in it:
            acc.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(tick, schema), acc


def test_ranks_of_a_dag_stop_at_their_fixed_point(spark, monkeypatch):
    cuts, plain = [], Steps.cut
    monkeypatch.setattr(Steps, "cut", lambda self, df: cuts.append(1) or plain(self, df))
    edges, acc = counted(spark, [(1, 2), (1, 2), (1, 3), (3, 2), (2, 4)], "src long, dst long")
    got = {r["id"]: r["rank"] for r in gr.pagerank(edges).collect()}
    rank = dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(50):
        rank = {v: 0.0375 + 0.85 * sum(s * rank[u] for u, w, s in [(1, 2, 2 / 3), (1, 3, 1 / 3), (3, 2, 1.0), (2, 4, 1.0)] if w == v) for v in rank}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in rank)
    assert acc.value == 5 and len(cuts) <= 4  # 50 rounds had 9


def test_ranks_of_a_cycle_take_all_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1)], "src long, dst long")
    got = {r["id"]: r["rank"] for r in gr.pagerank(edges, rounds=7).collect()}
    rank = dict.fromkeys((1, 2, 3), 1 / 3)
    for _ in range(7):
        rank = {1: 0.05 + 0.85 * (rank[2] / 2 + rank[3]), 2: 0.05 + 0.85 * rank[1], 3: 0.05 + 0.85 * rank[2] / 2}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in rank)


def test_shortest_distances_compute_the_edges_once(spark):
    rows = [(1, 2, 4.0), (1, 2, 1.0), (3, 2, 2.0), (5, 6, 1.0)]
    for directed, want in ((False, {1: 0.0, 2: 1.0, 3: 3.0, 5: float("inf"), 6: float("inf")}), (True, {1: 0.0, 2: 1.0, 3: float("inf"), 5: float("inf"), 6: float("inf")})):
        edges, acc = counted(spark, rows, "src long, dst long, weight double")
        assert {r["id"]: r["distance"] for r in gr.sssp(edges, 1, directed).collect()} == want
        assert acc.value == len(rows) * (1 if directed else 2)  # both ways read them twice; the vertices did so four times more


def test_components_of_chains_strings_and_lone_vertices(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 13] + [(7, 30), (50, 50)]
    comp = {v: v for e in edges for v in e}
    for _ in range(50):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["id"]: r["component"] for r in gr.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == comp
    named = spark.createDataFrame([(f"v{a:02}", f"v{b:02}") for a, b in edges], "src string, dst string")
    assert {r["id"]: r["component"] for r in gr.connected_components(named).collect()} == {f"v{k:02}": f"v{v:02}" for k, v in comp.items()}


def test_components_look_for_changes_without_a_join(spark, monkeypatch):
    seen, plain = [], Steps.cut
    monkeypatch.setattr(Steps, "cut", lambda self, df: seen.append(df.columns) or plain(self, df))
    gr.connected_components(spark.createDataFrame([(1, 2)], "src long, dst long")).collect()
    assert len(seen) > 1 and all("_moved" in c for c in seen[1:])
