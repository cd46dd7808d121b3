"""Queries over all call pairs, on a small fixture where most pairs call only once or twice, against brute force."""

import datetime
import random
from collections import Counter, deque

import pytest

from netfusion.operators import graph
from netfusion.plans import network, relational


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("whole")), random.Random(5)
    walk = [1]
    for _ in range(90):
        walk.append(rng.choice([x for x in range(1, 31) if x != walk[-1]] if rng.random() < 0.3 else [x for x in range(max(1, walk[-1] - 3), min(30, walk[-1] + 3) + 1) if x != walk[-1]]))
    walk += [40, 40]  # 40 hangs on the last one
    ts = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i + 1, u, ts, "click", 1.5) for i, u in enumerate(walk)] + [(900, 50, ts, "view", 0.5)], "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{d}/events.parquet")
    ids = sorted({*walk, 50})
    spark.createDataFrame([(i, f"C{i}", "AB"[i % 2], 0) for i in ids], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey long, n_name string").write.parquet(f"{d}/nation.parquet")
    pairs = {(min(a, b), max(a, b)) for a, b in zip(walk, walk[1:]) if a != b}
    return d, ids, pairs


def adjacency(ids, pairs):
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return near


def distances(near, s):
    dist, count, todo = {s: 0}, {s: 1}, deque([s])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in dist:
                dist[w], count[w] = dist[v] + 1, 0
                todo.append(w)
            if dist[w] == dist[v] + 1:
                count[w] += count[v]
    return dist, count


def groups(near):
    out = {}
    for s in sorted(near):
        for w in distances(near, s)[0]:
            out.setdefault(w, s)
    return out


def mean_inverse(near):
    return sum(1 / h for s in near for h in distances(near, s)[0].values() if h) / (len(near) * (len(near) - 1))


def run(spark, case, name):
    return [tuple(r) for r in network.QUERIES[name][0](spark, case[0]).collect()]


def test_takedown_is_over_all_pairs(spark, case):
    _, ids, pairs = case
    near, rest = adjacency(ids, pairs), adjacency([i for i in ids if i >= 3], {p for p in pairs if min(p) >= 3})
    before, after = mean_inverse(near), mean_inverse(rest)
    want = (round(before, 4), round(after, 4), round(min(100, max(0, (1 - after / before) * 100)), 1), len(set(groups(rest).values())), len(pairs) - sum(min(p) >= 3 for p in pairs))
    assert run(spark, case, "takedown_impact") == [want] and want[4] > 0


def test_communities_cover_all_callers(spark, case):
    _, ids, pairs = case
    assert sum(r[1] for r in run(spark, case, "communities")) == len({x for p in pairs for x in p}) == len(ids) - 1


def test_distances(spark, case):
    _, ids, pairs = case
    near = adjacency(ids, pairs)
    dist, _ = distances(near, network.START)
    assert dict(run(spark, case, "bfs_hops")) == {i: h for i, h in dist.items() if h <= 4}
    found = run(spark, case, "shortest_path4")
    assert [r[1] for r in found] == ([dist[network.GOAL]] if dist.get(network.GOAL, 9) <= 4 else [])
    linked = {i: near[i] for i in ids if near[i]}
    assert run(spark, case, "network_efficiency") == [(round(mean_inverse(linked), 6),)]


def test_components_labels_and_what_if(spark, case):
    _, ids, pairs = case
    near = adjacency(ids, pairs)
    assert dict(run(spark, case, "connected_components")) == groups(near)
    labels = {i: i for i in ids if near[i]}
    for _ in range(3):
        votes = {i: Counter([labels[i], *(labels[j] for j in near[i])]) for i in labels}
        labels = {i: min(v, key=lambda x: (-v[x], x)) for i, v in votes.items()}
    assert dict(run(spark, case, "label_propagation")) == labels
    rest = {p for p in pairs if network.START not in p}
    (row,) = network.QUERIES["whatif_impact"][0](spark, case[0]).collect()
    after = len(set(groups(adjacency([i for i in ids if i != network.START], rest)).values()))
    assert (row.edges_before, row.edges_after, row.nodes_before, row.components_before, row.components_after) == (len(pairs), len(rest), len(ids), len(set(groups(near).values())), after)


def test_ranks_and_mutual_counts(spark, case):
    _, ids, pairs = case
    near = {i: x for i, x in adjacency(ids, pairs).items() if x}
    n = len(near)
    rank = dict.fromkeys(near, 1 / n)
    for _ in range(4):
        rank = {i: 0.15 / n + 0.85 * sum(rank[j] / len(near[j]) for j in near[i]) for i in near}
    assert dict(run(spark, case, "pagerank_k")) == pytest.approx(rank, abs=1e-8)
    assert {(p, q): m for p, q, m in run(spark, case, "mutual_counts")} == {(p, q): len(near[p] & near[q]) for p, q in pairs}


def between(near):
    """Betweenness by counting the shortest paths of all pairs through each node."""
    ways, n = {s: distances(near, s) for s in near}, len(near)
    out = dict.fromkeys(near, 0.0)
    for s, (dist, count) in ways.items():
        for t in dist:
            for v in dist:
                if len({s, t, v}) == 3 and t in ways[v][0] and dist[v] + ways[v][0][t] == dist[t]:
                    out[v] += count[v] * ways[v][1][t] / count[t]
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_of_all_pairs(spark, case):
    _, ids, pairs = case
    assert dict(run(spark, case, "betweenness")) == pytest.approx(between({i: x for i, x in adjacency(ids, pairs).items() if x}), abs=1e-6)


def test_betweenness_with_very_many_paths(spark):
    """A chain of 700 diamonds has 3^700 shortest paths, more than a float holds; by symmetry the middle ones of a diamond are alike."""
    pairs = [(4 * k, 4 * k + j) for k in range(700) for j in (1, 2, 3)] + [(4 * k + j, 4 * k + 4) for k in range(700) for j in (1, 2, 3)]
    got = {r.id: r.betweenness for r in graph.betweenness(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    n, k = len(got), 350
    before, after = 4 * k + 1, n - 4 * k - 4
    want = 2 * before * after / 3 / ((n - 1) * (n - 2))
    assert all(got[4 * k + j] == pytest.approx(want, rel=1e-3) for j in (1, 2, 3))


def test_bridges_leads_and_strategies_use_betweenness(spark, tmp_path):
    """Two cliques and a broker of degree 2 between them, which degree centrality ranks last."""
    d, day = str(tmp_path), datetime.date(1995, 1, 5)
    pairs = [(a, b) for g in (range(1, 7), range(11, 17)) for a in g for b in g if a < b] + [(1, 30), (11, 30)]
    ids = sorted({x for p in pairs for x in p})
    spark.createDataFrame([(i, i, i, day, 100.0 * i, "A", 1) for i in range(len(pairs))], "l_orderkey long, x long, l_partkey long, l_shipdate date, l_extendedprice double, l_returnflag string, l_linenumber int").drop("x").join(
        spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "l_orderkey long, l_suppkey long"), "l_orderkey"
    ).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    ts = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, 1, ts, "click", 1.5), (2, 2, ts, "click", 1.5)], "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, f"C{i}", "AB"[i > 10], 0) for i in ids], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(0, "N")], "n_nationkey long, n_name string").write.parquet(f"{d}/nation.parquet")
    near = adjacency(ids, pairs)
    want = between(near)
    assert max(want, key=want.get) == 30
    ranks = network.QUERIES["bridge_ranks"][0](spark, d).collect()
    assert {r.id: r.betweenness for r in ranks} == pytest.approx(want, abs=2e-9)
    chosen = {}
    for r in sorted(network.QUERIES["takedown_strategies"][0](spark, d).collect(), key=lambda r: r["rank"]):
        chosen.setdefault(r.strategy, []).append(r.id)
    assert chosen["bridge"] == sorted(want.keys() - {*chosen["decap"]}, key=lambda i: (-want[i], i))[:3] and len(chosen["decap"]) == 3
    assert chosen["sync"] == list(dict.fromkeys(chosen["decap"][:2] + chosen["bridge"][:2] + chosen["mule"][:2]))
    leads = {int(r.id): r.centrality for r in network.QUERIES["lead_scores"][0](spark, d).collect()}
    degree = {i: len(near[i]) + (i in (1, 2)) for i in ids}  # 1 and 2 also call once
    assert leads == pytest.approx({i: (want[i] / max(want.values()) + degree[i] / max(degree.values())) / 2 for i in ids}, abs=1.1e-3)


def test_evidence_of_single_calls(spark, case, tmp_path):
    d = case[0]
    spark.createDataFrame([], "l_orderkey long, l_partkey long, l_shipdate date, l_extendedprice double, l_returnflag string, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{d}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    ties = relational.QUERIES["evidence_points"][0](spark, str(tmp_path)).collect()
    assert {(r.p, r.q) for r in ties} == case[2] and min(r.evidence_points for r in ties) < 4


def _random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n + 1, n + 2), (n + 2, n + 3), (5, 5)]


def test_betweenness_by_rounds_equals_the_kernel(spark):
    e = spark.createDataFrame(_random_graph(40, 60, 1), "src long, dst long")
    kernel = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    rounds = graph.betweenness_by_rounds(e, batch=16).collect()
    assert {r.id for r in rounds} == {*kernel} and {r.error for r in rounds} == {0.0}
    assert all(abs(r.betweenness - kernel[r.id]) < 1e-12 for r in rounds)


def test_sampled_betweenness_keeps_its_bound(spark, monkeypatch):
    e = spark.createDataFrame(_random_graph(60, 150, 2), "src long, dst long")
    kernel = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    some = graph.betweenness_by_rounds(e, sources=20).collect()
    assert {r.id for r in some} == {*kernel} and 0 < some[0].error < 1
    assert max(abs(r.betweenness - kernel[r.id]) for r in some) <= some[0].error
    monkeypatch.setattr(graph, "MAX_BROADCAST_EDGES", 10)  # a graph beyond the limit takes the rounds by itself
    assert {r.id: round(r.betweenness, 9) for r in graph.betweenness(e).collect()} == {k: round(v, 9) for k, v in kernel.items()}


def test_betweenness_by_rounds_of_nothing(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.betweenness_by_rounds(empty).collect() == [] and graph.efficiency_by_hops(empty) == (0.0, 0.0)


def test_efficiency_by_hops_is_near_the_exact_one(spark, monkeypatch):
    e = spark.createDataFrame(_random_graph(300, 700, 3), "src long, dst long")
    people = spark.createDataFrame([(k,) for k in range(320)], "id long")
    exact = graph.efficiency(e, people)
    value, error = graph.efficiency_by_hops(e, people, bits=12)
    assert abs(value - exact) <= 3 * error * exact
    monkeypatch.setattr(graph, "MAX_BROADCAST_EDGES", 10)
    assert abs(graph.efficiency(e, people) - exact) < 0.1 * exact


def test_all_pairs_kernels_keep_the_graph_out_of_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows = _random_graph(60, 150, 4)
    e = spark.createDataFrame(rows, "src long, dst long")
    near = {i: x for i, x in adjacency({x for p in rows for x in p}, {p for p in rows if p[0] != p[1]}).items() if x}

    def refuse(*_):
        raise AssertionError("the graph goes through the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    assert {r.id: r.betweenness for r in graph.betweenness(e).collect()} == pytest.approx(between(near))
    assert graph.efficiency(e) == pytest.approx(mean_inverse(near))


def test_rounds_take_as_many_sources_as_their_state_allows(spark, monkeypatch):
    star = spark.createDataFrame([(0, k) for k in range(1, 101)], "src long, dst long")
    rounds, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(df.columns) or real(df))
    out = {r.id: r.betweenness for r in graph.betweenness_by_rounds(star).collect()}
    assert out == pytest.approx({0: 1.0} | dict.fromkeys(range(1, 101), 0.0))
    assert rounds.count(["id", "d"]) == 1  # one batch of over 64 sources
