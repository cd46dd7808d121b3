"""Work that has to grow with the input: what is shuffled, searched or sent, beside the results."""

import itertools
import random

import pytest

from netfusion import session
from netfusion.operators import graph, pairs, resolution


def stages(spark):
    """Of all stages so far: their number by id and the records that they wrote to shuffles."""
    sc = spark.sparkContext
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s := listed.apply(k)).stageId(): s.shuffleWriteRecords() for k in range(listed.size())}


def shuffled(spark, run):
    """The result of run() and the records shuffled for it, without broadcasts as on large tables."""
    before = stages(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return out, sum(n for k, n in stages(spark).items() if k not in before)


def test_mutual_counts_shuffle_no_neighbours_of_pairs(spark):
    links = list(itertools.combinations(range(90), 2))
    e, p = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(links, "p long, q long")
    rows, n = shuffled(spark, lambda: pairs.mutual_counts(e, p).collect())
    assert {(r.p, r.q): r.mutual for r in rows} == dict.fromkeys(links, 88)
    assert n < 15 * len(links)  # 88 each before


def test_mutual_counts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_BITS", 3)
    rng = random.Random(7)
    links = [(rng.randrange(60) * 5, rng.randrange(60) * 5) for _ in range(300)] + [(0, 5 * k) for k in range(1, 60)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    asked = [(rng.randrange(62) * 5, rng.randrange(62) * 5) for _ in range(400)] + [(7, 10), (None, 5), (0, 5), (0, 5)]
    got = pairs.with_mutual(spark.createDataFrame([(p, q, f"{k}") for k, (p, q) in enumerate(asked)], "p long, q long, more string"), spark.createDataFrame(links, "src long, dst long")).collect()
    want = sorted((str(k), len(near.get(p, set()) & near.get(q, set()))) for k, (p, q) in enumerate(asked))
    assert sorted((r.more, r.mutual) for r in got) == want


def chain_of_clusters(clusters, size, seed):
    """Dense clusters, each linked to the next one by one edge: a large diameter, as in copies of a graph of calls."""
    rng = random.Random(seed)
    links = [(size * c + rng.randrange(size), size * c + rng.randrange(size)) for c in range(clusters) for _ in range(3 * size)]
    return links + [(size * c - 1, size * c) for c in range(1, clusters)]


def distances(near, s):
    dist, todo = {s: 0}, [s]
    for v in todo:
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    return dist


def test_efficiency_beyond_the_limit_of_betweenness_is_exact(spark, monkeypatch):
    links = [(a, b) for a, b in chain_of_clusters(12, 60, 3) if a != b]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = sum(1 / h for s in near for h in distances(near, s).values() if h) / (len(near) * (len(near) - 1))
    e = spark.createDataFrame(links, "src long, dst long")
    monkeypatch.setattr(graph, "MAX_BROADCAST_EDGES", 10)
    monkeypatch.setattr(graph, "efficiency_by_hops", None)
    assert graph.efficiency(e) == pytest.approx(want, rel=1e-12)
    assert graph.efficiency(spark.createDataFrame([(1, 1)], "src long, dst long")) == 0.0


def test_reached_in_small_slices(monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "SEARCH_ARCS", 7)
    starts, targets = np.array([0, 1, 3, 5, 7, 8, 8]), np.array([1, 0, 2, 1, 3, 2, 4, 3], np.int32)  # a path of five and one alone
    assert list(graph._reached((starts, targets), 0, 5)) == [8, 6, 4, 2]
    assert list(graph._reached((starts, targets), 1, 2)) == [4, 3, 1]


def test_sampled_betweenness_takes_no_rounds(spark, monkeypatch):
    e = spark.createDataFrame(chain_of_clusters(6, 30, 5), "src long, dst long")
    rounds = {r.id: r.betweenness for r in graph.betweenness_by_rounds(e, sources=16).collect()}
    monkeypatch.setattr(graph, "MAX_BROADCAST_EDGES", 10)
    monkeypatch.setattr(graph, "SOURCES", 16)
    monkeypatch.setattr(graph, "betweenness_by_rounds", None)  # before, a graph of so many edges went there
    assert {r.id: r.betweenness for r in graph.betweenness(e).collect()} == pytest.approx(rounds, abs=1e-12)


def test_cross_cell_degree_looks_up_cells_once_per_edge(spark):
    links = list(itertools.combinations(range(80), 2))
    e, nodes = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(k, ("A", "B", "Noise", None)[k % 4]) for k in range(70)], "id long, cell string")
    rows, n = shuffled(spark, lambda: graph.cross_cell_degree(e, nodes).collect())
    cell = lambda k: ("A", "B", "Noise", None)[k % 4] if k < 70 else None
    assert {r.id: r.cross for r in rows} == {k: sum(cell(j) in ("A", "B") and cell(j) != cell(k) for j in range(80) if j != k) for k in range(80)}
    assert n < 4 * len(links)  # over 5 before


def test_bridges_read_their_inputs_once(spark):
    from pyspark.sql import functions as F

    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        runs.add(1)
        yield from batches

    c = spark.createDataFrame([(k, "AB"[k % 2], k / 9) for k in range(8)], "id long, cell string, betweenness double").coalesce(1).mapInPandas(seen, "id long, cell string, betweenness double")
    x = spark.range(8).coalesce(1).select("id", (F.col("id") % 3).alias("cross")).mapInPandas(seen, "id long, cross long")
    assert len(graph.bridges(c, x).collect()) == 8 and runs.value == 2


def test_names_are_not_broadcast(spark):
    people = spark.createDataFrame([(k, f"Name{k} Last{k % 7}", k) for k in range(50)], "id long, name string, ordinal long")
    found = resolution.candidates(spark.createDataFrame([("Nam3 Last3",), ("N. Last3",), ("name4 last4",)], "value string"), people)
    assert {r.value for r in found.collect()} == {"Nam3 Last3", "N. Last3", "name4 last4"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_acts_meet_their_ends_in_tasks_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rng = random.Random(11)
    people = [(str(k), f"N{k % 30}", f"a{k}") for k in range(60)]  # two of each name
    told = lambda k: [(str(k), "", ""), ("", f" n{k % 30}", ""), ("", None, f"A{k}"), ("nobody", "", "")][rng.randrange(4)]
    acts = [(n, *told(0 if n % 3 else rng.randrange(60)), *told(rng.randrange(60)), rng.randrange(100)) for n in range(1500)]  # 0 has most
    names = [f"{s}_{c}" for s in ("sender", "receiver") for c in ("id", "name", "account")]
    t = spark.createDataFrame(acts, "txn_id long, " + ", ".join(f"{c} string" for c in names) + ", amount long")
    out, n = pairs.identified(t, spark.createDataFrame(people, "id string, name string, account string"), ("sender", "receiver"), "account")

    def who(i, name, account):
        low = lambda x: (x or "").strip().lower()
        return [p[0] for p in people if low(i) == p[0] or (low(name) and low(name) == p[1].lower()) or (low(account) and low(account) == p[2])]

    want = []
    for txn, i, name, account, j, other, number, amount in acts:
        x, y = who(i, name, account), who(j, other, number)
        want += [(txn, p, q, amount) for p in x for q in y if p < q or p > q and not (q in x and p in y)]
    assert sorted(map(tuple, out.select("txn_id", "sender", "receiver", "amount").collect())) == sorted(want)
    assert len(want) < 2 * n and n < 2 * len(want)
    counted = pairs.financials(out, n)
    assert counted.rdd.getNumPartitions() >= n // 50  # as many as shuffle partitions before
    assert sum(r.txns for r in counted.collect()) == len(want)


def brute_credits(near, s):
    dist = distances(near, s)
    paths, credit = {s: 1}, dict.fromkeys(dist, 0.0)
    order = sorted(dist, key=dist.get)
    for v in order[1:]:
        paths[v] = sum(paths[u] for u in near[v] if dist[u] == dist[v] - 1)
    for w in reversed(order):
        for v in near[w]:
            if dist[v] == dist[w] - 1:
                credit[v] += paths[v] / paths[w] * (1 + credit[w])
    return {v: c for v, c in credit.items() if v != s}


@pytest.mark.parametrize("arcs", [7, 1 << 22])
def test_betweenness_takes_many_sources_at_once_and_all_of_them(monkeypatch, arcs):
    import numpy as np

    assert graph.MAX_BROADCAST_EDGES is None  # 5,000,000 before, and sampled beyond
    layers = [(8 * k + a, 8 * k + 8 + b) for k in range(11) for a in range(8) for b in range(8)]  # 8**10 paths, over 2**24
    near = {}
    for a, b in {*layers, *((a, b) for a, b in chain_of_clusters(8, 40, 6) if a < b)}:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ids = sorted(near)
    at = {x: k for k, x in enumerate(ids)}
    starts = np.cumsum([0, *(len(near[x]) for x in ids)])
    targets = np.array([at[y] for x in ids for y in sorted(near[x])], np.int32)
    monkeypatch.setattr(graph, "SEARCH_ARCS", arcs)
    monkeypatch.setattr(graph, "RUN", 5)
    want = np.zeros(len(ids))
    for s in ids[:40]:
        for v, c in brute_credits(near, s).items():
            want[at[v]] += c
    assert graph._credits((starts, targets), np.arange(40)) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_all_pairs_beyond_a_task_are_exact(spark, monkeypatch):
    e = spark.createDataFrame(chain_of_clusters(10, 30, 8), "src long, dst long")
    people = spark.createDataFrame([(k,) for k in range(310)], "id long")
    want, mean = {r.id: r.betweenness for r in graph.betweenness(e).collect()}, graph.efficiency(e, people)
    monkeypatch.setattr(graph, "MAX_SEARCHED_EDGES", 10)
    monkeypatch.setattr(graph, "SLICE_BITS", 6)  # several blocks
    monkeypatch.setattr(graph, "SOURCES", 20)  # before, so many sources stood for all
    assert {r.id: r.betweenness for r in graph.betweenness(e).collect()} == pytest.approx(want, rel=1e-12, abs=1e-15)
    monkeypatch.setattr(graph, "efficiency_by_hops", None)  # before, an estimate by sketches
    assert graph.efficiency(e, people) == pytest.approx(mean, rel=1e-12)


def test_louvain_rounds_end_in_written_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut", None)  # before, checkpoints, whose planning took up to 30 s for eleven rows
    groups = graph.louvain(spark.createDataFrame([(a, b) for g in (0, 10, 20) for a, b in itertools.combinations(range(g, g + 6), 2)], "src long, dst long"))
    assert {(r.id, r.community) for r in groups.collect()} == {(k, g) for g in (0, 10, 20) for k in range(g, g + 6)}


def test_names_of_the_same_characters_share_their_bounds(monkeypatch):
    from netfusion.functions import similarity

    asked, real = [], similarity.upper_bounds
    monkeypatch.setattr(similarity, "upper_bounds", lambda counts, size, others, sizes: asked.append(len(others)) or real(counts, size, others, sizes))
    names = [f"Name {''.join(x)}" for x in itertools.permutations("12345")] + ["Name 1", "Nom 11"]
    values = [f"Nme {''.join(x)}" for x in itertools.permutations("1245")] + ["Nam 1", "x"]
    score = lambda a, b: max(similarity.indel_ratio(a.lower(), b.lower()), 0.95 * similarity.partial_ratio(a.lower(), b.lower()))
    want = {v: max(range(len(names)), key=lambda k: (score(v, names[k]), -k)) for v in values}
    assert similarity.best_by_bounds(values, names, 0.0) == [(v, want[v]) for v in values]
    assert sum(asked) == 9  # 3,172 before, one for each value and name


def test_what_spreads_acts_is_taken_once(spark):
    t = spark.createDataFrame([(1, "1", "", "", "2", "", "", 5)], "txn_id long, sender_id string, sender_name string, sender_account string, receiver_id string, receiver_name string, receiver_account string, amount long")
    people = spark.createDataFrame([("1", "A", "x"), ("2", "B", "y")], "id string, name string, account string")
    out, _ = pairs.identified(t, people, ("sender", "receiver"), "account")
    counted = out.select("sender", "receiver", "amount")
    assert counted.collect() == [("1", "2", 5)]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1  # 2 before, so all columns went through both shuffles
