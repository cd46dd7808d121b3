import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netfusion.functions import similarity, text, vectors
from netfusion.operators import bursts, extraction, finance, geo, graph, ledger, pairs, resolution, signals


def edges(spark, pairs_):
    return spark.createDataFrame([(a, b, "CALLED", 1.0, 1) for a, b in pairs_], "src string, dst string, kind string, confidence double, day int")


def nodes(spark, ids, cell="A"):
    return spark.createDataFrame([(i, cell) for i in ids], "id string, cell string")


def brute_bursts(counts, last):
    out = []
    for d in range(1, last + 1):
        w = [counts.get(x, 0) if x >= 1 else 0 for x in range(d - 6, d)]
        mean = sum(w) / 6
        std = (sum((x - mean) ** 2 for x in w) / 6) ** 0.5
        x = counts.get(d, 0)
        z = (0.0 if mean == 0 else 3.0 if x > 2 * mean else 0.0) if len({*w}) == 1 else (x - mean) / std
        if z > 2:
            out.append((d, x))
    return out


def test_bursts_match_the_definition(spark):
    rng = random.Random(1)
    counts = {d: rng.choice([0, 1, 2, 3, 9]) for d in range(1, 61) if rng.random() < 0.8} | {30: 40, 45: 2, 46: 2, 47: 2, 48: 2, 49: 2, 50: 2, 51: 5}
    df = spark.createDataFrame([("A", d, n) for d, n in counts.items() if n], "cell string, day int, n long")
    got = sorted((r.day, r.n) for r in bursts.bursts(bursts.zscores(df, 1, 60)).collect())
    assert got == brute_bursts(counts, 60) and (51, 5) in got


def test_correlation_and_greedy_groups(spark):
    rows = [("A", 10, 3.0), ("B", 14, 2.5), ("A", 18, 4.0), ("C", 40, 2.2), ("A", 60, 3.0), ("B", 60, 3.5), ("C", 67, 2.1)]
    df = spark.createDataFrame(rows, "cell string, day int, zscore double")
    got = {(r.cell, r.day): (r.correlated, r.correlated_cells, r.correlated_days) for r in bursts.correlated(df).collect()}
    assert got["C", 40] == (False, ["C"], [40]) and got["A", 18] == (True, ["A", "B"], [10, 14, 18])
    assert got["A", 10] == (True, ["A", "B"], [10, 14])
    groups = sorted((r.first_day, r.last_day, r.burst_count) for r in bursts.temporal_groups(df).collect())
    assert groups == [(10, 14, 2), (14, 18, 2), (60, 67, 2)]


def test_structuring(spark):
    small = [(f"c{i}", "X", "C12", 1000, 52 + i % 8, "Cash") for i in range(12)]
    big = [("l1", "C12", "C11", 300_000, 58, "Bank Transfer"), ("l2", "C12", "C11", 260_000, 70, "Bank Transfer"), ("l3", "C12", "C11", 900_000, 71, "Bank Transfer"), ("h", "Q", "R", 200_000, 60, "Hawala")]
    t = spark.createDataFrame(small + big, "txn_id string, sender string, receiver string, amount long, day int, txn_type string")
    fan = finance.structuring(t).collect()
    assert [(f.receiver, f.cash_small_count, f.window_start, f.window_end, [c.txn_id for c in f.consolidations], f.total) for f in fan] == [("C12", 12, 52, 64, ["l1", "l2"], 560_000)]
    assert sorted(r.txn_id for r in finance.large_transfers(t).collect()) == ["h", "l1", "l2"]
    kinds = {(r.entity_id, r.anomaly_type): r.score for r in signals.unified(finance.financial_anomalies(finance.structuring(t), finance.large_transfers(t))).collect()}
    assert kinds["C12", "financial_structuring"] == 1.0 and kinds["C11", "financial_consolidation"] == 0.8 and abs(kinds["Q", "financial_hawala"] - 1 / 3) < 1e-9


def test_efficiency_components_and_removal(spark):
    ab, abc = edges(spark, [("A", "B")]), edges(spark, [("A", "B"), ("B", "C")])
    assert graph.efficiency(edges(spark, []), nodes(spark, ["A"])) == 0
    assert graph.efficiency(ab) == 1.0 and round(graph.efficiency(abc), 3) == 0.833
    sizes = graph.components(edges(spark, [("A", "B"), ("C", "D")]), nodes(spark, "ABCDE")).groupBy("component").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 2, 2]
    path = [(f"{i:03d}", f"{i + 1:03d}") for i in range(100)]
    assert {r.component for r in graph.components(edges(spark, path)).collect()} == {"000"}
    hit = graph.takedown(abc, nodes(spark, "ABC"), spark.createDataFrame([("B",)], "id string")).first()
    assert (hit.disruption_pct, hit.fragments, hit.severed) == (100.0, 2, 2)
    row = graph.what_if(abc, nodes(spark, "ABC"), "B").first()
    assert (row.edges_before, row.edges_after, row.components_before, row.components_after, row.impact) == (2, 0, 1, 2, 100.0)


def random_graph(seed, n=30, m=60):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(n)], 2))) for _ in range(m)})


def distances(pairs_):
    near = {}
    for a, b in pairs_:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        dist, count, front = {s: 0}, {s: 1}, [s]
        while front:
            new = []
            for v in front:
                for w in near[v]:
                    if w not in dist:
                        dist[w], count[w] = dist[v] + 1, 0
                        new.append(w)
                    if dist[w] == dist[v] + 1:
                        count[w] += count[v]
            front = new
        out[s] = dist, count
    return near, out


def test_betweenness_and_hops_against_brute_force(spark):
    pairs_ = random_graph(5)
    near, d = distances(pairs_)
    want = {}
    for v in near:
        total = 0.0
        for s, t in itertools.permutations(near, 2):
            if v not in (s, t) and t in d[s][0] and v in d[s][0] and t in d[v][0] and d[s][0][v] + d[v][0][t] == d[s][0][t]:
                total += d[s][1][v] * d[v][1][t] / d[s][1][t]
        want[v] = total / ((len(near) - 1) * (len(near) - 2))
    e = edges(spark, pairs_)
    got = {r.id: r.betweenness for r in graph.betweenness(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    start = pairs_[0][0]
    assert {r.id: r.hops for r in graph.hops(e, start, 3).collect()} == {k: h for k, h in d[start][0].items() if h <= 3}
    goal = max(d[start][0], key=lambda k: (d[start][0][k] <= 4, d[start][0][k]))
    row = graph.shortest_path(e, start, goal).first()
    assert row.hops == d[start][0][goal] and row.path[0] == start and row.path[-1] == goal
    ranks = [r.rank for r in graph.pagerank(e, rounds=60, tolerance=1e-9).collect()]
    assert abs(sum(ranks) - 1) < 1e-6
    deg = graph.degrees(e).agg(F.sum("degree")).first()[0]
    assert deg == 2 * len(pairs_)


def test_louvain_finds_cliques(spark):
    cliques = [[f"{c}{i}" for i in range(6)] for c in "abc"]
    pairs_ = [p for c in cliques for p in itertools.combinations(c, 2)] + [("a0", "b0"), ("b1", "c1")]
    got = graph.louvain(edges(spark, pairs_)).groupBy("community").agg(F.array_sort(F.collect_set("id")).alias("m")).collect()
    assert sorted(r.m for r in got) == cliques
    people = spark.createDataFrame([(i, c[0][0].upper()) for c in cliques for i in c], "id string, cell string")
    assert {r.dominant_cell for r in graph.community_profile(graph.louvain(edges(spark, pairs_)), people).collect()} == {"A", "B", "C"}


def test_similarity():
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13) and similarity.indel_ratio("", "") == 100
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.partial_ratio("bablu", "ab") > 0
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs_length(a, b) == table[-1][-1]


def test_resolution(spark):
    people = spark.createDataFrame([("A1", "Rahul Kumar", "A", "70000", "AC1", "Dock Road, Mumbai", "Gang", 0), ("A2", "Sunil More", "A", "", "", "", "", 1)], "id string, name string, cell string, phone string, account string, address string, org string, ordinal int")
    rows = [(1, "R. Kumar", None, "seen"), (2, "rahul kumar", None, "at Dock Road"), (3, "Sunil Mo", None, "x"), (4, "Nobody Here", None, "x"), (5, "R. Kumar", None, "again"), (6, "Rahu Kumar", "70000", "x")]
    m = spark.createDataFrame([(*r, f"s{r[0]}", "fir") for r in rows], "seq long, value string, phone string, evidence_snippet string, source_id string, source_type string")
    mapping, log = resolution.resolve(m, people)
    assert {r.mention: r.canonical for r in mapping.collect()} == {"R. Kumar": "A1", "rahul kumar": "A1", "Sunil Mo": "A2", "Nobody Here": "Nobody Here", "Rahu Kumar": "A1"}
    methods = {r.merged_ids: (r.method, r.name_score, r.confidence) for r in log.collect()}
    assert methods["R. Kumar"][1] == 92.0 and methods["rahul kumar"][:2] == ("exact", 100.0) and "Nobody Here" not in methods


def test_initials(spark):
    rows = [("R. Kumar", "Rahul Kumar"), ("Rahul K.", "Rahul Kumar"), ("S. Kumar", "Rahul Kumar"), ("Rahul", "Rahul Kumar")]
    got = spark.createDataFrame(rows, "m string, n string").select(text.initials_score(F.col("m"), F.col("n"))).collect()
    assert [r[0] for r in got] == [92.0, 92.0, 0.0, 0.0]


def test_extraction(spark):
    t = spark.createDataFrame([("d1", "Ravi Kumar called 7000012345 twice: 7000012345.\nNear Station Road. Ravi ran! Package changed hands with Sunil More", "fir", 3), ("d2", None, "fir", 1)], "doc_id string, text string, source_type string, day int")
    hits = {(r.entity_type, r.value): (r.n, r.evidence_snippet) for r in extraction.pattern_entities(t).unionByName(extraction.gazetteer_entities(t)).collect()}
    assert hits["Phone", "7000012345"] == (2, "Ravi Kumar called 7000012345 twice: 7000012345. Near Stati") and hits["Location", "Station Road"][0] == 1
    names = {(r.value, r.confidence) for r in extraction.name_mentions(t, spark.createDataFrame([("ravi",)], "name string")).collect()}
    assert ("Ravi Kumar", 0.45) in names and ("Sunil More", 0.45) in names and ("Ravi", 0.40) in names and not any("Station" in n for n, _ in names)
    m = spark.createDataFrame([("Ravi Kumar",), ("Kumar called",), ("Rav",), ("",)], "mention string")
    assert sorted(r.mention for r in extraction.containment(t, m).collect()) == ["Kumar called", "Ravi Kumar"]
    assert sorted(r.mention for r in extraction.contains_pairs(t, m.where("mention <> ''")).collect()) == ["Kumar called", "Rav", "Ravi Kumar"]
    kinds = spark.createDataFrame([("They were in frequent contact",), ("he sent money",), ("nothing",)], "s string").select(text.relation_kind(F.col("s")).alias("r")).collect()
    assert [r.r.kind for r in kinds] == ["CALLS", "TRANSFERRED_TO", "ASSOCIATED_WITH"]


def test_merkle_and_chain(spark):
    leaves = [ledger.canonical_hash(x) for x in ("Record A", "Record B", "Record C")]
    rows = [("x", i, h) for i, h in enumerate(leaves)] + [("one", 0, leaves[0])]
    roots = {r.block: (r.n_leaves, r.root) for r in ledger.merkle_roots(spark.createDataFrame(rows, "block string, seq long, leaf string")).collect()}
    assert roots["x"] == (3, "a7abf0fae63ed28994659f3e679e011bd0291edf376ea56f2246ea69d7ad65d4") and roots["one"] == (1, leaves[0])
    assert ledger.EMPTY_ROOT == "0279d5004657a1e815912f9ccb964102391a66c302764b8cb29448f126aa6b34"
    blocks = ledger.chain([("a", leaves[0]), ("b", leaves[1]), ("c", leaves[2])])
    assert ledger.chain_valid(spark.createDataFrame(blocks)).first().valid
    blocks[1]["block_hash"] = "0" * 64
    assert not ledger.chain_valid(spark.createDataFrame(blocks)).first().valid
    found = ledger.verify(spark.createDataFrame(rows, "block string, seq long, leaf string"), spark.createDataFrame(blocks), leaves[2][:10])
    assert {(r.matched_in, r.name) for r in found.collect()} == {("merkle_root", "c"), ("leaf", "x")}
    rec = spark.createDataFrame([(1, "é", None), (2, "y", "abc")], "a long, b string, evidence_hash string")
    assert [r.leaf for r in ledger.record_hashes(rec).collect()] == [ledger.canonical_hash({"a": 1, "b": "é", "evidence_hash": None}), "abc"]


def test_geo_and_vectors(spark):
    rows = [("old market circle area",), ("Eastgate",), ("Nowhere",), ("",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(geo.coordinates(F.col("p")).alias("c")).select("c.*").collect()
    assert got[0].tower_id == "TOW-002" and got[1].lat == 19.0596 and got[2].zone == "Peripheral Zone" and got[3].lat is None and got[4].lat is None
    p = spark.createDataFrame([(x,) for x in (1.0, 0.9, 0.7, 0.5, 0.3, 0.0, -1.0)], "s double").select(vectors.match_percent(F.col("s")).alias("p")).collect()
    assert [r.p for r in p] == [99.8, 94.1, 79.0, 59.9, 39.9, 15.0, 5.0]


def test_pairs(spark):
    calls = spark.createDataFrame([(i, "a", "b", 1 + i % 2, 60, "T") for i in range(7)] + [(9, "b", "a", 3, 30, "U"), (10, "a", "a", 3, 30, "U")], "call_id long, caller string, callee string, day int, duration long, tower string")
    txns = spark.createDataFrame([("t", "b", "a", 500, 1, "UPI")], "txn_id string, sender string, receiver string, amount long, day int, txn_type string")
    m = spark.createDataFrame([("a", "f1", "fir"), ("b", "f1", "fir"), ("a", "f2", "fir")], "id string, doc_id string, source_type string")
    r = pairs.explain(calls, txns, m).collect()
    assert len(r) == 1 and (r[0].calls, r[0].calls_p, r[0].minutes, r[0].amount_q, r[0].fir, r[0].evidence_points) == (8, 7, 7.5, 500, 1, 2 + 2 + 3 + 2)
    assert r[0].relationship_strength.startswith("Direct")


def test_lead_bands(spark):
    people = spark.createDataFrame([("x", "A"), ("y", "B")], "id string, cell string")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    leads = signals.lead_scores(people, one([("x", 1.0)], "id string, bridge_score double"), one([("x", 1.0, 10), ("y", 0.0, 5)], "id string, betweenness double, degree long"), one([("x", 1.0)], "entity_id string, score double"), one([("x", 1.0)], "entity_id string, score double"), one([("A",)], "cell string"), one([("x", 1.0)], "id string, quality double"), one([("x", 1.0)], "entity string, confidence double"))
    got = {r.id: (r.lead_score, r.priority) for r in leads.collect()}
    assert got == {"x": (100, "HIGH"), "y": (10, "LOW")}


def _full_product(values, names, least):
    """The best name of each value by all scores, as in best_candidates()."""
    from netfusion.functions.similarity import indel_ratio, partial_ratio

    def initials(a, b):
        a, b = re.sub(r"[.\s]+", " ", a.lower()).strip().split(" "), re.sub(r"\s+", " ", b.lower()).strip().split(" ")
        ok = lambda k: len(a[k]) == 1 and a[k] == b[k][:1] and a[1 - k] == b[1 - k]
        return 92.0 if len(a) == len(b) == 2 and (ok(0) or ok(1)) else 0.0

    out = {}
    for v in {*values}:
        a = v.strip().lower()
        scores = []
        for i, name in names:
            b = name.strip().lower()
            scores.append((-(100.0 if a == b else max(indel_ratio(a, b), 0.95 * partial_ratio(a, b), initials(v, name))), i))
        score, i = min(scores)
        if -score >= least:
            out[v] = (i, round(-score, 6))
    return out


@pytest.mark.parametrize("least", [0.0, 70.0])
def test_best_names_are_those_of_the_full_product(spark, monkeypatch, least):
    monkeypatch.setattr(resolution, "NAME_BLOCK", 40)
    monkeypatch.setattr(resolution, "VALUE_BLOCK", 25)
    rng = random.Random(int(least))
    first, last = ["Rahul", "Sunita", "Farhan", "Gopal", "Meenakshi", "Al", "Ömer", "José María"], ["Kumar", "Shinde", "Qureshi", "Iyer", "Bose", "Li", "O'Neill", "Ali Khan"]
    names = [(i, f"{rng.choice(first)} {rng.choice(last)}" + rng.choice(["", "", " ", " Jr"])) for i in range(150)]

    def misspelt(x):
        x = list(x)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = rng.choice("abcxyzßé .")
        return "".join(x)

    values = [misspelt(rng.choice(names)[1]) for _ in range(120)] + ["R. Kumar", "Sunita S.", "Farhan", "kumar", "", " ", "zq", "Q", "Rahul  Kumar", "x" * 300, "GOPAL IYER"]
    m = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string")
    p = spark.createDataFrame([(i, n, i) for i, n in names] + [(999, None, 999)], "id long, name string, ordinal long")
    scores = resolution.scored(resolution.candidates(m, p, least)).where(F.col("name_score") >= least)
    got = {r.value: (r.id, round(r.name_score, 6)) for r in resolution.best_candidates(scores).collect()}
    assert got == _full_product(values, names, least)


def test_few_pairs_are_scored(spark):
    """Misspelt names among 3,000 of which a part shares each word: what is left to score is a small share of the product."""
    from netfusion.functions import similarity

    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))).capitalize()
    firsts, lasts = [word() for _ in range(60)], [word() for _ in range(300)]
    names = [f"{rng.choice(firsts)} {rng.choice(lasts)}" for _ in range(3000)]
    values = [n[:k] + n[k + 1 :] for n in rng.sample(names, 60) for k in [rng.randrange(len(n))]]
    scored, ratio = [0], similarity.indel_ratio
    try:
        similarity.indel_ratio = lambda a, b: (scored.__setitem__(0, scored[0] + 1), ratio(a, b))[1]
        similarity.partial_ratio, kept = lambda a, b: 0.0, similarity.partial_ratio
        similarity.best_by_bounds(values, names, 70.0)
    finally:
        similarity.indel_ratio, similarity.partial_ratio = ratio, kept
    assert scored[0] < 0.05 * len(values) * len(names)


def test_bounds_hold():
    from netfusion.functions import similarity as sim

    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcAB é12") for _ in range(rng.randrange(12)))
    for _ in range(2000):
        a, b = text().strip().lower(), text().strip().lower()
        bound = sim.upper_bounds(sim.character_counts([a]), len(a), sim.character_counts([b]), np.array([len(b)]))[0][0]
        assert bound >= max(sim.indel_ratio(a, b), 0.95 * sim.partial_ratio(a, b)) or not a and not b
        assert sim.window_bound(*sorted((a, b), key=len)) >= sim.partial_ratio(a, b) or not a or not b


def test_similar_names_need_no_common_initial(spark):
    m = spark.createDataFrame([("Shristina",), ("Ali",), ("Zed",)], "value string")
    p = spark.createDataFrame([(1, "Christina", 1), (2, "Khalid", 2), (3, "Bob", 3)], "id long, name string, ordinal long")
    best = {r.value: (r.id, round(r.name_score, 1)) for r in resolution.best_candidates(resolution.scored(resolution.candidates(m, p))).collect()}
    # 88.9 by the ratio, 0.95 * 200 * 8 / 17 by its parts; no name is like Zed
    assert best == {"Shristina": (1, 89.4), "Ali": (2, 95.0)}


def test_sessions_end_at_gaps(spark):
    rng = random.Random(2)
    days = sorted(rng.sample(range(-400, 2500), 300)) + list(range(3000, 3600))
    want, start = {}, None
    for i, d in enumerate(days):
        start = d if i == 0 or d - days[i - 1] > 6 else start
        want[d] = start
    df = spark.createDataFrame([(d,) for d in days + days[:5]], "day int")
    got = {r.day: r.session for r in bursts.sessions(df, 6, block=50).collect()}
    assert got == want and len({*want.values()}) > 20


def test_greedy_groups_do_not_depend_on_where_sessions_are(spark):
    """Two far copies of the same bursts give the same groups twice."""
    rng = random.Random(4)
    one = [(rng.choice("ABC"), d, 5, round(rng.random() * 3 + 2, 2)) for d in rng.sample(range(1, 80), 30)]
    schema = "cell string, day int, n long, zscore double"
    alone = [tuple(r)[:6] for r in bursts.temporal_groups(spark.createDataFrame(one, schema)).orderBy("first_day").collect()]
    both = [tuple(r)[:6] for r in bursts.temporal_groups(spark.createDataFrame(one + [(c, d + 1000, n, z) for c, d, n, z in one], schema)).orderBy("first_day").collect()]
    assert both == alone + [(a + 1000, z + 1000, [d + 1000 for d in ds], *rest) for a, z, ds, *rest in alone] and alone


def test_relations_find_names_once_and_keep_words_out_of_the_shuffle(spark):
    t = spark.createDataFrame([("d1", "Ravi Kumar met Sunil More and Meena. Short one. Ravi Kumar again was alone there.", "fir", 1)], "doc_id string, text string, source_type string, day int")
    known = spark.createDataFrame([("Meena Das",), ("Sunil More",)], "name string")
    found = extraction.relations(t, known=known)
    assert sorted((r.src, r.dst) for r in found.collect()) == [("Sunil More", "Meena"), ("Sunil More", "Ravi Kumar")]
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("regexp_extract_all") == 2
    words = extraction.containment(t, known.withColumnRenamed("name", "mention"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in words and "SortMergeJoin" not in words
