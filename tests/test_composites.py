"""Matching, groups, communities, removals, certificates and checks, against brute force on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from netfusion.operators import bursts, evaluation, extraction, faces, graph, ingest, ledger, pairs, ranking, signals
from netfusion.plans import registry
from netfusion.sources import sinks


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50)) for i in range(400)]
    got = ranking.ranked(spark.createDataFrame(rows, "id int, x int"), F.desc("x"), F.col("id")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert ranking.ranked(spark.createDataFrame([], "id int"), "id").collect() == []


def test_identities_against_every_pair(spark):
    rng = random.Random(2)
    people = [(f"P{i}", f"Name {i % 7}", f"+91 7000{i % 8}") for i in range(10)]
    acts = [(k, *(x for _ in "ab" for p in [rng.choice(people)] for x in (rng.choice([p[0].lower(), "", p[1]]), rng.choice([p[1].upper(), "", None]), rng.choice(["", p[2].replace("+", "00").replace("00", ""), None])))) for k in range(300)]
    df = spark.createDataFrame([(*a, "x") for a in acts], "k int, caller_id string, caller_name string, caller_phone string, callee_id string, callee_name string, callee_phone string, more string")
    digits = lambda x: "".join(c for c in x or "" if c.isdigit())
    low = lambda x: (x or "").strip().lower()

    def fits(p, i, n, x):
        own = {low(p[0]), low(p[1])}
        return low(i) in own or low(n) in own or bool(digits(x)) and digits(x) == digits(p[2])

    want = []
    for k, *a in acts:
        for p in people:
            for q in people:
                if p[0] < q[0]:
                    if fits(p, *a[:3]) and fits(q, *a[3:]):
                        want.append((k, p[0], q[0]))
                    elif fits(q, *a[:3]) and fits(p, *a[3:]):
                        want.append((k, q[0], p[0]))
    got = pairs.by_identity(df, spark.createDataFrame(people, "id string, name string, phone string"))
    assert sorted((r.k, r.caller, r.callee) for r in got.collect()) == sorted(want) and len(want) > 50


def greedy(found, span=7):
    every, used, out = sorted(found, key=lambda b: (b[1], b[0])), set(), []
    for cell, day, z in every:
        if day in used:
            continue
        low = high = day
        group = [(cell, day, z)]
        for b in every:
            if b[1] != day and abs(b[1] - day) <= span and max(high, b[1]) - min(low, b[1]) <= span:
                group.append(b)
                low, high = min(low, b[1]), max(high, b[1])
        if len({b[0] for b in group}) >= 2:
            used |= {b[1] for b in group}
            out.append((low, high, sorted({b[1] for b in group}), sorted({b[0] for b in group}), len(group), max(b[2] for b in group)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_burst_groups(spark, seed):
    rng = random.Random(seed)
    found = list({(rng.choice("ABCD"[: 1 + seed % 4]), rng.randrange(1, 90)): None for _ in range(rng.choice([3, 12, 40]))})
    found = [(c, d, round(rng.uniform(2, 9), 2)) for c, d in found]
    df = spark.createDataFrame(found, "cell string, day int, zscore double")
    got = [tuple(r)[:6] for r in bursts.temporal_groups(df).orderBy("first_day").collect()]
    assert got == sorted(greedy(found))
    groups = {}
    for _, anchor, _ in found:
        near = [b for b in found if abs(b[1] - anchor) <= 7]
        if len({b[0] for b in near}) >= 2:
            groups[tuple(sorted({b[1] for b in near}))] = {f"{c}:{d}": z for c, d, z in near}
    assert {tuple(r.days): r.zscores for r in bursts.correlated_groups(df).collect()} == groups


def modularity(pairs_, group):
    m = len(pairs_)
    degree = {}
    for a, b in pairs_:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(group[a] == group[b] for a, b in pairs_) / m
    total = {}
    for x, k in degree.items():
        total[group[x]] = total.get(group[x], 0) + k
    return inside - sum((t / (2 * m)) ** 2 for t in total.values())


def test_louvain_finds_planted_groups(spark):
    rng = random.Random(3)
    pairs_ = sorted({tuple(sorted(rng.sample(range(15 * g, 15 * g + 15), 2))) for g in range(5) for _ in range(60)} | {tuple(sorted(rng.sample(range(75), 2))) for _ in range(25)})
    found = {r.id: r.community for r in graph.louvain(spark.createDataFrame(pairs_, "src long, dst long")).collect()}
    assert modularity(pairs_, found) > modularity(pairs_, {i: i // 15 for i in range(75)}) - 0.02
    assert all(min(i for i, c in found.items() if c == g) == g for g in set(found.values()))


def test_substrings_in_blocks(spark):
    texts = [(1, "abc abd"), (2, None), (3, ""), (4, "xABCx"), (4, "xABCx")]
    mentions = ["ab", "abc", "bd", "zz", "", None, "ABC"]
    t, m = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(x,) for x in mentions], "mention string")
    want = sorted({(d, x) for d, text in texts for x in mentions if text and x and x in text})
    for block in (2, 100):
        assert sorted(tuple(r) for r in extraction.contains_pairs(t, m, block).collect()) == want
    folded = sorted({(d, x) for d, text in texts for x in mentions if text and x and x.lower() in text.lower()})
    assert sorted(tuple(r) for r in extraction.contains_pairs(t, m, lower=True).collect()) == folded


def test_relations_put_known_names_first(spark):
    t = spark.createDataFrame([("d", "Ravi Kumar was seen meeting sunil more and Anil at Station Road. Short.", "fir", 1)], "doc_id string, text string, source_type string, day int")
    known = spark.createDataFrame([("Sunil More",), ("Anil Rao",)], "name string")
    assert [(r.src, r.dst, r.kind) for r in extraction.relations(t, known=known).collect()] == [("Sunil More", "Ravi Kumar", "MET"), ("Sunil More", "Anil", "MET")]
    assert extraction.relations(t).collect() == []


def test_records_and_free_numbers(spark):
    raw = spark.createDataFrame([(" 5 ", "1,200", None, "F1"), ("x", "abc", "T9", "F2")], "day string, amount_inr string, txn_id string, fir_id string")
    got = ingest.normalize_record(raw, "firs").collect()
    assert [(r.day, r.amount_inr, r._source_id, r._source_type) for r in got] == [(5, 1200, "F1", "firs"), (None, None, "T9", "firs")]
    people = spark.createDataFrame([("AUTO-001", "1", ""), ("AUTO-003", "2", "")], "id string, phone string, account string")
    calls = spark.createDataFrame([("UNK1", "", str(70 + i), "", "", "") for i in range(3)], "caller_id string, caller_name string, caller_phone string, callee_id string, callee_name string, callee_phone string")
    assert sorted((r.id, r.phone) for r in ingest.bootstrap(people, calls, None).collect()) == [("AUTO-002", "70"), ("AUTO-004", "71"), ("AUTO-005", "72")]


def test_removals(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("X", "Y")], "src string, dst string")
    people = spark.createDataFrame([(x, "A" if x < "X" else "N", "Leader" if x in "AD" else "Member") for x in "ABCDXY"], "id string, cell string, role string")
    score = lambda name, **s: spark.createDataFrame([(k, float(v)) for k, v in s.items()], f"id string, {name} double")
    chosen = signals.packages(people, score("rank", B=5, C=4, A=3, X=9), score("betweenness", B=1, D=2, Y=1), score("volume", A=1, B=2, C=2, D=0, X=5), cells=("A",))
    by = {}
    for r in sorted(chosen.collect(), key=lambda r: r["rank"]):
        by.setdefault(r.strategy, []).append(r.id)
    assert by == {"decap": ["B", "C", "A"], "bridge": ["D", "Y", "X"], "mule": ["X", "B", "C", "A"], "sync": ["B", "C", "D", "Y", "X"]}
    txns = spark.createDataFrame([("B", "Z", 5), ("Z", "C", 7), ("Z", "Z", 9)], "sender string, receiver string, amount long")
    risk = spark.createDataFrame([("B", "CRITICAL (ARMED)")], "id string, risk_level string")
    row = signals.simulate(edges, people.select("id"), people, txns, spark.createDataFrame([("B",), ("D",)], "id string"), risk).first()
    assert (row.n_targets, row.severed, row.fragments, row.n_frozen, row.seized, row.armed, row.perimeter, row.personnel) == (2, 3, 3, 1, 5, 3, 3, 25)
    assert row.succession_risk == "MODERATE — Deputy leaders remain (A)"
    assert signals.simulate(edges, people.select("id"), people.where("role <> 'Leader'"), txns, spark.createDataFrame([("B",)], "id string")).first().succession_risk.startswith("LOW")


def test_gate(spark):
    ok = spark.createDataFrame([("a", 2, 2, "PASS")], "check string, found long, total long, status string")
    half = evaluation.recovered("b", spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int"))
    bad = evaluation.structuring_check(spark.createDataFrame([], "receiver string, cash_small_count long, consolidations array<int>"), "C12")
    assert [(r.check, r.status) for r in evaluation.gate(ok, half).collect()][-1] == ("overall", "PARTIAL")
    assert [(r.check, r.found, r.total, r.status) for r in evaluation.gate(ok, half, bad).collect()][-2:] == [("structuring", 0, 2, "FAIL"), ("overall", 1, 3, "FAIL")]


def test_certificate(spark):
    leaves = ledger.numbered_leaves(spark.createDataFrame([(b, i, f"{b}{i}") for b in "xy" for i in range(3000)], "block string, i int, leaf string"), "i")
    for b in "xy":
        got = [r.leaf for r in leaves.where(F.col("block") == b).orderBy("seq").collect()]
        assert got == [f"{b}{i}" for i in range(3000)] and leaves.where(F.col("block") == b).agg(F.max("seq")).first()[0] == 2999
    blocks = spark.createDataFrame(ledger.chain([("x", "1" * 64), ("y", "2" * 64)]))
    one = ledger.certificate(blocks, leaves, "c", "t").first()
    a, b = (r.block_hash for r in blocks.orderBy("index").collect())
    assert one.master_root == ledger.canonical_hash(a + b) and one.token == ledger.canonical_hash(f"{one.certificate_id}:{one.master_root}:t") and one.n_records == 6000


def test_stores(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, cell string")
    edges = spark.createDataFrame([("a", "b", "CALLED")], "src string, dst string, kind string")
    for case in ("one", "two"):
        sinks.write_graph(nodes, edges, str(tmp_path), case)
    sinks.delete_case(spark, str(tmp_path), "one")
    n, e = sinks.read_graph(spark, str(tmp_path), "two")
    assert graph.query(n, e, "SELECT b.cell FROM {edges} e JOIN {nodes} b ON b.id = e.dst WHERE e.src = :a", a="a").first().cell == "B"
    assert not (tmp_path / "nodes" / "case_id=one").exists() and sinks.clean(spark, str(tmp_path / "none")) == 0
    index = faces.cached_index(nodes, str(tmp_path / "cache"))
    assert index.count() == 2 and faces.cached_index(nodes.limit(0), str(tmp_path / "cache")).count() == 2


def test_signals_of_nobody(spark):
    facts = spark.createDataFrame([("a",)], "id string").select("id", *(F.lit(None).cast(t).alias(c) for c, t in (("lead_score", "int"), ("priority", "string"), ("flagged", "boolean"), ("rank", "int"), ("bridge_score", "double"), ("betweenness", "double"), ("called", "long"), ("transacted", "long"), ("degree", "long"), ("anomalies", "array<string>"), ("n_cases", "int"))))
    assert signals.top_signals(facts).first().top_signals == ["No strong flag"]


def test_every_query_has_its_columns_in_sql():
    names, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(names) and {n for n in names if n not in sql} == {"communities", "header_map"}
