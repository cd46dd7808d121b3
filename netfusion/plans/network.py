"""Queries on the graph: degrees, kernels, snapshots, leads, takedowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.operators import bursts, finance, graph, pairs, resolution, signals
from netfusion.plans.relational import call_bursts
from netfusion.plans.relational import FINANCIAL_ANOMALIES, Z
from netfusion.plans.views import ARCS, CALLS, EDGE_ARCS, EDGES, GRAPH, LEVELS, PEOPLE, TXNS, between_sql, call_pairs, calls, edges, levels_sql, pagerank_sql, people, sql, table, txns, users
from netfusion.session import cut, stored

START, GOAL, TARGETS = 1, 20, (1, 2)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The simple graph of all people, with edges whose ends are both customers."""
    return graph.undirected(graph.surviving(edges(spark, d), people(spark, d)))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


DEGREES = sql(
    CALLS, TXNS, EDGES,
    select="""SELECT id, degree, coalesce(neighbours, 0) AS neighbours, round(coalesce(neighbours, 0) / (count(*) OVER () - 1), 4) AS degree_centrality
FROM (SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM edges) GROUP BY id)
LEFT JOIN (SELECT u AS id, count(DISTINCT v) AS neighbours FROM (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges) WHERE u <> v GROUP BY u) USING (id)""",
)
CROSS = "cross_ AS (SELECT u AS id, count(*) FILTER (WHERE b.cell IS NOT NULL AND b.cell <> 'Noise' AND b.cell IS DISTINCT FROM a.cell) AS \"cross\" FROM (SELECT src AS u, dst AS v FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst) LEFT JOIN people a ON a.id = u LEFT JOIN people b ON b.id = v GROUP BY u)"


def between(e: DataFrame) -> DataFrame:
    """id, betweenness of all nodes with an edge, computed once."""
    return cut(graph.degrees(e).select("id").join(graph.betweenness(e), "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness")))


def true_bridges(e: DataFrame, p: DataFrame, b: DataFrame) -> DataFrame:
    return graph.bridges(b.join(p, "id").select("id", "cell", "betweenness"), graph.cross_cell_degree(e, p))


def measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All edges, and betweenness over them: what leads and bridges build on, computed once."""
    e = stored(edges(spark, d))
    return e, between(e)


def bridge_ranks(spark: SparkSession, d: str, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Bridges by betweenness over all calls and transfers (measured(), if known); betweenness to 9 digits, as sums may differ in the last ones."""
    e, b = known or measured(spark, d)
    return true_bridges(e, people(spark, d), b).withColumn("betweenness", F.round("betweenness", 9))


BRIDGE_PARTS = [
    PEOPLE, CALLS, TXNS, EDGES, CROSS, EDGE_ARCS, *between_sql(),
    """br AS (SELECT id, cell, b AS betweenness, round((b - lo) / (hi - lo), 4) AS norm_betweenness, "cross", round(0.6 * ((b - lo) / (hi - lo)) + 0.4 * "cross" / most, 4) AS bridge_score
FROM (SELECT id, cell, betweenness AS b, coalesce("cross", 0) AS "cross", min(betweenness) OVER () AS lo, max(betweenness) OVER () AS hi, (SELECT max("cross") FROM cross_) AS most FROM between JOIN people USING (id) LEFT JOIN cross_ USING (id)))""",
]
BRIDGES = sql(*BRIDGE_PARTS, select='SELECT id, cell, round(betweenness, 9) AS betweenness, norm_betweenness, "cross", bridge_score, CAST(row_number() OVER (ORDER BY bridge_score DESC, id) AS INTEGER) AS rank, row_number() OVER (ORDER BY bridge_score DESC, id) <= 6 AS flagged FROM br')


def day_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return graph.snapshot(edges(spark, d).where("kind = 'CALLED'"), 12)


def snapshot_nodes(spark: SparkSession, d: str) -> DataFrame:
    always = people(spark, d).orderBy("id").limit(6).select("id")
    return graph.incident_nodes(graph.snapshot(edges(spark, d), 3, 1), people(spark, d), always).select("id", "cell")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(call_pairs(spark, d), users(spark, d))


COMPONENTS = sql(
    CALLS, GRAPH, ARCS,
    select="""SELECT id, min(r) AS component FROM (
  WITH RECURSIVE reach(id, r) AS (SELECT DISTINCT user_id, user_id FROM events UNION SELECT arcs.v, reach.r FROM reach JOIN arcs ON arcs.u = reach.id)
  SELECT * FROM reach
) GROUP BY id""",
)


def bfs_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(call_pairs(spark, d), START, 4)


HOPS = sql(
    CALLS, GRAPH, ARCS,
    select=f"SELECT id, min(h)::INTEGER AS hops FROM (WITH RECURSIVE r(id, h) AS (SELECT {START}::BIGINT, 0 UNION SELECT arcs.v, r.h + 1 FROM r JOIN arcs ON arcs.u = r.id WHERE r.h < 4) SELECT * FROM r) GROUP BY id",
)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(call_pairs(spark, d), START, GOAL).select(F.array_join("path", ">").alias("path"), "hops")


def _path_sql(most: int = 4) -> str:
    """The first path by its ids among the shortest: of the paths to a node after k steps only the first is kept."""
    parts = [CALLS, GRAPH, ARCS, f"p0 AS (SELECT {START}::BIGINT AS id, [{START}::BIGINT] AS p)"]
    parts += [f"p{k} AS (SELECT v AS id, min(list_append(p, v)) AS p FROM p{k - 1} JOIN arcs ON u = id WHERE NOT list_contains(p, v) GROUP BY v)" for k in range(1, most + 1)]
    every = " UNION ALL ".join(f"SELECT * FROM p{k} WHERE id = {GOAL}" for k in range(most + 1))
    return sql(*parts, select=f"SELECT array_to_string(p, '>') AS path, len(p)::INTEGER - 1 AS hops FROM ({every}) ORDER BY len(p) LIMIT 1")


def network_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(graph.efficiency(call_pairs(spark, d)), 6),)], "efficiency double")


def _efficiency_sql(name: str, n: str) -> str:
    """Mean of 1 / distance over pairs, from the tables of levels_sql()."""
    return "(SELECT (" + " + ".join(f"(SELECT count(*) FROM {name}{k}) / {k}" for k in range(1, LEVELS + 1)) + f") / ({n} * ({n} - 1)))"


EFFICIENCY = sql(CALLS, GRAPH, ARCS, *levels_sql(), select=f"SELECT round({_efficiency_sql('s', '(SELECT count(DISTINCT u) FROM arcs)')}, 6)::DOUBLE AS efficiency")


def takedown_impact(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(i,) for i in TARGETS], "id long")
    return graph.takedown(stored(call_pairs(spark, d)), users(spark, d), targets)


def what_if(spark: SparkSession, d: str) -> DataFrame:
    return graph.what_if(call_pairs(spark, d), users(spark, d), START)


def _count_components(edges_: str, keep: str) -> str:
    return f"(SELECT count(DISTINCT c) FROM (SELECT id, min(r) AS c FROM (WITH RECURSIVE reach(id, r) AS (SELECT DISTINCT user_id, user_id FROM events WHERE {keep} UNION SELECT a.v, reach.r FROM reach JOIN {edges_} a ON a.u = reach.id) SELECT * FROM reach) GROUP BY id))"


def _takedown_sql() -> str:
    rest = f"arcs2 AS (SELECT * FROM arcs WHERE u NOT IN {TARGETS} AND v NOT IN {TARGETS})"
    before = _efficiency_sql("s", "(SELECT count(DISTINCT user_id) FROM events)")
    after = _efficiency_sql("z", f"(SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN {TARGETS})")
    return sql(
        CALLS, GRAPH, ARCS, rest, *levels_sql(), *levels_sql("arcs2", "z"),
        select=f"""SELECT round(b, 4) AS efficiency_before, round(a, 4) AS efficiency_after, round(least(100, greatest(0, (1 - a / b) * 100)), 1)::DOUBLE AS disruption_pct, fragments, severed FROM (
  SELECT {before} AS b, {after} AS a, {_count_components('arcs2', f'user_id NOT IN {TARGETS}')} AS fragments, (SELECT count(*) FROM graph) - (SELECT count(*) FROM arcs2) // 2 AS severed)""",
    )


WHAT_IF = sql(
    CALLS, GRAPH, ARCS, f"arcs2 AS (SELECT * FROM arcs WHERE u <> {START} AND v <> {START})",
    select=f"""SELECT edges_before, edges_after, nodes_before, nodes_after, components_before, components_after,
  round(100 * (0.6 * ((edges_before - edges_after) / greatest(edges_before, 1)) + 0.4 * least(1.0, greatest(0, components_after - components_before) / greatest(components_before, 1))), 1)::DOUBLE AS impact FROM (
  SELECT (SELECT count(*) FROM graph) AS edges_before, (SELECT count(*) FROM graph WHERE src <> {START} AND dst <> {START}) AS edges_after,
  (SELECT count(DISTINCT user_id) FROM events) AS nodes_before, (SELECT count(DISTINCT user_id) FROM events WHERE user_id <> {START}) AS nodes_after,
  {_count_components('arcs', 'TRUE')} AS components_before, {_count_components('arcs2', f'user_id <> {START}')} AS components_after
)""",
)


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(call_pairs(spark, d), rounds=4).select("id", F.round("rank", 9).alias("rank"))


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(call_pairs(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


def betweenness_by_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by rounds of joins, every node a source."""
    return graph.betweenness_by_rounds(call_pairs(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


BETWEENNESS = sql(CALLS, GRAPH, ARCS, *between_sql(), select="SELECT id, round(betweenness, 6) AS betweenness FROM between")


def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(call_pairs(spark, d), 3)


def _labels_sql(rounds: int) -> str:
    parts = [CALLS, GRAPH, ARCS, "l0 AS (SELECT DISTINCT u AS id, u AS label FROM arcs)"]
    for k in range(rounds):
        parts.append(
            f"l{k + 1} AS (SELECT id, arg_max(label, (n, -label)) AS label FROM (SELECT id, label, count(*) AS n FROM (SELECT u AS id, label FROM arcs JOIN l{k} ON l{k}.id = v UNION ALL SELECT id, label FROM l{k}) GROUP BY id, label) GROUP BY id)"
        )
    return sql(*parts, select=f"SELECT id, label FROM l{rounds}")


def communities(spark: SparkSession, d: str) -> DataFrame:
    """Louvain communities of callers, flagged bridges taken out."""
    e, p = stored(edges(spark, d).select("src", "dst")), people(spark, d)
    flagged = true_bridges(e, p, between(e)).where("flagged")
    c = graph.louvain(graph.without(call_pairs(spark, d), flagged))
    return graph.community_profile(c, people(spark, d)).select("community", "size", "dominant_cell")


def label_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities by label propagation, flagged bridges taken out, by size: T8 and the filter of G7."""
    e, p = stored(edges(spark, d).select("src", "dst")), people(spark, d)
    flagged = true_bridges(e, p, between(e)).where("flagged")
    labels = graph.label_propagation(graph.without(call_pairs(spark, d), flagged), 3).withColumnRenamed("label", "community")
    return graph.community_profile(labels, p).select("community", "size", "dominant_cell")


def _label_communities_sql(rounds: int = 3) -> str:
    parts = [*BRIDGE_PARTS, "flagged AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY bridge_score DESC, id) AS k FROM br) WHERE k <= 6)", GRAPH]
    parts.append("left_ AS (SELECT src AS u, dst AS v FROM graph WHERE src NOT IN (SELECT id FROM flagged) AND dst NOT IN (SELECT id FROM flagged))")
    parts.append("la AS (SELECT u, v FROM left_ UNION ALL SELECT v, u FROM left_)")
    parts.append("l0 AS (SELECT DISTINCT u AS id, u AS label FROM la)")
    for k in range(rounds):
        parts.append(
            f"l{k + 1} AS (SELECT id, arg_max(label, (n, -label)) AS label FROM (SELECT id, label, count(*) AS n FROM (SELECT u AS id, label FROM la JOIN l{k} ON l{k}.id = v UNION ALL SELECT id, label FROM l{k}) GROUP BY id, label) GROUP BY id)"
        )
    parts.append(f"cn AS (SELECT label, coalesce(cell, 'Unknown') AS cell, count(*) AS n FROM l{rounds} LEFT JOIN people USING (id) GROUP BY 1, 2)")
    return sql(*parts, select="SELECT label AS community, CAST(sum(n) AS BIGINT) AS size, arg_min(cell, (-n, cell)) AS dominant_cell FROM cn GROUP BY label")


def history_context(spark: SparkSession, d: str) -> DataFrame:
    """What is last known of customers, their orders being the history; some rows know one thing, some the other, some neither."""
    k = F.col("o_orderkey")
    sometimes = lambda n, value: F.when(k % n == 0, "").when(k % n == 1, F.lit(None).cast("string")).otherwise(value)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), sometimes(3, F.concat(F.lit("Street "), (k % 17).cast("string"))).alias("known_address"), sometimes(4, F.col("o_orderpriority")).alias("gang_affiliation"), k.alias("row"))
    return resolution.history_context(rows, "row")


HISTORY_CONTEXT = """SELECT o_custkey AS person_id, arg_max('Street ' || o_orderkey % 17, o_orderkey) FILTER (WHERE o_orderkey % 3 = 2) AS address,
arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 4 >= 2) AS org FROM orders GROUP BY o_custkey"""

SEGMENTS = {"click": "AUTOMOBILE", "error": "BUILDING", "purchase": "FURNITURE", "signup": "HOUSEHOLD", "view": "MACHINERY"}


def _segment(cell: str = "cell") -> Column:
    """Towers stand for segments in burst data."""
    return F.create_map(*(F.lit(x) for kv in SEGMENTS.items() for x in kv))[F.col(cell)]


def unified_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Communication anomalies: a tower's bursts for the first four customers of its segment."""
    comm = signals.communication_anomalies(call_bursts(spark, d).withColumn("cell", _segment()), people(spark, d))
    return signals.unified(comm).select("entity_id", "anomaly_type", "score", "day", "severity")


_SEGMENTS_SQL = "seg AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SEGMENTS.items()) + ") t(tower, segment))"
COMM_PARTS = [
    _SEGMENTS_SQL, "first4 AS (SELECT id, cell FROM (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY ordinal, id) AS k FROM people) WHERE k <= 4)",
    "comm AS (SELECT entity_id, score, CAST(day AS INTEGER) AS day FROM (SELECT id AS entity_id, round(least(1.0, zscore / 5), 3) AS score, day, row_number() OVER (PARTITION BY id ORDER BY round(least(1.0, zscore / 5), 3) DESC, day) AS k FROM b JOIN seg ON seg.tower = b.cell JOIN first4 ON first4.cell = seg.segment) WHERE k = 1)",
]
COMMUNICATION = sql(PEOPLE, CALLS, Z, *COMM_PARTS, select="SELECT entity_id, 'communication_burst' AS anomaly_type, score, day, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM comm")


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Mentions: customers, and as places their nations, in the cases of suppliers that they returned something to."""
    t = txns(spark, d).where("txn_type = 'R'").select(F.col("sender").alias("id"), F.concat(F.lit("S"), F.col("receiver").cast("string")).alias("case_id"), "day")
    places = t.join(people(spark, d).select("id", "role"), "id").select(F.concat(F.lit("LOC:"), "role").alias("entity"), "case_id", "day")
    return t.select(F.col("id").cast("string").alias("entity"), "case_id", "day").unionByName(places).distinct()


def named_people(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).withColumn("id", F.col("id").cast("string"))


CROSS_PARTS = [
    "m AS (SELECT sender::VARCHAR AS entity, 'S' || receiver AS case_id, day FROM txns WHERE txn_type = 'R' UNION SELECT 'LOC:' || role, 'S' || receiver, day FROM txns JOIN people ON id = sender WHERE txn_type = 'R')",
    "xs AS (SELECT entity, list_sort(list(DISTINCT case_id)) AS cases, max(day) - min(day) AS span FROM m GROUP BY entity HAVING count(DISTINCT case_id) >= 2)",
    "xc AS (SELECT DISTINCT case_id, cell FROM m JOIN people p ON p.id::VARCHAR = entity), xv AS (SELECT entity, count(DISTINCT cell) AS n_cells FROM (SELECT DISTINCT entity, case_id FROM m) JOIN xc USING (case_id) GROUP BY entity)",
    """x AS (SELECT entity, CASE WHEN entity LIKE 'LOC:%' THEN 'Location' ELSE 'Person' END AS entity_type, len(cases)::INTEGER AS n_cases, coalesce(n_cells, 0) AS n_cells,
  round(least(0.95, CASE WHEN entity LIKE 'LOC:%' THEN 0.5 + 0.15 * len(cases) ELSE 0.6 + 0.05 * len(cases) + CASE WHEN n_cells >= 2 THEN 0.1 ELSE 0 END + CASE WHEN span > 20 THEN 0.05 ELSE 0 END END), 3)::DOUBLE AS confidence,
  substr(sha256(entity || array_to_string(cases, '')), 1, 16) AS evidence_hash FROM xs LEFT JOIN xv USING (entity))""",
]


def cross_case(spark: SparkSession, d: str) -> DataFrame:
    """Customers and nations shared by suppliers, the suppliers being cases."""
    return signals.cross_case(returns(spark, d), named_people(spark, d), limit=None).select("entity", "entity_type", "n_cases", "n_cells", "confidence", "evidence_hash")


def lead_scores(spark: SparkSession, d: str, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All signals fused for every customer."""
    (e, b), p, t = known or measured(spark, d), people(spark, d), txns(spark, d)
    centrality = b.join(graph.degrees(e).select("id", "degree"), "id")
    fin = finance.financial_anomalies(finance.structuring(t, cash="R", least=3, lump=60_000, least_lumps=1), finance.large_transfers(t, ("A",), 90_000, 50, 400), 200_000)
    hot = bursts.correlated(call_bursts(spark, d)).where("correlated")
    s = lambda df, c="id": df.withColumn(c, F.col(c).cast("string"))
    leads = signals.lead_scores(
        named_people(spark, d), s(true_bridges(e, p, b)), s(centrality), s(fin, "entity_id"), s(unified_anomalies(spark, d), "entity_id"), hot.select(_segment().alias("cell")), s(graph.evidence_quality(e)),
        signals.cross_case(returns(spark, d), named_people(spark, d), limit=None),
    )
    return leads.withColumn("reasons", F.array_join("reasons", ","))


#: Shares are whole thousandths, so that half of an odd sum is rounded up in both engines.
LEAD_PARTS = [
    *BRIDGE_PARTS, Z, *COMM_PARTS, *CROSS_PARTS,
    f"fin AS (SELECT entity_id AS id, max(score) AS score FROM ({FINANCIAL_ANOMALIES[FINANCIAL_ANOMALIES.index('SELECT entity_id, anomaly_type, score, day, CASE'):]}) GROUP BY entity_id)",
    "dg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM edges) GROUP BY id)",
    "ct AS (SELECT id, (CAST(round(betweenness / max(betweenness) OVER (), 3) * 1000 AS BIGINT) + CAST(round(degree / max(degree) OVER (), 3) * 1000 AS BIGINT) + 1) // 2 / 1000.0 AS centrality FROM between JOIN dg USING (id))",
    "ev AS (SELECT id, round(CAST(avg(confidence) AS DECIMAL(18, 9)), 3)::DOUBLE AS quality FROM (SELECT unnest([src, dst]) AS id, confidence FROM edges) GROUP BY id)",
    "hot AS (SELECT DISTINCT segment AS cell FROM seg JOIN b ON b.cell = seg.tower WHERE EXISTS (SELECT 1 FROM b a, b c WHERE abs(a.day - b.day) <= 7 AND abs(c.day - a.day) <= 7 AND c.cell <> b.cell))",
    """sg AS (SELECT p.id::VARCHAR AS id, p.cell, round(CAST(coalesce(br.bridge_score, 0) AS DECIMAL(9, 4)), 3)::DOUBLE AS bridge_score, coalesce(ct.centrality, 0) AS centrality, round(CAST(coalesce(fin.score, 0) AS DECIMAL(9, 6)), 3)::DOUBLE AS financial_anomaly,
  coalesce(comm.score, 0) AS communication_anomaly, CASE WHEN hot.cell IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS temporal_correlation, coalesce(ev.quality, 0.5)::DOUBLE AS evidence_quality, coalesce(x.confidence, 0) AS cross_case
FROM people p LEFT JOIN br USING (id) LEFT JOIN ct USING (id) LEFT JOIN fin USING (id) LEFT JOIN comm ON comm.entity_id = p.id LEFT JOIN hot ON hot.cell = p.cell LEFT JOIN ev USING (id) LEFT JOIN x ON x.entity = p.id::VARCHAR)""",
    "ls AS (SELECT *, CAST(greatest(0, least(100, round_even(round(100 * (0.25 * bridge_score + 0.20 * financial_anomaly + 0.15 * communication_anomaly + 0.10 * temporal_correlation + 0.15 * evidence_quality + 0.10 * centrality + 0.05 * cross_case), 6), 0))) AS INTEGER) AS lead_score FROM sg)",
]
LEADS = sql(
    *LEAD_PARTS,
    select="""SELECT * REPLACE (centrality::DOUBLE AS centrality, financial_anomaly::DOUBLE AS financial_anomaly, communication_anomaly::DOUBLE AS communication_anomaly, cross_case::DOUBLE AS cross_case), CASE WHEN lead_score >= 75 THEN 'HIGH' WHEN lead_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  concat_ws(',', CASE WHEN bridge_score >= 0.5 THEN 'bridge_score' END, CASE WHEN financial_anomaly >= 0.5 THEN 'financial_anomaly' END, CASE WHEN communication_anomaly >= 0.5 THEN 'communication_anomaly' END,
    CASE WHEN temporal_correlation >= 0.5 THEN 'temporal_correlation' END, CASE WHEN centrality >= 0.5 THEN 'centrality' END, CASE WHEN cross_case >= 0.5 THEN 'cross_case' END) AS reasons FROM ls""",
)


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the four removals, over all calls and transfers."""
    e, p = stored(edges(spark, d).select("src", "dst")), people(spark, d)
    return signals.packages(p, graph.pagerank(e, rounds=10), between(e), finance.account_volume(txns(spark, d)), cells=None)


def _packages(volume: str) -> list[str]:
    """Table pk: strategy, rank, id; from people, r10, between and volume."""
    return [
        "decap AS (SELECT id, row_number() OVER (ORDER BY coalesce(rank, 0) DESC, id) AS k FROM people LEFT JOIN r10 USING (id) QUALIFY k <= 3)",
        "bridge AS (SELECT id, row_number() OVER (ORDER BY coalesce(betweenness, 0) DESC, id) AS k FROM people LEFT JOIN between USING (id) WHERE id NOT IN (SELECT id FROM decap) QUALIFY k <= 3)",
        f"mule AS (SELECT id, row_number() OVER (ORDER BY volume DESC, id) AS k FROM people JOIN ({volume}) USING (id) QUALIFY k <= 4)",
        "turn AS (SELECT id, min(turn) AS turn FROM (SELECT id, k AS turn FROM decap WHERE k <= 2 UNION ALL SELECT id, k + 2 FROM bridge WHERE k <= 2 UNION ALL SELECT id, k + 4 FROM mule WHERE k <= 2) GROUP BY id)",
        "pk AS (SELECT 'sync' AS strategy, CAST(row_number() OVER (ORDER BY turn) AS INTEGER) AS rank, id FROM turn UNION ALL SELECT 'decap', k, id FROM decap UNION ALL SELECT 'bridge', k, id FROM bridge UNION ALL SELECT 'mule', k, id FROM mule)",
    ]


VOLUME = "SELECT id, sum(amount) AS volume FROM (SELECT unnest([sender, receiver]) AS id, amount FROM txns) GROUP BY id"
STRATEGIES = sql(PEOPLE, CALLS, TXNS, EDGES, EDGE_ARCS, *between_sql(), *pagerank_sql(10), *_packages(VOLUME), select="SELECT strategy, CAST(rank AS INTEGER) AS rank, id FROM pk")


def callers(spark: SparkSession, d: str) -> DataFrame:
    """People who call or are called; customers of two nations are leaders."""
    p = people(spark, d).join(users(spark, d), "id", "left_semi")
    return p.withColumn("role", F.when(F.col("role").isin("NATION_1", "NATION_2"), "Leader").otherwise(F.col("role")))


def simulated(spark: SparkSession, d: str) -> DataFrame:
    """What the four removals do to the call graph."""
    e, p, t = stored(call_pairs(spark, d)), callers(spark, d), txns(spark, d)
    chosen = cut(signals.packages(p, graph.pagerank(e, rounds=10), graph.betweenness(e), finance.account_volume(t), cells=None))
    return signals.simulated_packages(e, p.select("id"), p, t, chosen)


def _simulated_sql(select: str) -> str:
    p = "people AS (SELECT c_custkey AS id, c_mktsegment AS cell, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'Leader' ELSE n_name END AS role FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT user_id FROM events))"
    parts = [p, CALLS, TXNS, GRAPH, ARCS, *between_sql(), *pagerank_sql(10), *_packages(VOLUME)]
    rows = []
    for k, name in enumerate(("sync", "bridge", "decap", "mule")):
        inside = f"(SELECT id FROM pk WHERE strategy = '{name}')"
        parts += [f"arcs_{name} AS (SELECT * FROM arcs WHERE u NOT IN {inside} AND v NOT IN {inside})", *levels_sql(f"arcs_{name}", f"q{k}_")]
        parts.append(
            f"n_{name} AS (SELECT count(DISTINCT c) AS fragments FROM (SELECT id, min(r) AS c FROM (WITH RECURSIVE reach(id, r) AS (SELECT id, id FROM people WHERE id NOT IN {inside} UNION SELECT a.v, reach.r FROM reach JOIN arcs_{name} a ON a.u = reach.id) SELECT * FROM reach) GROUP BY id))"
        )
        rows.append(
            f"""SELECT '{name}' AS strategy, {_efficiency_sql('s', '(SELECT count(*) FROM people)')} AS b, {_efficiency_sql(f'q{k}_', f'(SELECT count(*) FROM people WHERE id NOT IN {inside})')} AS a, (SELECT fragments FROM n_{name}) AS fragments,
  (SELECT count(*) FROM graph) - (SELECT count(*) FROM arcs_{name}) // 2 AS severed, (SELECT count(*) FROM txns WHERE sender IN {inside} OR receiver IN {inside}) AS n_frozen, (SELECT coalesce(sum(amount), 0)::BIGINT FROM txns WHERE sender IN {inside} OR receiver IN {inside}) AS seized,
  (SELECT string_agg(id::VARCHAR, ', ' ORDER BY id::VARCHAR) FROM (SELECT id FROM people WHERE role = 'Leader' AND id NOT IN {inside} ORDER BY id LIMIT 2)) AS leaders, (SELECT count(*) FROM pk WHERE strategy = '{name}') AS k"""
        )
    parts.append("sim AS (" + " UNION ALL ".join(rows) + ")")
    parts.append(
        """simulated AS (SELECT strategy, round(b, 4) AS efficiency_before, round(a, 4) AS efficiency_after, round(least(100, greatest(0, (1 - a / b) * 100)), 1)::DOUBLE AS disruption_pct, fragments, severed, n_frozen, seized,
  CASE WHEN leaders IS NULL THEN 'LOW — Command structure shattered' ELSE 'MODERATE — Deputy leaders remain (' || leaders || ')' END AS succession_risk, k AS n_targets, k AS armed, k AS cyber, k AS perimeter, 9 * k AS personnel FROM sim)"""
    )
    return sql(*parts, select=select)


OPERATION_ORDERS = """SELECT strategy, 'OPORD-NCRB-OPERATION_THUNDERCLAP-2026' AS order_id, 'OPERATION THUNDERCLAP' AS codename, 'Authorized Joint Commissioner' AS commander,
  format('Arrests and seizures at {} primary targets for an estimated {:.1f}% structural collapse of the network', n_targets, disruption_pct) AS objective, '03:30 hrs - 05:00 hrs IST (Simultaneous Pre-Dawn Sweep)' AS execution_window,
  format('Rs. {:,}', seized) AS recovery, succession_risk, armed, cyber, perimeter, personnel FROM simulated"""


def operation_orders(spark: SparkSession, d: str) -> DataFrame:
    s = cut(simulated(spark, d))
    orders = None
    for name in ("sync", "bridge", "decap", "mule"):
        o = signals.operation_order(s.where(F.col("strategy") == name)).select(F.lit(name).alias("strategy"), "*")
        orders = o if orders is None else orders.unionByName(o)
    return orders


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    t = txns(spark, d)
    fans = finance.structuring(t, cash="R", least=3, lump=60_000, least_lumps=1)
    shared = signals.cross_case(returns(spark, d), named_people(spark, d))
    calls_ = pairs.call_counts(calls(spark, d)).select(F.col("p").cast("string").alias("p"), F.col("q").cast("string").alias("q"), "calls")
    return signals.recommendations(shared, fans, cut(lead_scores(spark, d)), calls_)


RECOMMENDATIONS = sql(
    *LEAD_PARTS, "tl AS (SELECT id FROM ls ORDER BY lead_score DESC, id LIMIT 10)", "top20 AS (SELECT * FROM x ORDER BY confidence DESC, n_cases DESC, entity LIMIT 20)",
    """fan AS (SELECT s.receiver, any_value(cash_small_count)::BIGINT AS n, sum(t.amount)::BIGINT AS total FROM (
    SELECT receiver, count(*) AS cash_small_count, min(day) FILTER (WHERE inside >= 3) AS w0
    FROM (SELECT receiver, day, count(*) OVER (PARTITION BY receiver ORDER BY day RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside FROM txns WHERE txn_type = 'R' AND amount < 50000) GROUP BY receiver
  ) s JOIN txns t ON t.sender = s.receiver AND t.amount >= 60000 AND t.day BETWEEN s.w0 AND s.w0 + 18 WHERE w0 IS NOT NULL GROUP BY s.receiver)""",
    "nb AS (SELECT other, count(*) AS n FROM (SELECT caller::VARCHAR AS lead, callee::VARCHAR AS other FROM calls UNION ALL SELECT callee::VARCHAR, caller::VARCHAR FROM calls) WHERE lead IN (SELECT id FROM tl) AND other NOT IN (SELECT id FROM tl) GROUP BY other ORDER BY n DESC, other LIMIT 10)",
    select="""SELECT * FROM (
  SELECT 'CROSS_CASE_LINK' AS type, entity AS target_id, CASE WHEN entity IN (SELECT id FROM tl) THEN 'CRITICAL' ELSE 'HIGH' END AS priority, CASE WHEN entity IN (SELECT id FROM tl) THEN 0.94 ELSE confidence END::DOUBLE AS priority_score, 'shared by ' || n_cases || ' cases' AS reason FROM top20
  UNION ALL SELECT 'FINANCIAL_MULE', receiver::VARCHAR, 'CRITICAL', 0.92, n || ' small cash receipts, ' || total || ' passed on' FROM fan
  UNION ALL SELECT 'NETWORK_NEIGHBOUR', other, 'MEDIUM', round(least(0.85, 0.5 + n * 0.02), 3), n || ' calls with leads' FROM nb
) ORDER BY priority_score DESC, type, target_id LIMIT 12""",
)


def why(spark: SparkSession, d: str) -> DataFrame:
    """What is known of customer 5: edges by kind, evidence quality, degree, counterparties."""
    e = edges(spark, d).where("src = 5 OR dst = 5")
    kinds = graph.edge_kind_counts(e).where("id = 5").groupBy("id").agg(F.sum(F.when(F.col("kind") == "CALLED", F.col("n"))).alias("called"), F.sum(F.when(F.col("kind") == "TRANSACTED", F.col("n"))).alias("transacted"))
    return kinds.join(graph.evidence_quality(e), "id").join(graph.degrees(e).select("id", "neighbours"), "id").select("id", "called", "transacted", F.round("quality", 6).alias("quality"), "neighbours")


QUERIES = {
    "graph_edges_dedup": (graph_edges, sql(PEOPLE, CALLS, TXNS, EDGES, select="SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst AND src IN (SELECT id FROM people) AND dst IN (SELECT id FROM people)")),
    "degree_centrality": (degrees, DEGREES),
    "cross_cell_degree": (lambda s, d: graph.cross_cell_degree(edges(s, d), people(s, d)), sql(PEOPLE, CALLS, TXNS, EDGES, CROSS, select='SELECT id, "cross" FROM cross_')),
    "bridge_ranks": (bridge_ranks, BRIDGES),
    "edge_kind_counts": (lambda s, d: graph.edge_kind_counts(edges(s, d)), sql(CALLS, TXNS, EDGES, select="SELECT id, kind, count(*) AS n FROM (SELECT unnest(list_distinct([src, dst])) AS id, kind FROM edges) GROUP BY ALL")),
    "day_snapshot": (
        day_snapshot,
        sql(CALLS, TXNS, EDGES, select="SELECT src, dst, kind, confidence, CAST(day AS INTEGER) AS day, CASE WHEN day = 12 THEN 1.0 ELSE round(0.35 + 0.65 * (1 - (12 - day) / 6), 2) END::DOUBLE AS opacity FROM edges WHERE kind = 'CALLED' AND day BETWEEN 6 AND 12"),
    ),
    "snapshot_incident_nodes": (snapshot_nodes, sql(PEOPLE, CALLS, TXNS, EDGES, select="SELECT id, cell FROM people WHERE id IN (SELECT unnest([src, dst]) FROM edges WHERE day BETWEEN 2 AND 3) OR id IN (SELECT id FROM people ORDER BY id LIMIT 6)")),
    "connected_components": (connected_components, COMPONENTS),
    "bfs_hops": (bfs_hops, HOPS),
    "shortest_path4": (shortest_path, _path_sql()),
    "network_efficiency": (network_efficiency, EFFICIENCY),
    "takedown_impact": (takedown_impact, _takedown_sql()),
    "whatif_impact": (what_if, WHAT_IF),
    "pagerank_k": (pagerank, sql(CALLS, GRAPH, ARCS, *pagerank_sql(4), select="SELECT id, round(rank, 9) AS rank FROM r4")),
    "betweenness": (betweenness, BETWEENNESS),
    "betweenness_by_rounds": (betweenness_by_rounds, BETWEENNESS),
    "label_propagation": (label_propagation, _labels_sql(3)),
    "communities": (communities, None),
    "label_communities": (label_communities, _label_communities_sql()),
    "history_context": (history_context, HISTORY_CONTEXT),
    "communication_anomalies": (unified_anomalies, COMMUNICATION),
    "cross_entity_cases": (cross_case, sql(PEOPLE, TXNS, *CROSS_PARTS, select="SELECT * FROM x")),
    "lead_scores": (lead_scores, LEADS),
    "takedown_strategies": (strategies, STRATEGIES),
    "simulated_strategies": (simulated, _simulated_sql("SELECT * FROM simulated")),
    "operation_orders": (operation_orders, _simulated_sql(OPERATION_ORDERS)),
    "recommendations": (recommendations, RECOMMENDATIONS),
    "why_flagged": (
        why,
        sql(CALLS, TXNS, EDGES, select="SELECT 5::BIGINT AS id, count(*) FILTER (WHERE kind = 'CALLED') AS called, count(*) FILTER (WHERE kind = 'TRANSACTED') AS transacted, (SELECT round(avg(confidence), 6) FROM (SELECT unnest([src, dst]) AS i, confidence FROM edges) WHERE i = 5) AS quality, count(DISTINCT CASE WHEN src = 5 THEN nullif(dst, 5) ELSE src END) AS neighbours FROM edges WHERE src = 5 OR dst = 5"),
    ),
    "mutual_counts": (
        lambda s, d: pairs.mutual_counts(call_pairs(s, d), call_pairs(s, d).select(F.col("src").alias("p"), F.col("dst").alias("q"))),
        sql(CALLS, GRAPH, ARCS, select="SELECT src AS p, dst AS q, count(b.v) AS mutual FROM graph LEFT JOIN arcs a ON a.u = src LEFT JOIN arcs b ON b.u = dst AND b.v = a.v GROUP BY src, dst"),
    ),
    "staffing": (
        lambda s, d: signals.staffing(table(s, d, "supplier").select(F.when(F.col("s_acctbal") < 0, "CRITICAL (ARMED)").otherwise("HIGH").alias("risk_level"))),
        "SELECT count(*) AS targets, sum(CASE WHEN s_acctbal < 0 THEN 2 ELSE 1 END)::BIGINT AS armed, count(*) AS cyber, sum(CASE WHEN s_acctbal < 0 THEN 2 ELSE 1 END)::BIGINT AS perimeter, (7 * sum(CASE WHEN s_acctbal < 0 THEN 2 ELSE 1 END) + 2 * count(*))::BIGINT AS personnel FROM supplier",
    ),
}
