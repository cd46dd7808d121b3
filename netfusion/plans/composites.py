"""Queries on matching parties, dossiers, certificates, checks, questions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.functions.text import risk_level
from netfusion.operators import bursts, evaluation, extraction, finance, geo, graph, ingest, ledger, pairs, resolution, signals
from netfusion.plans import network
from netfusion.plans.records import _chain_sql, evidence_leaves, merkle
from netfusion.plans.relational import call_bursts
from netfusion.plans.views import ARCS, BEST_NAMES, CALLS, CASES, EDGES, GRAPH, PEOPLE, TXNS, call_pairs, calls, cases, edges, people, sql, table, txns
from netfusion.service import accounts, ask
from netfusion.session import cut, shared_dir, stored

# ---- parties known by different things


def known_people(spark: SparkSession, d: str) -> DataFrame:
    """Customers with phones and accounts."""
    i = F.col("id").cast("string")
    return people(spark, d).select(i.alias("id"), "name", "cell", "role", F.concat(F.lit("+91 "), F.lpad(i, 10, "0")).alias("phone"), F.concat(F.lit("AC"), F.lpad(i, 8, "0")).alias("account"))


def one_of_three(acts: DataFrame, key: str, sides: tuple[str, str], number: str, write: object) -> DataFrame:
    """acts whose sides are told by an id, a name or a number only, in turn."""
    out, k = acts, F.pmod(F.xxhash64(key), F.lit(3))
    for n, s in enumerate(sides):
        i, turn = F.col(s).cast("string"), (k + n) % 3
        out = out.withColumns({f"{s}_id": F.when(turn == 0, i).otherwise(""), f"{s}_name": F.when(turn == 1, F.concat(F.lit(" CUSTOMER#"), F.lpad(i, 9, "0"))), f"{s}_{number}": F.when(turn == 2, write(i)).otherwise("")})
    return out.drop(*sides)


def identity_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose ends are told by id, name or phone, matched with the directory; then counted by pair."""
    c = one_of_three(calls(spark, d, dealt=True), "call_id", ("caller", "callee"), "phone", lambda i: F.concat(F.lit("91-"), F.lpad(i, 10, "0")))
    return pairs.telephony(*pairs.identified(c, known_people(spark, d)))


def identity_transfers(spark: SparkSession, d: str) -> DataFrame:
    """J11 for transfers, by account."""
    t = one_of_three(txns(spark, d, dealt=True), "txn_id", ("sender", "receiver"), "account", lambda i: F.concat(F.lit("ac"), F.lpad(i, 8, "0")))
    return pairs.financials(*pairs.identified(t, known_people(spark, d), ("sender", "receiver"), "account"))


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """Ends replaced by their canonical ids: customers of a segment stand for their nation."""
    e = edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind")
    m = people(spark, d).where("cell = 'BUILDING'").select(F.col("id").cast("string").alias("mention"), F.col("role").alias("canonical"))
    return graph.resolve_ends(e, m).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def co_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Parts that the same orders have, by return flag."""
    return pairs.co_mentions(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("source_type")))


def explained_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair's counts, direct edges, mutual contacts and story, over calls, transfers and shared orders of suppliers."""
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("doc_id"), F.lit("fir").alias("source_type"))
    out = pairs.explain(calls(spark, d), txns(spark, d), m, edges(spark, d).where("kind = 'CALLED'"), people(spark, d))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("p", "q", z("calls"), z("txns"), z("fir"), z("direct_edges"), z("mutual"), "evidence_points", "relationship_strength", "story")


EXPLAINED = sql(
    PEOPLE, CALLS, TXNS, GRAPH, ARCS,
    "t AS (SELECT least(caller, callee) AS p, greatest(caller, callee) AS q, count(*) AS calls, round(sum(duration) / 60.0, 1) AS minutes, count(DISTINCT day) AS n_days FROM calls GROUP BY 1, 2)",
    "tw AS (SELECT p, q, arg_min(tower, (-n, tower)) AS top_tower FROM (SELECT least(caller, callee) AS p, greatest(caller, callee) AS q, tower, count(*) AS n FROM calls GROUP BY 1, 2, 3) GROUP BY p, q)",
    "f AS (SELECT least(sender, receiver) AS p, greatest(sender, receiver) AS q, count(*) AS txns, sum(amount)::BIGINT AS amount FROM txns WHERE sender <> receiver GROUP BY 1, 2)",
    "s AS (SELECT a.l_suppkey AS p, b.l_suppkey AS q, count(*) AS fir FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2)",
    "e AS (SELECT p, q, coalesce(calls, 0) AS calls, minutes, n_days, coalesce(txns, 0) AS txns, amount, coalesce(fir, 0) AS fir, top_tower FROM t FULL JOIN f USING (p, q) FULL JOIN s USING (p, q) LEFT JOIN tw USING (p, q))",
    "mu AS (SELECT p, q, count(b.v) AS mutual FROM e LEFT JOIN arcs a ON a.u = p LEFT JOIN arcs b ON b.u = q AND b.v = a.v GROUP BY p, q)",
    """x AS (SELECT *, CAST(CASE WHEN calls > 0 THEN least(4, calls // 5 + 1) + 2 ELSE 0 END + CASE WHEN txns > 0 THEN least(4, 2 * txns) ELSE 0 END + 3 * fir AS INTEGER) AS pts FROM e JOIN mu USING (p, q))""",
    select="""SELECT p, q, calls, txns, fir, calls AS direct_edges, mutual, pts AS evidence_points,
  CASE WHEN pts >= 8 THEN 'Direct Coordinated Operational Link (Critical)' WHEN pts >= 4 THEN 'Strong Financial / Communication Tie (High)' WHEN pts >= 2 THEN 'Corroborated Association (Moderate)' ELSE 'Indirect or Low-Frequency Link' END AS relationship_strength,
  concat_ws('; ', coalesce(a.name, p::VARCHAR) || ' (' || coalesce(a.role, 'Entity') || ') and ' || coalesce(b.name, q::VARCHAR) || ' (' || coalesce(b.role, 'Entity') || ')',
    CASE WHEN calls > 0 THEN format('{} calls over {} days ({:.1f} minutes), most at {}', calls, n_days, minutes, top_tower) END, CASE WHEN txns > 0 THEN format('{} transfers of {} in all', txns, amount) END,
    CASE WHEN fir > 0 THEN format('{} shared fir records', fir) END, CASE WHEN mutual > 0 THEN format('{} mutual contacts', mutual) END) AS story
FROM x LEFT JOIN people a ON a.id = p LEFT JOIN people b ON b.id = q""",
)

# ---- graphs and entities from records


def graph_built(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of people, phones, accounts, calls and transfers, counted by kind; what ends nowhere goes."""
    p = known_people(spark, d).withColumn("phone", F.when(F.col("cell") == "BUILDING", " ").otherwise(F.col("phone")))
    s = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    nodes, e = graph.build_graph(p.where("role <> 'NATION_1'"), s(calls(spark, d), "caller", "callee"), s(txns(spark, d), "sender", "receiver"))
    return graph.kind_histogram(e).unionByName(nodes.groupBy("kind").agg(F.count("*").alias("n")))


def structured(spark: SparkSession, d: str) -> DataFrame:
    """Entities that directory, transfers and reports name in their fields."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    t = o.select(k.alias("txn_id"), F.col("o_custkey").cast("string").alias("sender_id"), F.concat(F.lit("N"), "o_custkey").alias("sender_name"), F.lit("").alias("sender_account"), F.lit(None).cast("string").alias("receiver_id"), F.lit("x").alias("receiver_name"), F.concat(F.lit("A"), k).alias("receiver_account"), F.floor("o_totalprice").alias("amount_inr"), (F.col("o_orderkey") % 90).cast("int").alias("day"))
    h = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("record_id"), F.col("s_suppkey").cast("string").alias("person_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Nick").alias("alias"), F.when(F.col("s_suppkey") % 3 == 0, "Unaffiliated").when(F.col("s_suppkey") % 3 == 1, "Gang").alias("gang_affiliation"), F.lit(" ").alias("known_address"))
    f = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("fir_id"), F.col("n_name").alias("location"), F.lit(None).cast("string").alias("station"), F.lit(1).alias("day"))
    return extraction.structured_entities(known_people(spark, d), None, t, h, f)


_ENTITY = "SELECT '{}' AS entity_type, {} AS value, {} AS canonical_id, {} AS source_id, '{}' AS source_type, {} AS day, {}::DOUBLE AS confidence, {} AS evidence_snippet, substr(sha256({}), 1, 16) AS evidence_hash, '{}' AS extractor FROM {}"


def _entity(kind: str, value: str, canonical: str, source: str, source_type: str, day: str, conf: float, evidence: str, extractor: str, where: str, hashed: str = "") -> str:
    return _ENTITY.format(kind, value, canonical, source, source_type, day, conf, evidence, hashed or evidence, extractor, where)


_GANG = "CASE s_suppkey % 3 WHEN 0 THEN 'Unaffiliated' WHEN 1 THEN 'Gang' END"
_NICK = "CASE WHEN s_suppkey % 2 = 0 THEN 'Nick' END"
_PHONE, _ACCOUNT = "'+91 ' || lpad(c_custkey::VARCHAR, 10, '0')", "'AC' || lpad(c_custkey::VARCHAR, 8, '0')"
STRUCTURED = " UNION ALL ".join(
    (
        _entity("Person", "c_name", "c_custkey::VARCHAR", "'people_directory'", "people_directory", "NULL::INTEGER", 1.0, "'people_directory:' || c_custkey || ' ' || c_name", "canonical", "customer", "c_name"),
        _entity("Phone", _PHONE, _PHONE, "'people_directory'", "people_directory", "NULL::INTEGER", 1.0, _PHONE, "canonical", "customer"),
        _entity("Account", _ACCOUNT, _ACCOUNT, "'people_directory'", "people_directory", "NULL::INTEGER", 1.0, _ACCOUNT, "canonical", "customer"),
        _entity("Person", "'N' || o_custkey", "o_custkey::VARCHAR", "o_orderkey::VARCHAR", "transaction", "CAST(o_orderkey % 90 AS INTEGER)", 0.98, "o_orderkey || ':N' || o_custkey || '  INR' || CAST(floor(o_totalprice) AS BIGINT)", "txn_canonical", "orders"),
        _entity("Account", "'A' || o_orderkey", "'A' || o_orderkey", "o_orderkey::VARCHAR", "transaction", "CAST(o_orderkey % 90 AS INTEGER)", 0.98, "'A' || o_orderkey", "regex_account", "orders"),
        _entity("Person", "s_name", "s_suppkey::VARCHAR", "s_suppkey::VARCHAR", "criminal_history", "NULL::INTEGER", 0.97, f"s_name || ' alias:' || coalesce({_NICK}, '') || ' gang:' || coalesce({_GANG}, '')", "criminal_history", "supplier", f"s_name || coalesce({_GANG}, '')"),
        _entity("Person_alias", "'Nick'", "s_suppkey::VARCHAR", "s_suppkey::VARCHAR", "criminal_history", "NULL::INTEGER", 0.6, "'Nick'", "alias", "supplier WHERE s_suppkey % 2 = 0"),
        _entity("Organization", "'Gang'", "'Gang'", "s_suppkey::VARCHAR", "criminal_history", "NULL::INTEGER", 0.75, "'Gang'", "gang_affiliation", "supplier WHERE s_suppkey % 3 = 1"),
        _entity("Location", "n_name", "n_name", "n_nationkey::VARCHAR", "fir", "1", 0.9, "n_name", "fir_location", "nation"),
    )
)


def confidence_split(spark: SparkSession, d: str) -> DataFrame:
    """P10: entities that stand and those to be resolved, by type."""
    sure, rest = extraction.split_confidence(structured(spark, d))
    n = lambda df, part: df.groupBy("entity_type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "entity_type", "n")
    return n(sure, "structured").unionByName(n(rest, "unstructured"))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each dataset and edges of each kind."""
    out = graph.kind_histogram(edges(spark, d)).withColumnRenamed("kind", "name")
    for name in ("customer", "orders", "lineitem", "conversations"):
        out = out.unionByName(table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    """the hash of a record's canonical JSON; a record's own hash stays."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("b"), F.concat("s_name", F.lit(' "é"')).alias("a"), F.when(F.col("s_suppkey") % 4 == 0, "given").otherwise("").alias("evidence_hash"))
    return ledger.record_hashes(s, "s_suppkey")


# ---- dossiers


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Calls and transfers as edges with their sources."""
    c = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLED").alias("kind"), F.lit(1.0).alias("confidence"), F.col("day").cast("int").alias("day"), F.col("call_id").cast("string").alias("source"), F.lit("cdr").alias("source_type"), F.concat(F.lit("call of "), "duration").alias("supporting_text"))
    t = txns(spark, d).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), F.lit("TRANSACTED").alias("kind"), F.lit(1.0).alias("confidence"), F.col("day").cast("int").alias("day"), F.col("txn_id").alias("source"), F.lit("transaction").alias("source_type"), F.concat(F.lit("transfer of "), "amount").alias("supporting_text"))
    return c.unionByName(t)


NODE, LABEL = 5, "ab"


def why_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where a customer is known from: first edges, then texts that have the label or id."""
    e = linked(spark, d).where(F.col("kind") == "TRANSACTED")
    first = signals.sources(e.where("day <= 400"), cases(spark, d), NODE, LABEL, first=3)
    return first.select("source", "source_type", "kind", "day", "confidence", "supporting_text", "evidence_hash")


WHY_SOURCES = sql(
    TXNS, CASES,
    select=f"""SELECT source, source_type, kind, CAST(day AS INTEGER) AS day, confidence, supporting_text, evidence_hash FROM (
  SELECT 0 AS part, row_number() OVER (ORDER BY day, sender, receiver, txn_id) AS k, txn_id AS source, 'transaction' AS source_type, 'TRANSACTED' AS kind, day, 1.0::DOUBLE AS confidence, 'transfer of ' || amount AS supporting_text, '' AS evidence_hash FROM txns WHERE (sender = {NODE} OR receiver = {NODE}) AND day <= 400 QUALIFY k <= 3
  UNION ALL SELECT 1, row_number() OVER (ORDER BY doc_id) AS k, doc_id, 'text_mention', 'TEXT', day, 0.6, replace(substr(text, 1, 120), chr(10), ' '), substr(sha256(replace(substr(text, 1, 120), chr(10), ' ')), 1, 16) FROM cases WHERE contains(text, '{LABEL}') OR contains(text, '{NODE}')
) ORDER BY part, k LIMIT 8""",
)


def why_dossiers(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's facts and the signals that they add up to."""
    known = network.measured(spark, d)
    e = known[0]
    s = lambda df, c="id": df.withColumn(c, F.col(c).cast("string"))
    leads = network.lead_scores(spark, d, known).select("id", "lead_score", "priority")
    br = s(network.bridge_ranks(spark, d, known)).select("id", "flagged", "rank", "bridge_score", F.round("betweenness", 4).alias("betweenness"))
    kinds = s(graph.edge_kind_counts(e)).groupBy("id").agg(F.sum(F.when(F.col("kind") == "CALLED", F.col("n"))).alias("called"), F.sum(F.when(F.col("kind") == "TRANSACTED", F.col("n"))).alias("transacted"))
    degree = s(graph.degrees(e)).select("id", "degree")
    anomalies = s(network.unified_anomalies(spark, d), "entity_id").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("anomaly_type")).alias("anomalies"))
    shared = network.cross_case(spark, d).select(F.col("entity").alias("id"), "n_cases")
    facts = leads
    for more in (br, kinds, degree, anomalies, shared):
        facts = facts.join(more, "id", "left")
    return signals.top_signals(facts).select("id", "lead_score", "called", "transacted", "degree", F.array_join("top_signals", "; ").alias("signals"))


WHY_DOSSIERS = sql(
    *network.LEAD_PARTS, "rk AS (SELECT id, bridge_score, betweenness, row_number() OVER (ORDER BY bridge_score DESC, id) AS rank FROM br)",
    "kc AS (SELECT id, count(*) FILTER (WHERE kind = 'CALLED') AS called, count(*) FILTER (WHERE kind = 'TRANSACTED') AS transacted FROM (SELECT unnest(list_distinct([src, dst])) AS id, kind FROM edges) GROUP BY id)",
    select="""SELECT ls.id, lead_score, nullif(called, 0) AS called, nullif(transacted, 0) AS transacted, degree, coalesce(nullif(array_to_string(list_filter([
    format('Lead score {}/100, priority {}', lead_score, CASE WHEN lead_score >= 75 THEN 'HIGH' WHEN lead_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END), CASE WHEN rank <= 6 THEN format('Flagged as bridge: score {}, rank {}', rk.bridge_score, rank) END,
    CASE WHEN round(betweenness, 4) > 0.05 THEN 'High betweenness ' || round(betweenness, 4) END, CASE WHEN called >= 5 THEN format('{} calls', called) END, CASE WHEN transacted >= 3 THEN format('{} transfers', transacted) END,
    CASE WHEN degree >= 8 THEN format('High degree {}', degree) END, CASE WHEN comm.score IS NOT NULL THEN 'Anomalies: communication_burst' END, CASE WHEN n_cases >= 2 THEN format('Shared by {} cases', n_cases) END], lambda x: x IS NOT NULL)[1:6], '; '), ''), 'No strong flag') AS signals
FROM ls LEFT JOIN rk ON rk.id::VARCHAR = ls.id LEFT JOIN kc ON kc.id::VARCHAR = ls.id LEFT JOIN dg ON dg.id::VARCHAR = ls.id LEFT JOIN comm ON comm.entity_id::VARCHAR = ls.id LEFT JOIN x ON x.entity = ls.id""",
)


def leads_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """The priority filters what the limit has left."""
    return signals.top_leads(network.lead_scores(spark, d), 25, "MEDIUM").select("id", "lead_score", "priority")


LEADS_BY_PRIORITY = sql(*network.LEAD_PARTS, select="SELECT id, lead_score, 'MEDIUM' AS priority FROM (SELECT * FROM ls ORDER BY lead_score DESC, id LIMIT 25) WHERE lead_score BETWEEN 50 AND 74")

# ---- certificates and checks


def custody_certificate(spark: SparkSession, d: str) -> DataFrame:
    """The certificate of the ledger of case texts."""
    leaves = evidence_leaves(spark, d)
    roots = ledger.merkle_roots(leaves).orderBy("block").collect()  # a row for each block
    blocks = spark.createDataFrame(ledger.chain([(r.block, r.root) for r in roots]))
    return ledger.certificate(blocks, leaves, "Case One", "2026-01-01 00:00:00 UTC", station="Central").drop("declaration")


def _certificate_sql() -> str:
    body, _ = _chain_sql().rsplit(" SELECT bool_and(", 1)
    parts = ["v0 AS (SELECT i, h FROM c WHERE i >= 0)"]
    for k in range(4):
        parts.append(f"v{k + 1} AS (SELECT i // 2 AS i, CASE WHEN any_value(w) = 1 THEN min(h) ELSE sha256(arg_min(h, i) || arg_max(h, i)) END AS h FROM (SELECT *, count(*) OVER () AS w FROM v{k}) GROUP BY i // 2)")
    return f"""{body}, {', '.join(parts)} SELECT certificate_id, 'LEDGER-NCRB-' || upper(substr(sha256('Case One'), 1, 12)) AS ledger_id, 'Case One' AS case_name, '2026-01-01 00:00:00 UTC' AS issued, 'Investigating Officer' AS officer, 'Central' AS station,
  master_root, (SELECT count(*) FROM v0) AS n_blocks, (SELECT count(*) FROM conversations) AS n_records, TRUE AS chain_valid, sha256(certificate_id || ':' || master_root || ':2026-01-01 00:00:00 UTC') AS token
FROM (SELECT h AS master_root, 'CERT-BSA63-' || upper(substr(h, 1, 12)) AS certificate_id FROM v4)"""


def verified_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Where the hash of a text is found: all leaves are looked at."""
    leaves = evidence_leaves(spark, d)
    roots = merkle(spark, d).orderBy("block").collect()
    blocks = spark.createDataFrame(ledger.chain([(r.block, r.root) for r in roots]))
    digest = table(spark, d, "conversations").agg(F.max(F.sha2(F.coalesce("text", F.lit("")), 256))).first()[0]
    return ledger.verify(leaves, blocks, digest)


def eval_checks(spark: SparkSession, d: str) -> DataFrame:
    """C17: the six checks and their sum: flag, communities, bridges, bursts, structuring, aliases."""
    e, p = stored(edges(spark, d).select("src", "dst")), people(spark, d)
    degrees = cut(graph.degrees(e))
    labels = graph.label_propagation(call_pairs(spark, d), 3).withColumnRenamed("label", "community")
    found = graph.community_profile(labels, p).select(F.col("dominant_cell").alias("id"))
    top = degrees.join(p.select("id"), "id").orderBy(F.desc("degree"), "id").limit(4).select("id")
    flagged = graph.bridges(degrees.join(p, "id").select("id", "cell", F.col("degree_centrality").alias("betweenness")), graph.cross_cell_degree(e, p)).where("flagged").select("id")
    fans = finance.structuring(txns(spark, d), cash="R", least=3, lump=60_000, least_lumps=1)
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    log = names.where("id < '2'").select(F.col("id").alias("master_id"), F.concat(F.lit("old "), "name").alias("merged_ids"))
    return evaluation.gate(
        evaluation.flag_hygiene("ground_truth_flag", edges=e, people=p),
        evaluation.recovered("communities", p.select(F.col("cell").alias("id")), found),
        evaluation.recovered("bridges", top, flagged),
        evaluation.event_coverage("bursts", call_bursts(spark, d), (5, 12, 20, 29)),
        evaluation.structuring_check(fans, 1, 3, 1),
        evaluation.alias_recovery(log, names.select(F.col("name").alias("alias"), F.col("name").alias("canonical")), names),
    )


EVAL_CHECKS = sql(
    PEOPLE, CALLS, TXNS, EDGES, network.CROSS, network.GRAPH, network.ARCS, network.Z, "l0 AS (SELECT DISTINCT u AS id, u AS label FROM arcs)",
    *(f"l{k + 1} AS (SELECT id, arg_max(label, (n, -label)) AS label FROM (SELECT id, label, count(*) AS n FROM (SELECT u AS id, label FROM arcs JOIN l{k} ON l{k}.id = v UNION ALL SELECT id, label FROM l{k}) GROUP BY id, label) GROUP BY id)" for k in range(3)),
    "dom AS (SELECT DISTINCT cell FROM (SELECT label, arg_min(cell, (-n, cell)) AS cell FROM (SELECT label, coalesce(cell, 'Unknown') AS cell, count(*) AS n FROM l3 LEFT JOIN people USING (id) GROUP BY 1, 2) GROUP BY label))",
    "dg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS id FROM edges) GROUP BY id)",
    "dc AS (SELECT dg.id, degree, round(coalesce(n, 0) / ((SELECT count(*) FROM dg) - 1), 4) AS c FROM dg LEFT JOIN (SELECT u AS id, count(DISTINCT v) AS n FROM (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges) WHERE u <> v GROUP BY u) k USING (id))",
    "top4 AS (SELECT id FROM dc JOIN people USING (id) ORDER BY degree DESC, id LIMIT 4)",
    "fl AS (SELECT id FROM (SELECT id, round(0.6 * ((c - lo) / (hi - lo)) + 0.4 * x / most, 4) AS s FROM (SELECT id, c, min(c) OVER () AS lo, max(c) OVER () AS hi, coalesce(\"cross\", 0) AS x, (SELECT max(\"cross\") FROM cross_) AS most FROM dc JOIN people USING (id) LEFT JOIN cross_ USING (id))) ORDER BY s DESC, id LIMIT 6)",
    """fan AS (SELECT count(*) AS lumps, any_value(n) AS n FROM (SELECT count(*) AS n, min(day) FILTER (WHERE inside >= 3) AS w0 FROM (SELECT day, count(*) OVER (ORDER BY day RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside FROM txns WHERE txn_type = 'R' AND amount < 50000 AND receiver = 1)) JOIN txns ON sender = 1 AND amount >= 60000 AND day BETWEEN w0 AND w0 + 18)""",
    """ck AS (SELECT 'flag_hygiene' AS "check", 2::BIGINT AS found, 2::BIGINT AS total, 0.0 AS partial
  UNION ALL SELECT 'communities', (SELECT count(*) FROM dom WHERE cell IN (SELECT cell FROM people)), (SELECT count(DISTINCT cell) FROM people), 0
  UNION ALL SELECT 'bridges', (SELECT count(*) FROM top4 WHERE id IN (SELECT id FROM fl)), 4, 0
  UNION ALL SELECT 'bursts', (SELECT count(*) FROM (SELECT unnest([5, 12, 20, 29]) AS t) WHERE EXISTS (SELECT 1 FROM b WHERE abs(day - t) <= 2)), 4, 0
  UNION ALL SELECT 'structuring', (SELECT CASE WHEN lumps = 0 THEN 0 WHEN n >= 3 THEN 2 ELSE 1 END FROM fan), 2, 0
  UNION ALL SELECT 'alias_recovery', (SELECT count(*) FROM nation WHERE n_nationkey::VARCHAR < '2'), (SELECT count(*) FROM nation), 0.5)""",
    "st AS (SELECT \"check\", found, total, CASE WHEN found / total < partial THEN 'FAIL' WHEN found >= total THEN 'PASS' WHEN found > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM ck)",
    select="""SELECT * FROM st UNION ALL SELECT 'overall', count(*) FILTER (WHERE status = 'PASS'), count(*), CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'PARTIAL') > 0 THEN 'PARTIAL' ELSE 'PASS' END FROM st""",
)

# ---- similar names


def nation_names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as people with two names, and how they are written elsewhere."""
    k = F.col("n_nationkey")
    pick = lambda some: F.element_at(F.array(*map(F.lit, some)), (k % len(some) + 1).cast("int"))
    name = F.concat(pick(("Rahul", "Sunita", "Farhan", "Gopal", "Meenakshi")), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Kumar", "Shinde", "Qureshi", "Iyer", "Bose"))), (F.floor(k / 5) % 5 + 1).cast("int")))
    p = table(spark, d, "nation").select(k.cast("string").alias("id"), name.alias("name"), F.lit("A").alias("cell"), F.lit("").alias("phone"), F.concat(F.lit("AC"), k.cast("string"), F.lit(".")).alias("account"), F.lit("").alias("address"), F.lit("Org").alias("org"), k.alias("ordinal"))
    first, last = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))
    n = F.col("ordinal") % 5
    value = F.when(n == 0, F.upper("name")).when(n == 1, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).when(n == 2, F.concat(first, F.lit("x "), F.substring(last, 1, 3))).when(n == 3, last).otherwise(F.concat(F.lit("zq"), F.col("id")))
    m = p.select(F.col("ordinal").alias("seq"), value.alias("value"), F.lit(None).cast("string").alias("phone"), F.when(n < 2, F.concat(F.lit("paid to "), "account")).otherwise("near Org house").alias("evidence_snippet"), F.col("id").alias("source_id"), F.lit("fir").alias("source_type"))
    return m, p


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """The name most like each value."""
    m, p = nation_names(spark, d)
    best = resolution.best_candidates(resolution.scored(resolution.candidates(m, p, least=0.0)))
    return best.select("value", "id", F.round("name_score", 4).alias("name_score"), "method")


def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The log of merges and rejects."""
    m, p = nation_names(spark, d)
    return resolution.resolve(m, p)[1].select("master_id", "merged_ids", "method", "confidence", "name_score", "phone_score", "context_score", "source_id", "evidence_hash")


NATION_PARTS = [
    "p AS (SELECT n_nationkey AS ordinal, n_nationkey::VARCHAR AS id, ['Rahul', 'Sunita', 'Farhan', 'Gopal', 'Meenakshi'][n_nationkey % 5 + 1] || ' ' || ['Kumar', 'Shinde', 'Qureshi', 'Iyer', 'Bose'][n_nationkey // 5 % 5 + 1] AS name, 'AC' || n_nationkey || '.' AS account FROM nation)",
    "mm AS (SELECT ordinal AS seq, CASE ordinal % 5 WHEN 0 THEN upper(name) WHEN 1 THEN substr(name, 1, 1) || '. ' || split_part(name, ' ', 2) WHEN 2 THEN split_part(name, ' ', 1) || 'x ' || substr(split_part(name, ' ', 2), 1, 3) WHEN 3 THEN split_part(name, ' ', 2) ELSE 'zq' || id END AS value, CASE WHEN ordinal % 5 < 2 THEN 'paid to ' || account ELSE 'near Org house' END AS snippet, id AS source_id FROM p)",
    "pr AS (SELECT v.value, id, name, ordinal, account, lower(trim(v.value)) AS a, lower(trim(name)) AS b FROM (SELECT DISTINCT value FROM mm) v CROSS JOIN p)",
    *BEST_NAMES,
]
FUZZY_NAMES = sql(*NATION_PARTS, select="SELECT value, id, round(score, 4)::DOUBLE AS name_score, CASE WHEN a = b THEN 'exact' ELSE 'fuzzy' END AS method FROM be")
NAME_RESOLUTION = sql(
    *NATION_PARTS,
    """j AS (SELECT *, CASE WHEN contains(snippet, account) THEN 1.0 ELSE 0.0 END AS phone, CASE WHEN contains(lower(snippet), 'org') THEN 1.0 WHEN contains(lower(snippet), 'a') THEN 0.8 ELSE 0.5 END AS context
FROM (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY value ORDER BY seq) = 1) JOIN be USING (value))""",
    "cf AS (SELECT *, round(least(1.0, CASE WHEN NOT contains(trim(value), ' ') AND part > 85 THEN greatest(score, part) ELSE score END / 100 + 0.04 * phone + 0.02 * context), 3) AS conf FROM j)",
    "ju AS (SELECT *, CASE WHEN score >= 85 AND conf >= 0.65 THEN CASE WHEN a = b THEN 'exact' ELSE 'fuzzy' END WHEN score >= 70 THEN 'fuzzy_reject' END AS method FROM cf)",
    select="""SELECT CASE WHEN method = 'fuzzy_reject' THEN value ELSE id END AS master_id, value AS merged_ids, method, CASE WHEN method = 'fuzzy_reject' THEN 0.5 ELSE conf END::DOUBLE AS confidence, round(score, 1)::DOUBLE AS name_score,
  phone::DOUBLE AS phone_score, context::DOUBLE AS context_score, source_id, substr(sha256(snippet), 1, 16) AS evidence_hash FROM ju WHERE method IS NOT NULL""",
)

# ---- places, users, questions, streams


def trajectories_of(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a segment's customers in some days."""
    who = people(spark, d).where("cell = 'BUILDING'").select("id")
    return geo.trajectories(calls(spark, d), 2, 20, who).drop("path")


def user_list(spark: SparkSession, d: str) -> DataFrame:
    """Users by state, then name; one that waits was let in, one was turned away."""
    book = accounts.Accounts(b"key")
    for name in ("zoe", "ann", "bob", "cid"):
        book.register(name, "long enough")
    book.set_state("bob", "active")
    book.set_state("cid", "rejected")
    return spark.createDataFrame([(i, u["name"], u["state"], u["role"]) for i, u in enumerate(book.list())], "place int, name string, state string, role string")


QUESTIONS = ("Who connects cells A and B?", "Transfers above 2 lakh", "Path between A1 and B12", "Calls of C3", "Why is A12 here", "Spike on day 58", "structuring into C12", "hello")


def question_routing(spark: SparkSession, d: str) -> DataFrame:
    """Templates and parameters of questions."""
    asked = [(q, ask.parse(q)) for q in QUESTIONS]
    return spark.createDataFrame([(q, x.template, ",".join(x.params["ids"]), x.params.get("amount"), x.params.get("day")) for q, x in asked], "question string, template int, ids string, amount long, day int")


ROUTING = "SELECT * FROM (VALUES ('Who connects cells A and B?', 1, '', NULL, NULL), ('Transfers above 2 lakh', 5, '', 200000, NULL), ('Path between A1 and B12', 4, 'A1,B12', NULL, NULL), ('Calls of C3', 6, 'C3', NULL, NULL), ('Why is A12 here', 3, 'A12', NULL, NULL), ('Spike on day 58', 2, '', NULL, 58), ('structuring into C12', 7, 'C12', NULL, NULL), ('hello', 3, '', NULL, NULL)) t(question, template, ids, amount, day)"


def asked_transfers(spark: SparkSession, d: str) -> DataFrame:
    """A question about transfers above an amount, answered."""
    e = txns(spark, d).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), F.lit("TRANSACTED").alias("kind"), "day", "amount", F.lit(1.0).alias("confidence"))
    return ask.run(ask.parse("transactions above 90 k"), people(spark, d).select("id", "cell", "role"), e).select("src", "dst", "day", "amount")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """2.12: daily counts by type of a stream of all events, read to its end; the last day, which isn't closed, doesn't come."""
    from netfusion.streaming import alerts

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("cell"))
    events.write.parquet(f"{at}/in")
    counts = alerts.daily_counts(spark.readStream.schema(events.schema).parquet(f"{at}/in"))
    out = counts.select("cell", F.to_date("day_start").cast("string").alias("day"), "n")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("cell string, day string, n long").parquet(f"{at}/out")


#: A day is closed once the watermark, a day behind the last event, has passed its end.
STREAM_COUNTS = "SELECT event_type AS cell, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(any_value(ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


def offence_risks(spark: SparkSession, d: str) -> DataFrame:
    """F29 with F30: risk levels of suppliers' offences, and the staff that they take."""
    risks = table(spark, d, "supplier").select(risk_level(F.element_at(F.array(F.lit("302 murder"), F.lit("pistol found"), F.lit("theft"), F.lit(None)), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("risk_level"))
    return signals.staffing(risks)


def header_maps(spark: SparkSession, d: str) -> DataFrame:
    """Mappings of the headers of other systems."""
    from netfusion.sources.detect import suggest_mapping

    heads = {
        "cdrs": ("CDR No", "A Num", "B Party Name", "Destination MSISDN", "Date-Time", "Call Length", "LAC Cell", "Call Category"),
        "transactions": ("Trans ID", "Remitter", "Beneficiary Account", "From Acc", "Payee", "Txn Val", "Transfer Type", "Date"),
        "firs": ("Crime No", "Date of Incident", "Police Chowki", "Place of Occurrence", "BNS Sections", "Brief Facts", "Suspect", "Victim"),
        "social_posts": ("Message ID", "Screen Name", "Author ID", "Check-in", "Caption", "Mention Tags"),
        "criminal_history": ("Row ID", "PID", "Full Name", "AKA", "Date of Birth", "Previous Cases", "Syndicate", "Last Known Address"),
        "intelligence_reports": ("Intel ID", "Report Date", "Trust Level", "Narration", "Linked IDs"),
        "surveillance_reports": ("Surveillance ID", "Watch Team", "Spot", "Reliability Score", "Field Notes"),
        "people_directory": ("Code", "Individual Name", "Rank", "Gang Cell", "Contact Number", "A/C No"),
    }
    return spark.createDataFrame([(k, t, c) for k, cs in heads.items() for t, c in suggest_mapping(cs, k).items() if c], "dataset string, target string, source string")


_HEADER_MAPS = {
    "cdrs": {"call_id": "CDR No", "caller_phone": "A Num", "callee_name": "B Party Name", "callee_phone": "Destination MSISDN", "timestamp": "Date-Time", "duration_sec": "Call Length", "cell_tower_location": "LAC Cell", "call_type": "Call Category"},
    "transactions": {"txn_id": "Trans ID", "sender_account": "From Acc", "receiver_account": "Beneficiary Account", "sender_id": "Remitter", "receiver_id": "Payee", "amount_inr": "Txn Val", "txn_type": "Transfer Type", "timestamp": "Date"},
    "firs": {"fir_id": "Crime No", "date": "Date of Incident", "station": "Police Chowki", "location": "Place of Occurrence", "ipc_sections": "BNS Sections", "narrative": "Brief Facts", "accused_name": "Suspect", "complainant_name": "Victim"},
    "social_posts": {"post_id": "Message ID", "handle": "Screen Name", "person_id": "Author ID", "location_tag": "Check-in", "post_text": "Caption", "hashtags": "Mention Tags"},
    "criminal_history": {"record_id": "Row ID", "person_id": "PID", "name": "Full Name", "alias": "AKA", "dob": "Date of Birth", "prior_offences": "Previous Cases", "gang_affiliation": "Syndicate", "known_address": "Last Known Address"},
    "intelligence_reports": {"report_id": "Intel ID", "date": "Report Date", "source_reliability": "Trust Level", "narrative": "Narration", "mentioned_entity_ids": "Linked IDs"},
    "surveillance_reports": {"report_id": "Surveillance ID", "team": "Watch Team", "location": "Spot", "confidence": "Reliability Score", "activity_notes": "Field Notes"},
    "people_directory": {"id": "Code", "name": "Individual Name", "role": "Rank", "cell": "Gang Cell", "phone": "Contact Number", "account": "A/C No"},
}
HEADER_MAPS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', '{c}')" for k, m in _HEADER_MAPS.items() for t, c in m.items()) + ") t(dataset, target, source)"

_TELEPHONY = "SELECT least(a.id, b.id) AS p, greatest(a.id, b.id) AS q, count(*) AS calls, count(*) FILTER (WHERE a.id < b.id) AS calls_p, count(*) FILTER (WHERE a.id > b.id) AS calls_q, round(sum(duration) / 60.0, 1)::DOUBLE AS minutes, count(DISTINCT day) AS n_days FROM calls JOIN k a ON a.c = caller JOIN k b ON b.c = callee GROUP BY ALL"
_FINANCIALS = "SELECT least(a.id, b.id) AS p, greatest(a.id, b.id) AS q, count(*) AS txns, sum(amount)::BIGINT AS amount, sum(CASE WHEN a.id < b.id THEN amount ELSE 0 END)::BIGINT AS amount_p, sum(CASE WHEN a.id > b.id THEN amount ELSE 0 END)::BIGINT AS amount_q FROM txns JOIN k a ON a.c = sender JOIN k b ON b.c = receiver WHERE a.id <> b.id GROUP BY ALL"
_KEYS = "k AS (SELECT c_custkey AS c, c_custkey::VARCHAR AS id FROM customer)"

QUERIES = {
    "identity_calls": (identity_calls, sql(CALLS, _KEYS, select=_TELEPHONY)),
    "identity_transfers": (identity_transfers, sql(TXNS, _KEYS, select=_FINANCIALS)),
    "resolved_edges": (resolved_edges, sql(CALLS, TXNS, EDGES, PEOPLE, "m AS (SELECT id, role FROM people WHERE cell = 'BUILDING')", select="SELECT coalesce(a.role, src::VARCHAR) AS src, coalesce(b.role, dst::VARCHAR) AS dst, kind, count(*) AS n FROM edges LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst GROUP BY ALL")),
    "co_mentions": (co_mentions, "SELECT a.i AS p, b.i AS q, a.f AS source_type, count(*) AS n_docs FROM (SELECT DISTINCT l_partkey AS i, l_orderkey AS o, l_returnflag AS f FROM lineitem) a JOIN (SELECT DISTINCT l_partkey AS i, l_orderkey AS o, l_returnflag AS f FROM lineitem) b ON a.o = b.o AND a.f = b.f AND a.i < b.i GROUP BY ALL"),
    "explained_pairs": (explained_pairs, EXPLAINED),
    "graph_built": (
        graph_built,
        sql(CALLS, TXNS, PEOPLE, "k AS (SELECT id, cell FROM people WHERE role <> 'NATION_1')", select="SELECT 'Person' AS kind, count(*) AS n FROM k UNION ALL SELECT unnest(['Account', 'OWNS_ACCOUNT']), count(*) FROM k UNION ALL SELECT unnest(['Phone', 'OWNS_PHONE', 'OWNED_BY']), count(*) FROM k WHERE cell <> 'BUILDING' UNION ALL SELECT 'CALLED', count(*) FROM calls WHERE caller IN (SELECT id FROM k) AND callee IN (SELECT id FROM k) UNION ALL SELECT 'TRANSACTED', count(*) FROM txns WHERE sender IN (SELECT id FROM k) AND receiver IN (SELECT id FROM k)"),
    ),
    "structured_entities": (structured, STRUCTURED),
    "confidence_split": (confidence_split, f"SELECT CASE WHEN confidence >= 0.8 THEN 'structured' ELSE 'unstructured' END AS part, entity_type, count(*) AS n FROM ({STRUCTURED}) GROUP BY 1, 2"),
    "dataset_stats": (dataset_stats, sql(CALLS, TXNS, EDGES, select="SELECT kind AS name, count(*) AS n FROM edges GROUP BY kind UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'conversations', count(*) FROM conversations")),
    "record_hashes": (record_hashes, r"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'given' ELSE sha256('{"a": "' || s_name || ' \"\u00e9\"", "b": ' || s_suppkey || ', "evidence_hash": ""}') END AS leaf FROM supplier"""),
    "why_sources": (why_sources, WHY_SOURCES),
    "why_dossiers": (why_dossiers, WHY_DOSSIERS),
    "leads_by_priority": (leads_by_priority, LEADS_BY_PRIORITY),
    "custody_certificate": (custody_certificate, _certificate_sql()),
    "verified_hashes": (verified_hashes, "SELECT 'leaf' AS matched_in, role AS name FROM conversations WHERE sha256(coalesce(text, '')) = (SELECT max(sha256(coalesce(text, ''))) FROM conversations)"),
    "eval_checks": (eval_checks, EVAL_CHECKS),
    "fuzzy_names": (fuzzy_names, FUZZY_NAMES),
    "name_resolution": (name_resolution, NAME_RESOLUTION),
    "trajectories_of_people": (
        trajectories_of,
        sql(CALLS, PEOPLE, select="SELECT person, count(*)::INTEGER AS waypoints, arg_min(tower, (day, ts, call_id)) AS first_place, arg_max(tower, (day, ts, call_id)) AS last_place FROM (SELECT unnest([caller, callee]) AS person, * FROM calls WHERE day BETWEEN 2 AND 20) WHERE person IN (SELECT id FROM people WHERE cell = 'BUILDING') GROUP BY person"),
    ),
    "user_list": (user_list, "SELECT * FROM (VALUES (0, 'ann', 'pending', 'investigator'), (1, 'zoe', 'pending', 'investigator'), (2, 'bob', 'active', 'investigator'), (3, 'cid', 'rejected', 'investigator')) t(place, name, state, role)"),
    "question_routing": (question_routing, ROUTING),
    "asked_transfers": (asked_transfers, sql(TXNS, select="SELECT sender AS src, receiver AS dst, day, amount FROM txns WHERE amount > 90000")),
    "stream_counts": (stream_counts, STREAM_COUNTS),
    "offence_staffing": (offence_risks, "SELECT n AS targets, a AS armed, n AS cyber, a AS perimeter, 7 * a + 2 * n AS personnel FROM (SELECT count(*) AS n, sum(CASE WHEN s_suppkey % 4 = 1 THEN 2 ELSE 1 END)::BIGINT AS a FROM supplier)"),
    "header_maps": (header_maps, HEADER_MAPS),
}
