"""Anomalies, cross-case links, lead scores and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netfusion.operators import finance, graph
from netfusion.session import cut

#: Weights of a lead's signals.
LEAD_WEIGHTS = {"bridge_score": 0.25, "financial_anomaly": 0.20, "communication_anomaly": 0.15, "temporal_correlation": 0.10, "evidence_quality": 0.15, "centrality": 0.10, "cross_case": 0.05}


def severity(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def communication_anomalies(bursts: DataFrame, people: DataFrame, members: int = 4) -> DataFrame:
    """entity_id, anomaly_type, score, day: each burst for the first ``members`` people of its cell (by ordinal), score min(1, z / 5)."""
    order = Window.partitionBy("cell").orderBy("ordinal", "id")
    first = people.select("cell", "ordinal", "id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= members).select("cell", F.col("id").alias("entity_id"))
    return bursts.join(first, "cell").select("entity_id", F.lit("communication_burst").alias("anomaly_type"), F.round(F.least(F.lit(1.0), F.col("zscore") / 5), 3).alias("score"), "day")


def network_anomalies(bridges: DataFrame, degrees: DataFrame, hubs: int = 5, hub_degree: int = 40) -> DataFrame:
    """entity_id, anomaly_type, score, day: flagged bridges, and of the ``hubs`` highest in betweenness those over ``hub_degree``."""
    none = F.lit(None).cast("int").alias("day")
    flagged = bridges.where("flagged").select(F.col("id").alias("entity_id"), F.lit("network_bridge").alias("anomaly_type"), F.round("bridge_score", 3).alias("score"), none)
    top = bridges.select("id", "betweenness").orderBy(F.desc("betweenness"), "id").limit(hubs).join(degrees.select("id", "degree"), "id").where(F.col("degree") > hub_degree)
    return flagged.unionByName(top.select(F.col("id").alias("entity_id"), F.lit("network_hub").alias("anomaly_type"), F.round(F.least(F.lit(1.0), F.col("betweenness") * 8), 3).alias("score"), none))


def unified(*anomalies: DataFrame) -> DataFrame:
    """The highest-scored anomaly of each entity and type (earliest day on ties), with severity; aggregated, not ranked."""
    every = anomalies[0]
    for more in anomalies[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    best = every.groupBy("entity_id", "anomaly_type").agg(F.min_by(F.struct("score", "day"), F.struct(-F.col("score"), F.coalesce("day", F.lit(2**31 - 1)))).alias("b"))
    return best.select("entity_id", "anomaly_type", "b.score", "b.day", severity(F.col("b.score")).alias("severity"))


def max_scores(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("entity_id").agg(F.max("score").alias("score"))


def entity_cases(mentions: DataFrame, least: int = 2) -> DataFrame:
    """entity, cases (sorted), n_cases, span of days, of entities found in ``least`` cases or more. mentions: entity, case_id, day."""
    per = mentions.groupBy("entity").agg(F.array_sort(F.collect_set("case_id")).alias("cases"), F.max("day").alias("last"), F.min("day").alias("first"))
    return per.where(F.size("cases") >= least).select("entity", "cases", F.size("cases").alias("n_cases"), (F.col("last") - F.col("first")).alias("span"))


def cross_case(mentions: DataFrame, people: DataFrame, least: int = 2, limit: int | None = 20, noise_least: int = 3) -> DataFrame:
    """Entities shared by cases: entity, entity_type, cases, n_cases, n_cells, confidence, evidence_hash, best first.

    mentions: entity (a person's id, or LOC: and a place), case_id, day. A location's confidence is 0.5 + 0.15 n; a person's 0.6 + 0.05 n,
    0.1 more if the cases involve people of two cells or more, 0.05 more if they span over 20 days; 0.95 at most.
    """
    m = mentions.select("entity", "case_id", "day").distinct()
    shared = entity_cases(m, least)
    cell = people.select(F.col("id").alias("entity"), "cell")
    # a pair of case and cell for each involved cell, before cases meet entities again: never a pair of people
    case_cells = m.join(cell, "entity").select("case_id", "cell").distinct()
    involved = m.join(shared.select("entity"), "entity", "left_semi").join(case_cells, "case_id").groupBy("entity").agg(F.count_distinct("cell").alias("n_cells"))
    place = F.col("entity").startswith("LOC:")
    conf = F.when(place, 0.5 + 0.15 * F.col("n_cases")).otherwise(0.6 + 0.05 * F.col("n_cases") + F.when(F.col("n_cells") >= 2, 0.1).otherwise(0.0) + F.when(F.col("span") > 20, 0.05).otherwise(0.0))
    out = shared.join(involved, "entity", "left").join(cell, "entity", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    out = out.where(~((F.coalesce("cell", F.lit("")) == "Noise") & (F.col("n_cases") < noise_least)))
    digest = F.substring(F.sha2(F.concat("entity", F.array_join("cases", "")), 256), 1, 16)
    out = out.select("entity", F.when(place, "Location").otherwise("Person").alias("entity_type"), "cases", "n_cases", "n_cells", F.round(F.least(F.lit(0.95), conf), 3).alias("confidence"), digest.alias("evidence_hash"))
    out = out.orderBy(F.desc("confidence"), F.desc("n_cases"), "entity")
    return out if limit is None else out.limit(limit)


def lead_scores(people: DataFrame, bridges: DataFrame, centrality: DataFrame, financial: DataFrame, communication: DataFrame, correlated_cells: DataFrame, evidence: DataFrame, cross: DataFrame) -> DataFrame:
    """Every person's signals (3 digits each, then weighed), lead_score (0 to 100) and priority, best first.

    bridges: id, bridge_score; centrality: id, betweenness, degree; financial and communication: entity_id, score; correlated_cells:
    cell; evidence: id, quality (0.5 where none); cross: entity, confidence.
    """
    tops = centrality.agg(F.max("betweenness").alias("max_b"), F.max("degree").alias("max_d"))
    share = lambda c, top: F.when(F.col(top) > 0, F.col(c) / F.col(top)).otherwise(0.0).cast("decimal(9,3)")
    central = centrality.join(F.broadcast(tops)).select("id", share("betweenness", "max_b").alias("betweenness_share"), share("degree", "max_d").alias("degree_share"))
    best = lambda df, name: max_scores(df).select(F.col("entity_id").alias("id"), F.col("score").alias(name))
    t = people.select("id", "cell").join(bridges.select("id", "bridge_score"), "id", "left").join(central, "id", "left").join(best(financial, "fin"), "id", "left").join(best(communication, "comm"), "id", "left")
    t = t.join(correlated_cells.select("cell", F.lit(1.0).alias("temporal")).distinct(), "cell", "left").join(evidence.select("id", "quality"), "id", "left")
    t = t.join(cross.groupBy(F.col("entity").alias("id")).agg(F.max("confidence").alias("cross_conf")), "id", "left")
    three = lambda c, default=0.0: F.round(F.coalesce(c, F.lit(default)), 3)
    zero = F.lit(0).cast("decimal(9,3)")
    half = F.round((F.coalesce("betweenness_share", zero) + F.coalesce("degree_share", zero)) / 2, 3).cast("double")  # exact, so halves go up
    s = t.select(
        "id", "cell", three("bridge_score").alias("bridge_score"), half.alias("centrality"),
        three("fin").alias("financial_anomaly"), three("comm").alias("communication_anomaly"), three("temporal").alias("temporal_correlation"), three("quality", 0.5).alias("evidence_quality"), three("cross_conf").alias("cross_case"),
    )
    total = sum((F.lit(w) * F.col(k) for k, w in LEAD_WEIGHTS.items()), F.lit(0.0)) * 100
    s = s.withColumn("lead_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(total, 6), 0).cast("int"))))
    reasons = F.array_compact(F.array(*(F.when(F.col(k) >= 0.5, F.lit(k)) for k in LEAD_WEIGHTS if k != "evidence_quality")))
    return s.select("*", F.when(F.col("lead_score") >= 75, "HIGH").when(F.col("lead_score") >= 50, "MEDIUM").otherwise("LOW").alias("priority"), reasons.alias("reasons")).orderBy(F.desc("lead_score"), "id")


def top_leads(leads: DataFrame, limit: int = 10, priority: str | None = None) -> DataFrame:
    """The first leads; a priority filters what the limit has left, as the query layer defines it."""
    first = leads.orderBy(F.desc("lead_score"), "id").limit(limit)
    return first if priority is None else first.where(F.col("priority") == priority)


def recommendations(cross: DataFrame, fans: DataFrame, leads: DataFrame, pair_calls: DataFrame, firs: DataFrame | None = None, top: int = 10, limit: int = 12, first_firs: int = 8) -> DataFrame:
    """What to look at next: type, target_id, priority, priority_score, reason, from shared entities, structuring receivers, the most
    frequent contacts of the ``top`` leads who aren't leads, and the first reports. pair_calls: p, q, calls."""
    rec = lambda df, kind, target, level, score, reason: df.select(F.lit(kind).alias("type"), target.cast("string").alias("target_id"), level.alias("priority"), F.round(score, 3).alias("priority_score"), reason.alias("reason"))
    ids = leads.orderBy(F.desc("lead_score"), "id").limit(top).select("id")
    is_lead = cross.join(ids, cross.entity == ids.id, "left").withColumn("lead", F.col("id").isNotNull())
    linked = rec(is_lead, "CROSS_CASE_LINK", F.col("entity"), F.when(F.col("lead"), "CRITICAL").otherwise("HIGH"), F.when(F.col("lead"), 0.94).otherwise(F.col("confidence")), F.format_string("shared by %d cases", "n_cases"))
    mules = rec(fans, "FINANCIAL_MULE", F.col("receiver"), F.lit("CRITICAL"), F.lit(0.92), F.format_string("%d small cash receipts, %d passed on", "cash_small_count", "total"))
    ends = pair_calls.select(F.explode(F.array(F.struct(F.col("p").alias("lead"), F.col("q").alias("other")), F.struct(F.col("q").alias("lead"), F.col("p").alias("other")))).alias("e"), "calls").select("e.lead", "e.other", "calls")
    near = ends.join(ids, ends.lead == ids.id, "left_semi").join(ids, F.col("other") == ids.id, "left_anti").groupBy("other").agg(F.sum("calls").alias("n"))
    contacts = rec(near.orderBy(F.desc("n"), "other").limit(top), "NETWORK_NEIGHBOUR", F.col("other"), F.lit("MEDIUM"), F.least(F.lit(0.85), 0.5 + F.col("n") * 0.02), F.format_string("%d calls with leads", "n"))
    out = linked.unionByName(mules).unionByName(contacts)
    if firs is not None:
        out = out.unionByName(rec(firs.orderBy("case_id").limit(first_firs), "CASE_REVIEW", F.col("case_id"), F.lit("MEDIUM"), F.lit(0.6), F.lit("open report")))
    return out.orderBy(F.desc("priority_score"), "type", "target_id").limit(limit)


#: Roles that can take over, the window of an operation, and what is said of a succession without and with leaders left.
LEADERS = ("Kingpin", "Leader", "Lieutenant", "Coordinator")
STRIKE_WINDOW = "03:30 hrs - 05:00 hrs IST (Simultaneous Pre-Dawn Sweep)"
SUCCESSION = ("LOW — Command structure shattered", "MODERATE — Deputy leaders remain (")


def packages(people: DataFrame, pagerank: DataFrame, betweenness: DataFrame, volume: DataFrame, cells: Sequence[str] | None = ("A", "B", "C", "Bridge")) -> DataFrame:
    """strategy, rank, id: the targets of four removals. decap: the 3 people of ``cells`` (None: of any) highest in PageRank; bridge: the 3
    others highest in betweenness; mule: the 4 people whose accounts moved most; sync: the first two of each, each once. Ties go by id.

    people: id, cell; pagerank: id, rank; betweenness: id, betweenness; volume: id, volume.
    """
    def first(df: DataFrame, by: str, n: int) -> DataFrame:  # at most n rows
        top = df.orderBy(F.desc(by), "id").limit(n)
        return cut(top.select("id", F.row_number().over(Window.orderBy(F.desc(by), "id")).alias("rank")))

    own = people.select("id", "cell")
    score = lambda df, c: own.join(df.select("id", c), "id", "left").withColumn(c, F.coalesce(c, F.lit(0.0)))
    central = score(pagerank.select("id", F.col("rank").alias("pagerank")), "pagerank")
    decap = first(central if cells is None else central.where(F.col("cell").isin(*cells)), "pagerank", 3)
    bridge = first(score(betweenness, "betweenness").join(decap, "id", "left_anti"), "betweenness", 3)
    mule = first(own.join(volume.select("id", "volume"), "id"), "volume", 4)
    parts = {"decap": decap, "bridge": bridge, "mule": mule}
    turn = None
    for k, df in enumerate(parts.values()):
        two = df.where("rank <= 2").select("id", (F.col("rank") + 2 * k).alias("turn"))
        turn = two if turn is None else turn.union(two)
    turn = turn.groupBy("id").agg(F.min("turn").alias("turn"))
    out = turn.select(F.lit("sync").alias("strategy"), F.row_number().over(Window.orderBy("turn")).alias("rank"), "id")  # at most six rows
    for name, df in parts.items():
        out = out.unionByName(df.select(F.lit(name).alias("strategy"), "rank", "id"))
    return out


def simulate(edges: DataFrame, nodes: DataFrame, people: DataFrame, txns: DataFrame, targets: DataFrame, risk: DataFrame | None = None, before: float | None = None) -> DataFrame:
    """One row on the removal of targets (id): n_targets, what graph.takedown() returns, n_frozen and seized of their transfers, succession_risk
    (the first two leaders left), and what staff it takes. people: id, role; risk: id, risk_level (none is STANDARD)."""
    ids = targets.select("id").distinct()
    left = people.join(ids, "id", "left_anti").where(F.col("role").isin(*LEADERS)).select("id").orderBy("id").limit(2)
    names = left.agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ", ").alias("left"))
    verdict = F.when(F.col("left") == "", SUCCESSION[0]).otherwise(F.concat(F.lit(SUCCESSION[1]), "left", F.lit(")")))
    profile = ids.select("id", F.lit("STANDARD").alias("risk_level")) if risk is None else ids.join(risk, "id", "left").select("id", F.coalesce("risk_level", F.lit("STANDARD")).alias("risk_level"))
    return graph.takedown(edges, nodes, ids, before).join(finance.frozen_transactions(txns, ids)).join(names.select(verdict.alias("succession_risk"))).join(staffing(profile).withColumnRenamed("targets", "n_targets"))


def simulated_packages(edges: DataFrame, nodes: DataFrame, people: DataFrame, txns: DataFrame, chosen: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """strategy and simulate() of each of the packages, the most disruptive first."""
    before, out = graph.efficiency(edges, nodes), None
    for name in ("sync", "bridge", "decap", "mule"):
        row = simulate(edges, nodes, people, txns, chosen.where(F.col("strategy") == name), risk, before).select(F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("disruption_pct"), "strategy")


def operation_order(simulated: DataFrame, codename: str = "OPERATION THUNDERCLAP", commander: str = "Authorized Joint Commissioner") -> DataFrame:
    """A row for each simulated removal: order_id, codename, commander, objective, execution_window, recovery, succession_risk, staff."""
    name = codename.upper()
    objective = F.format_string("Arrests and seizures at %d primary targets for an estimated %.1f%% structural collapse of the network", "n_targets", "disruption_pct")
    return simulated.select(
        F.lit(f"OPORD-NCRB-{name.replace(' ', '_')}-2026").alias("order_id"), F.lit(name).alias("codename"), F.lit(commander).alias("commander"), objective.alias("objective"), F.lit(STRIKE_WINDOW).alias("execution_window"),
        F.format_string("Rs. %,d", F.col("seized").cast("long")).alias("recovery"), "succession_risk", "armed", "cyber", "perimeter", "personnel",
    )


def sources(edges: DataFrame, texts: DataFrame, node: object, label: str, first: int = 12, most: int = 8) -> DataFrame:
    """Where a node is known from: source, source_type, kind, day, confidence, supporting_text, evidence_hash, extractor of its first edges (by
    day, kind, ends and source), then of texts that have its label or id; ``most`` in all. edges may have supporting_text; texts: doc_id, source_type, day, text."""
    has = lambda c: F.col(c) if c in edges.columns else F.lit(None).cast("string")
    own = edges.where((F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node)))
    near = own.orderBy(F.col("day").asc_nulls_first(), "kind", "src", "dst", "source").limit(first)
    supporting = F.substring(F.coalesce(has("supporting_text"), F.lit("")), 1, 200)
    a = near.select(
        F.struct(F.lit(0).alias("part"), "day", "kind", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("source").cast("string").alias("s")).alias("_at"), F.col("source").cast("string").alias("source"), has("source_type").alias("source_type"), "kind", F.col("day").cast("int").alias("day"),
        F.col("confidence").cast("double").alias("confidence"), supporting.alias("supporting_text"), F.coalesce(has("evidence_hash"), F.lit("")).alias("evidence_hash"), F.coalesce(has("extractor"), F.lit("")).alias("extractor"),
    )
    said = F.replace(F.substring("text", 1, 120), F.lit("\n"), F.lit(" "))
    hit = (F.contains("text", F.lit(label)) & F.lit(bool(label))) | F.contains("text", F.lit(str(node)))
    docs = texts.where(hit).orderBy("doc_id").limit(most)
    b = docs.select(
        F.struct(F.lit(1).alias("part"), F.lit(None).cast(edges.schema["day"].dataType).alias("day"), F.lit("").alias("kind"), F.lit("").alias("src"), F.lit("").alias("dst"), F.col("doc_id").cast("string").alias("s")).alias("_at"), F.col("doc_id").cast("string").alias("source"), F.lit("text_mention").alias("source_type"), F.lit("TEXT").alias("kind"),
        F.col("day").cast("int").alias("day"), F.lit(0.6).alias("confidence"), said.alias("supporting_text"), F.substring(F.sha2(said, 256), 1, 16).alias("evidence_hash"), F.lit("text_mention").alias("extractor"),
    )
    return a.unionByName(b).orderBy("_at").limit(most).drop("_at")


def top_signals(facts: DataFrame, most: int = 6) -> DataFrame:
    """facts with top_signals, the sentences that apply. facts: lead_score, priority, flagged, rank, bridge_score, betweenness, called, transacted,
    degree, anomalies (array), n_cases; nulls where a signal is missing."""
    c = F.col
    every = F.array_compact(
        F.array(
            F.when(c("lead_score").isNotNull(), F.format_string("Lead score %d/100, priority %s", "lead_score", "priority")),
            F.when(c("flagged"), F.format_string("Flagged as bridge: score %s, rank %d", c("bridge_score").cast("string"), "rank")),
            F.when(c("betweenness") > 0.05, F.concat(F.lit("High betweenness "), c("betweenness").cast("string"))),
            F.when(c("called") >= 5, F.format_string("%d calls", "called")),
            F.when(c("transacted") >= 3, F.format_string("%d transfers", "transacted")),
            F.when(c("degree") >= 8, F.format_string("High degree %d", "degree")),
            F.when(F.size("anomalies") > 0, F.concat(F.lit("Anomalies: "), F.array_join(F.slice("anomalies", 1, 2), ", "))),
            F.when(c("n_cases") >= 2, F.format_string("Shared by %d cases", "n_cases")),
        )
    )
    return facts.withColumn("top_signals", F.when(F.size(every) > 0, F.slice(every, 1, most)).otherwise(F.array(F.lit("No strong flag"))))


def staffing(profiles: DataFrame) -> DataFrame:
    """targets, armed, cyber, perimeter, personnel from risk levels: an armed target takes two armed and two perimeter units, others one each."""
    two = F.when(F.col("risk_level").startswith("CRITICAL"), 2).otherwise(1)
    t = profiles.agg(F.count("*").alias("targets"), F.greatest(F.lit(1), F.sum(two)).cast("long").alias("armed"), F.greatest(F.lit(1), F.count("*")).cast("long").alias("cyber"), F.greatest(F.lit(1), F.sum(two)).cast("long").alias("perimeter"))
    return t.select("*", (4 * F.col("armed") + 2 * F.col("cyber") + 3 * F.col("perimeter")).alias("personnel"))
