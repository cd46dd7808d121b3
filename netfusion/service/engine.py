"""A case's tables and every question the query layer answers about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.functions.text import risk_level
from netfusion.operators import bursts, extraction, finance, geo, graph, ingest, ledger, pairs, resolution, signals
from netfusion.service import ask
from netfusion.session import cut
from netfusion.sources.files import load_all
from netfusion.sources.upload import upload

CELLS = ("A", "B", "C")


@dataclass
class Case:
    """Typed datasets; what several answers share (graph, centrality, resolved mentions) is checkpointed once per case."""

    spark: SparkSession
    datasets: dict[str, DataFrame]
    quarantine: DataFrame | None = None
    last_day: int = 90
    cells: tuple[str, ...] = CELLS
    options: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Case:
        datasets, bad = load_all(spark, folder)
        return cls(spark, datasets, bad)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: Sequence[str], mappings: Mapping[str, Mapping[str, str | None]] | None = None) -> Case:
        """A case of files with any headers; see upload(). What each file was taken for is in options["files"]."""
        got = upload(spark, paths, mappings)
        return cls(spark, got.datasets, got.quarantine, options={"files": got.files})

    @cached_property
    def people(self) -> DataFrame:
        p = self.datasets["people_directory"]
        seen = ingest.bootstrap(p.select("id", "phone", "account"), self.datasets["cdrs"], self.datasets["transactions"])
        auto = seen.join(p.select("id"), "id", "left_anti").withColumns({"is_noise": F.lit(False), "ordinal": F.lit(50_000_000), "photo": F.lit(None).cast("string")})
        return cut(p.unionByName(auto.select(p.columns)))

    @cached_property
    def calls(self) -> DataFrame:
        c = self.datasets["cdrs"]
        stamp = F.col("timestamp")
        return c.select("call_id", F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee"), F.col("day").cast("int").alias("day"), stamp.alias("ts"), F.col("duration_sec").cast("long").alias("duration"), F.col("cell_tower_location").alias("tower"))

    @cached_property
    def txns(self) -> DataFrame:
        t = self.datasets["transactions"]
        return t.select("txn_id", F.col("sender_id").alias("sender"), F.col("receiver_id").alias("receiver"), F.col("amount_inr").cast("long").alias("amount"), F.col("day").cast("int").alias("day"), "txn_type")

    @cached_property
    def texts(self) -> DataFrame:
        d = self.datasets
        of = lambda df, key, text, kind: df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit(kind).alias("source_type"), F.col("day").cast("int").alias("day"))
        out = of(d["firs"], "fir_id", "narrative", "fir").unionByName(of(d["social_posts"], "post_id", "post_text", "social_post"))
        return out.unionByName(of(d["surveillance_reports"], "report_id", "activity_notes", "surveillance")).unionByName(of(d["intelligence_reports"], "report_id", "narrative", "intel"))

    @cached_property
    def resolved(self) -> tuple[DataFrame, DataFrame]:
        m = extraction.name_mentions(self.texts, extraction.known_names(self.people))
        m = m.select((F.xxhash64("source_type", "doc_id", "seq", "value")).alias("seq"), "value", F.lit(None).cast("string").alias("phone"), "evidence_snippet", F.col("doc_id").alias("source_id"), "source_type")
        # a file is read in order, so its rows' numbers are too
        history = resolution.history_context(self.datasets["criminal_history"].withColumn("_row", F.monotonically_increasing_id()), "_row")
        p = self.people.join(history, self.people.id == history.person_id, "left").select("id", "name", "cell", "phone", "account", "address", "org", "ordinal")
        mapping, log = resolution.resolve(m, p)
        return cut(mapping), log

    @cached_property
    def mentions(self) -> DataFrame:
        """entity, case_id, day, source_type of people found in texts."""
        known = self.resolved[0].where("mention <> canonical")
        found = extraction.containment(self.texts, known.select("mention")).join(known, "mention")
        t = self.texts.select("doc_id", "day", "source_type")
        return cut(found.join(t, "doc_id").select(F.col("canonical").alias("entity"), F.col("doc_id").alias("case_id"), "day", "source_type").distinct())

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = graph.build_graph(self.people, self.calls, self.txns)
        return cut(nodes), cut(edges)

    @cached_property
    def centrality(self) -> DataFrame:
        nodes, edges = self.graph
        b, d, r = graph.betweenness(edges), graph.degrees(edges), graph.pagerank(edges, rounds=100, tolerance=1e-6)
        out = nodes.join(b, "id", "left").join(d, "id", "left").join(r, "id", "left")
        four = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
        return cut(out.select("id", "kind", "cell", four("betweenness"), F.coalesce("degree", F.lit(0)).alias("degree"), four("degree_centrality"), F.round(F.coalesce("rank", F.lit(0.0)), 4).alias("pagerank")))

    def stats(self) -> DataFrame:
        """name, n: rows of the datasets, nodes and edges, edges of each kind, relations with supporting text."""
        rows = [(k, v.count()) for k, v in self.datasets.items()]
        counts = self.spark.createDataFrame([*rows, ("nodes", self.graph[0].count()), ("edges", self.graph[1].count())], "name string, n long")
        kinds = graph.kind_histogram(self.graph[1]).select(F.concat(F.lit("edges "), "kind").alias("name"), "n")
        said = extraction.provenance(self.relations).agg(F.coalesce(F.sum("with_text"), F.lit(0)).alias("n")).select(F.lit("relations with text").alias("name"), "n")
        return counts.unionByName(kinds).unionByName(said)

    @cached_property
    def relations(self) -> DataFrame:
        return cut(extraction.relations(self.texts, known=self.people.select("name")))

    def entities(self) -> tuple[DataFrame, DataFrame]:
        """Structured entities: those that stand and those to be resolved."""
        d = self.datasets
        return extraction.split_confidence(extraction.structured_entities(self.people, d["cdrs"], d["transactions"], d["criminal_history"], d["firs"]))

    def bursts(self) -> DataFrame:
        return self._bursts

    @cached_property
    def _bursts(self) -> DataFrame:
        counts = bursts.daily_counts(self.calls, self.txns, self.people)
        return cut(bursts.correlated(bursts.bursts(bursts.zscores(counts, 1, self.last_day, cells=self.cells))))

    def temporal(self) -> DataFrame:
        return bursts.temporal_groups(self.bursts())

    def structuring(self) -> DataFrame:
        return finance.structuring(self.txns)

    def bridges(self) -> DataFrame:
        return self._bridges

    @cached_property
    def _bridges(self) -> DataFrame:
        return cut(graph.bridges(self.centrality.select("id", "cell", "betweenness"), graph.cross_cell_degree(self.graph[1], self.graph[0])))

    def communities(self, filter_bridges: bool = True) -> DataFrame:
        """Louvain communities of people; the flagged bridges are taken out first, as they join what else falls apart."""
        ids = self.people.select("id")
        e = graph.surviving(self.graph[1].where(F.col("kind").isin("CALLED", "TRANSACTED")), ids)
        e = graph.without(e, self.bridges().where("flagged")) if filter_bridges else e
        return graph.community_profile(graph.louvain(e), self.people)

    def anomalies(self) -> DataFrame:
        fin = finance.financial_anomalies(self.structuring(), finance.large_transfers(self.txns))
        comm = signals.communication_anomalies(self.bursts(), self.people.where("NOT is_noise"))
        net = signals.network_anomalies(self.bridges(), self.centrality)
        return signals.unified(fin, comm, net)

    def cross_case(self) -> DataFrame:
        return self._cross_case

    @cached_property
    def _cross_case(self) -> DataFrame:
        d = self.datasets
        place = lambda df, key: df.where("location <> ''").select(F.concat(F.lit("LOC:"), "location").alias("entity"), F.col(key).alias("case_id"), F.col("day").cast("int").alias("day"))
        m = self.mentions.where(F.col("source_type").isin("fir", "surveillance")).select("entity", "case_id", "day")
        return cut(signals.cross_case(m.unionByName(place(d["firs"], "fir_id")).unionByName(place(d["surveillance_reports"], "report_id")), self.people))

    def leads(self, limit: int | None = None, priority: str | None = None) -> DataFrame:
        return self._leads if limit is None else signals.top_leads(self._leads, limit, priority)

    @cached_property
    def _leads(self) -> DataFrame:
        fin = finance.financial_anomalies(self.structuring(), finance.large_transfers(self.txns))
        comm = signals.communication_anomalies(self._bursts, self.people.where("NOT is_noise"))
        return cut(signals.lead_scores(self.people, self._bridges, self.centrality, fin, comm, self._bursts.where("correlated").select("cell"), graph.evidence_quality(self.graph[1]), self._cross_case))

    def snapshot(self, day: int) -> tuple[DataFrame, DataFrame]:
        edges = graph.snapshot(self.graph[1], day)
        return graph.incident_nodes(edges, self.graph[0], self.bridges().where("flagged").select("id")), edges

    def towers(self) -> DataFrame:
        t = geo.tower_stats(self.calls, self.people, self.cells)
        return t.select("*", geo.coordinates(F.col("tower")).alias("at"))

    def schematic(self) -> DataFrame:
        return geo.tower_schematic(self.calls, self.people, self.cells)

    def trajectories(self, first_day: int | None = None, last_day: int | None = None, person: str | None = None) -> DataFrame:
        who = None if person is None else self.spark.createDataFrame([(person,)], "id string")
        return geo.trajectories(self.calls, first_day, last_day, who)

    def hotspots(self) -> DataFrame:
        calls = self.calls.select(F.explode(F.array("caller", "callee")).alias("id"), F.col("tower").alias("place"), "day", F.lit(1).alias("weight"), F.col("call_id").alias("event"))
        seen = self.datasets["surveillance_reports"].select(F.col("report_id").alias("case_id"), F.col("location").alias("place"))
        sightings = self.mentions.join(seen, "case_id").select(F.col("entity").alias("id"), "place", "day", F.lit(2).alias("weight"), F.col("case_id").alias("event"))
        return geo.hotspots(calls.unionByName(sightings), self.people)

    def explain(self, p: str, q: str) -> DataFrame:
        """What ties two people, each told by id, name or phone (account): only what touches both is looked at."""
        both = self.people.where(F.col("id").isin(p, q))
        calls = pairs.by_identity(self.datasets["cdrs"], both).select("call_id", "caller", "callee", F.col("day").cast("int").alias("day"), F.col("duration_sec").cast("long").alias("duration"), F.col("cell_tower_location").alias("tower"))
        t = pairs.by_identity(self.datasets["transactions"], both, ("sender", "receiver"), "account").select("txn_id", "sender", "receiver", F.col("amount_inr").cast("long").alias("amount"))
        m = self.mentions.where(F.col("entity").isin(p, q)).select(F.col("entity").alias("id"), F.col("case_id").alias("doc_id"), "source_type")
        e = self.graph[1].where(F.col("src").isin(p, q) | F.col("dst").isin(p, q))
        a, b = sorted((p, q))
        return pairs.explain(calls, t, m, e, both).where((F.col("p") == a) & (F.col("q") == b))

    def recommendations(self) -> DataFrame:
        firs = self.datasets["firs"].select(F.col("fir_id").alias("case_id"))
        return signals.recommendations(self.cross_case(), self.structuring(), self.leads(), pairs.call_counts(self.calls), firs)

    def what_if(self, node: str) -> DataFrame:
        return graph.what_if(self.graph[1], self.graph[0], node)

    def risks(self) -> DataFrame:
        """id, risk_level of people with priors."""
        h = self.datasets["criminal_history"]
        return h.groupBy(F.col("person_id").alias("id")).agg(F.concat_ws(" ", F.collect_list("prior_offences")).alias("x")).select("id", risk_level(F.col("x")).alias("risk_level"))

    def takedown(self, targets: list[str]) -> DataFrame:
        ids = self.spark.createDataFrame([(t,) for t in targets], "id string")
        return signals.simulate(self.graph[1], self.graph[0], self.people, self.txns, ids, self.risks())

    @cached_property
    def packages(self) -> DataFrame:
        """Targets of the four removals."""
        c = self.centrality.where("kind = 'Person'")
        return cut(signals.packages(self.people, c.select("id", F.col("pagerank").alias("rank")), c.select("id", "betweenness"), finance.account_volume(self.txns)))

    def strategies(self) -> DataFrame:
        return signals.simulated_packages(self.graph[1], self.graph[0], self.people, self.txns, self.packages, self.risks())

    def operation_order(self, targets: str | list[str], codename: str = "OPERATION THUNDERCLAP") -> DataFrame:
        """The order for a package, by its name, or for given targets."""
        ids = [r.id for r in self.packages.where(F.col("strategy") == targets).collect()] if isinstance(targets, str) else targets  # at most six
        return signals.operation_order(self.takedown(ids), codename)

    def why(self, node: str) -> DataFrame:
        """A node's facts in one row: centrality, bridge rank, anomalies, lead score, evidence quality, cases, and the signals they add up to."""
        only = lambda df, c="id": df.where(F.col(c) == node)
        a = only(self.anomalies(), "entity_id").agg(F.max("score").alias("anomaly_score"), F.array_sort(F.collect_set("anomaly_type")).alias("anomalies"))
        kinds = only(graph.edge_kind_counts(self.graph[1])).groupBy("id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(name) for k, name in (("CALLED", "called"), ("TRANSACTED", "transacted"))))
        facts = only(self.centrality).join(only(self.bridges()).select("id", "rank", "bridge_score", "flagged"), "id", "left").join(only(self.leads()).select("id", "lead_score", "priority"), "id", "left")
        facts = facts.join(only(graph.evidence_quality(self.graph[1])), "id", "left").join(kinds, "id", "left").join(only(self.cross_case(), "entity").select(F.col("entity").alias("id"), "n_cases"), "id", "left")
        return signals.top_signals(facts.join(a))

    def sources(self, node: str) -> DataFrame:
        """The records and texts that a node is known from."""
        name = self.people.where(F.col("id") == node).select("name").first()
        return signals.sources(self.graph[1], self.texts, node, name[0] if name else "")

    def certificate(self, case_name: str, issued: str, officer: str = "Investigating Officer", station: str = "") -> DataFrame:
        leaves, blocks = self.ledger(officer)
        return ledger.certificate(blocks, leaves, case_name, issued, officer, station)

    def ask(self, text: str) -> DataFrame:
        t = self.txns.select(F.col("txn_id").alias("source"), "amount")
        return ask.run(ask.parse(text), self.people.select("id", "cell", "role"), self.graph[1].join(t, "source", "left"))

    def ledger(self, officer: str = "Investigating Officer") -> tuple[DataFrame, DataFrame]:
        """Leaves (block, seq, leaf) and chained blocks, a dataset being a block."""
        leaves = None
        for name in sorted(self.datasets):
            rows = ledger.record_hashes(self.datasets[name]).select(F.lit(name).alias("block"), "leaf")
            leaves = rows if leaves is None else leaves.unionByName(rows)
        leaves = cut(ledger.numbered_leaves(leaves, "leaf"))
        roots = {r.block: r.root for r in ledger.merkle_roots(leaves).collect()}  # a row for each dataset
        blocks = ledger.chain([(n, roots.get(n, ledger.EMPTY_ROOT)) for n in sorted(self.datasets)], officer)
        return leaves, self.spark.createDataFrame(blocks)

    def search(self, text: str, most: int = 15) -> DataFrame:
        low = F.lit(text.lower())
        hit = F.lit(False)
        for c in ("id", "name", "phone", "account"):
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), low)
        return self.people.where(hit).orderBy("id").limit(most)
