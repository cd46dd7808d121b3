"""Queries on bursts, finance, places, pairs and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.operators import bursts, finance, geo, graph, pairs
from netfusion.plans.views import CALLS, EDGES, PEOPLE, TXNS, calls, edges, people, sql, table, txns

CELLS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return bursts.daily_counts(calls(spark, d), txns(spark, d), people(spark, d))


ACTS = "acts AS (SELECT caller AS id, day FROM calls UNION ALL SELECT sender, day FROM txns), counts AS (SELECT coalesce(cell, 'Noise') AS cell, day, count(*) AS n FROM acts LEFT JOIN people USING (id) WHERE day IS NOT NULL GROUP BY 1, 2)"


def call_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of calls by tower over the month, the towers standing for cells."""
    counts = calls(spark, d).groupBy(F.col("tower").alias("cell"), "day").agg(F.count("*").alias("n"))
    return bursts.bursts(bursts.zscores(counts, 1, 30))


Z = """z AS (
  SELECT cell, day, n, s, q, CASE WHEN 6 * q - s * s = 0 THEN CASE WHEN s > 0 AND n * 6 > 2 * s THEN 3.0 ELSE 0.0 END ELSE (n * 6 - s) / sqrt((6 * q - s * s)::DOUBLE) END AS z
  FROM (SELECT cell, day, n, sum(n) OVER w AS s, sum(n * n) OVER w AS q FROM (
    SELECT c.cell, t.day, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT tower AS cell FROM calls) c CROSS JOIN (SELECT unnest(range(-5, 31)) AS day) t
    LEFT JOIN (SELECT tower AS cell, day, count(*) AS n FROM calls WHERE day >= 1 GROUP BY ALL) k ON k.cell = c.cell AND k.day = t.day
  ) WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE day >= 1
), b AS (SELECT cell, CAST(day AS INTEGER) AS day, n::BIGINT AS n, round(z, 2) AS zscore, round(s / 6, 2) AS mean, CAST(day - 6 AS INTEGER) AS window_start, CAST(day - 1 AS INTEGER) AS window_end FROM z WHERE z > 2.0)"""


def burst_correlated(spark: SparkSession, d: str) -> DataFrame:
    c = bursts.correlated(call_bursts(spark, d))
    return c.select("cell", "day", "zscore", "correlated", F.array_join("correlated_cells", ",").alias("cells"), F.array_join("correlated_days", ",").alias("days"))


BURST_CORRELATED = sql(
    CALLS, Z,
    select="""SELECT b.cell, b.day, b.zscore, g.day IS NOT NULL AS correlated, coalesce(g.cells, b.cell) AS cells, coalesce(g.days, b.day::VARCHAR) AS days
FROM b LEFT JOIN (
  SELECT d AS day, arg_min(cells, anchor) AS cells, arg_min(days, anchor) AS days FROM (
    SELECT a.day AS anchor, array_to_string(list_sort(list(DISTINCT x.cell)), ',') AS cells, array_to_string(list_sort(list(DISTINCT x.day)), ',') AS days, unnest(list(DISTINCT x.day)) AS d
    FROM (SELECT DISTINCT day FROM b) a JOIN b x ON abs(x.day - a.day) <= 7 GROUP BY a.day HAVING count(DISTINCT x.cell) >= 2
  ) GROUP BY d
) g ON g.day = b.day""",
)


def temporal_groups(spark: SparkSession, d: str) -> DataFrame:
    g = bursts.temporal_groups(call_bursts(spark, d))
    return g.select("first_day", "last_day", F.array_join("days", ",").alias("days"), F.array_join("cells", ",").alias("cells"), "burst_count", "max_zscore", "evidence_hash")


TEMPORAL = sql(
    CALLS, Z, "l AS (SELECT list({'day': day, 'cell': cell, 'z': zscore} ORDER BY day, cell) AS every FROM b)",
    select="""SELECT g.lo AS first_day, g.hi AS last_day, array_to_string(days, ',') AS days, array_to_string(cells, ',') AS cells, len(g.took)::INTEGER AS burst_count, list_max(list_transform(g.took, lambda x: x.z)) AS max_zscore, 'temporal-' || g.lo || '-' || g.hi AS evidence_hash FROM (
  WITH RECURSIVE walk(i, used, g) AS (
    SELECT 0, []::INTEGER[], NULL::STRUCT(lo INTEGER, hi INTEGER, took STRUCT(day INTEGER, cell VARCHAR, z DOUBLE)[]) FROM l
    UNION ALL
    SELECT i + 1, CASE WHEN ok THEN list_concat(used, list_distinct(list_transform(new.took, lambda x: x.day))) ELSE used END, CASE WHEN ok THEN new END FROM (
      SELECT i, used, new, NOT list_contains(used, anchor.day) AND len(list_distinct(list_transform(new.took, lambda x: x.cell))) >= 2 AS ok FROM (
        SELECT i, used, anchor, list_reduce(list_prepend({'lo': anchor.day, 'hi': anchor.day, 'took': [anchor]}, list_transform(every, lambda x: {'lo': x.day, 'hi': x.day, 'took': [x]})), lambda s, x:
          CASE WHEN x.lo <> anchor.day AND abs(x.lo - anchor.day) <= 7 AND greatest(s.hi, x.lo) - least(s.lo, x.lo) <= 7
               THEN {'lo': least(s.lo, x.lo), 'hi': greatest(s.hi, x.lo), 'took': list_concat(s.took, x.took)} ELSE s END) AS new
        FROM (SELECT i, used, every, every[i + 1] AS anchor FROM walk, l WHERE i < len(every))
      )
    )
  ) SELECT g, list_sort(list_distinct(list_transform(g.took, lambda x: x.day))) AS days, list_sort(list_distinct(list_transform(g.took, lambda x: x.cell))) AS cells FROM walk WHERE g IS NOT NULL
)""",
)


def burst_groups(spark: SparkSession, d: str) -> DataFrame:
    g = bursts.correlated_groups(call_bursts(spark, d))
    scores = F.array_join(F.array_sort(F.transform(F.map_entries("zscores"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("decimal(9,2)").cast("string")))), ";")
    return g.select("first_day", "last_day", F.array_join("cells", ",").alias("cells"), F.array_join("days", ",").alias("days"), scores.alias("zscores"))


BURST_GROUPS = sql(
    CALLS, Z,
    select="""SELECT list_min(ds)::INTEGER AS first_day, list_max(ds)::INTEGER AS last_day, cells, array_to_string(ds, ',') AS days, zscores FROM (
  SELECT DISTINCT list_sort(list(DISTINCT x.day)) AS ds, array_to_string(list_sort(list(DISTINCT x.cell)), ',') AS cells, string_agg(DISTINCT x.cell || ':' || x.day || '=' || x.zscore::DECIMAL(9, 2), ';' ORDER BY x.cell || ':' || x.day || '=' || x.zscore::DECIMAL(9, 2)) AS zscores
  FROM (SELECT DISTINCT day FROM b) a JOIN b x ON abs(x.day - a.day) <= 7 GROUP BY a.day HAVING count(DISTINCT x.cell) >= 2)""",
)


def nearest(spark: SparkSession, d: str) -> DataFrame:
    return bursts.nearest_bursts(call_bursts(spark, d), (5, 12, 20, 29))


def structuring(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds fitted to the tables' amounts: returns under 50000, three in 13 days, one payment of 60000 or more."""
    fans = finance.structuring(txns(spark, d), cash="R", least=3, lump=60_000, least_lumps=1)
    return fans.select("receiver", "cash_small_count", "window_start", "window_end", F.size("consolidations").alias("n_consolidations"), "total", "confidence")


STRUCTURING = sql(
    TXNS,
    select="""SELECT receiver, any_value(cash_small_count)::BIGINT AS cash_small_count, CAST(any_value(w0) AS INTEGER) AS window_start, CAST(any_value(w0) + 12 AS INTEGER) AS window_end, count(*)::INTEGER AS n_consolidations, sum(amount)::BIGINT AS total, 0.92::DOUBLE AS confidence FROM (
  SELECT s.receiver, cash_small_count, w0, t.amount FROM (
    SELECT receiver, count(*) AS cash_small_count, min(day) FILTER (WHERE inside >= 3) AS w0
    FROM (SELECT receiver, day, count(*) OVER (PARTITION BY receiver ORDER BY day RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside FROM txns WHERE txn_type = 'R' AND amount < 50000)
    GROUP BY receiver
  ) s JOIN txns t ON t.sender = s.receiver AND t.amount >= 60000 AND t.day BETWEEN s.w0 AND s.w0 + 18 WHERE w0 IS NOT NULL
) GROUP BY receiver""",
)


def financial_anomalies(spark: SparkSession, d: str) -> DataFrame:
    t = txns(spark, d)
    fans = finance.structuring(t, cash="R", least=3, lump=60_000, least_lumps=1)
    large = finance.large_transfers(t, ("A",), 90_000, 50, 400)
    from netfusion.operators.signals import unified

    return unified(finance.financial_anomalies(fans, large, 200_000)).select("entity_id", "anomaly_type", F.round("score", 6).alias("score"), "day", "severity")


FINANCIAL_ANOMALIES = sql(
    TXNS,
    select="""SELECT entity_id, anomaly_type, score, day, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM (
  SELECT entity_id, anomaly_type, round(score, 6) AS score, CAST(day AS INTEGER) AS day, row_number() OVER (PARTITION BY entity_id, anomaly_type ORDER BY score DESC, day) AS k FROM (
    WITH f AS (SELECT s.receiver, w0, t.day, t.receiver AS dest FROM (
      SELECT receiver, min(day) FILTER (WHERE inside >= 3) AS w0
      FROM (SELECT receiver, day, count(*) OVER (PARTITION BY receiver ORDER BY day RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside FROM txns WHERE txn_type = 'R' AND amount < 50000) GROUP BY receiver
    ) s JOIN txns t ON t.sender = s.receiver AND t.amount >= 60000 AND t.day BETWEEN s.w0 AND s.w0 + 18)
    SELECT DISTINCT receiver AS entity_id, 'financial_structuring' AS anomaly_type, 1.0::DOUBLE AS score, w0 AS day FROM f
    UNION ALL SELECT dest, 'financial_consolidation', 0.8::DOUBLE, min(day) FROM f GROUP BY dest
    UNION ALL SELECT sender, 'financial_large_transfer', least(1.0, amount / 200000), day FROM txns WHERE txn_type = 'A' AND amount >= 90000 AND day BETWEEN 50 AND 400
  )
) WHERE k = 1""",
)


def tower_stats(spark: SparkSession, d: str) -> DataFrame:
    t = geo.tower_stats(calls(spark, d), people(spark, d), CELLS[:3])
    return t.select("tower", "call_count", "total_duration", "n_callers", "n_callees", "n_suspects", "days_active", *(F.col(f"n_{c}").alias(f"n_{c.lower()}") for c in CELLS[:3]), "dominant_cell", "is_cross_cell", "intensity")


TOWER_STATS = sql(
    PEOPLE, CALLS,
    select="""SELECT tower, count(*) AS call_count, sum(duration)::BIGINT AS total_duration, count(DISTINCT caller) AS n_callers, count(DISTINCT callee) AS n_callees,
  any_value(s.n) AS n_suspects, count(DISTINCT day) AS days_active, a AS n_automobile, b AS n_building, f AS n_furniture,
  CASE WHEN greatest(a, b, f) = 0 THEN 'Unknown' WHEN a >= b AND a >= f THEN 'AUTOMOBILE' WHEN b >= f THEN 'BUILDING' ELSE 'FURNITURE' END AS dominant_cell,
  (a >= 3)::INT + (b >= 3)::INT + (f >= 3)::INT >= 2 AS is_cross_cell, round(count(*) / (SELECT max(n) FROM (SELECT count(*) AS n FROM calls GROUP BY tower)), 3) AS intensity
FROM calls JOIN (SELECT tower, count(DISTINCT id) AS n FROM (SELECT tower, caller AS id FROM calls UNION ALL SELECT tower, callee FROM calls) GROUP BY tower) s USING (tower)
JOIN (SELECT tower, count(*) FILTER (WHERE cell = 'AUTOMOBILE') AS a, count(*) FILTER (WHERE cell = 'BUILDING') AS b, count(*) FILTER (WHERE cell = 'FURNITURE') AS f
      FROM (SELECT tower, caller AS id FROM calls UNION ALL SELECT tower, callee FROM calls) LEFT JOIN people USING (id) GROUP BY tower) USING (tower) GROUP BY tower, a, b, f""",
)


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    place = F.concat_ws("/", "tower", F.col("day").cast("string"))
    acts = c.select(F.explode(F.array("caller", "callee")).alias("id"), place.alias("place"), "day", F.lit(1).alias("weight"), F.col("call_id").alias("event"))
    return geo.hotspots(acts, people(spark, d), CELLS)


HOTSPOTS = sql(
    PEOPLE, CALLS,
    select="""SELECT place, count(DISTINCT id) AS n_suspects, count(DISTINCT cell) AS n_cells, count(DISTINCT day) AS n_days, count(DISTINCT call_id)::BIGINT AS total_events,
  CASE WHEN count(DISTINCT cell) >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_tier
FROM (SELECT tower || '/' || day AS place, day, call_id, unnest([caller, callee]) AS id FROM calls) JOIN people USING (id)
GROUP BY place HAVING count(DISTINCT id) >= 3 AND count(DISTINCT cell) >= 2""",
)


def pair_explain(spark: SparkSession, d: str) -> DataFrame:
    """Ties of all pairs."""
    t = pairs.explain(calls(spark, d), txns(spark, d))
    return t.select("p", "q", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("txns", F.lit(0)).alias("txns"), "evidence_points", "relationship_strength")


PAIR_EXPLAIN = sql(
    CALLS, TXNS,
    select="""SELECT p, q, calls, txns, pts AS evidence_points, CASE WHEN pts >= 8 THEN 'Direct Coordinated Operational Link (Critical)' WHEN pts >= 4 THEN 'Strong Financial / Communication Tie (High)' WHEN pts >= 2 THEN 'Corroborated Association (Moderate)' ELSE 'Indirect or Low-Frequency Link' END AS relationship_strength FROM (
  SELECT p, q, sum(c)::BIGINT AS calls, sum(t)::BIGINT AS txns, CAST(CASE WHEN sum(c) > 0 THEN least(4, sum(c) // 5 + 1) ELSE 0 END + CASE WHEN sum(t) > 0 THEN least(4, 2 * sum(t)) ELSE 0 END + 2 AS INTEGER) AS pts FROM (
    SELECT least(caller, callee) AS p, greatest(caller, callee) AS q, 1 AS c, 0 AS t FROM calls UNION ALL SELECT least(sender, receiver), greatest(sender, receiver), 0, 1 FROM txns WHERE sender <> receiver
  ) GROUP BY p, q
)""",
)


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Those who bought on a day and those who signed up then: their union, intersection and difference."""
    e = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("id"), "event_type")
    a, b = e.where("event_type = 'purchase'").select("id"), e.where("event_type = 'signup'").select("id")
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "id")
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.subtract(b), "except"))


SET_OPERATIONS = sql(
    "e AS (SELECT user_id || '/' || CAST(ts AS DATE) AS id, event_type FROM events)",
    select="""SELECT 'union' AS op, id FROM (SELECT id FROM e WHERE event_type = 'purchase' UNION SELECT id FROM e WHERE event_type = 'signup')
UNION ALL SELECT 'intersect', id FROM (SELECT id FROM e WHERE event_type = 'purchase' INTERSECT SELECT id FROM e WHERE event_type = 'signup')
UNION ALL SELECT 'except', id FROM (SELECT id FROM e WHERE event_type = 'purchase' EXCEPT SELECT id FROM e WHERE event_type = 'signup')""",
)


def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    """Towers in the order in which each user first used them."""
    c = calls(spark, d)
    first = c.groupBy("caller", "tower").agg(F.min("call_id").alias("first_call"))
    return first.groupBy("caller").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_call", "tower"))), lambda x: x["tower"]), ">").alias("towers"))


def people_search(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold '15', the first 15 by id, with the count of all."""
    hit = people(spark, d).where(F.contains(F.lower("name"), F.lit("15")))
    return hit.orderBy("id").limit(15).join(F.broadcast(hit.agg(F.count("*").alias("found")))).select("id", "name", "cell", "found")


def frozen(spark: SparkSession, d: str) -> DataFrame:
    accounts = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return finance.frozen_transactions(txns(spark, d), accounts)


QUERIES = {
    "burst_daily_counts": (daily, sql(PEOPLE, CALLS, TXNS, ACTS, select="SELECT cell, day, n FROM counts")),
    "burst_zscore": (call_bursts, sql(CALLS, Z, select="SELECT * FROM b")),
    "burst_correlated": (burst_correlated, BURST_CORRELATED),
    "temporal_groups": (temporal_groups, TEMPORAL),
    "burst_groups": (burst_groups, BURST_GROUPS),
    "burst_nearest": (
        nearest,
        sql(CALLS, Z, select="SELECT t::INTEGER AS target_day, arg_min(cell, (abs(day - t), day, cell)) AS cell, arg_min(day, (abs(day - t), day, cell)) AS day, arg_min(day, (abs(day - t), day, cell)) - t::INTEGER AS \"offset\" FROM (SELECT unnest([5, 12, 20, 29]) AS t) LEFT JOIN b ON abs(day - t) <= 3 GROUP BY t"),
    ),
    "small_cash_counts": (lambda s, d: finance.small_cash_counts(txns(s, d), "R", 20_000, 10), sql(TXNS, select="SELECT receiver, count(*) AS cash_small_count FROM txns WHERE txn_type = 'R' AND amount < 20000 GROUP BY receiver HAVING count(*) >= 10")),
    "structuring_fan": (structuring, STRUCTURING),
    "large_transfers": (lambda s, d: finance.large_transfers(txns(s, d), ("A", "R"), 90_000, 50, 400), sql(TXNS, select="SELECT txn_id, amount, day, txn_type, sender, receiver FROM txns WHERE amount >= 90000 AND txn_type IN ('A', 'R') AND day BETWEEN 50 AND 400")),
    "financial_anomalies": (financial_anomalies, FINANCIAL_ANOMALIES),
    "account_volume": (lambda s, d: finance.account_volume(txns(s, d)), sql(TXNS, select="SELECT id, sum(amount)::BIGINT AS volume FROM (SELECT unnest([sender, receiver]) AS id, amount FROM txns) GROUP BY id")),
    "frozen_transactions": (frozen, sql(TXNS, select="SELECT count(*) AS n_frozen, coalesce(sum(amount), 0)::BIGINT AS seized FROM txns WHERE sender IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR receiver IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")),
    "tower_stats": (tower_stats, TOWER_STATS),
    "tower_schematic": (
        lambda s, d: geo.tower_schematic(calls(s, d), people(s, d), CELLS[:3]),
        sql(PEOPLE, CALLS, select="SELECT tower, 'TWR-' || lpad(row_number() OVER (ORDER BY tower)::VARCHAR, 2, '0') AS tower_label, count(*) AS call_count, count(DISTINCT cell) FILTER (WHERE cell IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')) AS co_location_count FROM calls LEFT JOIN people ON id = caller GROUP BY tower"),
    ),
    "hotspots": (hotspots, HOTSPOTS),
    "trajectories": (
        lambda s, d: geo.trajectories(calls(s, d), 2, 20).drop("path"),
        sql(CALLS, select="SELECT person, count(*)::INTEGER AS waypoints, arg_min(tower, (day, ts, call_id)) AS first_place, arg_max(tower, (day, ts, call_id)) AS last_place FROM (SELECT unnest([caller, callee]) AS person, * FROM calls WHERE day BETWEEN 2 AND 20) GROUP BY person"),
    ),
    "place_coordinates": (
        lambda s, d: table(s, d, "part").select("p_partkey", "p_name", geo.coordinates(F.col("p_name")).alias("c")).select("p_partkey", "c.lat", "c.lng", "c.zone", "c.tower_id"),
        "SELECT p_partkey, round(19.045 + ((h % 1000) / 1000.0 - 0.5) * 0.15, 4)::DOUBLE AS lat, round(72.855 + ((h // 1000 % 1000) / 1000.0 - 0.5) * 0.15, 4)::DOUBLE AS lng, 'Peripheral Zone' AS zone, 'TOW-' || (h % 900 + 100) AS tower_id FROM (SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 6))::BIGINT AS h FROM part)",
    ),
    "pair_telephony": (
        lambda s, d: pairs.telephony(calls(s, d)),
        sql(CALLS, select="SELECT least(caller, callee) AS p, greatest(caller, callee) AS q, count(*) AS calls, count(*) FILTER (WHERE caller < callee) AS calls_p, count(*) FILTER (WHERE caller > callee) AS calls_q, round(sum(duration) / 60.0, 1)::DOUBLE AS minutes, count(DISTINCT day) AS n_days FROM calls GROUP BY ALL"),
    ),
    "pair_top_towers": (
        lambda s, d: pairs.top_towers(calls(s, d)).select("p", "q", F.array_join("towers", ",").alias("towers")),
        sql(CALLS, select="SELECT p, q, string_agg(tower, ',' ORDER BY k) AS towers FROM (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY n DESC, tower) AS k FROM (SELECT least(caller, callee) AS p, greatest(caller, callee) AS q, tower, count(*) AS n FROM calls GROUP BY ALL)) WHERE k <= 4 GROUP BY p, q"),
    ),
    "pair_financials": (
        lambda s, d: pairs.financials(txns(s, d)),
        sql(TXNS, select="SELECT least(sender, receiver) AS p, greatest(sender, receiver) AS q, count(*) AS txns, sum(amount)::BIGINT AS amount, sum(CASE WHEN sender < receiver THEN amount ELSE 0 END)::BIGINT AS amount_p, sum(CASE WHEN sender > receiver THEN amount ELSE 0 END)::BIGINT AS amount_q FROM txns WHERE sender <> receiver GROUP BY ALL"),
    ),
    "pair_call_counts": (lambda s, d: pairs.call_counts(calls(s, d)), sql(CALLS, select="SELECT least(caller, callee) AS p, greatest(caller, callee) AS q, count(*) AS calls FROM calls GROUP BY ALL")),
    "evidence_points": (pair_explain, PAIR_EXPLAIN),
    "mutual_neighbours": (
        lambda s, d: pairs.mutual_neighbours(edges(s, d).where("kind = 'CALLED'"), 1, 2),
        sql(CALLS, select="SELECT id FROM (SELECT caller AS id FROM calls WHERE callee = 1 UNION SELECT callee FROM calls WHERE caller = 1) INTERSECT SELECT id FROM (SELECT caller AS id FROM calls WHERE callee = 2 UNION SELECT callee FROM calls WHERE caller = 2) WHERE id NOT IN (1, 2)"),
    ),
    "set_operations": (set_operations, SET_OPERATIONS),
    "distinct_first": (distinct_first, sql(CALLS, select="SELECT caller, string_agg(tower, '>' ORDER BY f) AS towers FROM (SELECT caller, tower, min(call_id) AS f FROM calls GROUP BY ALL) GROUP BY caller")),
    "people_search": (people_search, sql(PEOPLE, select="SELECT id, name, cell, (SELECT count(*) FROM people WHERE contains(lower(name), '15')) AS found FROM people WHERE contains(lower(name), '15') ORDER BY id LIMIT 15")),
    "evidence_quality": (
        lambda s, d: graph.evidence_quality(edges(s, d)).select("id", F.round("quality", 6).alias("quality")),
        sql(CALLS, TXNS, EDGES, select="SELECT id, round(avg(confidence), 6) AS quality FROM (SELECT unnest([src, dst]) AS id, confidence FROM edges) GROUP BY id"),
    ),
}
