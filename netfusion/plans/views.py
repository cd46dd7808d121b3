"""Domain views over the benchmark tables, as DataFrames and as SQL for the comparison.

people: customers, a market segment being a cell; calls: consecutive events of different users; txns: line items from customers to
suppliers; call edges: all pairs of users with a call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.session import by_rows


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def people(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cell"), F.col("n_name").alias("role"), F.col("c_custkey").alias("ordinal"))


PEOPLE = "people AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS cell, n_name AS role, c_custkey AS ordinal FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def calls(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """dealt: joined in as many tasks as the events need."""
    e = table(spark, d, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    a = e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("caller"), day.alias("day"), "ts", F.floor("value").cast("long").alias("duration"), F.col("event_type").alias("tower"))
    b = e.select((F.col("event_id") - 1).alias("call_id"), F.col("user_id").alias("callee"))
    if dealt:
        n = e.count()
        a, b = by_rows(a, n, "call_id"), by_rows(b, n, "call_id")
    return a.join(b, "call_id").where("caller <> callee")


CALLS = (
    "calls AS (SELECT a.event_id AS call_id, a.user_id AS caller, b.user_id AS callee, date_diff('day', DATE '2024-01-01', CAST(a.ts AS DATE)) + 1 AS day, a.ts, "
    "CAST(floor(a.value) AS BIGINT) AS duration, a.event_type AS tower FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id)"
)


def txns(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """dealt: joined in as many tasks as the line items need."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    if dealt:
        n = l.count()
        l, o = by_rows(l, n, "l_orderkey"), by_rows(o, n, "o_orderkey")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) + 1
    txn = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(txn.alias("txn_id"), F.col("o_custkey").alias("sender"), F.col("l_suppkey").alias("receiver"), F.floor("l_extendedprice").cast("long").alias("amount"), day.alias("day"), F.col("l_returnflag").alias("txn_type"))


TXNS = (
    "txns AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id, o_custkey AS sender, l_suppkey AS receiver, CAST(floor(l_extendedprice) AS BIGINT) AS amount, "
    "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS day, l_returnflag AS txn_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """All calls and transfers among people as edges; a transfer's confidence is 0.5 for type N."""
    c = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLED").alias("kind"), F.lit(1.0).alias("confidence"), F.col("day").cast("int").alias("day"))
    t = txns(spark, d).select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), F.lit("TRANSACTED").alias("kind"), F.when(F.col("txn_type") == "N", 0.5).otherwise(1.0).alias("confidence"), F.col("day").cast("int").alias("day"))
    return c.unionByName(t)


EDGES = (
    "edges AS (SELECT caller AS src, callee AS dst, 'CALLED' AS kind, 1.0::DOUBLE AS confidence, day FROM calls "
    "UNION ALL SELECT sender, receiver, 'TRANSACTED', CASE WHEN txn_type = 'N' THEN 0.5 ELSE 1.0 END::DOUBLE, day FROM txns)"
)


def call_pairs(spark: SparkSession, d: str) -> DataFrame:
    """src, dst of all pairs of users with a call."""
    return calls(spark, d).select(F.least("caller", "callee").alias("src"), F.greatest("caller", "callee").alias("dst")).distinct()


GRAPH = "graph AS (SELECT DISTINCT least(caller, callee) AS src, greatest(caller, callee) AS dst FROM calls)"
ARCS = "arcs AS (SELECT src AS u, dst AS v FROM graph UNION ALL SELECT dst, src FROM graph)"
#: The same for all edges.
EDGE_ARCS = "arcs AS (SELECT src AS u, dst AS v FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"
LEVELS = 8


def levels_sql(arcs: str = "arcs", name: str = "s") -> list[str]:
    """Tables <name>1 to <name>8: s, t at that distance, and c, the number of shortest paths between them."""
    parts = [f"{name}0 AS (SELECT u AS s, u AS t, 1::DOUBLE AS c FROM (SELECT DISTINCT u FROM {arcs}))", f"seen_{name}0 AS (SELECT s, t FROM {name}0)"]
    for k in range(1, LEVELS + 1):
        parts.append(f"{name}{k} AS (SELECT p.s, a.v AS t, sum(p.c) AS c FROM {name}{k - 1} p JOIN {arcs} a ON a.u = p.t WHERE NOT EXISTS (SELECT 1 FROM seen_{name}{k - 1} x WHERE x.s = p.s AND x.t = a.v) GROUP BY p.s, a.v)")
        parts.append(f"seen_{name}{k} AS (SELECT s, t FROM seen_{name}{k - 1} UNION ALL SELECT s, t FROM {name}{k})")
    return parts


def between_sql() -> list[str]:
    """Table between: id, betweenness of all nodes of arcs, over (n - 1)(n - 2)."""
    parts = [*levels_sql(), f"f{LEVELS} AS (SELECT s, t, c, 0::DOUBLE AS d FROM s{LEVELS})"]
    for k in range(LEVELS - 1, 0, -1):
        parts.append(f"f{k} AS (SELECT a.s, a.t, a.c, coalesce(a.c * g.d, 0) AS d FROM s{k} a LEFT JOIN (SELECT b.s, x.u AS t, sum((1 + b.d) / b.c) AS d FROM f{k + 1} b JOIN arcs x ON x.v = b.t GROUP BY b.s, x.u) g ON g.s = a.s AND g.t = a.t)")
    every = " UNION ALL ".join(f"SELECT t, d FROM f{k}" for k in range(1, LEVELS + 1))
    return [*parts, "nn AS (SELECT count(DISTINCT u) AS n FROM arcs)", f"between AS (SELECT u AS id, coalesce(any_value(b.d), 0) / any_value((n - 1) * (n - 2)) AS betweenness FROM arcs CROSS JOIN nn LEFT JOIN (SELECT t, sum(d) AS d FROM ({every}) GROUP BY t) b ON b.t = u GROUP BY u)"]


def pagerank_sql(rounds: int) -> list[str]:
    """Tables r0 to r<rounds>: id, rank on arcs."""
    parts = ["deg AS (SELECT u AS id, count(*) AS d, count(*) OVER () AS n FROM arcs GROUP BY u)", "r0 AS (SELECT id, d, n, 1.0::DOUBLE / n AS rank FROM deg)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS (SELECT r.id, r.d, r.n, 0.15::DOUBLE / r.n + 0.85 * g.got AS rank FROM r{k} r JOIN (SELECT v AS id, sum(rank / d) AS got FROM arcs JOIN r{k} ON id = u GROUP BY v) g ON g.id = r.id)")
    return parts


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as short case texts."""
    t = table(spark, d, "conversations")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text", F.col("role").alias("source_type"), F.col("turn").cast("int").alias("day"))


CASES = "cases AS (SELECT concat_ws('-', conv_id, turn) AS doc_id, text, role AS source_type, CAST(turn AS INTEGER) AS day FROM conversations)"


#: Names of the people in incidents.
FIRST_NAMES = ("Ravi", "Sunil", "Meena", "Farid", "Anita", "Gopal", "Lalita", "Imran")
LAST_NAMES = ("Kumar", "More", "Shaikh", "Patil", "Rao", "Nair", "Das")
ACTS = ("was seen meeting", "transferred cash to", "works for", "owns a flat with", "had a possible link to", "watched")


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """Case texts with identifiers, names and sentences written from orders."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    pad = lambda c, n: F.lpad((F.col(c) % 10**n).cast("string"), n, "0")
    pick = lambda some, n: F.element_at(F.array(*map(F.lit, some)), (n % len(some) + 1).cast("int"))
    name = lambda n: F.concat(pick(FIRST_NAMES, n), F.lit(" "), pick(LAST_NAMES, n))
    text = F.concat(name(k), F.lit(" "), pick(ACTS, k), F.lit(" "), name(F.col("o_custkey")), F.lit(" near "), F.when(F.col("o_custkey") % 2 == 0, "Station Road").otherwise("Eastgate"), F.lit(". Call from 70000"), pad("o_custkey", 5), F.lit(" to account AC0009"), pad("o_orderkey", 6), F.lit(".\nVehicle MH-DEMO-"), pad("o_custkey", 4), F.lit(" left to Meena."))
    return o.select(k.alias("doc_id"), text.alias("text"), F.lit("fir").alias("source_type"), (k % 90 + 1).cast("int").alias("day"))


def _name_sql(n: str) -> str:
    pick = lambda some: f"{list(some)}[{n} % {len(some)} + 1]"
    return f"{pick(FIRST_NAMES)} || ' ' || {pick(LAST_NAMES)}"


INCIDENTS = (
    f"incidents AS (SELECT o_orderkey AS doc_id, {_name_sql('o_orderkey')} || ' ' || {list(ACTS)}[o_orderkey % {len(ACTS)} + 1] || ' ' || {_name_sql('o_custkey')} || ' near ' || "
    "CASE WHEN o_custkey % 2 = 0 THEN 'Station Road' ELSE 'Eastgate' END || '. Call from 70000' || lpad((o_custkey % 100000)::VARCHAR, 5, '0') || ' to account AC0009' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || "
    "'.' || chr(10) || 'Vehicle MH-DEMO-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' left to Meena.' AS text, 'fir' AS source_type, CAST(o_orderkey % 90 + 1 AS INTEGER) AS day FROM orders)"
)
#: Sentences of incidents with their runs of capitalised words, by the patterns of extraction.
SENTENCES = (
    r"sentences AS (SELECT doc_id, seq, sentence, regexp_extract_all(sentence, '\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,2}\b') AS caps, regexp_extract_all(sentence, '\b[A-Z][a-z]{2,}\b') AS singles, replace(substr(trim(sentence), 1, 120), chr(10), ' ') AS evidence "
    r"FROM (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS seq FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]\s+') AS ss FROM incidents)))"
)


def sql(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}" if parts else select


#: Similarity in SQL: a row of the longest-common-subsequence table for each character of the second string.
_LCS = """list_last(list_reduce(list_prepend(list_transform(range(length({a}) + 1), lambda i: 0), list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda r, j:
  list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i, CASE WHEN substr({a}, i, 1) = substr({b}, j[1], 1) THEN 1 ELSE 0 END, r[i], r[i + 1]]), lambda acc, x: list_append(acc, CASE WHEN x[2] = 1 THEN x[3] + 1 ELSE greatest(x[4], list_last(acc)) END), [0])))"""


def _lcs(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE {_LCS.format(a=a, b=b)} END)"


#: Tables over pr (value, id, name, ordinal and, in small letters, a and b): sc with the scores of all pairs, be with the best of each value.
BEST_NAMES = [
    "sh AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM pr)",
    f"ra AS (SELECT *, 200.0 * {_lcs('a', 'b')} / (length(a) + length(b)) AS ratio FROM sh)",
    "wi AS (SELECT value, id, s, substr(l, greatest(1, k), least(length(l), k + length(s) - 1) - greatest(1, k) + 1) AS w FROM (SELECT value, id, s, l, unnest(range(2 - length(s), length(l) + 1)) AS k FROM sh))",
    f"pt AS (SELECT value, id, max(200.0 * {_lcs('s', 'w')} / (length(s) + length(w))) AS part FROM wi GROUP BY value, id)",
    """sc AS (SELECT *, CASE WHEN a = b THEN 100.0 ELSE greatest(ratio, 0.95 * part, CASE WHEN len(mw) = 2 AND len(nw) = 2 AND ((length(mw[1]) = 1 AND mw[1] = substr(nw[1], 1, 1) AND mw[2] = nw[2]) OR (mw[1] = nw[1] AND length(mw[2]) = 1 AND mw[2] = substr(nw[2], 1, 1))) THEN 92.0 ELSE 0.0 END) END AS score
FROM (SELECT *, string_split(trim(regexp_replace(a, '[.\\s]+', ' ', 'g')), ' ') AS mw, string_split(b, ' ') AS nw FROM ra JOIN pt USING (value, id)))""",
    "be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY value ORDER BY score DESC, ordinal, id) = 1)",
]
