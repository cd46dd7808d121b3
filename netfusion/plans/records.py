"""Queries on parsing, ingest, text, vectors and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.functions import parsing, vectors
from netfusion.functions.text import LOCATIONS, PATTERNS, RELATIONS, evidence_hash, risk_level
from netfusion.operators import evaluation, extraction, faces, ingest, ledger, resolution
from netfusion.operators.ranking import number_rows, ranked
from netfusion.plans.views import BEST_NAMES, CASES, INCIDENTS, PEOPLE, SENTENCES, cases, incidents, people, sql, table
from netfusion.sources.detect import detect_type, suggest_mapping


def parse_amounts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("v"))
    text = F.element_at(
        F.array(
            F.format_string("₹%,d.00", "v"), F.concat(F.col("v").cast("string"), F.lit("/-")), F.concat((F.col("v") % 90 + 1).cast("string"), F.lit(".5L")), F.concat((F.col("v") % 9 + 1).cast("string"), F.lit(" Cr")),
            F.lit("none"), F.concat(F.lit("Rs. "), (F.col("v") % 900 + 1).cast("string"), F.lit("k")),
        ),
        (F.col("o_orderkey") % 6 + 1).cast("int"),
    )
    return o.select("o_orderkey", parsing.parse_amount(text).alias("amount"))


def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    text = F.element_at(
        F.array(
            F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.date_format("t", "dd/MM/yyyy HH:mm"), F.date_format("t", "d-M-yyyy"), F.unix_seconds("t").cast("string"),
            F.datediff(F.col("t").cast("date"), F.lit("1899-12-30").cast("date")).cast("string"), F.date_format("t", "MMM d, yyyy"), F.lit("not a date"),
        ),
        (F.col("o_orderkey") % 7 + 1).cast("int"),
    )
    x, stamp = F.col("x"), F.col("stamp")
    read = o.select("o_orderkey", text.alias("x")).select("o_orderkey", "x", parsing.date_parts(x).alias("cut"))  # each step once a row
    read = read.select("o_orderkey", "x", parsing.parse_timestamp(x, F.col("cut")).alias("stamp"))
    return read.select("o_orderkey", parsing.parse_date(x, stamp).alias("parsed"), parsing.to_day(x, "1995-01-01", stamp).alias("day"))


PARSE_DATES = """SELECT o_orderkey, CASE WHEN k = 6 THEN 'not a date' WHEN short THEN epoch(o_orderdate)::BIGINT::VARCHAR ELSE strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') END AS parsed,
  CASE WHEN k <> 6 AND NOT short AND day BETWEEN 1 AND 730 THEN CAST(day AS INTEGER) END AS day
FROM (SELECT *, o_orderkey % 7 AS k, o_orderkey % 7 = 3 AND epoch(o_orderdate) < 1000000000 AS short, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 1 AS day FROM orders)"""


def clean_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Phones and durations in several spellings."""
    c = table(spark, d, "customer")
    ten = F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    phone = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+91-"), ten)).when(F.col("c_custkey") % 3 == 1, F.concat_ws(" ", F.substring(ten, 1, 5), F.substring(ten, 6, 5))).otherwise(ten)
    n = (F.col("c_custkey") % 50).cast("string")
    duration = F.element_at(F.array(F.concat(n, F.lit("m")), n, F.concat(n, F.lit(".5 h")), F.lit("long"), F.concat(n, F.lit(" sec"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", parsing.clean_phone(phone).alias("phone"), parsing.clean_duration(duration).alias("seconds"))


CLEAN_CONTACTS = """SELECT c_custkey, '98' || lpad(c_custkey::VARCHAR, 8, '0') AS phone,
  CAST(CASE c_custkey % 5 WHEN 0 THEN c_custkey % 50 * 60 WHEN 2 THEN (c_custkey % 50) * 3600 + 1800 WHEN 3 THEN 0 ELSE c_custkey % 50 END AS BIGINT) AS seconds FROM customer"""


def raw_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as badly kept transfer records: some lack a sender, some a receiver, some both."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").orderBy("o_orderkey").select(
        F.when(k % 5 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("Sender"), F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit("R"), (k % 97).cast("string"))).alias("Beneficiary ID"),
        F.concat(F.floor("o_totalprice").cast("long").cast("string"), F.lit("/-")).alias("Txn Amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.lit("UPI").alias("Mode"),
    )


def mapped_transfers(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_transfers(spark, d)
    mapping = suggest_mapping(raw.columns, "transactions")
    return ingest.normalize(ingest.apply_mapping(raw, mapping), "transactions").select("txn_id", "sender_id", "receiver_id", "amount_inr", "timestamp", "txn_type")


RAW = "raw AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey AS k, o_custkey, o_totalprice, o_orderdate FROM orders)"


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """What the records lack before normalising gives them ids."""
    raw = raw_transfers(spark, d)
    rows = ingest.apply_mapping(raw, suggest_mapping(raw.columns, "transactions"))
    return ingest.split_quarantine(number_rows(rows), "transactions", "transfers.csv")[1]


def header_map(spark: SparkSession, d: str) -> DataFrame:
    """Detected datasets and mappings of some headers."""
    heads = (["call_id", "caller", "receiver", "day", "duration_sec", "type"], ["Remitter", "Payee Account", "Txn Amount", "Date"], ["FIR No", "Police Station", "Brief Narrative", "date"], ["x", "y"])
    rows = []
    for i, h in enumerate(heads):
        kind, conf = detect_type(h)
        rows += [(i, kind, float(conf), t, c) for t, c in suggest_mapping(h, kind).items() if c] or [(i, kind, float(conf), None, None)]
    return spark.createDataFrame(rows, "header int, dataset string, confidence double, target string, source string")


def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    t = incidents(spark, d)
    return extraction.pattern_entities(t).unionByName(extraction.gazetteer_entities(t)).drop("source_type")


def _snip(value: str) -> str:
    return f"replace(trim(substr(text, greatest(instr(text, {value}) - 30, 1), instr(text, {value}) + length({value}) + 30 - greatest(instr(text, {value}) - 30, 1))), chr(10), ' ')"


ENTITY_EXTRACT = sql(
    INCIDENTS,
    "hits AS ("
    + " UNION ALL ".join([f"SELECT doc_id, day, text, '{k}' AS entity_type, unnest(list_distinct(f)) AS value, f, 0.95::DOUBLE AS confidence FROM (SELECT *, regexp_extract_all(text, '{p}') AS f FROM incidents)" for k, p in PATTERNS.items()] + [f"SELECT doc_id, day, text, 'Location', '{x}', ['{x}'], 0.85::DOUBLE FROM incidents WHERE contains(text, '{x}')" for x in LOCATIONS])
    + ")",
    select=f"SELECT doc_id, day, entity_type, value, CAST(len(list_filter(f, lambda x: x = value)) AS INTEGER) AS n, confidence, {_snip('value')} AS evidence_snippet, substr(sha256({_snip('value')}), 1, 16) AS evidence_hash FROM hits",
)


def incident_people(spark: SparkSession) -> DataFrame:
    """Two of the people in incidents, as a directory knows them."""
    return spark.createDataFrame([("Sunil More",), ("Meena Das",)], "name string")


def relation_kinds(spark: SparkSession, d: str) -> DataFrame:
    return extraction.relations(incidents(spark, d), known=incident_people(spark)).select("doc_id", "src", "dst", "kind", "confidence", "supporting_text", "evidence_hash")


_PLACES = " OR ".join(f"contains(x, '{w}')" for w in extraction.NOT_PEOPLE)
RELATION_PARTS = [
    INCIDENTS, SENTENCES,
    f"""c AS (SELECT doc_id, seq, sentence, singles, list_concat(list_filter(['Meena Das', 'Sunil More'], lambda n: contains(plain, ' ' || lower(n) || ' ')), list_filter(caps, lambda x: length(x) < 35 AND NOT ({_PLACES}))) AS sm FROM (SELECT *, ' ' || regexp_replace(lower(sentence), '[^\\pL\\pN]+', ' ', 'g') || ' ' AS plain FROM sentences) WHERE length(trim(sentence)) >= 10)""",
    "f AS (SELECT *, list_concat(sm, list_filter(singles, lambda w: lower(w) IN ('sunil', 'meena') AND NOT list_contains(list_transform(sm, lambda x: split_part(x, ' ', 1)), w))) AS found FROM c)",
    "n AS (SELECT *, list_filter(found, lambda x, i: NOT list_contains(list_transform(found[: i - 1], lambda y: lower(y)), lower(x))) AS names FROM f)",
    "rel AS (SELECT doc_id, names[1] AS src, unnest(names[2:3]) AS dst, CASE "
    + " ".join(f"WHEN {' OR '.join(f'contains(lower(sentence), {chr(39)}{w}{chr(39)})' for w in words)} THEN ('{kind}', {conf}::DOUBLE)" for kind, conf, words in RELATIONS)
    + " ELSE ('ASSOCIATED_WITH', 0.55::DOUBLE) END AS r, replace(substr(trim(sentence), 1, 200), chr(10), ' ') AS supporting_text FROM n WHERE len(names) >= 2)",
]
RELATION_KINDS = sql(*RELATION_PARTS, select="SELECT doc_id, src, dst, r[1] AS kind, r[2] AS confidence, supporting_text, substr(sha256(supporting_text), 1, 16) AS evidence_hash FROM rel")


def relation_provenance(spark: SparkSession, d: str) -> DataFrame:
    return extraction.provenance(extraction.relations(incidents(spark, d), known=incident_people(spark)))


def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    first = spark.createDataFrame([("call",), ("meena",), ("eastgate",)], "name string")
    return extraction.name_mentions(incidents(spark, d), first).select("doc_id", "seq", "value", "confidence", "extractor", "evidence_hash")


_STOP = " OR ".join(f"contains(value, '{w}')" for w in extraction.STOP_WORDS)
NAME_MENTIONS = sql(
    INCIDENTS, SENTENCES,
    select=f"""SELECT doc_id, CAST(seq AS INTEGER) AS seq, value, confidence, extractor, substr(sha256(evidence), 1, 16) AS evidence_hash FROM (
  SELECT doc_id, seq, unnest(caps) AS value, 0.45::DOUBLE AS confidence, 'fallback_two_word' AS extractor, evidence FROM sentences
) WHERE length(value) BETWEEN 4 AND 35 AND NOT ({_STOP})
UNION ALL SELECT doc_id, CAST(seq AS INTEGER), value, 0.40::DOUBLE, 'fallback_single', substr(sha256(evidence), 1, 16) FROM (SELECT doc_id, seq, caps, evidence, unnest(singles) AS value FROM sentences)
WHERE value NOT IN {extraction.STOP_WORDS} AND len(list_filter(caps, lambda c: contains(c, value))) = 0 AND lower(value) IN ('call', 'meena', 'eastgate')""",
)


def mention_containment(spark: SparkSession, d: str) -> DataFrame:
    """Which case texts hold the opening two words of some conversation."""
    w = F.split(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), " ")
    m = cases(spark, d).where("day = 0").select(F.array_join(F.slice(w, 1, 2), " ").alias("mention")).distinct()
    return extraction.containment(cases(spark, d), m)


MENTION_CONTAINMENT = sql(
    CASES, "clean AS (SELECT doc_id, day, trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM cases)",
    "m AS (SELECT DISTINCT array_to_string(string_split(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')[1:2], ' ') AS mention FROM cases WHERE day = 0)",
    select="SELECT doc_id, mention FROM clean JOIN m ON contains(' ' || t || ' ', ' ' || trim(mention) || ' ') WHERE trim(mention) <> ''",
)


def fuzzy_top1(spark: SparkSession, d: str) -> DataFrame:
    """The customer most similar to misspelt names."""
    p = people(spark, d)
    wrong = table(spark, d, "supplier").select(F.concat(F.lit("Custmer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("value"))
    best = resolution.best_candidates(resolution.scored(resolution.candidates(wrong, p, least=0.0)))
    return best.select("value", "id", F.round("name_score", 4).alias("name_score"), "method")


def resolve_mentions(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d).select("id", "name", "cell", F.lit("").alias("phone"), F.lit("").alias("account"), F.lit("").alias("address"), F.lit("").alias("org"), "ordinal")
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("Customer 0"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("value"), F.lit(None).cast("string").alias("phone"), F.lit("seen in HOUSEHOLD").alias("evidence_snippet"), F.col("s_suppkey").cast("string").alias("source_id"), F.lit("intel").alias("source_type"))
    return resolution.resolve(m, p)[1].select("master_id", "merged_ids", "method", "confidence", "name_score", "context_score")


def _digits(c: str) -> str:
    return f"array_to_string(list_sort(string_split(right({c}, 9), '')), '')"


#: The name with a value's own number scores 97.1 and 94.4. That takes all of a value's characters but one, so only names of the same digits
#: in any order can score as much; the others need no score here.
_SAME_DIGITS = f"pr AS (SELECT v.value, id, name, ordinal, lower(trim(v.value)) AS a, lower(trim(name)) AS b FROM (SELECT DISTINCT value FROM mm) v JOIN people ON {_digits('v.value')} = {_digits('name')})"
FUZZY_TOP1 = sql(
    PEOPLE, "mm AS (SELECT 'Custmer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS value FROM supplier)", _SAME_DIGITS, *BEST_NAMES,
    select="SELECT value, id, round(score, 4)::DOUBLE AS name_score, CASE WHEN a = b THEN 'exact' ELSE 'fuzzy' END AS method FROM be",
)
ENTITY_RESOLUTION = sql(
    PEOPLE, "mm AS (SELECT 'Customer 0' || lpad(s_suppkey::VARCHAR, 8, '0') AS value FROM supplier)", _SAME_DIGITS, *BEST_NAMES,
    "cx AS (SELECT be.*, CASE WHEN cell = 'HOUSEHOLD' THEN 0.8 ELSE 0.5 END AS context FROM be JOIN people USING (id))",
    "cf AS (SELECT *, round(least(1.0, score / 100 + 0.02 * context), 3) AS conf FROM cx)",
    select="""SELECT CASE WHEN score >= 85 AND conf >= 0.65 THEN id::VARCHAR ELSE value END AS master_id, value AS merged_ids, CASE WHEN score >= 85 AND conf >= 0.65 THEN CASE WHEN a = b THEN 'exact' ELSE 'fuzzy' END ELSE 'fuzzy_reject' END AS method,
  CASE WHEN score >= 85 AND conf >= 0.65 THEN conf ELSE 0.5 END::DOUBLE AS confidence, round(score, 1)::DOUBLE AS name_score, context::DOUBLE AS context_score FROM cf WHERE score >= 70""",
)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to vector 0 by cosine, with match percentages."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    score = vectors.cosine(F.col("embedding"), F.col("q"))
    near = e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", "label", F.round(score, 4).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)
    percent = vectors.match_percent(F.col("similarity"))
    return near.select("vec_id", "label", "similarity", percent.alias("percent"), vectors.match_label(percent).alias("confidence_level"))


VECTOR_TOPK = """SELECT vec_id, label, s AS similarity, p AS percent, CASE WHEN p >= 85 THEN 'High Probability Match' WHEN p >= 70 THEN 'Probable Match' WHEN p >= 50 THEN 'Possible Lead' ELSE 'Low Similarity' END AS confidence_level FROM (
  SELECT *, CASE WHEN s >= 0.99 THEN 99.8 WHEN s >= 0.8 THEN round(88 + (s - 0.8) / 0.19 * 11.5, 1) WHEN s >= 0.6 THEN round(70 + (s - 0.6) / 0.2 * 17.9, 1) WHEN s >= 0.4 THEN round(50 + (s - 0.4) / 0.2 * 19.9, 1)
    WHEN s >= 0.2 THEN round(30 + (s - 0.2) / 0.2 * 19.9, 1) ELSE round(greatest(5, (s + 1) * 15), 1) END::DOUBLE AS p FROM (
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS s FROM embeddings WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 10
  )
)"""


def evidence_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Case texts as ledger leaves, a role being a block."""
    c = table(spark, d, "conversations").select("role", "conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("leaf"))
    return ledger.numbered_leaves(c.select(F.col("role").alias("block"), "conv_id", "turn", "leaf"), "conv_id", "turn", "leaf")


def merkle(spark: SparkSession, d: str) -> DataFrame:
    return ledger.merkle_roots(evidence_leaves(spark, d))


def _merkle_sql(levels: int = 14) -> str:
    parts = ["l0 AS (SELECT role AS block, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, sha256(coalesce(text, ''))) - 1 AS i, sha256(coalesce(text, '')) AS h FROM conversations)"]
    for k in range(levels):
        parts.append(
            f"l{k + 1} AS (SELECT block, i // 2 AS i, CASE WHEN any_value(w) = 1 THEN min(h) ELSE sha256(arg_min(h, i) || arg_max(h, i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY block) AS w FROM l{k}) GROUP BY block, i // 2)"
        )
    return sql(*parts, select=f"SELECT block, n_leaves, h AS root FROM l{levels} JOIN (SELECT block, count(*) AS n_leaves FROM l0 GROUP BY block) USING (block)")


def chain_validity(spark: SparkSession, d: str) -> DataFrame:
    roots = merkle(spark, d).orderBy("block").collect()  # a row for each block
    blocks = spark.createDataFrame(ledger.chain([(r.block, r.root) for r in roots]))
    return ledger.chain_valid(blocks).join(blocks.agg(F.max_by("block_hash", "index").alias("head")))


def _chain_sql() -> str:
    base = _merkle_sql()
    body = base[len("WITH ") :].rsplit(" SELECT block, n_leaves", 1)
    roots = f"roots AS (SELECT block, h AS root, row_number() OVER (ORDER BY block) - 1 AS i FROM l14)"
    return (
        f"WITH RECURSIVE {body[0]}, {roots}, c(i, h) AS (SELECT -1::BIGINT, repeat('0', 64) UNION ALL SELECT r.i, sha256(r.i || ':' || r.block || ':' || c.h || ':' || r.root || ':2026-01-01T00:00:00+00:00:Investigating Officer') FROM c JOIN roots r ON r.i = c.i + 1) "
        "SELECT bool_and(n = 1) AS valid, arg_max(h, i) AS head FROM (SELECT i, h, count(*) OVER (PARTITION BY i) AS n FROM c)"
    )


def observed_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Phones and with whom they were seen."""
    o = table(spark, d, "orders")
    calls = o.select(F.col("o_custkey").cast("string").alias("caller_id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("caller_name"), F.lpad((F.col("o_custkey") % 700).cast("string"), 10, "7").alias("caller_phone"), F.lit("").alias("callee_id"), F.lit("").alias("callee_name"), F.lit("").alias("callee_phone"))
    seen = ingest.observed(calls, None)
    return seen.select("value", F.size("ids").alias("n_ids"), F.array_join("names", ",").alias("names"))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    calls = o.select(F.col("o_custkey").cast("string").alias("caller_id"), F.lit("").alias("caller_name"), F.concat(F.lit("70"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("caller_phone"), F.lit("UNK1").alias("callee_id"), F.lit("").alias("callee_name"), F.lit("7999999999").alias("callee_phone"))
    ppl = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("70"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"), F.lit("").alias("account"))
    return ingest.bootstrap(ppl, calls, None)


def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    """How well long texts without symbols predict quality, against the labels."""
    docs = table(spark, d, "documents").where("n_chars > 200").where(~F.contains("text", F.lit("###")) & ~F.contains("text", F.lit(" | ")) & ~F.contains("text", F.lit("!!")))
    labels = table(spark, d, "labels")
    known = docs.join(labels, "doc_id", "left_semi").select(F.col("doc_id").alias("id"))
    return evaluation.precision_recall(known, labels.where("quality = 1").select(F.col("doc_id").alias("id")))


EVAL_GATE = """SELECT round(count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE p), 6) AS "precision", round(count(*) FILTER (WHERE p AND t) / count(*) FILTER (WHERE t), 6) AS recall FROM (
  SELECT quality = 1 AS t, n_chars > 200 AND NOT contains(text, '###') AND NOT contains(text, ' | ') AND NOT contains(text, '!!') AS p FROM labels JOIN documents USING (doc_id))"""


def content_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Pages most like page 0 by their bytes."""
    index = faces.index_files(table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content")), "page_id")
    return faces.search(index, index.where("id = '0'"), 10)


#: The vectors of 128 numbers in SQL: shares of byte values by fours and means of 64 segments, both centred, over their length.
CONTENT_VECTORS = """WITH h AS (SELECT page_id, hex(encode(html)) AS x, octet_length(encode(html)) AS n FROM pages WHERE html <> ''),
b AS (SELECT page_id, n, i, ('0x' || substr(x, 2 * i + 1, 2))::INTEGER AS v, greatest(1, n // 64) AS size FROM h, unnest(range(n)) u(i)),
g AS (SELECT page_id, k FROM h, unnest(range(64)) u(k)),
hs AS (SELECT g.page_id, g.k, (coalesce(c / n, 0) - 1 / 64)::FLOAT AS x FROM g LEFT JOIN (SELECT page_id, v // 4 AS k, count(*) AS c, any_value(n) AS n FROM b GROUP BY 1, 2) USING (page_id, k)),
sg AS (SELECT g.page_id, g.k + 64 AS k, coalesce(m, 0) / 255 AS m FROM g LEFT JOIN (SELECT page_id, i // size AS k, avg(v) AS m FROM b WHERE i // size < 64 GROUP BY 1, 2) USING (page_id, k)),
vs AS (SELECT page_id, k, x FROM hs UNION ALL SELECT page_id, k, (m - avg(m) OVER (PARTITION BY page_id))::FLOAT FROM sg),
nv AS (SELECT page_id, k, x / (sqrt(sum(x::DOUBLE * x) OVER (PARTITION BY page_id)) + 1e-6) AS x FROM vs),
c AS (SELECT a.page_id::VARCHAR AS id, round(sum(a.x * q.x), 4) AS s FROM nv a JOIN nv q ON q.page_id = 0 AND q.k = a.k GROUP BY a.page_id),
p AS (SELECT id, s AS raw_cosine, CASE WHEN s >= 0.99 THEN 99.8 WHEN s >= 0.8 THEN round(88 + (s - 0.8) / 0.19 * 11.5, 1) WHEN s >= 0.6 THEN round(70 + (s - 0.6) / 0.2 * 17.9, 1) WHEN s >= 0.4 THEN round(50 + (s - 0.4) / 0.2 * 19.9, 1)
  WHEN s >= 0.2 THEN round(30 + (s - 0.2) / 0.2 * 19.9, 1) ELSE round(greatest(5, (s + 1) * 15), 1) END::DOUBLE AS similarity_score FROM c)
SELECT id, raw_cosine, similarity_score, CASE WHEN similarity_score >= 85 THEN 'High Probability Match' WHEN similarity_score >= 70 THEN 'Probable Match' WHEN similarity_score >= 50 THEN 'Possible Lead' ELSE 'Low Similarity' END AS confidence_level
FROM p ORDER BY similarity_score DESC, raw_cosine DESC, id LIMIT 10"""

QUERIES = {
    "eval_gate": (eval_gate, EVAL_GATE),
    "content_vectors": (content_vectors, CONTENT_VECTORS),
    "parse_amounts": (parse_amounts, "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN (v % 90 + 1) * 100000 + 50000 WHEN 3 THEN (v % 9 + 1) * 10000000 WHEN 4 THEN 0 ELSE (v % 900 + 1) * 1000 END AS BIGINT) AS amount FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)"),
    "parse_dates": (parse_dates, PARSE_DATES),
    "clean_contacts": (clean_contacts, CLEAN_CONTACTS),
    "mapped_transfers": (
        mapped_transfers,
        sql(RAW, select="SELECT 'GEN-TXN' || lpad(n::VARCHAR, 5, '0') AS txn_id, CASE WHEN k % 5 = 0 THEN 'UNK' || (n - 1) ELSE o_custkey::VARCHAR END AS sender_id, CASE WHEN k % 7 = 0 THEN 'UNK' || (n - 1) ELSE 'R' || (k % 97) END AS receiver_id, CAST(floor(o_totalprice) AS BIGINT) AS amount_inr, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS timestamp, 'UPI' AS txn_type FROM raw"),
    ),
    "quarantine_split": (
        quarantined,
        sql(RAW, select="SELECT CAST(n + 1 AS INTEGER) AS row_no, 'transfers.csv' AS source_file, 'Missing/invalid required field(s): ' || concat_ws(', ', CASE WHEN k % 5 = 0 THEN 'sender_id / sender_account' END, CASE WHEN k % 7 = 0 THEN 'receiver_id / receiver_account' END) AS reason, 0.0::DOUBLE AS confidence FROM raw WHERE k % 5 = 0 OR k % 7 = 0"),
    ),
    "header_map": (header_map, None),
    "entity_regex_extract": (entity_extract, ENTITY_EXTRACT),
    "relation_kinds": (relation_kinds, RELATION_KINDS),
    "relation_provenance": (relation_provenance, sql(*RELATION_PARTS, select="SELECT r[1] AS kind, count(*) AS n, count(*) FILTER (WHERE supporting_text <> '') AS with_text FROM rel GROUP BY 1")),
    "name_mentions": (name_mentions, NAME_MENTIONS),
    "mention_containment": (mention_containment, MENTION_CONTAINMENT),
    "fuzzy_top1": (fuzzy_top1, FUZZY_TOP1),
    "entity_resolution": (resolve_mentions, ENTITY_RESOLUTION),
    "risk_levels": (
        lambda s, d: cases(s, d).select("doc_id", risk_level(F.concat(F.col("text"), F.when(F.col("day") % 3 == 0, " with a gun").when(F.col("day") % 3 == 1, " Assault").otherwise(""))).alias("risk_level")),
        sql(CASES, select="SELECT doc_id, CASE WHEN regexp_matches(x, 'arms|firearm|weapon|gun|pistol') THEN 'CRITICAL (ARMED)' WHEN regexp_matches(x, 'murder|302|307|arms|firearm|weapon|extortion|384|assault|violence|threat|392|397') THEN 'HIGH' ELSE 'STANDARD' END AS risk_level FROM (SELECT doc_id, lower(text || CASE day % 3 WHEN 0 THEN ' with a gun' WHEN 1 THEN ' Assault' ELSE '' END) AS x FROM cases)"),
    ),
    "evidence_hashes": (lambda s, d: cases(s, d).select("doc_id", evidence_hash(F.col("text")).alias("evidence_hash")), sql(CASES, select="SELECT doc_id, substr(sha256(text), 1, 16) AS evidence_hash FROM cases")),
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "merkle_root": (merkle, _merkle_sql()),
    "chain_validity": (chain_validity, _chain_sql()),
    "observed_contacts": (observed_contacts, "SELECT lpad((o_custkey % 700)::VARCHAR, 10, '7') AS value, count(DISTINCT o_custkey)::INTEGER AS n_ids, string_agg(DISTINCT 'N' || o_custkey, ',' ORDER BY 'N' || o_custkey) AS names FROM orders GROUP BY 1"),
    "bootstrap_entities": (
        bootstrap,
        "SELECT o_custkey::VARCHAR AS id, o_custkey::VARCHAR AS name, 'Unknown (auto-bootstrapped)' AS role, 'Unknown' AS cell, '70' || lpad(o_custkey::VARCHAR, 8, '0') AS phone, '' AS account FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) UNION ALL SELECT 'AUTO-001', 'AUTO-001', 'Unknown (auto-bootstrapped)', 'Unknown', '7999999999', ''",
    ),
}
