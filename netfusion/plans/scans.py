"""Queries that write the tables in a file format and read them back through the sources and sinks.

Each writes into a folder of its own under the shared one, so nothing depends on what ran before; results are compared with SQL over
the tables themselves.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.operators import faces, graph, ingest
from netfusion.plans.views import CALLS, CASES, EDGES, TXNS, calls, cases, edges, people, sql, table, txns
from netfusion.session import by_rows, shared_dir
from netfusion.service.engine import Case
from netfusion.service.store import CaseStore
from netfusion.sources import detect, files, sinks
from netfusion.sources.schemas import COLUMNS, FLAG


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scan-{name}-{uuid.uuid4().hex}"


def transfers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a transactions file; a nineth lack a day."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    s = lambda c: F.col(c).cast("string")
    return o.select(
        F.concat(F.lit("T"), s("o_orderkey")).alias("txn_id"), s("o_custkey").alias("sender_id"), F.concat(F.lit('Name "'), s("o_custkey"), F.lit('", Mr')).alias("sender_name"), F.lit("").alias("sender_account"), F.concat(F.lit("R"), (k % 97).cast("string")).alias("receiver_id"),
        F.lit("é").alias("receiver_name"), F.lit("A\nB").alias("receiver_account"), F.floor("o_totalprice").cast("long").cast("string").alias("amount_inr"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        F.when(k % 9 > 0, (k % 90 + 1).cast("string")).otherwise("").alias("day"), s("o_orderpriority").alias("txn_type"), F.lit("x").alias(FLAG),
    )


def fixed_csv(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = f"{folder(spark, 'fixed')}/transactions.csv"
    transfers(spark, d).write.csv(path, header=True, escape='"')
    return files.read_fixed_csv(spark, path, "transactions")


def scan_fixed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a file with the fixed header."""
    return fixed_csv(spark, d)[0]


FIXED = """SELECT 'T' || o_orderkey AS txn_id, o_custkey::VARCHAR AS sender_id, 'Name "' || o_custkey || '", Mr' AS sender_name, '' AS sender_account, 'R' || (o_orderkey % 97) AS receiver_id, 'é' AS receiver_name, 'A' || chr(10) || 'B' AS receiver_account,
  CAST(floor(o_totalprice) AS BIGINT) AS amount_inr, strftime(o_orderdate, '%Y-%m-%d') AS timestamp, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 90 + 1 AS INTEGER) END AS day, o_orderpriority AS txn_type, CASE WHEN o_orderkey % 9 = 0 THEN 0.3 END::DOUBLE AS _quarantine_confidence FROM orders"""


def quarantine_csv(spark: SparkSession, d: str) -> DataFrame:
    """What is quarantined, written as CSV and read back; counted, as the line of a row depends on how files are cut."""
    out = folder(spark, "quarantine")
    sinks.write_quarantine(fixed_csv(spark, d)[1], out)
    rows = spark.read.csv(out, header=True)
    return rows.groupBy("source_file", "reason", "confidence").agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("lines"))


def load_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder with one good file, one with another header, a directory and five missing ones."""
    at = folder(spark, "load")
    transfers(spark, d).write.csv(f"{at}/transactions.csv", header=True, escape='"')
    table(spark, d, "nation").write.csv(f"{at}/firs.csv", header=True)
    directory(spark, d, f"{at}/people_directory.json")
    tables, bad = files.load_all(spark, at)
    counts = None
    for name, rows in tables.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return counts.unionByName(bad.groupBy(F.concat_ws(": ", "source_file", "reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("what"), "name", "n"))


def uploaded(spark: SparkSession, d: str) -> Case:
    """A case of four files with headers of their own: calls and transfers by commas and semicolons, people by tabs in Latin-1, and
    a table of no dataset."""
    at = folder(spark, "upload")
    c = calls(spark, d).select(F.col("call_id").alias("CDR No"), F.when(F.col("call_id") % 10 > 0, F.concat(F.lit("U"), "caller")).alias("A Num"), F.concat(F.lit("U"), "callee").alias("B Num"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date-Time"), F.col("duration").alias("Call Length"), F.col("tower").alias("Tower ID"))
    c.write.csv(f"{at}/calls.csv", header=True)
    o = table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").alias("Trans ID"), F.concat(F.lit("U"), "o_custkey").alias("Payer ID"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("R"), F.col("o_orderkey") % 97)).alias("Beneficiary ID"), F.floor("o_totalprice").cast("string").alias("Txn Amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"))
    t.write.csv(f"{at}/bank.csv", header=True, sep=";")
    p = table(spark, d, "customer").select(F.concat(F.lit("U"), "c_custkey").alias("Person ID"), F.concat(F.lit("Zoé "), "c_name").alias("Full Name"), F.col("c_mktsegment").alias("Gang Cell"), F.concat(F.lit("70"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("Phone Number"), F.lit("").alias("Bank Account"))
    p.write.csv(f"{at}/people.csv", header=True, sep="\t", encoding="ISO-8859-1")
    table(spark, d, "region").write.csv(f"{at}/odd.csv", header=True)
    return Case.from_files(spark, [f"{at}/{n}.csv" for n in ("calls", "bank", "people", "odd")])


def uploaded_case(spark: SparkSession, d: str) -> DataFrame:
    """What files with foreign headers came to, and the ends of the graph that the case has of them."""
    case = uploaded(spark, d)
    out = None
    for name in ("cdrs", "transactions", "people_directory", "firs"):
        n = case.datasets[name].agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    out = out.unionByName(case.quarantine.groupBy(F.concat_ws(": ", "source_file", "reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("what"), "name", "n"))
    named = case.datasets["people_directory"].where("name LIKE 'Zo\u00e9 %'").agg(F.count("*").alias("n")).select(F.lit("named").alias("what"), F.lit("Zo\u00e9").alias("name"), "n")
    large = case.txns.where("amount >= 100000").groupBy(F.col("sender").alias("name")).agg(F.sum("amount").alias("n")).select(F.lit("sent").alias("what"), "name", "n")
    called = case.calls.groupBy(F.col("callee").alias("name")).agg(F.sum("duration").alias("n")).select(F.lit("heard").alias("what"), "name", "n")
    return out.unionByName(named).unionByName(large).unionByName(called)


UPLOADED_CASE = sql(
    CALLS,
    "good AS (SELECT * FROM calls WHERE call_id % 10 > 0)", "sent AS (SELECT * FROM orders WHERE o_orderkey % 4 > 0)",
    select="""SELECT 'rows' AS what, 'cdrs' AS name, count(*) AS n FROM good UNION ALL SELECT 'rows', 'transactions', count(*) FROM sent UNION ALL SELECT 'rows', 'people_directory', count(*) FROM customer UNION ALL SELECT 'rows', 'firs', 0
UNION ALL SELECT 'quarantine', 'calls.csv: Missing/invalid required field(s): caller_phone / caller_id', count(*) FROM calls WHERE call_id % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT 'quarantine', 'bank.csv: Missing/invalid required field(s): receiver_id / receiver_account', count(*) FROM orders WHERE o_orderkey % 4 = 0 HAVING count(*) > 0
UNION ALL SELECT 'quarantine', 'odd.csv: Unknown dataset', 1
UNION ALL SELECT 'named', 'Zoé', count(*) FROM customer
UNION ALL SELECT 'sent', 'U' || o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT FROM sent WHERE floor(o_totalprice) >= 100000 GROUP BY o_custkey
UNION ALL SELECT 'heard', 'U' || callee, sum(duration)::BIGINT FROM good GROUP BY callee""",
)


def directory(spark: SparkSession, d: str, path: str) -> None:
    """Customers as a people directory, those of BUILDING as noise."""
    p = people(spark, d).select(*(F.col("id").cast("string").alias("id") if c == "id" else F.col(c) if c in ("name", "role", "cell") else F.lit(None).cast("string").alias(c) for c in COLUMNS["people_directory"]))
    one = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in p.columns))
    noise = F.col("cell") == "BUILDING"
    lists = lambda c: F.array_sort(F.collect_list(F.when(c, one)))
    p.agg(lists(~noise).alias("network_people"), lists(noise).alias("noise_people")).coalesce(1).write.json(path)


def scan_people(spark: SparkSession, d: str) -> DataFrame:
    """S3."""
    path = f"{folder(spark, 'people')}/people_directory.json"
    directory(spark, d, path)
    return files.read_people(spark, path)[0].select("id", "name", "role", "cell", "is_noise")


def delimited(sep: str, encoding: str) -> object:
    """Tables with a sniffed delimiter and another encoding; blank rows go."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = folder(spark, "table")
        p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("Key No."), F.concat("p_name", F.lit(" é"), F.lit(sep), F.lit(' "q"')).alias(" Name "), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("Brand"))
        p.unionByName(spark.createDataFrame([("", " ", None)], p.schema)).write.csv(path, header=True, sep=sep, escape='"', encoding=encoding, emptyValue="")
        return files.read_table(spark, path, encoding=encoding).withColumnRenamed("Key No.", "key_no").withColumnRenamed("Name", "name").withColumnRenamed("Brand", "brand")

    return run


def _delimited(sep: str) -> str:
    return f"SELECT p_partkey::VARCHAR AS key_no, p_name || ' é{sep} \"q\"' AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE '' END AS brand FROM part"


def write_bytes(df: DataFrame, at: str) -> DataFrame:
    """Files (name, content) written under a folder by the tasks that have them; the number of each task's files."""

    def run(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for batch in batches:
            store, root = fs.FileSystem.from_uri(at.replace("s3a://", "s3://", 1))
            store.create_dir(root, recursive=True)
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return df.mapInPandas(run, "n long")


def scan_encodings(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each supplier in UTF-8 (with or without a mark) or Latin-1, decoded by trial into document rows."""
    at, k = folder(spark, "texts"), F.col("s_suppkey")
    text = F.concat(F.lit("FIR No. "), k.cast("string"), F.lit(" of 05/01/2026, accused: Ravi Kumar. Café near "), "s_name", F.lit(".\n\nSecond paragraph naïve "), k.cast("string"))
    content = F.when(k % 3 == 0, F.encode(text, "UTF-8")).when(k % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "ISO-8859-1"))
    write_bytes(table(spark, d, "supplier").select(F.concat(F.lit("n"), k.cast("string"), F.lit(".txt")).alias("name"), content.alias("content")), at).agg(F.sum("n")).collect()
    return files.read_documents(spark, at)[0]


DOCUMENT_ROWS = """SELECT 'n' || s_suppkey || '.txt' AS source, unnest([s_suppkey::VARCHAR, 'DOC-0002']) AS fir_id, unnest(['05/01/2026', NULL]) AS date, unnest(['Ravi Kumar', NULL]) AS accused_name,
  unnest(['FIR No. ' || s_suppkey || ' of 05/01/2026, accused: Ravi Kumar. Café near ' || s_name || '.', 'Second paragraph naïve ' || s_suppkey]) AS narrative FROM supplier"""


def docx(text: str) -> bytes:
    """A minimal OOXML document."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    paragraphs = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in text.split("\n"))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def pdf(text: str) -> bytes:
    """A minimal PDF with a compressed page."""
    import zlib

    lines = " ".join(f"({x.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj T*" for x in text.split("\n"))
    page = zlib.compress(f"BT /F1 12 Tf 14 TL 50 700 Td {lines} ET".encode("latin-1"))
    return b"%PDF-1.4\n4 0 obj <</Length " + str(len(page)).encode() + b" /Filter /FlateDecode>>\nstream\n" + page + b"\nendstream endobj\n%%EOF"


def scan_office(kind: str) -> object:
    """A DOCX or PDF for each supplier."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        make, at = (docx if kind == "docx" else pdf), folder(spark, kind)

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"name": [f"n{k}.{kind}" for k in b["s_suppkey"]], "content": [make(f"FIR No. {k} (first) & more\nMet {n} there") for k, n in zip(b["s_suppkey"], b["s_name"], strict=True)]})

        made = table(spark, d, "supplier").select("s_suppkey", "s_name").mapInPandas(write, "name string, content binary")
        write_bytes(made, at).agg(F.sum("n")).collect()
        return files.read_documents(spark, at)[0].select("source", "fir_id", "narrative")

    return run


def _office(kind: str) -> str:
    lines = "['FIR No. ' || s_suppkey || ' (first) & more', 'Met ' || s_name || ' there']"
    if kind == "docx":
        return f"SELECT 'n' || s_suppkey || '.docx' AS source, unnest([s_suppkey::VARCHAR, 'DOC-0002']) AS fir_id, unnest({lines}) AS narrative FROM supplier"
    return f"SELECT 'n' || s_suppkey || '.pdf' AS source, s_suppkey::VARCHAR AS fir_id, array_to_string({lines}, chr(10)) AS narrative FROM supplier"


def xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    """A minimal workbook with inline strings."""
    from xml.sax.saxutils import escape

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{r + 1}" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for k, c in enumerate(row) if c) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def scan_excel(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions as two sheets of one workbook, under the union of their headers."""
    grid = lambda df: [df.columns, *([str(x) for x in r] for r in df.collect())]  # noqa: E731  a workbook is one small file
    at = folder(spark, "xlsx")
    data = xlsx({"nations": grid(table(spark, d, "nation")), "regions": grid(table(spark, d, "region"))})
    write_bytes(spark.createDataFrame([("book.xlsx", bytearray(data))], "name string, content binary"), at).collect()
    return files.read_any(spark, f"{at}/book.xlsx")


EXCEL = """SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, '' AS r_regionkey, '' AS r_name, 'nations' AS _sheet FROM nation
UNION ALL SELECT '', '', '', r_regionkey::VARCHAR, r_name, 'regions' FROM region"""


def scan_json(spark: SparkSession, d: str) -> DataFrame:
    """Records under a key of one JSON object."""
    path = folder(spark, "json")
    rows = table(spark, d, "supplier").select(F.struct("s_suppkey", "s_name").alias("r"))
    rows.agg(F.array_sort(F.collect_list("r")).alias("records"), F.lit("x").alias("other")).coalesce(1).write.json(path)
    return files.read_json_records(spark, path)


def scan_zip(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations in an archive with files that mustn't be read; what was expanded is read by its format."""
    import tempfile

    csv = lambda df, sep: "\n".join(sep.join(map(str, r)) for r in [df.columns, *df.collect()]).encode()  # noqa: E731  an archive is one small file
    out = None
    with tempfile.TemporaryDirectory() as own:  # archives are expanded by the driver
        path = os.path.join(own, "a.zip")
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("case/nation.csv", csv(table(spark, d, "nation"), ","))
            z.writestr("region.tsv", csv(table(spark, d, "region"), "\t"))
            z.writestr("notes.txt", "Nothing but a story.\n")
            for bad in ("ground_truth/x.csv", "../up.csv", "a.exe", "docs/readme.txt"):
                z.writestr(bad, b"a,b\n1,2")
        os.mkdir(os.path.join(own, "in"))
        for found in files.expand_zip(path, os.path.join(own, "in")):
            with open(found, "rb") as f:
                row = spark.createDataFrame([(os.path.basename(found), bytearray(f.read()))], "name string, content binary")
            at = folder(spark, "unzipped")
            write_bytes(row, at).collect()
            rows = files.read_any(spark, f"{at}/{os.path.basename(found)}")
            tagged = rows.select(F.lit(os.path.basename(found)).alias("file"), F.to_json(F.struct(*rows.columns)).alias("row"))
            out = tagged if out is None else out.unionByName(tagged)
    return out


ZIP = """SELECT 'case_nation.csv' AS file, '{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"}' AS row FROM nation
UNION ALL SELECT 'region.tsv', '{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}' FROM region
UNION ALL SELECT 'notes.txt', '{"source":"notes.txt","fir_id":"DOC-0001","narrative":"Nothing but a story."}'"""


def formats(spark: SparkSession, d: str) -> DataFrame:
    """The format of each supplier's file, by its name or its beginning."""
    names = (".csv", ".XLSX", ".json", ".log", ".tsv", ".pdf", ".docx", ".bin", "")

    @F.pandas_udf("string")
    def detected(names: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([detect.detect_format(n, h.encode()) for n, h in zip(names, heads, strict=True)])

    k = F.col("s_suppkey")
    name = F.concat("s_name", F.element_at(F.array(*map(F.lit, names)), (k % 9 + 1).cast("int")))
    head = F.when(k % 2 == 0, '  [{"a": 1}]').otherwise("a;b\n1;2\n3;4\n")
    return table(spark, d, "supplier").select("s_suppkey", detected(F.replace(name, F.lit("#"), F.lit("-")), head).alias("format"))


FORMATS = "SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'json' WHEN 3 THEN 'txt' WHEN 4 THEN 'txt' WHEN 5 THEN 'pdf' WHEN 6 THEN 'docx' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'json' ELSE 'csv' END END AS format FROM supplier"


def described(spark: SparkSession, d: str) -> DataFrame:
    """What is said of a file: format, columns, dataset and mapping."""
    path = f"{folder(spark, 'describe')}/calls.csv"
    c = calls(spark, d).select(F.col("call_id").alias("CDR No"), F.col("caller").alias("Caller Number"), F.col("callee").alias("Called Party"), F.col("duration").alias("Talk Time"), F.col("tower").alias("Cell Site"))
    c.write.csv(path, header=True)
    found = files.describe(spark, path)
    mapped = sorted((t, s) for t, s in found["mapping"].items() if s)
    return spark.createDataFrame([(found["format"], found["dataset"], len(found["sample_rows"]), t, s) for t, s in mapped], "format string, dataset string, samples int, target string, source string")


DESCRIBED = """SELECT 'csv' AS format, 'cdrs' AS dataset, 3 AS samples, unnest(['call_id', 'callee_phone', 'caller_phone', 'cell_tower_location', 'duration_sec']) AS target, unnest(['CDR No', 'Called Party', 'Caller Number', 'Cell Site', 'Talk Time']) AS source"""


def graph_store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two cases' graphs written, one of them twice and a third deleted; the first as read back."""
    at, e = folder(spark, "graph"), edges(spark, d)
    nodes = people(spark, d).select("id", "cell")
    sinks.write_graph(nodes.limit(0), e.limit(0), at, "c1")
    sinks.write_graph(nodes.unionByName(nodes), e, at, "c1")
    sinks.write_graph(nodes.where("cell = 'BUILDING'"), e.where("kind = 'CALLED'"), at, "c2")
    sinks.write_graph(nodes, e, at, "c3")
    sinks.delete_case(spark, at, "c3")
    return sinks.read_graph(spark, at, "c1")


def graph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A case's edges and nodes as read back; nodes written twice are one."""
    nodes, e = graph_store(spark, d)
    return e.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"), F.sum("day").cast("long").alias("total")).unionByName(nodes.agg(F.count("*").alias("n"), F.sum("id").alias("total")).select(F.lit("nodes").alias("what"), "n", "total"))


def graph_merged(spark: SparkSession, d: str) -> DataFrame:
    """K4: two overlapping writes of edges and a repeated one, merged by ends and kind; the later write lacks some confidences."""
    most = table(spark, d, "events").count() + table(spark, d, "lineitem").count()
    dealt = by_rows(edges(spark, d), most, "src", "dst", "kind", "day")  # few edges come twice, so sums before an exchange hold nearly all rows of a task
    at, e = folder(spark, "merged"), dealt.groupBy("src", "dst", "kind").agg(F.min("day").alias("day"), F.min("confidence").alias("confidence"))
    keys = ["src", "dst", "kind"]
    sinks.merge_rows(e.where("kind = 'CALLED' OR src % 2 = 0"), at, keys)
    later = e.where("src % 3 = 0").select(*keys, (F.col("day") + 100).alias("day"), F.when(F.col("dst") % 2 == 0, 0.25).alias("confidence"), F.lit("second").alias("origin"))
    for _ in range(2):
        sinks.merge_rows(later, at, keys)
    return sinks.read_merged(spark, at)


MERGED = """SELECT src, dst, kind, CASE WHEN src % 3 = 0 THEN day + 100 ELSE day END AS day, CASE WHEN src % 3 = 0 AND dst % 2 = 0 THEN 0.25 WHEN kind = 'CALLED' OR src % 2 = 0 THEN confidence END AS confidence, CASE WHEN src % 3 = 0 THEN 'second' END AS origin
FROM (SELECT src, dst, kind, min(day) AS day, min(confidence) AS confidence FROM edges GROUP BY ALL) WHERE kind = 'CALLED' OR src % 2 = 0 OR src % 3 = 0"""


def graph_query(spark: SparkSession, d: str) -> DataFrame:
    """A read in SQL over the stored graph: who calls into another cell, and how often."""
    nodes, e = graph_store(spark, d)
    return graph.query(nodes, e, "SELECT a.id, count(*) AS n FROM {edges} e JOIN {nodes} a ON a.id = e.src JOIN {nodes} b ON b.id = e.dst WHERE e.kind = :kind AND a.cell <> b.cell GROUP BY a.id", kind="CALLED")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a case saved, updated and loaded; a table that it lacks comes from the default."""
    import tempfile

    with tempfile.TemporaryDirectory() as own:  # a store's metadata lie with the driver
        store = CaseStore(own, tables=folder(spark, "cases"))
        case = store.create("one", "officer")["id"]
        store.save(case, transactions=txns(spark, d))
        store.update(case, status="ready")
        t = store.load(spark, case, "transactions").groupBy("txn_type").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
        other = store.load(spark, case, "firs", default=table(spark, d, "nation")).agg(F.count("*").alias("n"))
        status = store.get(case)["status"]
        out = t.unionByName(other.select(F.lit("default").alias("txn_type"), "n", F.lit(None).cast("long").alias("amount"))).withColumn("status", F.lit(status))
        return spark.createDataFrame(out.collect(), out.schema)  # a row for each type


def case_list(spark: SparkSession, d: str) -> DataFrame:
    """Of ten cases the newest eight stay, newest first; one is deleted."""
    import tempfile

    with tempfile.TemporaryDirectory() as own:
        store = CaseStore(own)
        for k in range(10):
            made = store.create(f"case {k}")
            store.update(made["id"], created=1000.0 + k)
        store.delete(next(m["id"] for m in store.list() if m["name"] == "case 5"))
        return spark.createDataFrame([(i, m["name"]) for i, m in enumerate(store.list())], "place int, name string")


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Events appended one by one, read back newest first."""
    from netfusion.service import store

    path = folder(spark, "audit")
    for k in range(3):
        store.audit(spark, path, f"user{k}", f"/why/{k}", [str(i) for i in range(60 * k)])
    rows = store.audit_trail(spark, path, "WHY")
    return rows.select("user", "query", F.size("result_ids").alias("kept"))


def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """Pages as binary files, scanned into an index that is kept and searched; the first page itself comes first."""
    at, cache = folder(spark, "images"), folder(spark, "index")
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".bin")).alias("name"), F.col("html").cast("binary").alias("content"))
    write_bytes(pages, at).agg(F.sum("n")).collect()
    index = faces.cached_index(faces.index_files(faces.scan_files(spark, at, "*.bin"), "name"), cache)
    again = faces.cached_index(index.limit(0), cache)  # comes from the cache
    return again.join(F.broadcast(again.where("id = 'p0.bin'").select(F.col("embedding").alias("q")))).select("id", (F.size("embedding")).alias("dims"), (F.col("embedding") == F.col("q")).alias("same"))


def templates(spark: SparkSession, d: str) -> DataFrame:
    """K8: the template of each dataset, as the catalogue lists it."""
    return spark.createDataFrame([(n, sinks.template(n).strip(), len(c["columns"]), len(c["required"])) for n, c in sinks.catalogue().items()], "dataset string, header string, columns int, required int")


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """A lock that one writer holds, and the removal of what earlier runs wrote."""
    import tempfile

    at = folder(spark, "clean")
    table(spark, d, "nation").write.parquet(f"{at}/a")
    table(spark, d, "region").write.parquet(f"{at}/b")
    with tempfile.TemporaryDirectory() as own, sinks.exclusive(f"{own}/lock"):
        try:
            with sinks.exclusive(f"{own}/lock"):
                second = True
        except FileExistsError:
            second = False
        gone = sinks.clean(spark, f"{at}/a", f"{at}/none")
    return spark.createDataFrame([(second, gone, spark.read.parquet(f"{at}/b").count())], "second_writer boolean, removed int, left long")


def resolution_log(spark: SparkSession, d: str) -> DataFrame:
    """K2: resolution rows written as CSV and read back, quotes and line ends kept."""
    out, s = folder(spark, "resolution"), F.col("s_suppkey").cast("string")
    log = table(spark, d, "supplier").select(
        s.alias("master_id"), F.concat(F.lit('"'), "s_name", F.lit('", x')).alias("merged_ids"), F.lit("fuzzy").alias("method"), F.lit(0.91).alias("confidence"), F.lit(90.0).alias("name_score"), F.lit(0.0).alias("phone_score"), F.lit(0.5).alias("context_score"), s.alias("source_id"),
        F.lit("fir").alias("source_type"), F.lit("a\nb").alias("evidence_snippet"), F.lit("00").alias("evidence_hash"), F.lit("dropped").alias("more"),
    )
    sinks.write_resolution(log, out)
    return spark.read.csv(out, header=True, multiLine=True, escape='"')


def normalized(dataset: str, **columns: Column) -> object:
    """A dataset normalised from other headers, with blanks filled; row numbers follow the key."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = table(spark, d, "supplier").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey").select(*(c.alias(n) for n, c in columns.items()))
        out = ingest.normalize(ingest.apply_mapping(raw, detect.suggest_mapping(raw.columns, dataset)), dataset)
        return out.drop("row_no")

    return run


K = F.col
_K = "s_suppkey"
_N = "row_number() OVER (ORDER BY s_suppkey)"


def _s() -> Column:
    return K(_K).cast("string")


def _sometimes(value: Column, n: int) -> Column:
    return F.when(K(_K) % n == 0, "  ").otherwise(value)


NORMALIZED = {
    "normalized_calls": (
        lambda s, d: normalized("cdrs", **{"CDR No": _sometimes(_s(), 4), "Calling Number": F.concat(F.lit("+91 98765 "), F.lpad(_s(), 5, "0")), "Called Party": F.lpad(_s(), 10, "7"), "Talk Time": F.concat(_s(), F.lit(" min")), "Call Date": F.lit("05/01/2026"), "Tower ID": _sometimes(K("s_name"), 3)})(s, d),
        f"""SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'GEN-CDR' || lpad(({_N})::VARCHAR, 5, '0') ELSE s_suppkey::VARCHAR END AS call_id, '+91 98765 ' || lpad(s_suppkey::VARCHAR, 5, '0') AS caller_id, '' AS caller_name, '98765' || lpad(s_suppkey::VARCHAR, 5, '0') AS caller_phone,
  lpad(s_suppkey::VARCHAR, 10, '7') AS callee_id, '' AS callee_name, lpad(s_suppkey::VARCHAR, 10, '7') AS callee_phone, '2026-01-05 00:00:00' AS timestamp, 5 AS day, 'voice' AS call_type, s_suppkey * 60 AS duration_sec, CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown' ELSE s_name END AS cell_tower_location FROM supplier""",
    ),
    "normalized_firs": (
        lambda s, d: normalized("firs", **{"FIR No": _sometimes(_s(), 4), "Police Station": K("s_name"), "Incident Details": F.concat(F.lit("Seen "), _s()), "Incident Date": F.lit("2026-02-01"), "Accused": _sometimes(F.lit("Ravi"), 2)})(s, d),
        f"""SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'GEN-FIR' || lpad(({_N})::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS fir_id, '2026-02-01 00:00:00' AS date, 32 AS day, s_name AS station, '' AS location, '' AS ipc_sections, 'Seen ' || s_suppkey AS narrative, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Ravi' END AS accused_name, '' AS complainant_name FROM supplier""",
    ),
    "normalized_posts": (
        lambda s, d: normalized("social_posts", **{"Tweet ID": _sometimes(_s(), 4), "User": K("s_name"), "Message": F.concat(F.lit("Hi "), _s()), "Date": F.lit("2026-01-02"), "Tags": F.lit("#x")})(s, d),
        f"SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'GEN-POST' || lpad(({_N})::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS post_id, s_name AS handle, '' AS person_id, '2026-01-02 00:00:00' AS timestamp, 2 AS day, '' AS location_tag, 'Hi ' || s_suppkey AS post_text, '#x' AS hashtags FROM supplier",
    ),
    "normalized_history": (
        lambda s, d: normalized("criminal_history", **{"Sheet No": _sometimes(_s(), 4), "Full Name": _sometimes(K("s_name"), 5), "AKA": F.lit("Nick"), "Birth Date": F.lit("01-02-1990"), "Convictions": F.lit("302"), "Gang": F.lit("G"), "Hideout": F.lit("H")})(s, d),
        f"""SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'GEN-REC' || lpad(({_N})::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS record_id, CASE WHEN s_suppkey % 5 = 0 THEN 'Nick' ELSE s_name END AS person_id, CASE WHEN s_suppkey % 5 = 0 THEN 'Nick' ELSE s_name END AS name, 'Nick' AS alias, '1990-02-01 00:00:00' AS dob,
  '302' AS prior_offences, 'G' AS gang_affiliation, 'H' AS known_address FROM supplier""",
    ),
    "normalized_intelligence": (
        lambda s, d: normalized("intelligence_reports", **{"Intel ID": _sometimes(_s(), 4), "Report Date": F.lit("2026-01-03"), "Grading": F.lit("B2"), "Summary": K("s_name"), "Entities": _s()})(s, d),
        f"SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'GEN-INTEL' || lpad(({_N})::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS report_id, '2026-01-03 00:00:00' AS date, 3 AS day, 'B2' AS source_reliability, s_name AS narrative, s_suppkey::VARCHAR AS mentioned_entity_ids FROM supplier",
    ),
    "normalized_surveillance": (
        lambda s, d: normalized("surveillance_reports", **{"Surveillance ID": _sometimes(_s(), 4), "Unit": F.lit("U"), "Place": K("s_name"), "Certainty": F.lit("High"), "Observations": F.concat(F.lit("Saw "), _s()), "Date": F.lit("2026-01-04")})(s, d),
        f"SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'GEN-SURV' || lpad(({_N})::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS report_id, '2026-01-04 00:00:00' AS date, 4 AS day, 'U' AS team, s_name AS location, 'High' AS confidence, 'Saw ' || s_suppkey AS activity_notes FROM supplier",
    ),
}


def clean_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header names cleaned; the part types stand for them."""

    @F.pandas_udf("string")
    def clean(names: pd.Series) -> pd.Series:
        return names.map(detect.clean_header)

    raw = F.concat(F.lit("  "), F.initcap("p_type"), F.lit(" No./"), F.col("p_size").cast("string"), F.lit("-é_ "))
    return table(spark, d, "part").select("p_partkey", clean(raw).alias("header"))


def detected_types(spark: SparkSession, d: str) -> DataFrame:
    """The dataset of each kind's own header, if its own mapping is valid, and a reviewed one."""
    rows = []
    for name, columns in COLUMNS.items():
        kind, _ = detect.detect_type(columns)
        mapping = detect.suggest_mapping(columns, name)
        reviewed = detect.review_mapping(columns, name, {columns[0]: None})
        rows.append((name, kind, detect.validate_mapping(mapping, name)[0], sum(c is not None for c in reviewed.values())))
    return spark.createDataFrame(rows, "dataset string, detected string, valid boolean, mapped int")


_TYPES = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{n}', TRUE, {len(c) - 1})" for n, c in COLUMNS.items()) + ") t(dataset, detected, valid, mapped)"


def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    """P9."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    raw = o.select(F.when(k % 2 == 0, k.cast("string")).alias("txn_id"), F.when(k % 2 == 1, k.cast("string")).otherwise("").alias("fir_id"), F.when(k % 3 == 0, "x").otherwise(F.concat(F.lit(" "), (k % 90).cast("string"))).alias("day"), F.format_string("%,d", F.floor("o_totalprice").cast("long")).alias("amount_inr"))
    return ingest.normalize_record(raw, "orders").select("_source_id", "_source_type", "day", "amount_inr")


QUERIES = {
    "uploaded_case": (uploaded_case, UPLOADED_CASE),
    "scan_fixed_csv": (scan_fixed_csv, FIXED),
    "quarantine_csv": (quarantine_csv, "SELECT 'transactions.csv' AS source_file, 'Missing day' AS reason, '0.3' AS confidence, count(*) AS n, count(*) AS lines FROM orders WHERE o_orderkey % 9 = 0"),
    "load_folder": (
        load_folder,
        """SELECT 'rows' AS what, 'transactions' AS name, count(*) AS n FROM orders UNION ALL SELECT 'rows', 'people_directory', count(*) FROM customer UNION ALL SELECT 'rows', unnest(['cdrs', 'firs', 'social_posts', 'criminal_history', 'intelligence_reports', 'surveillance_reports']), 0
UNION ALL SELECT 'quarantine', 'transactions.csv: Missing day', count(*) FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'quarantine', 'firs.csv: Header mismatch: n_nationkey, n_name, n_regionkey', 1
UNION ALL SELECT 'quarantine', unnest(['cdrs', 'social_posts', 'criminal_history', 'intelligence_reports', 'surveillance_reports']) || '.csv: File not found', 1""",
    ),
    "scan_people": (scan_people, "SELECT c_custkey::VARCHAR AS id, c_name AS name, n_name AS role, c_mktsegment AS cell, c_mktsegment = 'BUILDING' AS is_noise FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "scan_semicolons": (delimited(";", "UTF-8"), _delimited(";")),
    "scan_latin_tabs": (delimited("\t", "ISO-8859-1"), _delimited("\t")),
    "scan_encodings": (scan_encodings, DOCUMENT_ROWS),
    "scan_docx": (scan_office("docx"), _office("docx")),
    "scan_pdf": (scan_office("pdf"), _office("pdf")),
    "scan_excel": (scan_excel, EXCEL),
    "scan_json": (scan_json, "SELECT s_suppkey, s_name FROM supplier"),
    "scan_zip": (scan_zip, ZIP),
    "file_formats": (formats, FORMATS),
    "file_described": (described, DESCRIBED),
    "graph_roundtrip": (graph_roundtrip, sql(CALLS, TXNS, EDGES, select="SELECT kind AS what, count(*) AS n, sum(day)::BIGINT AS total FROM edges GROUP BY kind UNION ALL SELECT 'nodes', count(*), sum(c_custkey)::BIGINT FROM customer")),
    "graph_merged": (graph_merged, sql(CALLS, TXNS, EDGES, select=MERGED)),
    "graph_query": (graph_query, sql(CALLS, select="SELECT caller AS id, count(*) AS n FROM calls JOIN customer a ON a.c_custkey = caller JOIN customer b ON b.c_custkey = callee WHERE a.c_mktsegment <> b.c_mktsegment GROUP BY caller")),
    "case_snapshots": (snapshots, sql(TXNS, select="SELECT txn_type, count(*) AS n, sum(amount)::BIGINT AS amount, 'ready' AS status FROM txns GROUP BY txn_type UNION ALL SELECT 'default', count(*), NULL, 'ready' FROM nation")),
    "case_list": (case_list, "SELECT CAST(i AS INTEGER) AS place, 'case ' || n AS name FROM (SELECT unnest(range(7)) AS i, unnest([9, 8, 7, 6, 4, 3, 2]) AS n)"),
    "audit_log": (audit_log, "SELECT 'user' || k AS user, '/why/' || k AS query, CAST(least(50, 60 * k) AS INTEGER) AS kept FROM (SELECT unnest(range(3)) AS k)"),
    "vector_cache": (vector_cache, "SELECT 'p' || page_id || '.bin' AS id, 128 AS dims, html = (SELECT html FROM pages WHERE page_id = 0) AS same FROM pages"),
    "templates": (templates, "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{','.join(c)}', {len(c)}, {len(sinks.REQUIRED[n])})" for n, c in COLUMNS.items()) + ") t(dataset, header, columns, required)"),
    "cleaned_artifacts": (cleaned, "SELECT FALSE AS second_writer, 1 AS removed, count(*) AS \"left\" FROM region"),
    "resolution_csv": (resolution_log, "SELECT s_suppkey::VARCHAR AS master_id, '\"' || s_name || '\", x' AS merged_ids, 'fuzzy' AS method, '0.91' AS confidence, '90.0' AS name_score, '0.0' AS phone_score, '0.5' AS context_score, s_suppkey::VARCHAR AS source_id, 'fir' AS source_type, 'a' || chr(10) || 'b' AS evidence_snippet, '00' AS evidence_hash FROM supplier"),
    "clean_headers": (clean_headers, "SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(lower('  ' || p_type || ' No./' || p_size || '-é_ '), '[^0-9a-z]+', '_', 'g'), '_+', '_', 'g'), '_'), 'é', '', 'g') AS header FROM part"),
    "detected_types": (detected_types, _TYPES),
    "normalized_records": (normalized_records, "SELECT o_orderkey::VARCHAR AS _source_id, 'orders' AS _source_type, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 90 AS INTEGER) END AS day, CAST(floor(o_totalprice) AS BIGINT) AS amount_inr FROM orders"),
} | NORMALIZED
