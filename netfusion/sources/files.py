"""Reading files into DataFrames of strings, with a quarantine for what can't be used."""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netfusion.operators.ranking import number_rows
from netfusion.sources.detect import decode, detect_format, detect_type, is_table, sniff_delimiter, suggest_mapping
from netfusion.sources.schemas import COLUMNS, FLAG, INTEGERS, LONGS

QUARANTINE = "row_no int, source_file string, reason string, confidence double"
#: Archive folders that are never read.
BLOCKED = {"ground_truth", "evaluation", "benchmark", "benchmarks", "docs", ".git", "__macosx"}
NARRATIVE_CHARS = 4000


def quarantine(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), QUARANTINE)


def read_fixed_csv(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """A dataset with its fixed header, and quarantine rows. A missing file or another header gives no rows and one quarantine row. Rows
    without a day stay, tagged with confidence 0.3 and logged; the evaluation column goes. Numbers are parsed, bad ones become null."""
    want, name = COLUMNS[dataset], os.path.basename(path)
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except Exception as e:  # Spark raises an analysis error for a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in want)), quarantine(spark, [(0, name, "File not found", 0.0)])
    if [c for c in raw.columns if c != FLAG] != want:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in want)), quarantine(spark, [(1, name, f"Header mismatch: {', '.join(raw.columns)}", 0.0)])
    typed = [F.col(c).try_cast("int").alias(c) if c in INTEGERS else F.col(c).try_cast("long").alias(c) if c in LONGS else F.coalesce(c, F.lit("")).alias(c) for c in want]
    rows = raw.select(*typed)
    if "day" not in want:
        return rows, quarantine(spark)
    numbered = number_rows(rows)
    bad = numbered.where("day IS NULL").select((F.col("row_no") + 1).cast("int").alias("row_no"), F.lit(name).alias("source_file"), F.lit("Missing day").alias("reason"), F.lit(0.3).alias("confidence"))
    return rows.withColumn("_quarantine_confidence", F.when(F.col("day").isNull(), 0.3)), bad


def read_people(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The directory's network and noise people as one table with is_noise and ordinal."""
    want = COLUMNS["people_directory"]
    schema = f"network_people array<struct<{', '.join(f'{c}:string' for c in want)}>>, noise_people array<struct<{', '.join(f'{c}:string' for c in want)}>>"
    try:
        raw = spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in want) + ", is_noise boolean, ordinal int"), quarantine(spark, [(0, os.path.basename(path), "File not found", 0.0)])
    part = lambda c, noise: raw.select(F.posexplode(c).alias("ordinal", "p")).select("p.*", F.lit(noise).alias("is_noise"), (F.col("ordinal") + (10_000_000 if noise else 0)).alias("ordinal"))
    return part("network_people", False).unionByName(part("noise_people", True)), quarantine(spark)


def load_all(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The seven datasets and the directory of a folder, and the quarantine of all."""
    out, bad = {}, quarantine(spark)
    for name in COLUMNS:
        rows, q = read_people(spark, f"{folder}/{name}.json") if name == "people_directory" else read_fixed_csv(spark, f"{folder}/{name}.csv", name)
        out[name], bad = rows, bad.unionByName(q)
    return out, bad


def table_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding of the trial in which every line can be read: UTF-8, or Latin-1, which takes any byte. Lines are judged by tasks."""
    return "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """Any delimited text with a header, as strings: cells trimmed of nothing, missing ones empty, blank rows dropped, line ends in quotes
    kept. The delimiter is sniffed from the first lines, the encoding is tried on all of them unless it is given."""
    if encoding is None:
        encoding = table_encoding(spark, path)
    if delimiter is None:
        delimiter = sniff_delimiter("\n".join(r.value for r in spark.read.option("encoding", encoding).text(path).limit(20).collect()))
    raw = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, escape='"', encoding=encoding, mode="PERMISSIVE")
    raw = raw.toDF(*(c.strip().lstrip("﻿") for c in raw.columns)).na.fill("")
    return raw.where(F.exists(F.array(*(F.col(f"`{c}`") for c in raw.columns)), lambda x: F.trim(x) != ""))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: a list, or an object's network_people (with noise_people), data or records, else the object itself."""
    raw = spark.read.json(path, multiLine=True)
    arrays = {f.name for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    for keys in (("network_people", "noise_people"), ("data",), ("records",)):
        if keys[0] in arrays:
            parts = [raw.select(F.explode(k).alias("r")).select("r.*") for k in keys if k in arrays]
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more, allowMissingColumns=True)
            return out
    return raw


FIR_NO = r"(?i)\bFIR\s*(?:No\.?|Number)?\s*[:#-]?\s*(\d+[\w\-/]*)"
DATE = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})"
ACCUSED = r"(?i:accused)\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"


def document_rows(texts: DataFrame) -> DataFrame:
    """A row for each paragraph of texts (source, text): fir_id, date, accused_name, narrative (4000 characters at most). Without blank lines
    the lines over 40 characters are taken, and without those the first 2000 characters."""
    bare = lambda c: F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
    t = texts.select("source", bare(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    full = lambda parts: F.filter(F.transform(parts, bare), lambda p: p != "")
    by_blank = full(F.split("text", r"\n\s*\n"))
    by_line = F.filter(full(F.split("text", "\n")), lambda p: F.length(p) > 40)
    parts = F.when(F.size(by_blank) > 1, by_blank).when(F.size(by_line) > 0, by_line).otherwise(F.array(F.substring("text", 1, 2000)))
    rows = t.select("source", F.posexplode(parts).alias("k", "p"))
    grab = lambda pattern: F.nullif(F.regexp_extract("p", pattern, 1), F.lit(""))
    number = F.coalesce(grab(FIR_NO), F.format_string("DOC-%04d", F.col("k") + 1))
    return rows.select("source", number.alias("fir_id"), grab(DATE).alias("date"), grab(ACCUSED).alias("accused_name"), F.substring("p", 1, NARRATIVE_CHARS).alias("narrative"))


def docx_text(data: bytes) -> str:
    """Paragraphs of an OOXML document."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return "\n\n".join(x for p in root.iter(f"{w}p") if (x := "".join(t.text or "" for t in p.iter(f"{w}t"))).strip())


_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|Td|TD|Tm|Tj|TJ|ET|['\"]", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(data: bytes) -> str:
    """The text that a PDF's pages show: strings of their content streams (plain or deflated) in order, a line for each move to another
    one. Fonts with encodings of their own come out as their bytes; a file without text operators, such as a scan, gives ''."""
    lines: list[bytes] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        content = m[1]
        try:
            content = zlib.decompress(content)
        except zlib.error:
            pass
        for block in re.findall(rb"BT\b(.*?\bET)\b", content, re.S):
            line = b""
            for token in _PDF_TOKEN.findall(block):
                if token[:1] == b"(":
                    octal = re.sub(rb"\\([0-7]{1,3})", lambda x: bytes([int(x[1], 8) & 255]), token[1:-1])
                    line += re.sub(rb"\\(.)", lambda x: _PDF_ESCAPES.get(x[1], x[1]), octal, flags=re.S)
                elif token[:1] == b"<":
                    digits = re.sub(rb"\s", b"", token[1:-1])
                    line += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"') and line:
                    lines.append(line)
                    line = b""
    return "\n".join(x.decode("latin-1") for x in lines if x.strip())


def xlsx_rows(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """(sheet, cells) of every row of a workbook, cells as strings, in order."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    r = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            target = links[sheet.get(r)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in root.iter(f"{m}row"):
                cells: list[str] = []
                for c in row.iter(f"{m}c"):
                    at = 0
                    for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (max(at, len(cells) + 1) - len(cells) - 1)
                    v, inline = c.find(f"{m}v"), c.find(f"{m}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{m}t")) if inline is not None else "" if v is None else v.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" else text)
                yield sheet.get("name"), cells


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of a workbook as strings under the union of their headers, tagged with _sheet; empty rows go."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    heads: dict[str, list[str]] = {}
    rows, columns = [], {}
    for sheet, cells in xlsx_rows(bytes(data)):
        if sheet not in heads:
            heads[sheet] = cells
            columns |= dict.fromkeys(c for c in cells if c)
        elif any(c.strip() for c in cells):
            rows.append({**{c: "" for c in columns}, **{h: c for h, c in zip(heads[sheet], cells, strict=False) if h}, "_sheet": sheet})
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_sheet"]])
    return spark.createDataFrame([tuple(r.get(c, "") for c in schema.names) for r in rows], schema)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Paragraph rows of DOCX, PDF or text documents under a path, decoded where they lie; a PDF without text (a scan) is quarantined."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,txt,log,pdf}").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                kind = detect_format(name)
                texts.append(pdf_text(bytes(content)) or None if kind == "pdf" else docx_text(bytes(content)) if kind == "docx" else decode(bytes(content)))
            yield pd.DataFrame({"source": [os.path.basename(p) for p in batch["path"]], "text": texts})

    texts = files.mapInPandas(run, "source string, text string")
    bad = texts.where("text IS NULL").select(F.lit(0).alias("row_no"), F.col("source").alias("source_file"), F.lit("No text could be extracted").alias("reason"), F.lit(0.0).alias("confidence"))
    return document_rows(texts.where("text IS NOT NULL")), bad


def expand_zip(path: str, into: str) -> list[str]:
    """Files of an archive written under ``into``, named by folder; blocked folders, unknown suffixes and paths that lead out are skipped."""
    out = []
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            parts = [p for p in info.filename.replace("\\", "/").split("/") if p]
            if info.is_dir() or not parts or ".." in parts or info.filename.startswith("/") or {p.lower() for p in parts[:-1]} & BLOCKED or detect_format(parts[-1]) == "unknown":
                continue
            target = os.path.join(into, "_".join(parts))
            with open(target, "wb") as f:
                f.write(z.read(info))
            out.append(target)
    return sorted(out)


def read_any(spark: SparkSession, path: str, head: bytes = b"") -> DataFrame:
    """Rows of a file of any supported format, as they are."""
    kind = detect_format(path, head)
    if kind == "csv":
        return read_table(spark, path)
    if kind == "json":
        return read_json_records(spark, path)
    if kind == "xlsx":
        return read_excel(spark, path)
    if kind == "txt":
        first = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
        if is_table(first, "." + path.rsplit(".", 1)[-1]):
            return read_table(spark, path, "\t" if path.endswith(".tsv") else None)
    return read_documents(spark, path)[0]


def describe(spark: SparkSession, path: str, sample: int = 3) -> dict:
    """Format, columns, sample rows, detected dataset with confidence, and the suggested mapping of a file."""
    rows = read_any(spark, path)
    dataset, confidence = detect_type(rows.columns)
    return {"format": detect_format(path), "columns": rows.columns, "sample_rows": [r.asDict() for r in rows.limit(sample).collect()], "dataset": dataset, "confidence": confidence, "mapping": suggest_mapping(rows.columns, dataset)}
