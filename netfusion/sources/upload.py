"""From files of any supported format, whatever their headers, to a case's datasets: read, detect, map, normalise, quarantine."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.operators.ingest import apply_mapping, normalize, split_quarantine
from netfusion.operators.ranking import number_rows
from netfusion.sources.detect import detect_type, suggest_mapping, validate_mapping
from netfusion.sources.files import quarantine, read_any
from netfusion.sources.schemas import COLUMNS, INTEGERS, LONGS

PEOPLE_MORE = {"is_noise": "boolean", "ordinal": "int"}


@dataclass
class Upload:
    """What files came to: the datasets of a case (empty ones where no file has any), the quarantine, and for each file its dataset, the
    confidence of that and the mapping used."""

    datasets: dict[str, DataFrame]
    quarantine: DataFrame
    files: dict[str, tuple[str, float, dict[str, str | None]]]


def _kind(column: str) -> str:
    return "int" if column in INTEGERS else "bigint" if column in LONGS else "string"


def _shaped(rows: DataFrame, dataset: str) -> DataFrame:
    """A dataset's columns in order and of their types; missing ones are empty, or null if they aren't text."""
    have = {*rows.columns}
    empty = lambda c: F.lit("" if _kind(c) == "string" else None)
    out = [(F.col(c) if c in have else empty(c)).try_cast(_kind(c)).alias(c) for c in COLUMNS[dataset]]
    if dataset == "people_directory":
        out += [F.lit(False).alias("is_noise"), F.col("row_no").cast("int").alias("ordinal")]
    return rows.select(*out)


def _empty(spark: SparkSession, dataset: str) -> DataFrame:
    more = PEOPLE_MORE if dataset == "people_directory" else {}
    return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in ({c: _kind(c) for c in COLUMNS[dataset]} | more).items()))


def upload(spark: SparkSession, paths: Sequence[str], mappings: Mapping[str, Mapping[str, str | None]] | None = None) -> Upload:
    """Files into datasets. A file's columns tell its dataset; its mapping is the suggested one, or that of its name in ``mappings`` (from
    target columns to its own), whose targets tell the dataset if its columns don't. A file of no known dataset, or one whose mapping lacks a required field, is quarantined as a whole, in one row;
    of the others, rows without what they need are. Files of one dataset are put together in the order given."""
    found: dict[str, DataFrame] = {}
    bad, files = quarantine(spark), {}
    for path in paths:
        name = os.path.basename(path.rstrip("/"))
        rows = read_any(spark, path)
        dataset, confidence = detect_type(rows.columns)
        given = (mappings or {}).get(name)
        if given and dataset not in COLUMNS:
            dataset, confidence = detect_type([t for t, c in given.items() if c])
        mapping = dict(given or (suggest_mapping(rows.columns, dataset) if dataset in COLUMNS else {}))
        files[name] = (dataset, confidence, mapping)
        valid, missing = validate_mapping(mapping, dataset) if dataset in COLUMNS else (False, [])
        if not valid:
            reason = f"No column for: {', '.join(missing)}" if dataset in COLUMNS else "Unknown dataset"
            bad = bad.unionByName(quarantine(spark, [(0, name, reason, float(confidence))]))
            continue
        # what a row lacks is judged before normalising gives it ids of its own
        good, wrong = split_quarantine(number_rows(apply_mapping(rows, mapping)), dataset, name)
        good = _shaped(normalize(good.drop("row_no"), dataset), dataset)
        found[dataset] = found[dataset].unionByName(good) if dataset in found else good
        bad = bad.unionByName(wrong)
    return Upload({k: found.get(k) if k in found else _empty(spark, k) for k in COLUMNS}, bad, files)
