"""Naming documents without relying on unique ids, and narrowing joins before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import written

#: The most hashes that narrow() broadcasts, as ints.
PICKS = 1 << 20


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), and did and th, which name a document by its id and text; equal rows have equal names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    did = F.col("doc_id").cast("long")
    return documents.select(did.alias("doc_id"), text.alias("text"), F.coalesce(did, F.lit(0)).alias("did"), F.xxhash64(text, did.isNull()).alias("th"))


def _pick(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PICKS)).cast("int")


def narrow(rows: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows cut in two: those that may have their key among ``keys``, and those that don't.

    A set of at most PICKS hashes is broadcast, whatever the number of keys; once it is full it narrows nothing and the join that
    follows shuffles all rows.
    """
    picks = F.broadcast(written(keys.select(_pick(*columns).alias("_pick")).distinct(), "picks"))
    rows = rows.withColumn("_pick", _pick(*columns))
    return rows.join(picks, "_pick", "left_semi").drop("_pick"), rows.join(picks, "_pick", "left_anti").drop("_pick")
