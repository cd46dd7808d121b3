"""Writing results: CSV logs, Parquet graphs, templates; a lock for writers of one folder."""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.session import by_rows
from netfusion.sources.schemas import COLUMNS, REQUIRED

RESOLUTION = ["master_id", "merged_ids", "method", "confidence", "name_score", "phone_score", "context_score", "source_id", "source_type", "evidence_snippet", "evidence_hash"]


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.select("row_no", "source_file", "reason", "confidence").write.mode("overwrite").csv(path, header=True)


def write_resolution(log: DataFrame, path: str) -> None:
    log.select(RESOLUTION).write.mode("overwrite").csv(path, header=True, escape='"')


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, case_id: str) -> None:
    """Nodes and edges under their case's partition; writing a case again replaces it alone."""
    for name, df, keys in (("nodes", nodes, ["id"]), ("edges", edges, None)):
        rows = df.dropDuplicates(keys) if keys else df
        rows.write.mode("overwrite").parquet(f"{path}/{name}/case_id={case_id}")


def read_graph(spark, path: str, case_id: str) -> tuple[DataFrame, DataFrame]:
    only = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").where(F.col("case_id") == case_id).drop("case_id")
    return only("nodes"), only("edges")


def clean(spark: SparkSession, *paths: str) -> int:
    """Removes what earlier runs wrote, through the file system that Spark writes to; how many of the paths there were."""
    jvm, gone = spark.sparkContext._jvm, 0
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def delete_case(spark: SparkSession, path: str, case_id: str) -> None:
    """A case's partitions; other cases stay."""
    clean(spark, *(f"{path}/{name}/case_id={case_id}" for name in ("nodes", "edges")))


def _versions(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of a merged table's newest version; (-1, None) if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return -1, None
    names = spark.read.text(f"{path}/versions").where("value <> ''").select(F.col("_metadata.file_name").cast("int").alias("k"), "value")
    newest = names.agg(F.max(F.struct("k", "value")).alias("v")).first().v
    return (newest.k, f"{path}/{newest.value}") if newest else (-1, None)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a merged table."""
    return spark.read.parquet(_versions(spark, path)[1])


def merge_rows(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert rows by keys (null is a key too): of each other column the later value stays unless it is null, columns may be added, and of
    rows with the same keys in one write the greatest value counts. The table is written as a new version, which readers see once a file
    with its number names it; only one writer can make that file, another one fails and may merge again. Merging the same rows again
    changes nothing, and a merge that fails leaves the version before; old versions stay until they are cleaned."""
    spark = rows.sparkSession
    k, old = _versions(spark, path)
    name, others = f"rows-{uuid.uuid4().hex}", [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in others)) if others else rows.select(*keys).distinct()
    one.write.parquet(f"{path}/in-{name}" if old else f"{path}/{name}")
    if old:  # both have each key once and their numbers are known: tasks are as many as rows need, and none is sorted before the exchange
        new, before = spark.read.schema(one.schema).parquet(f"{path}/in-{name}"), spark.read.parquet(old)
        both = new.withColumn("_new", F.lit(1)).unionByName(before.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        both, others = by_rows(both, new.count() + before.count(), *keys), [c for c in both.columns if c not in (*keys, "_new")]
        last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_new", F.col(c).alias("v"))))["v"].alias(c)
        out = both.groupBy(*keys).agg(*map(last, others)) if others else both.select(*keys).distinct()
        out.write.parquet(f"{path}/{name}")
        clean(spark, f"{path}/in-{name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{k + 1}")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    stream.write(bytearray(name.encode()))
    stream.close()


def write_datasets(datasets: dict[str, DataFrame], path: str) -> None:
    for name, df in datasets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def template(dataset: str) -> str:
    """An empty CSV file of a dataset."""
    out = io.StringIO()
    csv.writer(out).writerow(COLUMNS[dataset])
    return out.getvalue()


def catalogue() -> dict[str, dict]:
    """Columns and required groups of all datasets."""
    return {name: {"columns": columns, "required": [list(g) for g in REQUIRED.get(name, ())]} for name, columns in COLUMNS.items()}


@contextmanager
def exclusive(path: str) -> Iterator[None]:
    """A lock file that only one writer can hold."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)
