"""Cases as folders of Parquet with a little metadata, and the audit log."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netfusion.sources.sinks import clean

KEPT = 8


class CaseStore:
    """Creates, lists (newest first), loads and deletes cases; beyond the KEPT newest ones they are pruned.

    root: where the driver keeps their metadata; tables: where Spark writes their tables, a folder that executors share (``root`` if not given).
    """

    def __init__(self, root: str, kept: int = KEPT, tables: str | None = None):
        self.root, self.kept = Path(root), kept
        self.root.mkdir(parents=True, exist_ok=True)
        self.tables = (tables or str(self.root)).rstrip("/")

    def path(self, case_id: str) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", case_id):
            raise ValueError("bad case id")
        return self.root / case_id

    def create(self, name: str, officer: str = "") -> dict:
        meta = {"id": uuid.uuid4().hex[:12], "name": name, "officer": officer, "created": time.time(), "status": "created"}
        self.path(meta["id"]).mkdir()
        self._write(meta)
        for old in self.list(None)[self.kept :]:
            self.delete(old["id"])
        return meta

    def _write(self, meta: dict) -> None:
        target = self.path(meta["id"]) / "meta.json"
        temporary = target.with_suffix(".tmp")
        temporary.write_text(json.dumps(meta))
        os.replace(temporary, target)

    def get(self, case_id: str) -> dict:
        return json.loads((self.path(case_id) / "meta.json").read_text())

    def update(self, case_id: str, **changes: object) -> dict:
        meta = self.get(case_id) | changes
        self._write(meta)
        return meta

    def list(self, limit: int | None = KEPT) -> list[dict]:
        found = [json.loads(p.read_text()) for p in self.root.glob("*/meta.json")]
        return sorted(found, key=lambda m: (-m["created"], m["id"]))[:limit]

    def delete(self, case_id: str) -> None:
        shutil.rmtree(self.path(case_id), ignore_errors=True)
        if self.tables != str(self.root) and (spark := SparkSession.getActiveSession()):
            clean(spark, f"{self.tables}/{case_id}")

    def save(self, case_id: str, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.tables}/{self.path(case_id).name}/{name}")

    def load(self, spark: SparkSession, case_id: str, name: str, default: DataFrame | None = None) -> DataFrame:
        folder = f"{self.tables}/{self.path(case_id).name}/{name}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            if default is None:
                raise FileNotFoundError(name)
            return default
        return spark.read.parquet(folder)


AUDIT = "ts double, user string, query string, result_ids array<string>"


def audit(spark: SparkSession, path: str, user: str, query: str, result_ids: list[str]) -> None:
    """Append one event; at most 50 ids are kept."""
    spark.createDataFrame([(time.time(), user, query, [str(x) for x in result_ids[:50]])], AUDIT).coalesce(1).write.mode("append").json(path)


def audit_trail(spark: SparkSession, path: str, contains: str = "", limit: int = 100) -> DataFrame:
    """The newest events whose text has ``contains``, without case."""
    rows = spark.read.schema(AUDIT).json(path)
    return rows.where(F.contains(F.lower(F.to_json(F.struct("user", "query", "result_ids"))), F.lit(contains.lower()))).orderBy(F.desc("ts")).limit(limit)
