"""Content vectors of binary files and search over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from netfusion.functions.vectors import dot, match_label, match_percent

BINS = SEGMENTS = 64


def content_vector(data: bytes | None) -> np.ndarray:
    """128 numbers of unit length: a histogram of byte values and the means of equal segments, each centred; zeros for no content."""
    raw = np.frombuffer(data or b"", np.uint8)
    if not len(raw):
        return np.zeros(BINS + SEGMENTS, np.float32)
    shares = np.bincount(raw >> 2, minlength=BINS) / len(raw)
    size = max(1, len(raw) // SEGMENTS)
    means = np.array([raw[k * size : (k + 1) * size].mean() if k * size < len(raw) else 0.0 for k in range(SEGMENTS)]) / 255.0
    vector = np.concatenate([shares - shares.mean(), means - means.mean()]).astype(np.float32)
    return vector / (np.linalg.norm(vector) + 1e-6)


@F.pandas_udf(ArrayType(FloatType()))
def _vectors(data: pd.Series) -> pd.Series:
    return pd.Series([content_vector(x) for x in data])


def index_files(files: DataFrame, id_column: str = "path") -> DataFrame:
    """id and embedding of files (id_column, content), made where the files are read."""
    return files.select(F.col(id_column).cast("string").alias("id"), _vectors("content").alias("embedding"))


def scan_files(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """name and content of the files under a path. Spark deals small files out few to a task; here tasks don't grow with the files, as each
    task sends its figures to the driver."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").coalesce(tasks)


def cached_index(index: DataFrame, path: str) -> DataFrame:
    """The index kept at ``path``, written there first if there is none."""
    spark = index.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        index.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def search(index: DataFrame, query: DataFrame, top_k: int = 5, least_percent: float = 0.0) -> DataFrame:
    """id, raw_cosine, similarity_score, confidence_level of the nearest vectors. query: one row, embedding of unit length."""
    q = query.select(F.col("embedding").alias("_q"))
    near = index.join(F.broadcast(q)).select("id", F.round(dot(F.col("embedding"), F.col("_q")), 4).alias("raw_cosine"))
    percent = match_percent(F.col("raw_cosine"))
    found = near.select("id", "raw_cosine", percent.alias("similarity_score"), match_label(percent).alias("confidence_level"))
    return found.where(F.col("similarity_score") >= least_percent).orderBy(F.desc("similarity_score"), F.desc("raw_cosine"), "id").limit(top_k)
