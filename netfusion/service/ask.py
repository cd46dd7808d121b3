"""Questions in plain words, matched to query templates and run."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.operators import graph

#: Template number, what it answers, and keywords; the first template whose keyword is a part of the question is taken.
TEMPLATES = (
    (1, "people who link cells", ("bridge", "connects", "connect")),
    (7, "structuring into an account", ("structuring", "smurf", "fan")),
    (5, "transfers above an amount", ("transaction", "transact", "amount", "lakh", "hawala")),
    (4, "shortest path between two people", ("path", "between", "to")),
    (2, "calls on a day", ("burst", "spike", "activity")),
    (6, "calls of a person", ("calls", "called", "phone")),
    (3, "evidence on a person", ("why", "evidence", "support")),
    (8, "cell and role of a person", ("cell of",)),
)


@dataclass
class Question:
    template: int
    description: str
    text: str
    params: dict = field(default_factory=dict)


def parse(text: str) -> Question:
    """The template and its parameters: ids like A12, amounts like 2 lakh or 50k, and day numbers; evidence if nothing fits."""
    low = text.lower()
    number, what = next(((n, d) for n, d, words in TEMPLATES if any(w in low for w in words)), (3, "evidence on a person"))
    params: dict = {"ids": re.findall(r"\b[A-Z]\d{1,2}\b", text)}
    if m := re.search(r"(\d+(?:\.\d+)?)\s*(lakh|k)\b", low):
        params["amount"] = int(float(m[1]) * (100_000 if m[2] == "lakh" else 1_000))
    if m := re.search(r"day\s+(\d+)", low):
        params["day"] = int(m[1])
    return Question(number, what, text, params)


def run(question: Question, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The answer. nodes: id, cell, role; edges: src, dst, kind, day, amount, confidence."""
    q, ids = question, [*question.params.get("ids", []), None, None]
    touches = lambda x: (F.col("src") == F.lit(x)) | (F.col("dst") == F.lit(x))
    if q.template == 1:
        cell = lambda end: nodes.select(F.col("id").alias(end), F.col("cell").alias(f"cell_{end}"))
        crossing = edges.join(cell("src"), "src").join(cell("dst"), "dst").where("cell_src <> cell_dst")
        return crossing.groupBy("src").agg(F.count_distinct("cell_dst").alias("cells"), F.count("*").alias("n")).orderBy(F.desc("cells"), F.desc("n"), "src").limit(10)
    if q.template == 7:
        return edges.where((F.col("kind") == "TRANSACTED") & (F.col("dst") == F.lit(ids[0])) & (F.col("amount") < 50_000))
    if q.template == 5:
        return edges.where((F.col("kind") == "TRANSACTED") & (F.col("amount") > q.params.get("amount", 100_000))).orderBy(F.desc("amount"), "src", "dst")
    if q.template == 4:
        return graph.shortest_path(edges.where(F.col("kind").isin("CALLED", "TRANSACTED")), ids[0], ids[1])
    if q.template == 2:
        return edges.where((F.col("kind") == "CALLED") & (F.col("day") == q.params.get("day", 58)))
    if q.template == 6:
        return edges.where((F.col("kind") == "CALLED") & touches(ids[0])).orderBy("day", "src", "dst")
    if q.template == 3:
        return edges.where(touches(ids[0])).limit(20)
    return nodes.where(F.col("id") == F.lit(ids[0])).select("id", "cell", "role")
