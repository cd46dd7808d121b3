"""Vectors as arrays: dot products, cosine, match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


#: Cosine from which a piece holds, percentage there, its cosine width and its rise.
MATCH_PIECES = ((0.80, 88.0, 0.19, 11.5), (0.60, 70.0, 0.20, 17.9), (0.40, 50.0, 0.20, 19.9), (0.20, 30.0, 0.20, 19.9))
#: Percentage from which a label holds.
MATCH_LABELS = ((85.0, "High Probability Match"), (70.0, "Probable Match"), (50.0, "Possible Lead"))


def match_percent(similarity: Column) -> Column:
    """A percentage piecewise linear in the cosine; 99.8 from 0.99 up, at least 5."""
    out = F.when(similarity >= 0.99, F.lit(99.8))
    for start, base, width, rise in MATCH_PIECES:
        out = out.when(similarity >= start, F.round(base + (similarity - start) / width * rise, 1))
    return out.otherwise(F.round(F.greatest(F.lit(5.0), (similarity + 1) * 15), 1))


def match_label(percent: Column) -> Column:
    out = None
    for start, name in MATCH_LABELS:
        out = F.when(percent >= start, name) if out is None else out.when(percent >= start, name)
    return out.otherwise("Low Similarity")
