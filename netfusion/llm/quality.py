"""Quality classifier as a sparse rule ensemble.

Small boosted trees are grown on statistics of labelled texts; every path from a root to a node is a rule, a conjunction of
thresholds. A logistic regression with a lasso penalty picks and weighs the rules, and the ones that are left are compiled into a Spark
column expression, so scoring is one projection over built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import WORD, bucket_of, words_of

#: Labelled rows that the model is fitted on: all if fewer than twice as many, else about this many chosen by a hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_LEAF, SHRINK = 24, 3, 32, 10, 0.3
PENALTY = 2e-4
THRESHOLD = 0.3

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all of which hold


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, in two steps: these counts, then ratios()."""
    x = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(x, "\n"), lambda s: s != "")
    words = words_of(text)
    return {
        "n_chars": F.length(x).cast("double"),
        "n_words": F.regexp_count(x, F.lit(WORD)).cast("double"),
        "n_symbols": F.regexp_count(x, F.lit(r"[#*$%&|<>@~^=+_{}\[\]\\]")).cast("double"),
        "n_upper": F.regexp_count(x, F.lit(r"[A-Z]")).cast("double"),
        "n_digits": F.regexp_count(x, F.lit(r"[0-9]")).cast("double"),
        "n_ends": F.regexp_count(x, F.lit(r"[.?]")).cast("double"),
        "n_shouts": F.regexp_count(x, F.lit(r"!")).cast("double"),
        "n_lines": F.size(lines).cast("double"),
        "n_unique_lines": F.size(F.array_distinct(lines)).cast("double"),
        "n_unique_words": F.size(F.array_distinct(words)).cast("double"),
    }


def ratios() -> dict[str, Column]:
    c, words, chars = F.col, F.greatest(F.col("n_words"), F.lit(1.0)), F.greatest(F.col("n_chars"), F.lit(1.0))
    return {
        "n_words": c("n_words"),
        "n_chars": c("n_chars"),
        "word_length": c("n_chars") / words,
        "symbols": c("n_symbols") / words,
        "upper": c("n_upper") / chars,
        "digits": c("n_digits") / chars,
        "ends": c("n_ends") / words,
        "shouts": c("n_shouts") / words,
        "line_words": c("n_words") / F.greatest(c("n_lines"), F.lit(1.0)),
        "unique_lines": c("n_unique_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        "unique_words": c("n_unique_words") / words,
    }


FEATURES = ("n_words", "n_chars", "word_length", "symbols", "upper", "digits", "ends", "shouts", "line_words", "unique_lines", "unique_words")


def features(documents: DataFrame, *keep: str) -> DataFrame:
    counts = documents.select(*keep, *(v.alias(k) for k, v in statistics(F.col("text")).items()))
    return counts.select(*keep, *(v.alias(k) for k, v in ratios().items()))


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over FEATURES."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for f, above, at in rule:
                holds &= F.col(FEATURES[f]) > F.lit(at) if above else F.col(FEATURES[f]) <= F.lit(at)
            total += F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree on the loss's gradient: its paths as rules, and its prediction."""
    rules: list[Rule] = []
    out = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        g, h = residual[rows], hessian[rows]
        best = (1e-6, -1, 0.0, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            base = g.sum() ** 2 / (h.sum() + 1)
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                b = bins[rows, f]
                gs = np.cumsum(np.bincount(b, g, len(edge) + 1))[:-1]
                hs = np.cumsum(np.bincount(b, h, len(edge) + 1))[:-1]
                ns = np.cumsum(np.bincount(b, minlength=len(edge) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
                gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, edge[k], b <= k)
        if best[1] < 0:
            out[rows] = SHRINK * g.sum() / (h.sum() + 1)
            return
        _, f, at, low = best
        split(rows[low], (*path, (f, False, float(at))))
        split(rows[~low], (*path, (f, True, float(at))))

    split(np.arange(len(x)), ())
    return rules, out


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    edges = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(q[q < x[:, f].max()])
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    score, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rules, step = grow(x, bins, edges, y - p, p * (1 - p) + 1e-6)
        score += step
        found |= dict.fromkeys(rules)
    return list(found)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient; the bias is free of the penalty."""
    n, k = m.shape
    a = np.column_stack([np.ones(n), m])
    rng = np.random.default_rng(0)
    v = rng.random(k + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / n * 1.05 + 1e-12)
    w = np.zeros(k + 1)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        new = z - step * (a.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_arrays(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model for 0/1 labels; with one class or none, a constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(share / (1 - share))))
    rules = extract_rules(x, y)
    holds = np.column_stack([np.all([(x[:, f] > at) == above for f, above, at in rule], axis=0) for rule in rules] or [np.zeros(len(y))]).astype(float)
    bias, weights = lasso_logistic(holds, y)
    used = [i for i in np.flatnonzero(weights).tolist() if i < len(rules)]
    return RuleModel(bias, [rules[i] for i in used], [float(weights[i]) for i in used])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> RuleModel:
    """A model of labels.quality (doc_id, quality) from the texts; rows with a null id or label teach nothing, of several labels the
    greatest counts. SAMPLE_ROWS bounds the rows."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    every = max(1, known.count() // sample)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)  # fewer than 2 * sample rows, give or take the hash
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    table = features(rows, "doc_id", "quality").toPandas().sort_values("doc_id", kind="stable")
    return fit_arrays(table[list(FEATURES)].to_numpy(float), (table["quality"].to_numpy() == 1).astype(float))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Fit on rows whose crc32(doc_id) mod ``folds`` is not 0 and score all: doc_id, held_out, score, predicted (1 from THRESHOLD on).

    documents: doc_id, text; labels: doc_id, quality; more columns are ignored. A null text is scored as an empty one, a null doc_id
    keeps its row, repeated rows too. Without labels of both classes all scores are the same.
    """
    model = fit(documents, labels.where(bucket_of(F.col("doc_id"), folds) != 0))
    scored = features(documents, "doc_id").select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The documents that the classifier predicts as 1, with all their columns."""
    model = fit(documents, labels.where(bucket_of(F.col("doc_id"), folds) != 0))
    held = documents.select(F.struct(*documents.columns).alias("_row"), F.col("text"))
    # a filter on the score itself would be pushed below the statistics, with a copy of them for each use; past a generator it isn't
    scored = features(held, "_row").select("_row", F.explode(F.array(model.column())).alias("_score")).where(F.col("_score") >= THRESHOLD)
    return scored.select("_row.*")
