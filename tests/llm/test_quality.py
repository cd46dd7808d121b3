import zlib

import numpy as np

from netfusion.llm import quality

SCHEMA = "doc_id long, text string, score string, n_words string"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(labels)[order]
    rank = np.searchsorted(s, s, "left") + (np.searchsorted(s, s, "right") - np.searchsorted(s, s, "left") + 1) / 2
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_rules_and_lasso_on_a_known_rule():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    model = quality.fit_arrays(x, y)
    p = model.bias + sum(w * np.all([(x[:, f] > at) == above for f, above, at in r], axis=0) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((p > 0) == (y == 1)).mean() > 0.97 and len(model.rules) < len(quality.extract_rules(x, y))


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and auc([r.score for r in rows], [r.quality for r in rows]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_small_cases(spark):
    good, bad = "some calm words of prose that go on and on. ", "### $$$ %%% && "
    rows = [(i, (good if i % 2 else bad) * (5 + i % 7)) for i in range(300)] + [(None, good * 5), (400, None), (401, ""), (402, good * 50_000), (403, good), (403, good)]
    labels = [(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (1, None, 0), (7, 1, 1), (999, 0, 0)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 300)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5]
    assert quality.classify(docs.limit(0), none).collect() == []


def brute_features(text):
    import re

    x = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", x)
    lines = [y for y in x.split("\n") if y != ""]
    n = lambda p: len(re.findall(p, x))
    w, c, k = max(len(words), 1), max(len(x), 1), max(len(lines), 1)
    return (len(words), len(x), len(x) / w, n(r"[#*$%&|<>@~^=+_{}\[\]\\]") / w, n("[A-Z]") / c, n("[0-9]") / c, n("[.?]") / w, n("!") / w, len(words) / k, len({*lines}) / k, len({*words}) / w)


def test_features_and_compiled_score_against_brute_force(spark):
    """The statistics in Python, and the fitted rules on them, give what the column expressions give, for every document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\n "), (-4, "é\U0001f600 A!\n\nA!"), (-5, "word " * 50_000)], docs.schema)
    docs = docs.unionByName(odd)
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.rules
    rows = quality.features(docs.withColumn("copy", docs.text), "doc_id", "copy").withColumn("_s", model.column()).collect()
    for r in rows:
        x = brute_features(r["copy"])
        assert np.allclose(x, [r[f] for f in quality.FEATURES], rtol=1e-12), r.doc_id
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[f] > at) == above for f, above, at in rule))
        assert abs(r["_s"] - 1 / (1 + np.exp(-total))) < 1e-12
    scored = {r.doc_id: r for r in quality.classify(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()}
    assert len(scored) == len(rows)
