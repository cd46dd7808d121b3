import collections
import math

import pytest

from netfusion.llm import mixing

SCHEMA = "doc_id long, text string, source string, n long, src string, block string, mix_order string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "s", "b", "m") for r in rows], SCHEMA)


def corpus(sizes):
    out, i = [], 0
    for name, n in sizes.items():
        for k in range(n):
            out.append((i, "w " * (1 + (i * 7) % 19), name))
            i += 1
    return out


def weights(spark, rows, ratio, repeat, entropy):
    from pyspark.sql import functions as F

    tokens = frame(spark, rows).select("doc_id", F.col("source").alias("src"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))
    return {r.src: r for r in mixing.source_weights(tokens, ratio, repeat, entropy).collect()}


@pytest.mark.parametrize(("repeat", "entropy"), [(1.25, None), (1.0, None), (100.0, None), (None, 0.8), (None, 0.0), (None, 9.0)])
def test_exponent(spark, repeat, entropy):
    rows = corpus({"a": 3000, "b": 300, "c": 60})
    got = weights(spark, rows, 1.0, repeat, entropy)
    total = sum(r.tokens for r in got.values())
    a = got["a"].exponent
    z = sum((r.tokens / total) ** a for r in got.values())
    assert all(abs(r.weight - (r.tokens / total) ** a / z) < 1e-8 and r.budget <= r.weight * total for r in got.values())
    most = max(r.weight * total / r.tokens for r in got.values())
    h = -sum(r.weight * math.log(r.weight) for r in got.values())
    if repeat:
        assert most <= repeat + 1e-5 and (a == 0 or most > repeat - 1e-3)
    elif entropy == 9.0:
        assert a == 0 and abs(h - math.log(3)) < 1e-6
    else:
        assert h >= entropy - 1e-6 and (a == 1 or h < entropy + 1e-4)


@pytest.mark.parametrize("ratio", [0.4, 1.0, 2.7])
def test_budgets_and_copies(spark, ratio):
    rows = corpus({"hot": 4000, "b": 500, "c": 90})
    plan = weights(spark, rows, ratio, 2 * ratio, None)
    out = mixing.mix(frame(spark, rows), budget_ratio=ratio, max_repeat=2 * ratio, block_docs=4).collect()
    tokens = {i: (len(t.split()), s) for i, t, s in rows}
    by, seen = collections.Counter(), collections.Counter()
    for r in out:
        by[r.source] += r.mix_tokens
        seen[r.doc_id, r.mix_epoch] += 1
        assert r.mix_tokens == tokens[r.doc_id][0] and 0 <= r.mix_order <= 1 and r.src == "s" and r.text
    assert max(seen.values()) == 1
    for name, r in plan.items():
        assert r.budget - 19 < by[name] <= r.budget
    copies = collections.Counter(r.doc_id for r in out)
    for name in plan:
        own = [copies[i] for i, (_, s) in tokens.items() if s == name]
        assert max(own) - min(own) <= 1
    for upto in (0.25, 0.5):  # each prefix has the target weights
        part = collections.Counter()
        for r in out:
            part[r.source] += r.mix_tokens * (r.mix_order < upto)
        assert abs(part["hot"] / sum(part.values()) - plan["hot"].weight / sum(p.weight for p in plan.values())) < 0.05


def test_small_cases(spark):
    rows = [(1, "a b", None), (2, None, "x"), (3, "", "x"), (None, "c d e", "x"), (4, "a b", "x"), (4, "a b", "x"), (5, "w " * 100_000, "y"), (6, "", "empty")]
    out = mixing.mix(frame(spark, rows), max_repeat=1.0).collect()
    assert {r.source for r in out} <= {None, "x", "y"} and max(collections.Counter(r.doc_id for r in out).values()) <= 2
    assert mixing.mix(frame(spark, [])).collect() == []
    assert mixing.mix(frame(spark, [(1, "", "x"), (2, None, None)])).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), max_repeat=1.0, min_entropy=1.0)
