import random
import re

import numpy as np
import pytest

from netfusion.llm import decontam

SCHEMA = "doc_id long, text string, item_id string, n_shared string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sh(ws, k):
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items):
    found = []
    pairs = [(i, k, sh(ws, k)) for i, t in {*items} if (ws := words(t)) for k in [min(5, len(ws))]]
    for d, text in docs:
        own = {k: sh(words(text), k) for k in range(1, 6)}
        found += [(d, i, len(s), len(s & own[k])) for i, k, s in pairs if len(s & own[k]) >= 0.8 * len(s) - 1e-9]
    return sorted(found, key=str)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 30, 68, 69, 150]))) for i in range(80)]
    docs = []
    for d in range(150):
        parts = [text(rng.randrange(400))]
        for _, item in rng.sample(items, rng.randrange(4)):
            ws = item.split()
            kind = rng.randrange(5)
            if kind == 1 and len(ws) > 3:
                ws[rng.randrange(len(ws))] = "changed"
            if kind == 2:
                ws = ws[: max(1, int(len(ws) * rng.choice([0.7, 0.8, 0.85, 0.9])))]
            if kind == 3:
                at = rng.randrange(len(ws))
                ws = ws[:at] + text(rng.randrange(600)).split() + ws[at:]
            parts += [" ".join(ws).upper() if kind == 4 else "\n".join(ws), text(rng.randrange(3000))]
        docs.append((d, " ".join(parts)))
    docs += [(1000, " ".join(t for _, t in items)), (1001, " ".join(t for _, t in items[::-1])), (1002, items[0][1]), (1003, "w1 w1 w1 w1 w1 " * 4000 + items[5][1])]
    return docs, items


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs, items = planted(seed)
    want = brute(docs, items)
    assert len(want) > 60
    assert found(decontam.contained_items(*frames(spark, docs, items))) == want


def test_blocks_of_items(spark):
    docs, items = planted(9)
    d, b = frames(spark, docs, items)
    assert found(decontam.contained_items(d, b, items=20)) == brute(docs, items)
    kept = decontam.decontaminate(d, b, items=20)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, *_ in brute(docs, items)})


def test_small_cases(spark):
    item = "one two three four five six seven"
    docs = [(1, None), (2, ""), (None, "x " + item), (3, item.upper()), (3, item.upper()), (4, "two words"), (5, "more two words"), (6, "two other words"), (7, "x " * 200_000 + "two words " + item)]
    items = [(1, item), (1, item), (2, None), (3, "  "), (None, "two words")]
    d, b = frames(spark, docs, items)
    want = sorted(brute(docs, items), key=str)
    assert found(decontam.contained_items(d, b)) == want and len(want) == 7
    assert decontam.contained_items(d, b.limit(0)).collect() == [] and decontam.contained_items(d.limit(0), b).collect() == []
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_short_items_inside_long_documents(spark):
    docs = [(1, "filler words " * 5000 + "Alpha beta\ngamma delta" + " more words" * 5000), (2, "alpha beta gamma and delta"), (3, "beta")]
    items = [(10, "alpha beta gamma delta"), (11, "beta"), (12, "gamma delta more"), (13, "delta alpha")]
    want = brute(docs, items)
    assert [(d, i) for d, i, *_ in want] == [(1, 10), (1, 11), (1, 12), (2, 11), (3, 11)]
    assert found(decontam.contained_items(*frames(spark, docs, items))) == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = decontam.signatures(h[:40], np.array([0])), decontam.signatures(h[20:], np.array([0]))
    assert abs((a == b).mean() - 1 / 3) < 0.15
