import random

import pytest

from netfusion.llm import components


def groups(labels):
    out = {}
    for node, root in labels:
        out.setdefault(root, set()).add(node)
    return sorted(map(sorted, out.values()))


def brute(edges):
    of = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return sorted({tuple(sorted(g)) for g in of.values()})


def some_edges(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(-k, -k - 1) for k in range(1, 60)]


@pytest.mark.parametrize("last", [1 << 12, 40, 0])
def test_components_whatever_is_left_to_the_last_task(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST", last)
    edges = some_edges(400, last)
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    rows = [tuple(r) for r in components.connected_components(frame(edges)).select("node", "root").collect()]
    assert [tuple(g) for g in groups(rows)] == brute(edges) and len({node for node, _ in rows}) == len(rows)
    first = components.connected_components(frame(edges[::2]))
    rows = [tuple(r) for r in components.joined_components(first, frame(edges[1::2])).select("node", "root").collect()]
    assert [tuple(g) for g in groups(rows)] == brute(edges) and len({node for node, _ in rows}) == len(rows)


def test_few_edges_take_few_stages(spark):
    store = lambda: {s for s in spark.sparkContext.statusTracker().getJobIdsForGroup() or []}
    before = store()
    assert components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(3000)], "a long, b long")).count() == 3001
    assert len(store() - before) < 20  # rounds of some ten jobs each before
