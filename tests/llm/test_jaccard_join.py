import random
import re

import numpy as np
import pytest

from netfusion.llm import jaccard_join as j

SCHEMA = "doc_id long, text string, node string, n string, label int"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    """Rows of (doc_id, n_shingles, component_id)."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), least.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows)), key=str)


def corpus(n, seed):
    """Clusters of near copies with changed, dropped and added words, a passage and lines that many share, short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ähre", "ÉTÉ", "x"]
    passage = [rng.choice(vocab) for _ in range(40)]
    lines = [[rng.choice(vocab) for _ in range(8)] for _ in range(6)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([4, 5, 6, 9, 12, 30, 80, 200]))] for _ in range(n // 12)]
    bases += [sum((rng.choice(lines) for _ in range(10)), []) for _ in range(4)]
    out = []
    for i in range(n):
        ws = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            if ws:
                k = rng.randrange(len(ws))
                if rng.random() < 0.4:
                    ws[k] = rng.choice(vocab)
                elif rng.random() < 0.5:
                    del ws[k]
                else:
                    ws.append(rng.choice(vocab))
        if rng.random() < 0.2:
            ws = passage + ws
        out.append((i, "".join(w.upper() * (rng.random() < 0.1) or w for w in [(x + rng.choice([" ", "\n", "\t ", "\r\n"])) for x in ws]), "a", "b", 1))
    return out


def result(spark, rows, parts=5):
    out = j.similar_documents(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("n, part", [(700, 256), (500, 2)])
def test_as_brute_force(spark, monkeypatch, n, part):
    monkeypatch.setattr(j, "PART", part)  # 2: groups of three and more are cut, hubs too
    rows = corpus(n, n)
    got = result(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < n * 0.8


def test_large_cluster_whose_copies_are_near_their_base_only(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(1000, " ".join(base), "", "", 0)]
    for i in range(400):
        ws = list(base)
        for k in rng.sample(range(2, 118), 2):
            ws[k] = f"c{i}x{k}"
        rows.append((i, " ".join(ws), "", "", 0))
    assert result(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert result(spark, [], 1) == []
    rows = [(1, None, "", "", 0), (2, "", "", "", 0), (3, " \n\t", "", "", 0), (None, "a b c d e f", "", "", 0), (None, None, "", "", 0), (7, "A b\nc D", "", "", 0), (5, "a b c d", "", "", 0), (7, "a b c", "", "", 0), (7, "A b\nc D", "", "", 0), (9, "a b c d e F", "", "", 0)]
    assert result(spark, rows) == brute(rows)


def test_exactly_the_bound_and_very_long_texts(spark):
    # 4 of 5 shingles shared: linked; 4 of 6: not
    rows = [(1, "a b c d e f g h", "", "", 0), (2, "a b c d e f g h i", "", "", 0), (3, "p q r s t u v w", "", "", 0), (4, "p q r s t u v w x y", "", "", 0)]
    rng = random.Random(8)
    ws = [f"u{rng.randrange(10**7)}" for _ in range(60_000)]
    other = list(ws)
    for k in range(0, 50_000, 1000):
        other[k] = "changed"
    rows += [(11, " ".join(ws), "", "", 0), (12, " ".join(other), "", "", 0), (13, " ".join(ws[:30_000]), "", "", 0)]
    got = result(spark, rows)
    assert got == brute(rows) and sorted(r[2] for r in got) == [1, 1, 3, 4, 11, 11, 13]


def test_bits_bound_the_difference_and_fold():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[: int(rng.integers(0, n))], rng.integers(0, 2**63, int(rng.integers(1, n)), dtype=np.uint64)))
        g, h = (j.Group([k], [len(x)], [j.bits_of(x)], [k]) for k, x in enumerate((a, b)))
        x, _ = j.near_pairs(g, h, 80, False)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            assert len(x) == 1
    big = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    wide = np.frombuffer(j.bits_of(big), np.uint64)[None, :]
    narrow = np.zeros(wide.shape[1] * 32, bool)
    narrow[(big & np.uint64(len(narrow) - 1)).astype(int)] = True
    assert (j.folded(wide, wide.shape[1] // 2) == np.frombuffer(np.packbits(narrow, bitorder="little").tobytes(), np.uint64)).all()


def test_stars_cover_every_set_with_a_pair():
    x, y = np.array([0, 0, 0, 4, 5]), np.array([1, 2, 3, 5, 6])
    assert sorted(j.stars(8, x, y)) == [(0, 1), (0, 2), (0, 3), (5, 4), (5, 6)]


def test_shared_rows_are_those_that_may_be_similar():
    # key, node, place, n: one key with sizes and places apart, one with a pair that fits, one of a single node
    rows = np.array([[5, 1, 0, 100], [5, 2, 0, 200], [5, 3, 15, 90], [6, 1, 2, 100], [6, 3, 4, 90], [7, 2, 1, 200], [6, 1, 2, 100]])
    (got,) = j._shared(rows, 80)
    assert got.tolist() == [[6, 1, 2, 100], [6, 3, 4, 90]]  # all of key 5 before
    many = np.array([[8, k, 0, 2**k % 1000 + 1] for k in range(j.FEW + 1)])
    assert len(next(j._shared(many, 80))) == j.FEW + 1


def test_similar_sets_keep_their_first_shared_row():
    rng = np.random.default_rng(3)
    for _ in range(300):
        order = rng.permutation(400)
        at = np.sort(rng.choice(400, int(rng.integers(10, 200)), replace=False))
        other = np.unique(np.append(rng.choice(at, int(len(at) * rng.uniform(0.85, 1)), replace=False), rng.integers(0, 400, int(rng.integers(0, 8)))))
        sets = [[int(order[k]) for k in s] for s in (at, other)]
        rows = np.array([[key, node, place, len(s)] for node, s in enumerate(sets) for place, key in enumerate(s[: len(s) // 5 + 1])])
        shared = len({*sets[0]} & {*sets[1]})
        if 100 * shared >= 80 * (len(sets[0]) + len(sets[1]) - shared):
            first = next(key for key in sets[0] if key in sets[1])
            assert sorted(r[1] for r in next(j._shared(rows, 80)).tolist() if r[0] == first) == [0, 1]


def test_counters_are_packed_small_and_add_up():
    rng = np.random.default_rng(4)
    size = j.COUNTERS // j.SLICES
    sparse, full, none = np.bincount(rng.integers(0, size, size // 20), minlength=size), rng.integers(0, 70_000, size), np.zeros(size, int)
    sums = np.zeros(size, np.int64)
    for c in (sparse, full, none, sparse):
        j.add_counts(sums, j.packed_counts(c.astype(np.uint32)))
    assert (sums == 2 * sparse + full).all()
    assert len(j.packed_counts(sparse.astype(np.uint32))) < size // 14  # a tenth of the slots' bytes before
