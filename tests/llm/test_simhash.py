import random

import numpy as np
import pytest
import xxhash

from netfusion.llm import simhash
from netfusion.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_groups(codes, distance=4):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))] + [0, 2**64 - 1]
    out = set()
    while len(out) < n:
        c = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return sorted(out, key=lambda _: rng.random())


def same_partition(a, b):
    return len({*zip(a, b, strict=True)}) == len({*a}) == len({*b})


@pytest.mark.parametrize("n", [2, 3, 16, 17, 300, 1500])
def test_index_finds_every_link(n):
    codes = clustered(n, n)
    assert same_partition(simhash.near_groups(np.array(codes, np.uint64)).tolist(), brute_groups(codes))


def test_gray_rank():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_any_near_pair_shares_a_bucket():
    rng = random.Random(1)
    for n in (10, 10**8, 10**13):
        masks = simhash.bucket_masks(n, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("most", [3, 8192])
def test_links_with_split_buckets(spark, most):
    codes = clustered(400, 7)
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "fp long")
    root = {r.node % 2**64: r.root for r in connected_components(simhash.links(df, mean=10**9, most=most)).collect()}
    assert same_partition([root.get(c, c) for c in codes], brute_groups(codes))


def test_fingerprint_matches_spark_hash(spark):
    for text in ("", "one", "One TWO three", "a b c d", "a b c d e f g É é x \x1c y", "w " * 5000):
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1 and got[0] != got[1000]
    assert len(got) == 501


def brute(rows):
    codes = [brute_print(t) for _, t in rows]
    group = brute_groups(codes)
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{c:016x}", least.get(g)) for (d, _), c, g in zip(rows, codes, group, strict=True)), key=str)


def test_small_cases(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (9, base.upper()), (2, base + " more"), (7, ""), (3, None), (None, "  \n"), (None, "alone here now then"), (4, "alone here now and"), (5, base), (11, "x " * 100_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == brute(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "4", "11", "None", "None"])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == [] and simhash.keep_one(df).collect() == []


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == brute(rows)
