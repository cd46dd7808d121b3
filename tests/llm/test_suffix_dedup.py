import collections
import hashlib
import random

import pytest

from netfusion.llm import suffix_dedup

SCHEMA = "doc_id long, text string, did string, spans string"


def brute(docs, window=400):
    datas = [(d, (t or "").encode()) for d, t in docs]
    seen = collections.Counter(x[i : i + window] for _, x in datas for i in range(len(x) - window + 1))
    out = []
    for d, x in datas:
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefghij éü漢\n"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(rng.choice([150, 398, 399, 400, 401, 700, 2000])) for _ in range(12)]
    docs = []
    for d in range(n):
        t = text(rng.randrange(300))
        for s in rng.sample(shared, rng.randrange(4)):
            if rng.random() < 0.5:
                at = rng.randrange(len(s))
                s = s[:at] + "X" + s[at + 1 :]
            if rng.random() < 0.3:
                s = s[rng.randrange(len(s) // 2) :]
            t += s + text(rng.randrange(300))
        docs.append((d, t))
    base = text(3000)
    for d in range(n, n + 25):  # near copies
        c = list(base)
        for _ in range(rng.randrange(6)):
            c[rng.randrange(len(c))] = rng.choice(letters)
        docs.append((d, "".join(c)))
    docs += [(200, docs[0][1]), (201, docs[0][1]), (202, "a" * 1500), (203, "ab" * 400), (204, "b" + "a" * 398), (205, text(450) * 2)]
    return docs


def ours(df, **kw):
    return sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(df, **kw).collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA)


@pytest.mark.parametrize(("seed", "part", "chunk"), [(1, 4096, 1 << 18), (2, 3, 1 << 18), (3, 4096, 1000)])
def test_against_brute_force(spark, monkeypatch, seed, part, chunk):
    monkeypatch.setattr(suffix_dedup, "PART_RUNS", part)
    docs = corpus(seed)
    if chunk == 1000:  # cut texts into small pieces; the kernel is tried alone, as executors import their own copy
        for _, text in docs:
            data = text.encode()
            lo, hi, *_ = suffix_dedup.runs(data, chunk=chunk)
            assert sum((hi - lo + 1).tolist()) == max(0, len(data) - 399)
    want = brute(docs)
    assert sum(w[2] > 0 for w in want) > 30
    assert ours(frame(spark, docs)) == want


def test_small_cases(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500))
    docs = [(1, None), (2, ""), (3, "x" * 399), (None, long), (4, "q" + long[:450]), (5, long[60:]), (6, "short"), (6, "short"), (7, "é" * 201), (8, "z" * 200_000)]
    docs += [(9, long[::-1] + "!"), (9, long[::-1] + "!")]
    assert ours(frame(spark, docs)) == brute(docs)


def test_empty(spark):
    assert ours(frame(spark, [])) == []


def test_kept_bytes(spark):
    t = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(600))
    rows = suffix_dedup.remove_repeats(frame(spark, [(1, "AAA" + t + "BBB"), (2, t)])).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == {1: b"AAABBB", 2: b""}


def test_bytes_decide_where_hashes_agree(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 123) for _ in range(900))
    other = bytes(rng.randrange(97, 123) for _ in range(700))
    contexts = [shared, other, shared[:450] + other[:50], shared]
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda data, size: np.zeros(max(0, len(data) - size + 1), np.uint64))
    context, inside, repeated, *_ = suffix_dedup.repeated_windows(contexts, [300] * 4)
    windows = [contexts[c][i : i + 400] for c, i in zip(context.tolist(), inside.tolist(), strict=True)]
    seen = collections.Counter(windows)
    assert repeated.tolist() == [seen[w] > 1 for w in windows] and 0 < repeated.sum() < len(windows)


def test_second_digest_does_not_follow_the_first(monkeypatch):
    """Windows of two parts that collide in every digit of the first hash are told apart by the second."""
    rng = random.Random(6)
    one = bytes(rng.choice(b"abcdefgh") for _ in range(500))
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    table = suffix_dedup._BYTES.copy()
    table[ord("b")] = table[ord("a")]
    monkeypatch.setattr(suffix_dedup, "_BYTES", table)
    parts = [suffix_dedup.repeated_windows([x], [300], digests=True) for x in (one, other, one)]
    (_, _, _, d1, s1), (_, _, _, d2, s2), (_, _, _, d3, s3) = parts
    assert (d1 == d2).all() and (d1 == d3).all() and (s1 == s3).all()
    assert not (s1 == s2).any()
