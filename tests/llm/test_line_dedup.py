import random
import re

from netfusion.llm import line_dedup

SCHEMA = "doc_id long, text string, lh string, kept_text string"


def near(a, b):
    if len(a) == len(b):
        return len(a) > 1 and sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(docs, edits=1):
    seen, out = [], []
    for d, text in docs:  # in order of doc_id
        lines = (text or "").split("\n")
        kept, n, gone = [], 0, 0
        for x in lines:
            w = re.findall("[^\x20\x09-\x0d]+", x)
            n += bool(w)
            if w and any(w == v or (edits and near(w, v)) for v in seen):
                gone += 1
            else:
                kept.append(x)
            if w:
                seen.append(w)
        out.append((d, n, gone, "\n".join(kept)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "漢", "X|Y"]
    line = lambda: [rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 5, 7, 8, 9, 12, 30]))]
    base = [line() for _ in range(25)] + [["a"] * 9, ["a"] * 10, ["a", "b"] * 5]
    docs = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(12)):
            w = list(rng.choice(base)) if rng.random() < 0.7 else line()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                w = w[:at] + [rng.choice(words)] * (kind > 0) + w[at + (kind < 2) :]
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " ", "\x0b"]))
        docs.append((d, "\n".join(lines)))
    return docs


def ours(df, **kw):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df, **kw).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def frame(spark, docs):
    return spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA)


def test_against_brute_force(spark):
    for seed in range(3):
        docs = corpus(seed)
        want = brute(docs)
        assert sum(w[2] for w in want) > 100
        assert ours(frame(spark, docs)) == want
    assert ours(frame(spark, docs), edits=0) == brute(docs, 0) != want


def test_short_lines(spark):
    docs = [(1, "a\nb\na b"), (2, "a c\nd c\nd"), (3, "b c a\nx y z\nx q z\ny z\nq\n"), (4, "m n o\nn o\nm n\nm o")]
    assert ours(frame(spark, docs)) == brute(docs)


def test_small_cases(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    docs = [(None, "from no id one two three four five six"), (1, None), (2, ""), (3, "\n\n  \n"), (4, long), (5, long.replace("w777 ", "")), (6, "x\nx\ny"), (8, "from no id one two three four five six seven"), (9, "x\n")]
    assert ours(frame(spark, docs)) == brute(docs)
    twice = [(1, "a b\nc"), (1, "a b\nc"), (2, "c\nd")]
    assert ours(frame(spark, twice)) == [(1, 2, 0, "a b\nc"), (1, 2, 0, "a b\nc"), (2, 2, 1, "d")]


def test_empty(spark):
    assert ours(frame(spark, [])) == []


def test_no_python_in_the_plan(spark):
    plan = line_dedup.dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
