import zlib

import numpy as np
import pytest

from netfusion.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, shard string, block string"


def brute(rows):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def ours(df, **kw):
    return sorted((tuple(r) for r in tokens.read_tokens(tokens.write_tokens(df, PATH, **kw)).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 2**width, 70_001, dtype=np.uint64).astype(np.uint32)
    data = tokens.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    for a, b in ((0, len(ids)), (0, 0), (5, 6), (65_530, 65_545), (70_000, 70_001)):
        assert (tokens.unpack(data, width, a, b) == ids[a:b]).all()


def test_width():
    assert [tokens.bit_width(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_words_alone_equal_whole_texts():
    from tokenizers import Tokenizer

    with open(PATH) as f:
        e = tokens.Encoder(f.read())
    assert e.by_word and e.by_stem and e.by_lower
    t = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(0)
    parts = ["a", "'s", "B", "é", "é", "́", " ", "\x0b", "\x1c", " ", " ", "  ", "\n", "\t", "\r\n", "<|endoftext|>", "<|endo", "1", "23", "!?", "漢字", "İ", "Σ", "ς", "\U0001f600", "\x00", "</w>", "A'S", "<|ENDOFTEXT|>", "word.", "Word,", "É.", "x́.", "≠", "?̸", "İ!", "ª;", "²,", "_a_", "x" * 200]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(4000)] + [""]
    texts += ["".join(rng.choice([p for p in parts if "<" not in p], rng.integers(0, 9))) for _ in range(20_000)]
    assert e.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_small_cases(spark):
    rows = [(3, "one two"), (1, None), (2, ""), (None, "no id"), (3, "one two"), (3, "Another"), (9, "word " * 30_000), (-4, "neg")]
    df = spark.createDataFrame([(*r, "en", "x", "y") for r in rows], SCHEMA)
    assert ours(df) == brute(rows)
    assert ours(df, block_ids=3) == brute(rows)


def test_empty(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert ours(df, block_ids=5000) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_capitals_before_combining_marks():
    from tokenizers import Tokenizer

    with open(PATH) as f:
        e = tokens.Encoder(f.read())
    t = Tokenizer.from_file(PATH)
    pairs = ["J̌", "H̱", "T̈", "W̊", "Y̊"]  # composed small letters exist, composed capitals don't
    texts = [f"{before}{x}{after}" for x in pairs for before in ("", "A ", "a", "A") for after in ("", "a", "A.", " Word")]
    texts += [f"{chr(c)}{chr(m)}" for c in range(65, 91) for m in range(0x300, 0x370)]
    assert e.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def small_tokenizer(tmp_path, size):
    """A tokenizer of ``size`` words, not trained: the words are its vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({f"w{i}": i for i in range(size)}, unk_token="w0"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / f"{size}.json")
    t.save(path)
    return path


@pytest.mark.parametrize(("size", "width"), [(1000, 10), (5000, 13), (70_000, 17)])
def test_files_of_other_widths(spark, tmp_path, size, width):
    rng = np.random.default_rng(size)
    rows = [(i, rng.integers(0, size, int(rng.integers(0, 400))).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in ids), "en", "x", "y") for i, ids in rows], SCHEMA)
    blocks = tokens.write_tokens(df, small_tokenizer(tmp_path, size), block_ids=3000)
    by = {}
    for r in blocks.orderBy("shard", "block").collect():
        by.setdefault(r.file, []).append(r)
    assert len(by) > 1 and max(map(len, by.values())) > 1
    want = [ids + [2] for _, ids in rows]
    at = 0
    for file, own in by.items():
        f = tokens.TokenFile(file.removeprefix("file:"))
        n = sum(r.n_docs for r in own)
        assert f.block(0).width == width and own[0].size == 20 + 9 * own[0].n_docs + 8 * (own[0].n_docs + 1) + -(-own[0].n_ids * width // 8)
        assert [f.document(k).tolist() for k in range(n)] == want[at : at + n]
        flat = sum(want[at : at + n], [])
        for a, b in ((0, len(flat)), (5, 6), (len(flat) - 3, len(flat)), (2990, 3410), (7, 7)):
            assert f.ids(a, b).tolist() == flat[a:b]
        at += n
    assert at == len(rows)
    read = sorted((tuple(r) for r in tokens.read_tokens(blocks).collect()), key=lambda r: r[1])
    starts = np.cumsum([0, *map(len, want)]).tolist()
    assert read == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, want, strict=False)]


def test_other_orders(spark):
    rows = [(i, f"text {i}", (i * 7) % 30) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int")
    read = tokens.read_tokens(tokens.write_tokens(df, PATH, block_ids=9, order=("place",))).orderBy("start").collect()
    assert [r.doc_id for r in read] == [i for i, *_ in sorted(rows, key=lambda r: r[2])]
