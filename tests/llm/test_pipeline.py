import zlib

import corpus_pipeline
import numpy as np
from test_decontam import brute as brute_items
from test_simhash import brute as brute_groups

from netfusion.llm.mixing import mix
from netfusion.llm.quality import classify

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    after = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = corpus_pipeline.written(stage(spark, now, SF), "test")
        assert now.columns == docs.columns
        after[name] = now.collect()
        assert all(r == rows[r.doc_id] for r in after[name])
    ids = {k: [r.doc_id for r in v] for k, v in after.items()}
    # quality: what the operator predicts, and nearly all that is labelled good
    assert sorted(ids["quality"]) == sorted(r.doc_id for r in classify(docs, labels).collect() if r.predicted)
    good = [r.doc_id for r in labels.collect() if r.quality == 1]
    assert len({*good} & {*ids["quality"]}) > 0.98 * len(good)
    # one of each group stays
    groups = brute_groups([(i, rows[i].text) for i in ids["quality"]])
    assert sorted(ids["near_dedup"]) == sorted(d for d, _, head in groups if d == head)
    leaks = {d for d, *_ in brute_items([(i, rows[i].text) for i in ids["near_dedup"]], benchmark)}
    assert leaks and sorted(ids["decontamination"]) == sorted({*ids["near_dedup"]} - leaks)
    assert {*ids["mixing"]} <= {*ids["decontamination"]} and len(ids["mixing"]) > 0.8 * len(ids["decontamination"])
    # its files are in the order of the mixture
    left = spark.createDataFrame(after["decontamination"], docs.schema)
    mixed = [r.doc_id for r in mix(left).orderBy("mix_order", "mix_epoch", "mix_block", "doc_id").collect()]
    in_files = now.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order = [r.doc_id for r in sorted(in_files, key=lambda r: (r.file_name, r.row_index))]
    assert order == mixed != sorted(mixed)
    # token output
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in order:
        x = t.encode(rows[i].text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted((tuple(r) for r in corpus_pipeline.STAGES[4][1](spark, now, SF).collect()), key=lambda r: r[1]) == want


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = sorted(((r.doc_id, r.start, r.n_tokens) for r in out.collect()), key=lambda r: r[1])
    assert rows and all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns and a long text go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    rows = [(100_000 + i, t, f"s{i % 2}") for i, t in enumerate(good)]
    rows += [(None, good[0] + " with an end of its own", "s0"), (None, None, None), (200_000, None, "s1"), (200_001, "", None), (200_002, " ".join(good) * 20, "s0"), rows[3], rows[3]]
    odd = spark.createDataFrame([(*r, "en", "a", 1.0, "c") for r in rows], "doc_id long, text string, source string, lang string, _row string, mix_order double, score string")
    now = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, now = now, corpus_pipeline.written(stage(spark, now, SF), "test")
        assert now.columns == odd.columns and {r.text for r in now.collect()} <= {r.text for r in before.collect()}, name
    kept = now.collect()
    assert len(kept) > 10 and all(r._row == "a" and r.mix_order == 1.0 and r.score == "c" for r in kept)
    out = corpus_pipeline.STAGES[4][1](spark, now, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in kept)
