"""The pipeline's stages on a small table, each against a brute-force version of its own decision."""

import public_tokenizers
from helpers import SCHEMA, near, rows
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tmp_path):
    found = [r for r in rows() if r[0] is not None][:-1]
    sf = str(tmp_path)
    spark.createDataFrame(found, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
            after = [tuple(r) for r in docs.collect()]
            assert set(after) <= set(before) and len(after) == len(set(after))
        if name == "quality":
            assert 0.6 * len(before) < len(after)
        elif name == "exact dedup":
            last = {}
            for r in before:
                last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
            assert {r[0] for r in after} == set(last.values())
        elif name == "near dedup":
            assert {r[0] for r in after} == {d for d, _, c in near(before) if d == c}
        elif name == "packing":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before}
            got = {}
            for r in docs.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want
