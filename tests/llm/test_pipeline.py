import hashlib

import corpus_pipeline as C
from velum.llm import oracles, queries

SF = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    assert [n for n, _ in C.STAGES] == ["language", "near_dedup", "substring_dedup", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in C.run(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(got) < len(texts) and set(got) <= set(texts)
    whole = {hashlib.sha256((t or "").encode()).hexdigest(): d for d, t in texts.items()}
    same = [r for r in got.values() if r.decoded_sha256 in whole]
    # what lost no passage decodes to its own text, and of exact copies one is left
    assert same and len({r.decoded_sha256 for r in same}) == len(same)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(oracles.SQL) <= set(queries.queries())
