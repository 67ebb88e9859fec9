"""Empty tables, nulls, very long texts, repeated rows and clashing columns, for the operators on documents."""

import base64
import hashlib
import tempfile

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from velum.llm import bpe_duckdb, bpe_numpy, decontaminate, langid, licences, quality, substrings, weighted_minhash

SF = "/root/testdata/sf0.001"
CLASHES = ["ids", "decoded", "letters", "k1", "node", "rejected", "score", "licences", "sentence_ids", "hits", "kept", "spans", "h", "host"]
LONG = "una historia clinica muy larga " * 60_000 + "\nReleased under the MIT license."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, LONG), (4, "un texto"), (4, "un texto"), (None, "un texto"), (5, "!! \n\t"), (6, "w" * 300 + " fin")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHES})


OPERATORS = {
    "langid": lambda df, bench: langid.predict(df, langid.fit(bench.select("text", F.lit("es").alias("lang")))),
    "licences": lambda df, bench: licences.scan(df),
    "overlaps": lambda df, bench: decontaminate.flag(df, bench),
    "repeats": lambda df, bench: substrings.remove_repeats(df),
    "near": lambda df, bench: weighted_minhash.near_duplicates(df),
    "bpe_duckdb": lambda df, bench: bpe_duckdb.encode(df, decoded="decoded"),
    "bpe_numpy": lambda df, bench: bpe_numpy.encode(df, decoded="decoded"),
    "quality": lambda df, bench: quality.assess(df, bench.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("good")), "good", url=F.lit("a.org/b")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_and_nothing_comes_of_nothing(spark, odd, name):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = OPERATORS[name](odd, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.asDict())
    assert by_id[4][0] == by_id[4][1] or name == "near"  # rows that repeat each other are told apart only by what is kept
    if name != "near":
        made = {k for k, v in by_id[3][0].items() if v != "mine"}
        assert {c for c in CLASHES if c not in made} == {c for c in CLASHES if by_id[1][0].get(c) == "mine"}
    assert OPERATORS[name](odd.limit(0), bench).count() == 0


def test_values_of_odd_texts(spark, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_duckdb.encode(odd, decoded="decoded").collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.k1 == "mine"
    assert {r.doc_id: r.licences for r in licences.scan(odd).collect()}[3] == ["MIT"]
    near = sorted((str(r.doc_id), r.class_id, r.kept) for r in weighted_minhash.near_duplicates(odd).collect())
    assert [x for x in near if x[1] == 4] == [("4", 4, True), ("4", 4, True), ("None", 4, False)]
    assert all(kept for i, c, kept in near if i != "None")
    assert sorted(str(r.doc_id) for r in weighted_minhash.keep_one(odd).collect()) == ["1", "2", "3", "4", "5", "6"]


def _run(spark, docs):
    folder = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, folder).collect()


def test_pipeline_edges(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # the words of a document that stays, from behind: of its language, but no copy of it
    clean = next(" ".join(r.text.split()[:40][::-1]) for r in given.orderBy("doc_id").collect() if r.doc_id in before and r.text and len(r.text.split()) > 100)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(900_001, None), (900_002, ""), (900_003, "123 !!"), (900_004, clean), (900_004, clean), (None, clean), (900_005, " ".join(clean.split()[:20]) + " " + item)]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    docs = given.unionByName(more.select(given.columns)).withColumns({"k1": F.lit("x"), "node": F.lit("x"), "hits": F.lit("x"), "ids": F.lit("x")})
    got = _run(spark, docs)
    assert set(got[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    own = {r.doc_id: r.decoded_sha256 for r in got if r.doc_id is None or r.doc_id > 900_000}
    assert own == {900_004: hashlib.sha256(clean.encode()).hexdigest()}
    assert {r.doc_id for r in got} - set(own) == set(before)
    assert _run(spark, docs.limit(0)) == [] and _run(spark, docs.where("doc_id in (900001, 900002)")) == []
