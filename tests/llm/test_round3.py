"""Fill-in-middle, hard negatives and BPE by merge rounds: against brute force and the library."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers as P
from velum.llm import bpe_numpy, hard_negatives, infill, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", "\n", "\n\n\n", "  \n\t x", "</s><|endoftext|>  <|endoftext|>\n", "añ😀  don't\r\n1234", "ab" * 4000 + "\n" + "a" * 9001, "same", "same", "a<P>b\nc", "<S", "end.\n\n  next\n", "x՘࢏  \U000323b0y"]


def docs(spark):
    more = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id\nat all"), (90_008, "same")], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(more)


# --------------------------------------------------------------- fill in middle


def expected(doc_id, text, pattern, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(pattern, text)
    n = len(units)
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(
    "units, pattern",
    [
        (infill.LINES, r"[^\n]*\n|[^\n]+"),
        (infill.CHARACTERS, r"(?s)."),
        (infill.Units("\n", 5), r"[^\n]{5}|[^\n]*\n|[^\n]+"),
        (infill.Units(" .\n"), r"[^ .\n]*[ .\n]|[^ .\n]+"),
    ],
)
def test_infill_equals_regex(spark, units, pattern):
    clashing = docs(spark).withColumn("n", F.lit("x")).withColumn("h1", F.lit("kept"))
    made = infill.transform(clashing, units=units, rate=90).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == 200 + len(ODD) + 2 and {r.h1 for r in rows} == {"kept"} and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, pattern, 90), r.doc_id
        assert r.restored == (r.text or "")
    assert infill.transform(docs(spark).limit(0)).count() == 0


def test_infill_restores_texts_beside_sentinels(spark):
    texts = ["<\n<\n<", "S>\nP>\nM>\n", "<S\n<P\n<M", ">\n<<\n", "P>x\n<"]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    made = infill.transform(df).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    assert made.where("restored <> text").count() == 0 and made.where("form = 'plain'").count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P", "<M>"), ("<P", "P>", "<M>")):
        with pytest.raises(ValueError):
            infill.Sentinels(*bad)


# --------------------------------------------------------------- hard negatives


def brute(rows, positives, negatives, low, high, scale):
    good = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in good:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == lab) for j, other, w in good if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2]][:positives]:
            near = [(s, k) for s, k, same in scored if not same and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"positives": 2, "negatives": 40, "low": -20, "high": 100}, {"positives": 700, "negatives": 1, "scale": 3}])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(hard_negatives, "DIGIT", 4)  # many passes
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    r = random.Random(3)
    rows = [(i, [r.choice((r.uniform(-1, 1), 0.25)) for _ in range(4)], r.randrange(4)) for i in range(600)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.1], i % 3) for i in range(300)]  # a third are copies: ties
    rows += [(2000 + i, [0.1] * (i % 3), i % 2) for i in range(60)]  # other widths, none among them
    rows += [rows[0], rows[50], (50, [0.0, 0.1, 0.2, 0.3], 1)]  # repeated rows, an id that repeats
    rows += [(None, [0.5] * 4, 1), (3000, None, 1), (3001, [None, 1.0, 1.0, 1.0], 1), (3050, [float("nan")] * 4, 2), (3051, [float("-inf")] * 4, 2), (3100, [0.5] * 4, None), (-50, [-1.0, -1.0, -1.0, -1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    full = {"positives": 5, "negatives": 3, "low": 50, "high": 95, "scale": 256} | options
    want = brute(rows, **full)
    assert want and mined(df, **options) == want


def test_hard_negatives_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 1")) == [] and mined(df) == []
    assert hard_negatives.mine(df.limit(0), F.lit(True)).dtypes == hard_negatives.mine(df, F.lit(True)).dtypes
    wide = spark.createDataFrame([(0, [3e6, 1e6], 1), (1, [3e6, 1e6], 1), (2, [2e6, 1e6], 2)], "vec_id long, embedding array<double>, label int")
    a, b = 256 * 3 * 10**6, 256 * 10**6
    assert mined(wide) == [(0, 1, 1, 2, a * a + b * b, 2 * 256 * 10**6 * a + b * b)]
    with pytest.raises(OverflowError):
        mined(wide.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)))


# --------------------------------------------------------------------------- BPE


def test_merge_rounds_equal_library(spark):
    library = Tokenizer.from_file(P.path(bpe_numpy.TOKENIZER))
    coded = bpe_numpy.encode(docs(spark).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1)), packed="packed", decoded="decoded")
    again = {r.doc_id: r.again for r in bpe_numpy.decode(coded.drop("decoded"), decoded="again").collect()}
    rows = bpe_numpy.digests(coded).collect()
    assert len(rows) == 200 + len(ODD) + 2
    for r in rows:
        e = library.encode(r.text or "", add_special_tokens=False)
        assert list(r.ids) == e.ids and r.decoded == library.decode(e.ids, skip_special_tokens=False) == (r.text or "")
        assert again[r.doc_id] == r.decoded or r.doc_id is None
        data = np.array(e.ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(e.ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())
    assert bpe_numpy.encode(docs(spark).limit(0)).count() == 0
    q = queries.op13_bpe_roundtrip(spark, SF)
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.collect()} == {d: v for d, v in whole.items() if d is not None and d < 90_000}


def test_decoding_passes_over_unknown_ids(spark):
    library = Tokenizer.from_file(P.path(bpe_numpy.TOKENIZER))
    r = random.Random(5)
    rows = [[r.randrange(60_000) for _ in range(20)] for _ in range(200)] + [[], None, [None, 64, -3, 50256]]
    got = bpe_numpy.decode(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, ids array<int>")).orderBy("i").collect()
    for g, x in zip(got, rows, strict=True):
        assert g.decoded == library.decode([y for y in x or [] if y is not None and y >= 0], skip_special_tokens=False)


def test_merge_rounds_on_made_words():
    """Long words, in many blocks, and overlapping equal pairs; all code points as the library splits them."""
    c, library = bpe_numpy.Coder(bpe_numpy.TOKENIZER), Tokenizer.from_file(P.path(bpe_numpy.TOKENIZER))
    r = random.Random(1)
    letters = ["ab", "aaab", "abcdefghijklmnopqrstuvwxyz", "thequickandering", "ÃÂ", "=-", "-" * 9 + "="]
    texts = ["".join(r.choice(a) for _ in range(n)) for a in letters for n in (1, 2, 30, 383, 384, 768, 769, 5000, 20_000)]
    texts += ["a" * 5000, "aab" * 3000, "=" * 3001, *(f"a{chr(x)}1{chr(x)}-{chr(x)} {chr(x)}  x" for x in range(0, 0x30000, 7) if not 0xD800 <= x < 0xE000)]
    ids, bounds = c.encode(pa.array(texts))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids
    assert c.decode(ids, bounds).to_pylist() == texts
    with pytest.raises(ValueError):  # a merge that makes a token which an earlier merge needs
        bpe_numpy.Merges(np.array([(3, 0, 4), (0, 1, 3)]), np.ones(5, np.int64))
