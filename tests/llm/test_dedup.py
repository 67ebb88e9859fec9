import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from velum.llm import decontaminate, embedding_dedup, substrings, weighted_minhash

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, k1 string"


def groups(n, links):
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return [root(i) for i in range(n)]


def test_vectors_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    vectors = [(centres[i % 6] + rng.normal(scale=0.12, size=24)).tolist() for i in range(120)]
    vectors += [vectors[0], None, [0.0] * 24, [math.nan] * 24, [1.0, None] * 12, []]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], None if i == 3 else i % 2, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    results = []
    for block, heavy in ((1000, 16), (3, 1), (1000, 0)):
        monkeypatch.setattr(embedding_dedup, "HEAVY", heavy)
        results.append({r.vec_id: r for r in embedding_dedup.near_vectors(df, block=block).collect()})
    assert results[0] == results[1] == results[2]
    got = results[0]
    usable = [i for i, v, label, _ in rows if v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in usable}
    links = [(a, b) for a in usable for b in usable if a < b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    top = groups(len(rows), links)
    assert len(links) > 20 and len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i].n_links == sum(i in p for p in links) and got[i].component_id == top[i] and got[i].kept == (top[i] == i)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_broad_groups_make_few_rows(spark):
    """Vectors around one direction, pairs of which lie just below the cosine: pairs that become rows grow as
    the vectors do, and the links among them are found."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    made = []
    for n in (200, 400):
        noise = rng.normal(size=(n, 64))
        noise -= np.outer(noise @ centre, centre)
        v = centre + 0.16 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
        v[n // 2 :: 40] = v[: n // 2 : 40][: len(v[n // 2 :: 40])] + 0.02 * noise[: len(v[n // 2 :: 40])] / 8  # some that link
        df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = (u @ u.T >= 0.98).sum(axis=1) - 1
        assert {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()} == dict(enumerate(near.tolist())) and near.any()
        nodes = df.select(F.col("vec_id").cast("string").alias("node"), F.col("vec_id").cast("string").alias("cluster"), F.lit("1").alias("label"), F.size("embedding").alias("size"), "embedding")
        keys = embedding_dedup.Index(nodes, 0.98).keys(nodes, True, "cluster")
        homes = {r.key: (r.home, r.all) for r in keys.groupBy("key").agg(F.count(F.when(F.col("own"), 1)).alias("home"), F.count("node").alias("all")).collect()}
        rows = sum(h * a for h, a in homes.values() if h <= embedding_dedup.HEAVY) + sum(h + a for h, a in homes.values() if h > embedding_dedup.HEAVY)
        probes = sum(a for _, a in homes.values())
        made.append(rows / probes)
        assert rows <= embedding_dedup.HEAVY * probes
    assert made[1] < 1.6 * made[0]


def test_wide_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=400).tolist(), 1) for i in range(6)]
    rows.append((6, [x * 2 for x in rows[0][1]], 1))
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: i for i in range(6)}, 6: 0}


def test_near_duplicates_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "!!"), (9004, "uno dos"), (9005, "Uno, dos."), (None, "uno dos")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    rows = docs.collect()
    import pyarrow as pa

    weights = weighted_minhash.shingle_weights(docs)
    sets = []
    for i, j, doc, h, tf in weighted_minhash.shingles(pa.array([r.text for r in rows], pa.string())):
        sets += [(h[doc == d], weights(h[doc == d]).astype(float) * tf[doc == d]) for d in range(j - i)]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if weighted_minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    top = groups(len(rows), near)
    want = {}
    for i, t in enumerate(top):
        want.setdefault(t, []).append(rows[i].doc_id)
    classes = {}
    for r in weighted_minhash.near_duplicates(docs).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    key = lambda ids: sorted(ids, key=lambda x: (x is None, x or 0))
    assert sorted(map(str, map(key, classes.values()))) == sorted(map(str, map(key, want.values())))
    kept = weighted_minhash.keep_one(docs)
    assert kept.count() == len(want) and kept.columns == ["doc_id", "text"]
    assert weighted_minhash.keep_one(docs.limit(0)).count() == 0


def test_near_duplicates_with_shared_passages(spark):
    # a passage in every document, and own words that pair two of them: many pairs meet in the passage's buckets only
    import pyarrow as pa

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(300)]
    texts = []
    for _ in range(150):
        own = [word() for _ in range(44)]
        texts += [" ".join(passage + own), " ".join(passage + own[:22] + [word() for _ in range(22)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    weights = weighted_minhash.shingle_weights(docs)
    sets = []
    for i, j, doc, h, tf in weighted_minhash.shingles(pa.array(texts, pa.string())):
        sets += [(h[doc == d], weights(h[doc == d]).astype(float) * tf[doc == d]) for d in range(j - i)]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if weighted_minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    assert near == [(2 * k + 1, 2 * k) for k in range(150)]
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 149 and len(set(got.values())) >= 150


def test_document_frequencies(spark):
    from collections import Counter

    import pyarrow as pa

    texts = ["one two three four five six"] * 30 + [f"one two three four five d{i} e{i} one two three four five" for i in range(90)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    weights = weighted_minhash.shingle_weights(docs)
    df = Counter(x for *_, h, _ in weighted_minhash.shingles(pa.array(texts)) for x in h.tolist())
    assert set(weights.frequent.tolist()) == {h for h, n in df.items() if n >= 0.01 * len(texts)}
    rare = np.array([1, 2, 3], np.uint64)
    assert (weights(rare) == 1.25).all()
    common = np.array([h for h, n in df.items() if n == 120], np.uint64)
    assert np.allclose(weights(common), 1 + 0.25 * np.log(122 / 120) / np.log(100)) and len(common) == 1


def test_near_duplicates_in_a_chain(spark):
    # neighbours at 0.818, all others far less: one class, however its buckets fall
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[12 * i : 12 * i + 124]) for i in range(300)]
    got = weighted_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_near_duplicates_by_inverse_document_frequency(spark, tmp_path, monkeypatch):
    # pairs with common passages alike and rare words unlike, and the other way round, against plain Python with exact frequencies
    import re
    from collections import Counter

    from velum.llm import queries

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passages = [[word() for _ in range(60)] for _ in range(2)]
    texts = []
    for _ in range(40):  # alike but for own words
        texts += [" ".join(passages[0] + [word() for _ in range(3)]) for _ in range(2)]
    for _ in range(40):  # own words alike, one of both in a common frame
        own = [word() for _ in range(100)]
        texts += [" ".join(own), " ".join(own + passages[1][:30])]
    texts += [" ".join(passages[1]) for _ in range(80)] + [None, "", "?", "One two.", "one TWO"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3 + [(None, texts[9])] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    sets = []
    for _, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))))
    df = Counter(x for s in sets for x in s)

    def links(idf):
        weights = [{x: c * idf(df[x]) for x, c in s.items()} for s in sets]
        total = [sum(w.values()) for w in weights]
        out = set()
        for a, b in ((a, b) for a in range(len(rows)) for b in range(a)):
            low = sum(min(x, weights[b][k]) for k, x in weights[a].items() if k in weights[b])
            if low and low >= 0.8 * (total[a] + total[b] - low):
                out.add((a, b))
        return out

    n = len(rows)
    near = links(lambda d: math.log((1 + n) / (1 + d)) + 1)
    flat = links(lambda d: 1 + 0.25 * math.log(n / max(d, 0.01 * n)) / math.log(100))
    assert near - flat and flat - near
    top = groups(n, near)
    first = {t: min((rows[i][0] for i in range(n) if top[i] == t), key=lambda x: (x is None, x or 0)) for t in top}
    want = sorted(((rows[i][0], first[top[i]]) for i in range(n)), key=str)
    for block, part in ((1 << 22, 1 << 24), (1 << 11, 1 << 10)):
        monkeypatch.setattr(weighted_minhash, "BLOCK_BYTES", block, raising=False)
        monkeypatch.setattr(weighted_minhash, "PART_BYTES", part, raising=False)
        got = queries.op8_near_duplicates(spark, str(tmp_path)).collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want


def _removed(texts, window):
    words = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, j) for places in seen.values() if len(places) > 1 for d, i in places for j in range(i, i + window)}
    return [(len(w), sum((d, j) in gone for j in range(len(w))), " ".join(x for j, x in enumerate(w) if (d, j) not in gone)) for d, w in enumerate(words)]


def test_repeats_as_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "a " * 200, "a b c d e f", "a b c d e f"]
    df = spark.createDataFrame([(i % 60, t, "x") for i, t in enumerate(texts)], DOC)
    want = sorted(_removed(texts, 6))
    for group in (50_000, 7, 1):
        got = substrings.remove_repeats(df, window=6, prefix=3, group=group)
        assert got.columns == ["doc_id", "text", "k1", "n_words", "n_removed", "kept"]
        assert sorted((r.n_words, r.n_removed, r.kept) for r in got.collect()) == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_words_that_a_polynomial_confuses(spark):
    # two words of 2,048 letters whose polynomial hashes modulo 2 ** 64 are equal for every base
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    odd = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    texts = [" ".join([*(f"w{i}" for i in range(20)), w, *(f"w{i}" for i in range(20, 39))]) for w in odd]
    texts += [" ".join(f"x{i}" for i in range(34)), " ".join(f"x{i}" for i in range(34)), texts[0] + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (2000, 1):
        got = sorted((r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, group=group).collect())
        assert got == sorted(_removed(texts, 35))


def test_repeats_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    texts = [" ".join(words), "start " + " ".join(words[30_000:30_100]) + " end", " \t\n ", "é" * 70_000 + " " + " ".join(words[5:60])]
    df = spark.createDataFrame([(None if i == 1 else i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, _spans array<int>, k2 string")
    got = substrings.remove_repeats(df).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got) == sorted(_removed(texts, 35)) and all(r._spans == [1] and r.k2 == "x" for r in got)


def test_overlaps_with_items(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [[word() for _ in range(n)] for n in (30, 14, 7, 3)]
    spoilt = [*items[0]]
    spoilt[10] = spoilt[21] = "other"
    texts = ["x y " + " ".join(items[1]) + " z", " ".join(spoilt), "q " + " ".join(items[2]), " ".join(items[3]), " ".join(word() for _ in range(500)), None, ""]
    bench = spark.createDataFrame([(i, " ".join(w).upper() if i == 1 else " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    for least, third in ((1, [3]), (5, [])):  # an item of three words is a hit, but no reason to drop a document
        got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.flag(docs, bench, block_bytes=200, least=least).collect()}
        assert got == {0: [1], 1: [0], 2: [2], 3: third, 4: [], 5: [], 6: []}
    assert sorted(r.doc_id for r in decontaminate.clean(docs.drop("hits"), bench).collect()) == [3, 4, 5, 6]
    named = bench.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    doubled = docs.where("doc_id < 2").unionByName(docs.where("doc_id < 2")).withColumn("item_id", F.lit(0))
    assert sorted((r.doc_id, h.item_id) for r in decontaminate.flag(doubled, named).collect() for h in r.hits) == [(0, "i1"), (0, "i1"), (1, "i0"), (1, "i0")]
    long = docs.where("doc_id = 0").withColumn("text", F.concat(F.repeat(F.lit("lorem ipsum "), 200_000), "text"))
    assert [(h.item_id, h.start) for h in decontaminate.flag(long, bench).first().hits] == [(1, 400_002)]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 7 and decontaminate.flag(docs.limit(0), bench).count() == 0


def test_seeds_cover_what_is_accepted():
    # every set of substitutions in items of 5 to 13 words, and random ones in longer items, against the rule itself
    import pyarrow as pa

    rng = random.Random(7)
    for n in [*range(1, 14), 15, 17, 30, 40]:
        item = [f"w{n}x{k}" for k in range(n)]
        masks = range(1 << n) if n <= 12 else [sum((rng.random() < 0.75) << k for k in range(n)) for _ in range(3000)]
        same = [[m >> k & 1 for k in range(n)] for m in masks]
        texts = ["a b " + " ".join(w if s else "other" for w, s in zip(item, row, strict=True)) + " c" for row in same]
        want = {}
        for d, row in enumerate(same):
            best, at, low, low_at, total = 0, (0, 0), 0, 0, 0
            for k, x in enumerate(row):
                total += 1 if x else -2
                if total - low > best:
                    best, at = total - low, (low_at, k + 1)
                if total < low:
                    low, low_at = total, k + 1
            matched = sum(row[at[0] : at[1]])
            if matched >= min(12, math.ceil(0.8 * n)):
                want[d] = [(5, 2 + at[0], at[1] - at[0], matched)]
        seeds = decontaminate.Seeds([(5, " ".join(item)), (6, "a b c")])
        got = {}
        for i, _, words in decontaminate._tokens(pa.array(texts)):
            got |= {i + d: h for d, h in seeds.hits(words).items()}
        assert len(want) > (2 if n > 4 else 0) and got == want
