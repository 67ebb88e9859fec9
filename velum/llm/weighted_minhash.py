"""Near-duplicate documents by improved consistent weighted sampling.

A document is a multiset of five-word shingles (lower-cased words of letters and
digits). A shingle weighs its count times its inverse document frequency (TF-IDF). The
frequency is that in all documents, exact for every shingle: documents are dealt into
blocks, and each block sends its distinct hashes to parts of the range of hashes, which
count them and send their weights back. inverse() is ln((1 + N) / (1 + df)) + 1, which
the registered queries use; damped(), the general interface's default, hardly weighs
what is frequent less.

1. Documents with equal multisets form a class at once, however many they are.
2. Each class gets BANDS x ROWS samples; a sample of two documents agrees with a
   probability of their weighted Jaccard similarity. Classes that agree in all rows of
   a band share a bucket.
3. In each bucket every class is compared with one leader: the class whose buckets
   hold most classes, so the centre of a group of near copies. This is linear in the
   bucket, and buckets spread by their hash.
4. Candidates are verified by their exact weighted Jaccard similarity from the texts.
   Verified links give components. Where a bucket still holds other components than its
   leader's, the most central member of each is compared with the most central of them
   all, the next leader, until such a round links nothing. This too is linear in the
   bucket, and only joins early what is cheap to join.
5. The classes of all buckets that still hold several components are finished exactly: two
   multisets of similarity t share one of the rarest shingles that make up more than 1 - t of
   either's weight, rarest among these classes. Pairs of different components that share one, and whose weights from
   there on suffice, are verified, all of them. Common shingles are dealt out in blocks.

Edge cases: null and empty texts, and texts without a letter or digit, stand alone;
shorter texts than five words are one shingle; rows that repeat another row share its
class and class id; texts of any length are taken whole; a null id is larger than any
other as class id; columns besides id and text are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.common import NOT_WORD, Scratch, Words, chunks, components, let_go, materialize, mix, row_key, unused, utf8

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 5
#: Rows of one shingle that a task joins with the others of that shingle.
BLOCK = 500
#: Texts that are verified against one copy of their hub's text.
MEMBERS = 1000
#: For sums of weights in another order.
SLACK = 1e-6
RARE, DAMPING = 0.01, 0.25
#: Bytes of text, on average, of a block of documents, and of all blocks for each part of their hashes.
BLOCK_BYTES, PART_BYTES = 1 << 22, 1 << 24
#: Shingles that are sampled together, so that they stay in the processor's cache.
SAMPLED = 1 << 15

_rng = np.random.default_rng(20240229)
#: Draws of the two gamma variables by 16 random bits, and a multiplier for each sample.
_GAMMA_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_GAMMA_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: first, last + 1, then document, hash and count of
    each distinct shingle, sorted by document and hash."""
    let_go()
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    for i, j, data, offsets in chunks(*utf8(lower)):
        words = Words(data, offsets, NOT_WORD)
        at, h = words.grams(SHINGLE)
        doc = np.repeat(np.arange(j - i), words.counts)[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
        if len(short):
            doc = np.append(doc, short)
            h = np.append(h, words.spans(words.first[short], words.first[short + 1]))
        order = np.argsort(h)
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]  # by counting; a run has at most 4096 documents
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        yield i, j, doc[first], h[first], np.diff(np.append(first, len(h)))


def damped(n: int, df: np.ndarray) -> np.ndarray:
    """1 + DAMPING * log(n / df) / log(1 / RARE), with shingles in under RARE of the n documents as in RARE of them."""
    return (1 + DAMPING * np.log(max(n, 1) / np.maximum(df, RARE * n)) / np.log(1 / RARE)).astype(np.float32)


def inverse(n: int, df: np.ndarray) -> np.ndarray:
    """The inverse document frequency, smoothed so that what all n documents share weighs 1."""
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


class Weights:
    """damped() by a shingle's hash, from the frequencies of those in at least RARE of the n documents."""

    def __init__(self, n: int, frequent: np.ndarray, df: np.ndarray):
        order = np.argsort(frequent)
        self.rest = np.float32(1 + DAMPING)
        self.frequent = frequent[order]
        self.weights = damped(n, df[order])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rest)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            hit = self.frequent[at] == h
            out[hit] = self.weights[at[hit]]
        return out


def shingle_weights(docs: DataFrame) -> Weights:
    """From the document frequencies of all documents (text). At most the mean number of shingles / RARE are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for *_, h, _tf in shingles(b.column("text")))]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "df": df})

    n = docs.count()
    frequent = docs.select("text").mapInArrow(count, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") >= RARE * n).toPandas()
    return Weights(n, frequent["h"].to_numpy(np.int64).view(np.uint64), frequent["df"].to_numpy(np.int64))


def _blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs (doc_id, k1, k2, text) with one row for each key, how many rows had it (times) and
    its block; the number of rows of docs, and the bits of a hash that name its part."""
    sizes = docs.select("k1", "k2", F.octet_length("text").alias("bytes")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.max("bytes").alias("bytes"))
    r = sizes.agg(F.sum("times").alias("n"), F.max("times").alias("most"), F.sum("bytes").alias("bytes")).first()
    if (r.most or 1) > 1:
        docs = docs.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    else:
        docs = docs.withColumn("times", F.lit(1).cast("long"))
    block = F.pmod(F.xxhash64("k1", "k2"), F.lit((r.bytes or 0) // BLOCK_BYTES + 1)).alias("block")
    return docs.select(block, "doc_id", "k1", "k2", "times", "text"), r.n or 0, ((r.bytes or 0) // PART_BYTES).bit_length()


def _distinct(texts: pa.ChunkedArray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The runs of shingles(), their distinct hashes in ascending order, and the place among these of each of their rows."""
    runs = list(shingles(texts.combine_chunks()))
    return runs, *np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[3] for r in runs)]), return_inverse=True)


def block_weights(blocks: DataFrame, n: int, bits: int, idf: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """(block, part, weights): the weights of a block's distinct hashes that begin with part, in ascending order of these."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)

    def spread(t: pa.Table) -> pa.Table:
        runs, hashes, at = _distinct(t["text"])
        times = t["times"].to_numpy()
        df = np.bincount(at, np.concatenate([np.zeros(0), *(times[i:j][doc] for i, j, doc, _, _ in runs)]), len(hashes)).astype(np.int64)
        cuts = np.searchsorted(hashes, bounds)
        rows = [(p, h, c) for p, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(df, cuts), strict=True)) if len(h) or p == 0]
        return pa.table({
            "block": pa.array([t["block"][0].as_py()] * len(rows), pa.int64()),
            "part": pa.array([p for p, _, _ in rows], pa.int32()),
            # by places of bytes, of which the first ones repeat and compress
            "hashes": pa.array([h.view(np.uint8).reshape(-1, 8).T.tobytes() for _, h, _ in rows], pa.binary()),
            "counts": pa.array([c.astype(np.min_scalar_type(c.max(initial=0))).tobytes() for _, _, c in rows], pa.binary()),
        })

    def count(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel() for b in t["hashes"].to_pylist()]
        counts = [np.frombuffer(c, f"u{len(c) // max(len(h), 1) or 1}") for h, c in zip(hashes, t["counts"].to_pylist(), strict=True)]
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        weights = idf(n, np.bincount(at, np.concatenate(counts)))[at]
        parts = np.split(weights, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({"block": t["block"], "part": t["part"], "weights": pa.array([w.tobytes() for w in parts], pa.binary())})

    sent = blocks.groupBy("block").applyInArrow(spread, "block long, part int, hashes binary, counts binary")
    return sent.groupBy("part").applyInArrow(count, "block long, part int, weights binary")


def samples(h: np.ndarray, log_w: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Each sample of every document: a hash of the chosen shingle and its step.

    starts, counts: the rows of each document that has any.
    """
    for a in _MULTIPLIERS:
        bits = h * a
        r = _GAMMA_R.take((bits >> np.uint64(48)).view(np.int64))
        beta = ((bits >> np.uint64(8)).astype(np.uint32) & np.uint32(0xFFFFFF)).astype(np.float32)
        beta *= np.float32(2.0**-24)
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        # the score is log c - r * (t - beta + 1), in place
        score = _LOG_GAMMA_C.take(((bits >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64))
        np.subtract(t, beta, out=beta)
        beta += np.float32(1)
        beta *= r
        score -= beta
        hits = np.flatnonzero(score == np.repeat(np.minimum.reduceat(score, starts), counts))
        chosen = hits[np.searchsorted(hits, starts)]
        yield mix(h[chosen] ^ t[chosen].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, f1, f2, bands, weights): f1 and f2 name the multiset, null without words;
    weights are those of its distinct shingles in ascending order of their hashes."""
    u64 = np.uint64

    def run(docs: pa.Table, parts: pa.Table) -> pa.Table:
        docs, out, at_row = docs.combine_chunks(), [], 0
        runs, hashes, at = _distinct(docs["text"])
        weights = np.frombuffer(b"".join(parts.sort_by("part")["weights"].to_pylist()), np.float32)
        if len(weights) != len(hashes):
            raise RuntimeError("the rows of a block have changed")
        for i, j, doc, h, tf in runs:
            w = weights[at[at_row : at_row + len(h)]]
            at_row += len(h)
            counts = np.bincount(doc, minlength=j - i)
            ends = np.cumsum(counts)
            some = np.flatnonzero(counts)
            bands = np.zeros((j - i, BANDS), np.int64)
            f1, f2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
            if len(some):
                mixed = h ^ mix(tf.astype(u64))
                starts = (ends - counts)[some]
                f1[some] = np.add.reduceat(mix(mixed), starts).view(np.int64)
                f2[some] = np.add.reduceat(mix(mixed * u64(0xD6E8FEB86659FD93)), starts).view(np.int64)
                log_w = np.log(w * tf.astype(np.float32))
                # documents by SAMPLED shingles
                for those in np.split(some, np.flatnonzero(np.diff(starts // SAMPLED)) + 1):
                    lo, hi = ends[those[0]] - counts[those[0]], ends[those[-1]]
                    for k, s in enumerate(samples(h[lo:hi], log_w[lo:hi], ends[those] - counts[those] - lo, counts[those])):
                        if k % ROWS == 0:
                            band = np.full(len(s), k, u64)
                        band = mix(band ^ s) + u64(1)
                        if k % ROWS == ROWS - 1:
                            bands[those, k // ROWS] = band.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            cuts = np.append(0, ends * 4).astype(np.int32)
            own = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(w.tobytes())])
            part = [docs[c].slice(i, j - i).combine_chunks() for c in ("doc_id", "k1", "k2")]
            out.append(pa.table([*part, pa.array(f1, mask=counts == 0), pa.array(f2, mask=counts == 0), lists, own], ["doc_id", "k1", "k2", "f1", "f2", "bands", "weights"]))
        return pa.concat_tables(out)

    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, k1 long, k2 int, f1 long, f2 long, bands array<long>, weights binary"
    return blocks.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(run, schema)


def _weighed(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """As shingles() of a batch's texts, with the TF-IDF weight of each instead of its count."""
    for i, j, doc, h, tf in shingles(b.column("text")):
        idf = np.frombuffer(b"".join(b.column("weights").slice(i, j - i).to_pylist()), np.float32)
        yield i, j, doc, h, idf.astype(np.float64) * tf


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted hash arrays with their weights."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(common) else 0.0


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b) of the pairs (a, b, hub) that reach the threshold; texts: (node, text, weights) of every node.

    hub is the one of both that stands in most pairs. Each text travels to its hub once; a
    hub's own text travels once for each block of MEMBERS others, before theirs.
    """
    pairs = pairs.withColumn("node", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    # written, so that a hub of very many pairs can be split in the join
    blocks = scratch.write(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks")), "hubs")
    members = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node")
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    rows = members.unionByName(hubs).join(texts, "node").repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("node") != F.col("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, of = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                hub, node = b.column("hub").to_pylist(), b.column("node").to_pylist()
                linked: tuple[list, list] = ([], [])
                for i, j, doc, h, w in _weighed(b):
                    cuts = np.searchsorted(doc, np.arange(j - i + 1))
                    for k, x, y in zip(range(i, j), cuts, cuts[1:], strict=False):
                        if hub[k] == node[k]:
                            lead, of = (h[x:y].copy(), w[x:y].copy()), hub[k]
                        elif of != hub[k]:
                            raise RuntimeError("a hub's text is missing")
                        elif weighted_jaccard((h[x:y], w[x:y]), lead) >= threshold:
                            linked[0].append(min(hub[k], node[k]))
                            linked[1].append(max(hub[k], node[k]))
                yield pa.RecordBatch.from_pydict({"a": pa.array(linked[0], pa.string()), "b": pa.array(linked[1], pa.string())})

    return rows.select("hub", "node", "text", "weights").mapInArrow(run, "a string, b string")


def _tokens(texts: DataFrame) -> DataFrame:
    """(node, token, w): every shingle of each text with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, doc, h, w in _weighed(b):
                node = b.column("node").slice(i, j - i).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([node, pa.array(h.view(np.int64)), pa.array(w)], ["node", "token", "w"])

    return texts.select("node", "text", "weights").mapInArrow(run, "node string, token long, w double")


def _open_pairs(placed: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, hub), a < b: every pair of different components that can reach the threshold, of the
    nodes in buckets that hold several components.

    placed: (bucket, node, component). Shingles are put in one order: those of a single
    component, then the others by the number of these nodes that hold them. Two texts of
    similarity t meet at their first common shingle, and from there on each still has
    more than t of its weight.
    """
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    nodes = scratch.write(placed.join(several, "bucket").select("node", "component").distinct(), "open")
    rows = scratch.write(_tokens(texts.join(nodes.select("node"), "node")).join(nodes, "node"), "tokens")
    totals = rows.groupBy("node").agg(F.sum("w").alias("total"))
    common = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token", "n")
    rows = scratch.write(rows.join(scratch.write(common, "common"), "token"), "prefixes")
    # what is left of a text from a shingle on: only shingles of several components stand behind it
    behind = Window.partitionBy("node").orderBy(F.col("n").desc(), F.col("token").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rest", F.sum("w").over(behind)).join(totals, "node").where(F.col("rest") >= F.col("total") * (threshold * (1 - SLACK)))
    rows = rows.select("token", "node", "component", "rest", "total", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = scratch.write(rows, "prefixes")
    left = rows.select("token", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), *(F.col(c).alias(f"{c}_a") for c in ("node", "component", "rest", "total")))
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "rest", "total")))
    enough = F.least("rest_a", "rest_b") >= (F.col("total_a") + F.col("total_b")) * (threshold / (1 + threshold) * (1 - SLACK))
    both = left.join(right, ["token", "block"]).where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & enough)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().withColumn("hub", F.col("b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, idf: Callable[[int, np.ndarray], np.ndarray] = damped) -> DataFrame:
    """Per row of df: doc_id, k1, k2 (its row key), class_id (smallest doc_id of its
    class) and kept (whether the row is the class's first). idf: damped or inverse."""
    docs = df.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("text"))
    scratch = Scratch()
    blocks, n, bits = _blocks(docs)
    rows = scratch.write(signatures(blocks, block_weights(blocks, n, bits, idf)), "signatures").withColumn("node", F.concat(F.hex("f1"), F.lit("-"), F.hex("f2")))

    classes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("key"), F.min("bands").alias("bands"))
    found = classes.select("node", "key", F.posexplode("bands").alias("band", "value"))
    found = scratch.write(found.select("node", "key", F.xxhash64("band", "value").alias("bucket")), "members")
    shared = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = found.join(shared, "bucket")
    central = members.groupBy("node").agg(F.sum("size").alias("score"))
    members = scratch.write(members.select("bucket", "node", "key").join(central, "node"), "shared")

    nodes = members.select("node", "key.k1", "key.k2").distinct()
    nodes = scratch.write(nodes.join(rows.select("k1", "k2", "weights"), ["k1", "k2"]), "nodes")
    texts = scratch.write(blocks.select("k1", "k2", "text").join(nodes, ["k1", "k2"]).select("node", "text", "weights"), "texts")

    # each round compares a head of each component that its bucket's earlier leaders left over with the best of them
    heads = members.select("bucket", "score", "node", F.col("node").alias("component"))
    links = tried = None
    rounds = 0
    while True:
        leaders = heads.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("best")).select("bucket", F.col("best.node").alias("b"))
        pairs = heads.join(scratch.write(leaders, "leaders"), "bucket").where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), F.col("b").alias("hub")).groupBy("a", "b").agg(F.max("hub").alias("hub"))
        pairs = scratch.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = scratch.write(_verify(pairs, texts, threshold, scratch), "links")
        links, tried = (new, pairs.select("a", "b")) if tried is None else (links.unionByName(new), tried.unionByName(pairs.select("a", "b")))
        if rounds and new.isEmpty():
            break
        rounds += 1
        parts = scratch.write(components(links), "components")
        placed = members.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        led = scratch.write(placed.join(leaders.select("bucket", F.col("b").alias("node")), ["bucket", "node"]).select("bucket", "component"), "led")
        heads = placed.join(led, ["bucket", "component"], "left_anti").groupBy("bucket", "component").agg(F.max(F.struct("score", "node")).alias("best"))
        heads = scratch.write(heads.select("bucket", "best.score", "best.node", "component"), "heads")

    rest = _open_pairs(placed.select("bucket", "node", "component"), texts, threshold, scratch)
    rest = scratch.write(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    new = scratch.write(_verify(rest, texts, threshold, scratch), "links")
    if not new.isEmpty():
        parts = scratch.write(components(links.unionByName(new)), "components")

    # rows that repeat another row come back
    rows = docs.select("doc_id", "k1", "k2").join(rows.select("k1", "k2", "node"), ["k1", "k2"]).join(parts.withColumnRenamed("id", "node"), "node", "left")
    alone = F.concat(F.lit("row "), F.hex("k1"), F.lit("-"), F.hex("k2"))
    rows = materialize(rows.select("doc_id", "k1", "k2", F.coalesce("component", "node", alone).alias("component")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    # written, so that a component of very many documents can be split in the join
    first = materialize(rows.groupBy("component").agg(F.min(order).alias("first")), "first")
    scratch.clear()
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    return rows.join(first, "component").select("doc_id", "k1", "k2", F.col("first.doc_id").alias("class_id"), same.alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, idf: Callable[[int, np.ndarray], np.ndarray] = damped) -> DataFrame:
    """df with the first row of each class; of rows that repeat each other one stays."""
    kept = near_duplicates(df, doc_id, text, threshold, idf).where("kept").select("k1", "k2")
    keys = unused(df.columns, "k1", "k2")
    keyed = df.select("*", *(c.alias(n) for c, n in zip(row_key(doc_id, text), keys, strict=True)))
    kept = kept.select(*(F.col(c).alias(n) for c, n in zip(("k1", "k2"), keys, strict=True)))
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
