"""Removal of word passages that occur more than once, by prefix-partitioned
suffix trees.

A window is WINDOW consecutive words of a document. It repeats if two suffixes of the
corpus share their first WINDOW words: then they hang below one internal node, at
least that deep, of the corpus's suffix tree. That tree is never built whole:

1. Suffixes are represented at anchors. The anchor of a window is its first run of
   PREFIX words with the least hash; equal windows have equal anchors at equal
   places, so only suffixes with the same anchor words can share a node. Neighbouring
   windows mostly share their anchor, so there is a row for about 14 words.
2. The PREFIX words are the first, short prefix. Prefixes that occur once lead to no
   internal node and are dropped by counting.
3. Of occurrences whose whole surroundings (the words of all windows of the anchor) have
   one 128-bit digest, the first and the last become leaves: enough for every node above
   them to have two. So thousands of copies are two rows, and their words are compared.
4. A prefix with at most GROUP leaves is a memory-sized group. Larger ones are split
   again and again by longer prefixes, up to the end of their anchor and then STEP words
   more each time, until they are small enough or the prefix is a whole window, which is
   a node itself.
5. A task sorts a group's suffixes by their words (a suffix array) and takes the common
   depth of neighbours: runs of depth WINDOW or more are the leaves below one deep
   internal node, and the greatest depth beside a leaf is the maximal repeat there.
6. What they cover goes back to all occurrences, and documents drop those words.

Suffixes are compared by the bytes of their words. Hashes only deal out the work, but for
the digest of step 3. Documents are keyed by 96 bits of id and text, so null or repeated
ids need no care: rows that repeat each other make their windows repeat.

Edge cases: null and empty texts have no words; texts under WINDOW words lose
nothing; very long words and texts are like any other; an empty table gives an empty
result; columns other than the three made stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import SPACES, Scratch, Words, chunks, give_back, let_go, materialize, row_key, unused, utf8

WINDOW, PREFIX, STEP = 35, 8, 9
#: Leaves of a prefix that a task takes as one group, some 30 suffixes each.
GROUP = 2000
#: Bytes of words that a task sorts at once, besides those of a group that it is in.
BATCH_BYTES = 1 << 20

ANCHORS = "k1 long, k2 int, gram long, c1 long, c2 long, lo int, step int, times int, off int, n int"
LEAF = ["gram", "c1", "c2", "bit", "n", "words"]


def _first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each i with i + width <= len(h): where h[i:i + width] has its first minimum."""
    at = np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        right_h, right_at = h[step:], at[step:]
        n = len(right_h)
        take = right_h < h[:n]
        h, at = np.where(take, right_h, h[:n]), np.where(take, right_at, at[:n])
        have += step
    return at


def anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Document, anchor, first window and number of windows of every anchor."""
    n = len(words.hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - prefix + 1)
    least = _first_minima(words.spans(at, at + prefix), window - prefix + 1)
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts)
    whole = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])  # windows within a document
    least = least[whole]
    opens = np.ones(len(whole), bool)
    opens[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1] + 1) | (doc[whole[1:]] != doc[whole[:-1]])
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(whole)))
    return doc[whole[first]], least[first], whole[first], size


def _spelled(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each with a space behind it, and where each begins."""
    lengths = words.ends - words.starts
    first = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=first[1:])
    out = np.full(first[-1], 32, np.uint8)
    word = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(word)) + word] = words.data[~SPACES[words.data]]
    return out, first


def _scan(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """The anchors of all documents (k1, k2, text). Equal ones in line, as words that
    repeat over and over make them, are one row: the first, their distance and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        give_back()  # what tasks of other kinds have left in this worker
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for i, _, data, offsets in chunks(*utf8(b.column("text"))):
                words = Words(data, offsets, SPACES)
                doc, a, lo, n = anchors(words, window, prefix)
                gram = words.spans(a, a + prefix)
                spelled, begins = _spelled(words)
                view, digest = memoryview(spelled), xxhash.xxh3_128_digest
                ctx = b"".join([digest(view[x:y]) for x, y in zip(begins[lo].tolist(), begins[lo + n + window - 1].tolist(), strict=True)])
                ctx = np.frombuffer(ctx, np.int64).reshape(-1, 2)
                same = np.zeros(len(doc), bool)
                same[1:] = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1]) & (ctx[1:] == ctx[:-1]).all(axis=1)
                step = np.diff(lo, prepend=0)
                runs = ~same
                runs[1:] |= same[:-1] & (step[1:] != step[:-1])
                first = np.flatnonzero(runs)
                times = np.diff(np.append(first, len(doc)))
                step = np.where(times > 1, step[np.minimum(first + 1, len(doc) - 1)], 0)
                doc, a, lo, n = doc[first], a[first], lo[first], n[first]
                yield pa.RecordBatch.from_pydict({
                    "k1": k1[i + doc], "k2": k2[i + doc], "gram": gram[first].view(np.int64), "c1": ctx[first, 0], "c2": ctx[first, 1],
                    "lo": (lo - words.first[doc]).astype(np.int32), "step": step.astype(np.int32), "times": times.astype(np.int32),
                    "off": (a - lo).astype(np.int32), "n": n.astype(np.int32),
                })

    return docs.select("k1", "k2", "text").mapInArrow(run, ANCHORS)


def _leaves(docs: DataFrame, window: int) -> DataFrame:
    """The words of the wanted surroundings: a row for each of `wants`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        give_back()  # what tasks of other kinds have left in this worker
        for b in batches:
            wants = b.column("wants")
            for i, j, data, offsets in chunks(*utf8(b.column("text"))):
                words = Words(data, offsets, SPACES)
                spelled, begins = _spelled(words)
                part = wants.slice(i, j - i)
                of = np.repeat(np.arange(j - i), pc.list_value_length(part).to_numpy())
                w = {x: y.to_numpy(zero_copy_only=False) for x, y in zip(("lo", "n", "off", "many", "gram", "c1", "c2"), part.flatten().flatten(), strict=True)}
                lo = words.first[of] + w["lo"]
                raw = spelled.tobytes()
                texts = [raw[x : y - 1] for x, y in zip(begins[lo].tolist(), begins[lo + w["n"] + window - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({x: w[x] for x in ("gram", "c1", "c2", "off", "n", "many")} | {"words": pa.array(texts, pa.binary()).cast(pa.string())})

    return docs.mapInArrow(run, "gram long, c1 long, c2 long, off int, n int, many boolean, words string")


def subtree_marks(groups: np.ndarray, n: np.ndarray, words: pa.Array, window: int) -> np.ndarray:
    """Of each leaf's n windows, as bits, those that lie within a maximal repeat.

    groups: ascending; words: the leaf's words, joined by single spaces. Suffixes that
    begin with its windows are sorted within their group by word after word.
    """
    lists = pc.split_pattern(words, " ")
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(">u4") + 1  # equal ids: equal words
    first = np.asarray(lists.offsets).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start, length = first[row] + bit, (first[row + 1] - first[row] - bit)
    width = int(length.max(initial=0))
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)])
    suffixes = np.empty((len(row), width + 1), ">u4")
    suffixes[:, 0] = np.cumsum(np.diff(groups, prepend=groups[:1]) != 0)[row]
    suffixes[:, 1:] = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    suffixes[:, 1:][np.arange(width) >= length[:, None]] = 0
    order = np.argsort(suffixes.view(f"V{suffixes.shape[1] * 4}").ravel(), kind="stable")
    suffixes, length, row, bit = suffixes[order], length[order], row[order], bit[order]

    differ = suffixes[1:] != suffixes[:-1]
    depth = np.where(differ.any(axis=1), differ.argmax(axis=1) - 1, width)  # words in common with the leaf before; -1: another group
    depth = np.minimum(depth, np.minimum(length[1:], length[:-1]))
    deepest = np.full(len(row), -1)  # the deepest internal node above each leaf: a repeat that no other extends
    deepest[1:] = depth
    deepest[:-1] = np.maximum(deepest[:-1], depth)
    hit = deepest >= window
    spans = (np.int64(1) << (deepest[hit] - window + 1)) - 1 << bit[hit]
    marks = np.zeros(len(n), np.int64)
    np.bitwise_or.at(marks, row[hit], spans)
    return marks


def _trees(leaves: DataFrame, window: int) -> DataFrame:
    """(c1, c2, mask) of memory-sized groups of leaves; a partition holds whole groups, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        give_back()  # what tasks of other kinds have left in this worker
        held: list[pa.RecordBatch] = []
        size = 0

        def marks(table: pa.Table) -> pa.RecordBatch:
            column = {c: table.column(c).combine_chunks() for c in LEAF}
            m = subtree_marks(column["gram"].to_numpy(), column["n"].to_numpy().astype(np.int64), column["words"], window) << column["bit"].to_numpy().astype(np.int64)
            kept = pa.array(m != 0)
            return pa.RecordBatch.from_arrays([column["c1"].filter(kept), column["c2"].filter(kept), pa.array(m[m != 0])], ["c1", "c2", "mask"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                held.append(b)
                size += pc.sum(pc.binary_length(b.column("words"))).as_py() or 0
                if size < BATCH_BYTES:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                grams = table.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1], "left"))  # the last group may go on
                if cut:
                    yield marks(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(pc.sum(pc.binary_length(x.column("words"))).as_py() or 0 for x in held)
        if held:
            yield marks(pa.Table.from_batches(held).combine_chunks())

    dealt = leaves.select(LEAF).repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "c1 long, c2 long, mask long")


def _by_longer_prefixes(leaves: DataFrame, window: int, prefix: int, group: int, scratch: Scratch) -> DataFrame:
    """(c1, c2, mask) of groups that are too large: each window is a leaf of its own, dealt
    by its first words, which reach to the end of the anchor and then on."""
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bit")
    rows = leaves.select("c1", "c2", "off", "words", at).select("c1", "c2", "bit", (F.col("off") - F.col("bit")).alias("place"), F.expr(f"substring_index(substring_index(words, ' ', bit + {window}), ' ', -{window})").alias("words"))
    rows = scratch.write(rows, "windows")
    done = None
    for length in range(prefix, window + STEP, STEP):
        keyed = rows.withColumn("head", F.expr(f"substring_index(words, ' ', least({window}, place + {length}))"))
        sizes = scratch.write(keyed.groupBy("place", "head").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        keyed = scratch.write(keyed.join(sizes, ["place", "head"]), "keyed")  # a prefix that occurs once leads to no internal node
        small = keyed.where(F.col("size") <= group).select(F.xxhash64("place", "head").alias("gram"), "c1", "c2", "bit", F.lit(1).alias("n"), "words")
        found = _trees(small, window)
        done = found if done is None else done.unionByName(found)
        rows = keyed.where(F.col("size") > group).drop("head", "size")
        if length >= window or rows.isEmpty():
            break
    # what is left shares whole windows: the prefix is the node
    whole = rows.select("c1", "c2", F.expr("shiftleft(1L, bit)").alias("mask"))
    return done.unionByName(whole)


def removals(docs: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """(k1, k2, spans): for documents (k1, k2, text, ...) with repeated windows, the
    first window of each anchor and the bits of its windows that repeat."""
    scratch = Scratch()
    found = _scan(docs, window, prefix)
    # written, so that a prefix which is very common can be split in the join
    twice = scratch.write(found.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram"), "twice")
    found = materialize(found.join(twice, "gram", "left_semi"), "anchors")

    last = F.struct("k1", "k2", (F.col("lo") + F.col("step") * (F.col("times") - 1)).alias("lo"))
    contexts = found.groupBy("c1", "c2").agg(F.sum("times").alias("seen"), F.min(F.struct("k1", "k2", "lo")).alias("first"), F.max(last).alias("last"), F.min("gram").alias("gram"), F.max("off").alias("off"), F.max("n").alias("n"))
    contexts = scratch.write(contexts, "contexts")
    sizes = contexts.groupBy("gram").agg(F.sum(F.when(F.col("seen") > 1, 2).otherwise(1)).alias("leaves"))
    large = scratch.write(sizes.where(F.col("leaves") > group).select("gram", F.lit(True).alias("many")), "large")

    ends = F.when(F.col("seen") > 1, F.array("first", "last")).otherwise(F.array("first"))
    wanted = contexts.join(large, "gram", "left").select(F.explode(ends).alias("at"), "n", "off", F.coalesce("many", F.lit(False)).alias("many"), "gram", "c1", "c2")
    wanted = wanted.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.lo", "n", "off", "many", "gram", "c1", "c2")).alias("wants"))
    leaves = scratch.write(_leaves(docs.join(wanted, ["k1", "k2"]), window), "leaves")

    masks = _trees(leaves.where("not many").withColumn("bit", F.lit(0)), window)
    if not large.isEmpty():
        masks = masks.unionByName(_by_longer_prefixes(leaves.where("many"), window, prefix, group, scratch))
    masks = materialize(masks.groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")), "masks")
    scratch.clear()
    marked = found.join(masks, ["c1", "c2"]).select("k1", "k2", F.struct("lo", "step", "times", "mask").alias("span"))
    return marked.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _covered(spans: pa.StructArray, n: int, window: int) -> np.ndarray:
    """Which of a document's n words a marked window covers."""
    lo, step, times, mask = (x.to_numpy() for x in spans.flatten())
    row = np.repeat(np.arange(len(lo)), times)
    lo = lo[row] + step[row] * (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))
    edges = np.zeros(n + 1, np.int64)
    for bit in range(int(mask.max()).bit_length()):
        starts = lo[(mask[row] >> bit) & 1 == 1] + bit
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """df with n_words, n_removed and kept (the words left, joined by one space)."""
    if window - prefix + 1 > 62:
        raise ValueError("at most 62 windows may share an anchor")
    made = ["n_words", "n_removed", "kept"]
    own = [c for c in df.columns if c not in made]
    schema = T.StructType([*(df.schema[c] for c in own), T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("kept", T.StringType(), False)])
    given, spans_of, *keys = unused(df.columns, "given", "spans", "k1", "k2")
    docs = df.select(*row_key(doc_id, text), F.col(text).alias("text"))
    spans = removals(docs, window, prefix, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        give_back()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                counts, gone, kept = [], [], []
                for t, found in zip(b.column(given).to_pylist(), b.column(spans_of), strict=True):
                    words = (t or "").encode().split()
                    drop = 0
                    if found.is_valid and len(found.values):
                        covered = _covered(found.values, len(words), window)
                        drop = int(covered.sum())
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    counts.append(len(words) + drop)
                    gone.append(drop)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema.names)

    both = df.select(*own, F.col(text).alias(given), *(c.alias(n) for c, n in zip(row_key(doc_id, text), keys, strict=True)))
    spans = spans.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("spans").alias(spans_of))
    return both.join(spans, keys, "left").mapInArrow(run, schema)
