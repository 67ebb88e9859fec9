"""Overlaps of training documents with test items by spaced-seed hashing.

Words are lower-cased runs of letters and digits. Every position of every document is
hashed under every mask (the words there that the mask looks at) and joined with the
hashed positions of the test items. Around each hit, the item is laid over the document at
that offset, and the best run (a match counts 1, a mismatch -2) is measured; it is an
overlap if it holds WORDS matches, or SHARE of the words of a shorter item.

The mask 1101 ignores every third position and misses nothing that this accepts. No
beginning of a best run sums below 0, so it begins with two matches; a mismatch behind them
has a match behind it (11x1: the mask lies on the first word); a third match has a fourth
behind it (1111: on the first word) or one mismatch and then a match (111x1: on the second).
So it lies on every run of four matches or more. Items that need fewer have up to three
words, all of which must match, and a mask of their length.

The test set is the small side, but its size is checked, not assumed: it is dealt
into blocks of about BLOCK_BYTES, each block is broadcast and all documents are joined
with it. Documents are never shuffled and every one is read whole.

Items of any length are looked for. Those of under EVIDENCE words must stand in a document
as they are and are hits like any other, but clean() keeps documents that hold no longer
ones, as such items are words of everyday use.

Edge cases: null and empty texts have no hits, nor have items without a word; items of fewer
words than `least` are passed over where a caller asks for that; a document of any length is read whole;
documents that repeat have equal hits; items that repeat give a hit each; of an item's
overlaps with one document the one with most matches counts, of equal ones the first; an
empty table on either side gives no hits; ids of items may have any type; extra columns
stay, but `hits` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from velum.llm.common import NOT_WORD, Words, chunks, let_go, mix, utf8

MASK = "1101"
WORDS, SHARE = 12, 0.8
#: Words of an item from which on an overlap with it is reason to drop a document.
EVIDENCE = 5
#: Words of items laid over documents at a time.
CELLS = 1 << 20
BLOCK_BYTES = 8 << 20

_FACTORS = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_matches(words: int) -> int:
    """Matches that an overlap with an item of so many words must have."""
    return min(WORDS, math.ceil(SHARE * words))


def _mask(words: int) -> str:
    return MASK if _least_matches(words) > 3 else "1" * words


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    let_go()
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    for i, j, data, offsets in chunks(*utf8(lower)):
        yield i, j, Words(data, offsets, NOT_WORD)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words that the mask looks at, from each position on."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    if n > 0:
        for k, o in enumerate(i for i, c in enumerate(mask) if c == "1"):
            out += h[o : o + n] * _FACTORS[k]
    return mix(out)


class Seeds:
    """The seeds of a block of test items, sorted for look-up."""

    def __init__(self, items: list[tuple[object, str]], least: int = 1):
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        for _, _, w in _tokens(pa.array([t for _, t in items], pa.string())):
            self.words += [w.hashes[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.all = np.concatenate([*self.words, np.zeros(1, np.uint64)])
        self.tables = []
        masks = [_mask(n) if n >= max(1, least) else "" for n in self.lengths.tolist()]
        for mask in sorted({*masks} - {""}):
            of = [i for i, m in enumerate(masks) if m == mask]
            found = [_seeds(self.words[i], mask) for i in of]
            seed = np.concatenate(found)
            item = np.repeat(of, [len(s) for s in found])
            at = np.concatenate([np.arange(len(s)) for s in found])
            order = np.argsort(seed, kind="stable")
            seed = seed[order]
            bits = np.zeros(1 << 20, bool)
            bits[seed >> np.uint64(44)] = True
            self.tables.append((mask, seed, item[order], at[order], bits))

    def hits(self, words: Words) -> dict[int, list[tuple[int, int, int, int]]]:
        """By document: (item, start, words, matched), the best run of each item."""
        n, end = len(words.hashes), words.doc_end()
        laid = [np.zeros((0, 3), np.int64)]
        for mask, seed, item, at, bits in self.tables:
            if n < len(mask):
                continue
            mine = _seeds(words.hashes, mask)
            p = np.flatnonzero(bits[mine >> np.uint64(44)])
            p = p[p + len(mask) <= end[p]]
            low, high = np.searchsorted(seed, mine[p], "left"), np.searchsorted(seed, mine[p], "right")
            i = 0
            while i < len(p):  # a word triple may stand in very many items
                upto = np.cumsum((high - low)[i:])
                j = i + max(1, int(np.searchsorted(upto, CELLS, "right")))
                count = (high - low)[i:j]
                where = np.repeat(p[i:j], count)
                k = np.repeat(low[i:j] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                doc = np.searchsorted(words.first, where, "right") - 1
                laid.append(self.overlaps(words, np.unique(np.stack([where - at[k], item[k], doc], 1), axis=0)))
                i = j
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        for _, item, doc, start, length, matched in sorted({tuple(r) for x in laid[1:] for r in x.tolist()}):
            if matched > out.setdefault(doc, {}).get(item, (0, 0, 0))[2]:
                out[doc][item] = (start - int(words.first[doc]), length, matched)
        return {d: [(self.ids[i], *r) for i, r in sorted(runs.items())] for d, runs in out.items()}

    def overlaps(self, words: Words, laid: np.ndarray) -> np.ndarray:
        """Of rows (offset, item, doc): offset, item, doc, start, words, matches of the best
        run of the item laid at offset, where it is an overlap."""
        found = [np.zeros((0, 6), np.int64)]
        laid = laid[np.argsort(self.lengths[laid[:, 1]], kind="stable")]
        length = self.lengths[laid[:, 1]]
        i = 0
        while i < len(laid):
            long = int(length[i])
            j = min(int(np.searchsorted(length, long, "right")), i + max(1, CELLS // long))
            offset, item, doc = laid[i:j].T
            at = offset[:, None] + np.arange(long)
            same = (at >= words.first[doc][:, None]) & (at < words.first[doc + 1][:, None])
            same &= words.hashes[np.clip(at, 0, len(words.hashes) - 1)] == self.all[self.first[item][:, None] + np.arange(long)]
            sums = np.zeros((j - i, long + 1), np.int32)
            np.cumsum(np.where(same, 1, -2), axis=1, out=sums[:, 1:])
            least = np.minimum.accumulate(sums, axis=1)
            b = (sums - least).argmax(axis=1)
            rows = np.arange(j - i)
            a = (sums == least[rows, b][:, None]).argmax(axis=1)
            # a run of n words that gains g has (g + 2 n) / 3 matches
            matched = (sums[rows, b] - sums[rows, a] + 2 * (b - a)) // 3
            ok = matched >= _least_matches(long)
            found.append(np.stack([offset, item, doc, offset + a, b - a, matched], 1)[ok])
            i = j
        return np.concatenate(found)


def flag(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, least: int = 1) -> DataFrame:
    """df with `hits`: the items that each document overlaps (empty: none)."""
    spark = df.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kept = [c for c in df.columns if c != "hits"]
    hit = T.StructType([T.StructField("item_id", items.schema["i"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("start", "words", "matched"))])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("hits", T.ArrayType(hit), False)])
    out = df.select(*kept, F.array().cast(T.ArrayType(hit)).alias("hits"))
    types = to_arrow_type(T.ArrayType(hit))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # about block_bytes
        seeds = spark.sparkContext.broadcast(Seeds(sorted(((r.i, r.t) for r in rows), key=lambda r: (r[0] is None, r)), least))

        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[list] = []
                for i, j, words in _tokens(b.column(text)):
                    hits = seeds.value.hits(words)
                    found += [hits.get(d, []) for d in range(j - i)]
                new = [[*(old or []), *({"item_id": a, "start": s, "words": w, "matched": m} for a, s, w, m in h)] for old, h in zip(b.column("hits").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(new, types)], schema.names)

        out = out.mapInArrow(run, schema)
    return out


def clean(df: DataFrame, benchmark: DataFrame, least: int = EVIDENCE, **names) -> DataFrame:
    """df without the documents that overlap a test item of `least` words or more."""
    return flag(df, benchmark, least=least, **names).where(F.size("hits") == 0).drop("hits")
