"""A token store: ids as separately compressed documents under one dictionary.

Layout, under one folder (any file system that Spark writes to):

* `dictionary/`: one row: hash (sha256, hex), a zstandard dictionary trained on
  serialized id arrays, the tokenizer, the end id.
* `blocks/`: rows of up to BLOCK bytes: shard, block, dictionary hash, payload and the
  offset index of its documents: id, byte offset and length in the payload,
  number of ids, ids before it in the shard. Shards hold ascending ranges of ids,
  and blocks and documents ascend within a shard.

A document is read by slicing the payload at its index entry and decompressing that
frame alone. Spark's own writer commits the files, so a lost executor or a second
attempt leaves no half-written shard.

The dictionary is fitted on the whole texts of a bounded sample: the SAMPLE
documents with the smallest hash of their id. Everything else covers all rows.

Shards hold SHARD_BYTES of text at most on the average, and less only where the table is small, so
their number, of which the driver holds the borders and one task the running total, stays
low: 200,000 for 100 TB.

Edge cases: null or empty text is a document with the end id alone; null document
ids come first; rows that repeat an id all stay, ordered by the crc32 of their ids; texts of any length
are encoded whole; strings of added tokens become their ids, as in the library; extra columns are ignored; an
empty table makes a store without blocks and with an empty dictionary.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velum.llm.common import chunks, give_back, held, scratch_dir, utf8
from velum.llm.segments import Known, encode as encode_texts, raw, stem

TOKENIZER, END = "byte_bpe_50k.json", 2
SAMPLE, DICTIONARY_BYTES, LEVEL = 1000, 64 << 10, 3
BLOCK = 4 << 20
#: Bytes of texts that are handled together, and their number.
TEXT_BYTES, DOCS_AT_ONCE = 4 << 20, 2048
#: Bytes of text of a shard at most, on the average, and at least, if there are shards for all cores.
SHARD_BYTES, LEAST_BYTES = 512 << 20, 16 << 20

BLOCKS = "shard int, block int, dictionary string, payload binary, index array<struct<doc_id:bigint,at:bigint,length:int,n:bigint,before:bigint>>"


class Encoder:
    """A tokenizer of one worker; encodes each distinct segment once."""

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.matches = lambda text: [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # each character of a byte-level token is one byte
            self.lengths[i] = len(token)
        self.segments = Known(self.encode_segments)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_segments(self, keys: list[str]) -> list[bytes]:
        stems = {k: w for k in keys if (w := stem(k))}
        if stems:  # a closing mark is a match of its own, so word and mark are coded apart
            words = list(dict.fromkeys([*stems.values(), *(k for k in keys if k not in stems)]))
            coded = dict(zip(words, self.encode_segments(words), strict=True))
            marks = {m: self._ids([m])[0].tobytes() for m in {k[-1] for k in stems}}
            return [coded[stems[k]] + marks[k[-1]] if k in stems else coded[k] for k in keys]
        out = [b""] * len(keys)
        # a segment that opens with a space ends where the next begins, so many go in one call
        plain = [i for i, k in enumerate(keys) if k and k[0] not in "\r\n"]
        for at in range(0, len(plain), 8192):
            part = plain[at : at + 8192]
            texts = [" " + keys[i] for i in part]
            ids = self._ids(["".join(texts)])[0]
            ends = np.cumsum([len(t.encode()) for t in texts])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            data = ids.tobytes()
            for i, a, b in zip(part, [0, *(cuts * 4).tolist()], (cuts * 4).tolist(), strict=False):
                out[i] = data[a:b]
        rest = [i for i, k in enumerate(keys) if not k or k[0] in "\r\n"]
        for i, ids in zip(rest, self._ids([raw(keys[i]) for i in rest]) if rest else [], strict=True):
            out[i] = ids.tobytes()
        return out

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian 32-bit integers."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.zeros(len(texts), bool)
        for token in self.added:  # what they cut apart is no matter of the split pattern
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        ids, bounds = encode_texts(plain, self.segments, self.matches)
        data, last = ids.tobytes(), np.array([end], "<u4").tobytes()
        cuts = (bounds * 4).tolist()
        del ids
        give_back()
        out = [data[a:b] + last for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero(whole):
            out[i] = self._ids([texts[int(i)].as_py()])[0].tobytes() + last
        return out


def encoder(name: str) -> Encoder:
    """This worker's, until it holds something else."""
    return held((Encoder, name), lambda: Encoder(name))


def train_dictionary(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the sample's serialized id arrays; empty if the
    sample is too small to train on."""
    picked = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = [r.doc_id for r in picked.collect()]  # at most `sample` numbers

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [a for b in batches for a in encoder(tokenizer).encode(b.column("text"), end)]
        try:
            made = zstandard.train_dictionary(size, arrays).as_bytes() if len(arrays) >= 8 else b""
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_pydict({"d": pa.array([made], pa.binary())})

    chosen = docs.select("doc_id", "text").where(F.col("doc_id").isin(ids))
    # one task reads the sample, whose size is bounded
    made = chosen.orderBy("doc_id", F.xxhash64("text")).limit(2 * sample).coalesce(1).mapInArrow(train, "d binary").first()
    return made.d if made else b""


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, shard_bytes: int = SHARD_BYTES, least_bytes: int = LEAST_BYTES, **training) -> None:
    """Write documents (doc_id bigint, text) as a token store at path."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer, end, **training)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary), tokenizer, end)], "hash string, dictionary binary, tokenizer string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes), min(-(-size // least_bytes), 4 * spark.sparkContext.defaultParallelism))
    cuts = docs.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    cuts = sorted({int(c) for c in cuts})

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        limits = np.array(cuts, np.int64)
        for whole in batches:
            for i, j, _, _ in chunks(*utf8(whole.column("text")), TEXT_BYTES, DOCS_AT_ONCE):
                b = whole.slice(i, j - i)
                arrays = encoder(tokenizer).encode(b.column("text"), end)
                ids = b.column("doc_id")
                shard = np.searchsorted(limits, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), "left").astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "shard": shard, "doc_id": ids, "n": np.array([len(a) // 4 for a in arrays], np.int64),
                    "tie": np.array([crc32(a) for a in arrays], np.int64), "frame": pa.array([zip_.compress(a) for a in arrays], pa.binary()),
                })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, before = None, 0, [], 0
        size = 0

        def full() -> pa.RecordBatch:
            index, at = [], 0
            for doc_id, n, frame, first in held:
                index.append({"doc_id": doc_id, "at": at, "length": len(frame), "n": n, "before": first})
                at += len(frame)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([name]), pa.array([b"".join(h[2] for h in held)], pa.binary()),
                 pa.array([index], pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("length", pa.int32()), ("n", pa.int64()), ("before", pa.int64())])))],
                ["shard", "block", "dictionary", "payload", "index"],
            )

        for b in batches:
            for s, doc_id, n, frame in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n", "frame")), strict=True):
                if held and (s != shard or size + len(frame) > BLOCK):
                    yield full()
                    block, held, size = block + 1, [], 0
                if s != shard:
                    shard, block, before = s, 0, 0
                held.append((doc_id, n, frame, before))
                before, size = before + n, size + len(frame)
        if held:
            yield full()

    frames = docs.mapInArrow(compress, "shard int, doc_id bigint, n bigint, tie bigint, frame binary")
    dealt = frames.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    dealt.mapInArrow(pack, BLOCKS).write.parquet(f"{path}/blocks")


def open_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """Hash and bytes (at most the size it was trained for) of a store's dictionary."""
    r = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(r.dictionary)).hexdigest() != r.hash:
        raise ValueError("the dictionary does not match its hash")
    return r.hash, bytes(r.dictionary)


def _frames(name: str, dictionary: bytes):
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(row_dictionary: str, frame: bytes, n: int) -> bytes:
        if row_dictionary != name:
            raise ValueError("the block was written with another dictionary")
        data = unzip.decompress(frame)
        if len(data) != 4 * n:
            raise ValueError("a document's length differs from its index entry")
        return data

    return ids


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, ids (array<int>)."""
    name, dictionary = open_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row a shard, of which there are few (see above): small enough for a running total and a broadcast
    totals = blocks.select("shard", F.aggregate("index", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _frames(name, dictionary)
        for b in batches:
            for d, payload, index, base in zip(*(b.column(c) for c in ("dictionary", "payload", "index", "base")), strict=True):
                d, payload, index, base = d.as_py(), payload.as_py(), index.as_py(), base.as_py()
                for at in range(0, len(index), 256):
                    part = index[at : at + 256]
                    found = [ids(d, payload[e["at"] : e["at"] + e["length"]], e["n"]) for e in part]
                    ends = np.cumsum([0, *(e["n"] for e in part)]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([e["doc_id"] for e in part], pa.int64()), "start": np.array([base + e["before"] for e in part], np.int64),
                        "n_tokens": np.array([e["n"] for e in part], np.int64), "ids_crc32": np.array([crc32(x) for x in found], np.int64),
                        "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4"))),
                    })

    return blocks.join(F.broadcast(starts), "shard").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a short list of documents; only their frames are decompressed."""
    name, dictionary = open_dictionary(spark, path)
    entry = F.explode(F.filter("index", lambda e: e.doc_id.isin(doc_ids)))
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("dictionary", "payload", entry.alias("e"))
    found = found.select("dictionary", "e.doc_id", "e.n", F.substring("payload", F.col("e.at").cast("int") + 1, F.col("e.length")).alias("frame"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _frames(name, dictionary)
        for b in batches:
            out = [np.frombuffer(ids(*x), "<i4") for x in zip(*(b.column(c).to_pylist() for c in ("dictionary", "frame", "n")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return found.mapInArrow(read, "doc_id bigint, ids array<int>")


def temporary_path(spark: SparkSession) -> str:
    """A new folder in the shared scratch space."""
    return f"{scratch_dir(spark)}/velum/{uuid.uuid4().hex}/tokens"
