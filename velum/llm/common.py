"""Helpers shared by the operators: scratch tables, document keys, hashing of
words and word n-grams in numpy, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------- scratch


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session that names none (tests, a laptop) gets a temporary folder; on a
    cluster executors would not see it, so there it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="velum-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it again.

    Cuts the lineage; a lost executor costs nothing afterwards. The folder is
    new for every call; it stays until discard() or until the scratch space is cleaned.
    """
    path = f"{scratch_dir(df.sparkSession)}/velum/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later result reads."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.__dict__["_scratch_path"]
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """The tables that one result is made from, to be deleted together once it is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialize(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def row_key(*cols: str) -> list[Column]:
    """Two hashes (96 bits) that name a row by its values.

    Rows that repeat an id with another text stay apart, null ids are values
    like any other, and rows equal in all columns share a key.
    """
    return [F.xxhash64(*cols).alias("k1"), F.hash(*cols).alias("k2")]


# -------------------------------------------------------------- Python workers

_held: dict = {}


def held(key: object, build: Callable[[], object]) -> object:
    """What build() makes, kept in this Python worker for later tasks. One key is kept, so
    what the stages of a job keep does not add up in a worker that serves them all."""
    if key not in _held:
        let_go()
        _held[key] = build()
    return _held[key]


def let_go() -> None:
    """Drop what earlier tasks kept, before this worker takes memory for another purpose."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ----------------------------------------------------------------- numpy: text

#: The separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: All but ASCII letters, digits and bytes of other characters.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_INV = {int(m): np.uint64(pow(int(m), -1, 1 << 64)) for m in (_P, _Q)}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    key = (int(base), inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _INV[int(base)] if inverse else base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _range_hash(values: np.ndarray, base: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of values[lo:hi] for each pair; the same content hashes alike anywhere."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    h = (sums[hi] - sums[lo]) * _powers(base, n + 1, inverse=True)[lo]
    return mix(h ^ ((hi - lo).astype(np.uint64) * _Q))


class Words:
    """The words of a chunk of documents.

    starts, ends: byte ranges; first: words before each document (documents + 1
    entries); hashes: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            joined = inside[:-1] & inside[1:]
            joined[edge - 1] = False
            begins[1:] &= ~joined
            ends[:-1] &= ~joined
        self.data = data
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._word_hashes()

    def _word_hashes(self) -> np.ndarray:
        """64 bits of each word: a sum over its bytes of what each byte stands for at its place.

        Eight bytes at a time, each block mixed with its place in the word. A polynomial
        modulo 2 ** 64 would give some long words equal hashes whatever its base.
        """
        lengths = self.ends - self.starts
        blocks = (lengths + 7) >> 3
        first = np.cumsum(blocks) - blocks
        word = np.repeat(np.arange(len(lengths)), blocks)
        place = np.arange(len(word)) - first[word]
        at = self.starts[word] + 8 * place
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        block = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
        left = np.minimum(lengths[word] - 8 * place, 8).astype(np.uint64)
        block = block & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        block = mix(mix(block ^ (place.astype(np.uint64) * _P)) + left + place.astype(np.uint64) * _Q)
        sums = np.add.reduceat(block, first) if len(first) else block
        return mix(sums + lengths.astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_end(self) -> np.ndarray:
        """For each word, where the words of its document end."""
        return np.repeat(self.first[1:], self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of k words within one document."""
        n = len(self.hashes)
        at = np.flatnonzero(self.doc_end() - np.arange(n) >= k)
        return at, self.spans(at, at + k)

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of words lo:hi for each pair."""
        return _range_hash(self.hashes, _Q, lo, hi)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20, docs: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most docs whole documents of about size bytes: first, last + 1,
    bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(max(i + 1, np.searchsorted(offsets, offsets[i] + size, "right") - 1))
        j = min(j, n, i + docs)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches.

    Alternates large-star and small-star contractions until nothing changes.
    Each round's edges are written, so lineage stays short, and the round before is
    deleted. A hot id's smallest neighbour is a partial aggregate, written as well, so
    that Spark can split the joins with it.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # each node's smallest neighbour or itself
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(nxt, name)
        discard(cur, low)
        # settled: every node points at a root, and no root points anywhere
        moving = nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = nxt.groupBy("u").count().where("count > 1")
        if moving.isEmpty() and twice.isEmpty():
            roots = nxt.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return nxt.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        cur = nxt
