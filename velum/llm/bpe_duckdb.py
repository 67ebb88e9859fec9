"""Byte-level BPE encoding and decoding with a recursive DuckDB query per batch.

Within each task, the distinct words of a batch become (word, position, token)
rows. A recursive query joins neighbours with the merge table and contracts each
word's leftmost pair of least rank until no word has a pair left. Decoding joins
ids with the vocabulary and aggregates their bytes in order.

Nothing is shuffled: documents stay in their partitions, and words repeat so
often that each task encodes only those it has not met.

Edge cases: a null or empty text has no ids and decodes to empty bytes; other
columns are kept, but `ids` and `decoded` are replaced. Words over LONG bytes
would need a round of the query for each byte, so they take the same rule over a
heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import give_back, held
from velum.llm.segments import PATTERN, Cache, Known, encode as encode_texts, raw, stem

#: Bytes of a word from which a heap takes the place of the recursive query.
LONG = 256
#: Words in one recursive query, runs in one decoding query, documents handled together.
WORDS_AT_ONCE, RUNS_AT_ONCE, DOCS_AT_ONCE = 16_000, 100_000, 2048
#: Words that a worker remembers, at about 200 bytes each.
REMEMBERED = 350_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: score: the rank of the pair that a row opens, then its position; null without
#: a pair in the merge table.
CONTRACT = """
WITH RECURSIVE step(round, word, pos, token, after, score) AS (
    SELECT 0, s.word, s.pos, s.token, s.after, CAST(m.merged AS BIGINT) * 65536 + s.pos
    FROM (SELECT word, pos, token, lead(token) OVER (PARTITION BY word ORDER BY pos) AS after FROM start) s
    LEFT JOIN merges m ON m.first = s.token AND m.second = s.after
    UNION ALL
    SELECT t.round, t.word, t.pos, t.token, t.after, CAST(m.merged AS BIGINT) * 65536 + t.pos
    FROM (
        SELECT s.round + 1 AS round, s.word, s.pos - CAST(s.pos > b.at AS INTEGER) AS pos,
               CASE WHEN s.pos = b.at THEN b.merged ELSE s.token END AS token,
               CASE WHEN s.pos = b.at THEN b.beyond WHEN s.pos = b.at - 1 THEN b.merged ELSE s.after END AS after
        FROM step s
        JOIN (
            SELECT x.word, x.at, x.merged, y.after AS beyond
            FROM (
                SELECT word, CAST(min(score) % 65536 AS INTEGER) AS at, CAST(min(score) // 65536 AS INTEGER) AS merged
                FROM step WHERE score IS NOT NULL GROUP BY word
            ) x
            JOIN step y ON y.word = x.word AND y.pos = x.at + 1
        ) b ON b.word = s.word
        WHERE s.pos <> b.at + 1
    ) t
    LEFT JOIN merges m ON m.first = t.token AND m.second = t.after
)
SELECT s.word, s.token
FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
ORDER BY s.word, s.pos
"""

DECODE = """
SELECT s.run, string_agg(v.bytes, '' ORDER BY s.pos) AS hex
FROM spelled s JOIN vocabulary v ON v.id = s.id
GROUP BY s.run ORDER BY s.run
"""


def read_ranks(name: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file that public_tokenizers offers."""
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """A vocabulary in an in-memory DuckDB of one worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        first, second, merged = np.array(pairs, np.int32).reshape(-1, 3).T
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        vocabulary = pa.table({"id": pa.array(self.bytes.keys(), pa.int32()), "bytes": [t.hex() for t in self.bytes.values()]})
        for name, table in (("merges", pa.table({"first": first, "second": second, "merged": merged})), ("vocabulary", vocabulary)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.words = Cache(self.encode_words, REMEMBERED)
        self.segments = Known(self.encode_segments)
        size = max(self.bytes) + 1
        self.opens = np.zeros(size, bool)
        self.opens[[i for i, t in self.bytes.items() if t[:1] in (b" ", b"\n")]] = True

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if w in self.ranks:  # a whole word of the vocabulary is one token, as in tiktoken
                out[i] = self.ranks[w].to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self.by_heap(w)
            elif w:
                short.append(i)
        for at in range(0, len(short), WORDS_AT_ONCE):
            part = short[at : at + WORDS_AT_ONCE]
            lengths = np.fromiter((len(words[i]) for i in part), np.int64, len(part))
            word = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            token = self.single[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
            self.con.register("start", pa.table({"word": word, "pos": pos.astype(np.int32), "token": token}))
            got = self.con.execute(CONTRACT).fetchnumpy()
            self.con.unregister("start")
            ids = np.asarray(got["token"], "<i4")
            cuts = np.searchsorted(np.asarray(got["word"]), np.arange(len(part) + 1)) * 4
            data = ids.tobytes()
            for k, i in enumerate(part):
                out[i] = data[cuts[k] : cuts[k + 1]]
        return out

    def by_heap(self, word: bytes) -> bytes:
        """The same contraction for one long word."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := self.ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (s, k))
        return np.array([self.ranks[p] for p in parts if p is not None], "<i4").tobytes()

    def encode_segments(self, keys: list[str]) -> list[bytes]:
        split = []
        for k in keys:
            if k.isalpha():
                split.append([b" " + k.encode()])
            elif word := stem(k):
                split.append([b" " + word.encode(), k[-1:].encode()])
            else:
                split.append([w.encode() for w in PATTERN.findall(raw(k))])
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(distinct, self.words.look_up(distinct), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        return encode_texts(texts, self.segments)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each document's ids. Runs that begin with a space or a line
        feed repeat, so each distinct run of the batch is decoded once."""
        if not len(ids):
            return pa.array([b""] * (len(bounds) - 1), pa.large_binary())
        opens = self.opens[ids]
        opens[bounds[:-1][bounds[:-1] < len(ids)]] = True
        starts = np.append(np.flatnonzero(opens), len(ids)).astype(np.int64)
        ids = np.ascontiguousarray(ids, "<i4")
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * 4), pa.py_buffer(ids)])
        runs = runs.dictionary_encode()
        distinct, decoded = runs.dictionary, []
        for at in range(0, len(distinct), RUNS_AT_ONCE):
            part = distinct.slice(at, RUNS_AT_ONCE)
            spelled = np.frombuffer(b"".join(part.to_pylist()), "<i4")
            lengths = np.diff(np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]) // 4
            run = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            self.con.register("spelled", pa.table({"run": run, "pos": np.arange(len(spelled)), "id": spelled}))
            decoded += map(bytes.fromhex, self.con.execute(DECODE).fetchnumpy()["hex"])
            self.con.unregister("spelled")
        texts = pa.array(decoded, pa.large_binary()).take(runs.indices)
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        cuts = np.ascontiguousarray(ends[np.searchsorted(starts, bounds)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(cuts), data])


def coder(vocabulary: str) -> Coder:
    """This worker's, until it holds something else."""
    return held((Coder, vocabulary), lambda: Coder(read_ranks(vocabulary)))


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids (array<int>) of each text; null text: none.

    decoded: also a column of the bytes that those ids decode to, as from decode().
    """
    made = [c for c in (ids, decoded) if c]
    kept = [c for c in df.columns if c not in made]
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded or "", T.BinaryType(), False)]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields[: len(made)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                found, bounds = c.encode(b.column(text))
                new = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))]
                if decoded:
                    new.append(c.decode(found, bounds).cast(pa.binary()))
                del found
                give_back()
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), *new], schema.names)

    return df.select(*kept, *([] if text in kept else [text])).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, decoded: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that each array of ids stands for; null: empty.

    An id that the vocabulary lacks, or a null among them, raises an error.
    """
    kept = [c for c in df.columns if c != decoded]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                lists = b.column(ids).cast(pa.list_(pa.int32()))
                flat = lists.flatten()
                bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
                found = flat.fill_null(-1).to_numpy()
                if len(found) and (found.min() < 0 or found.max() >= len(c.opens)):
                    raise ValueError("an id is not in the vocabulary")
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), c.decode(found, bounds).cast(pa.binary())], schema.names)

    return df.select(kept).mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the other columns."""
    return df.withColumns({
        "n_tokens": F.size(ids).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(decoded, 256),
    })
