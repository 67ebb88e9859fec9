"""BPE encoding and decoding by rounds of merges over flat numpy arrays.

The symbols of all new words of a batch lie in one array. Its neighbours, as keys
`left * size + right`, are looked up by binary search among the sorted keys of the
merge table, which gives each pair its rank. A round contracts, in all words at once,
the pairs of least rank, leftmost first, and looks up the pairs that this made; it ends
when no word has a pair left.

Long words take the same rounds. A word is laid in blocks of SPAN to 2 * SPAN bytes (a
short word is one block), and a pair is contracted when its rank is the least of its
own block and the two beside it. This gives what contracting one pair after the
other gives: what a merge makes only has pairs of higher rank (checked when a
tokenizer is read), so a pair of lower rank can reach another only as a token
that has swallowed all bytes between them, and SPAN is three times the longest token.
Equal pairs that overlap (aaaa) are contracted only together, so their order counts
from where they begin.

Texts are split as the library splits them: added tokens first, then its own
pre-tokenizer, whose Unicode tables differ from other modules' for some code points.
Words repeat, so a worker remembers the ids of those that it has met; that changes
speed only.

Edge cases: a null or empty text has no ids and decodes to an empty text; the strings
of added tokens become their ids, as in the library; other columns are kept, but those made are
replaced; repeated rows and ties need nothing; texts of any length are encoded
whole; an empty table gives an empty one. Ids that no token has, and nulls among ids, are passed
over in decoding, and bytes that are no UTF-8 become U+FFFD, both as in the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from velum.llm.common import chunks, give_back, held, utf8
from velum.llm.segments import Cache, Known, encode as encode_texts, raw, stem

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of the words that share one array (a longer word has an array of its own).
BYTES_AT_ONCE = 1 << 20
#: Bytes of texts that are handled together, and their number.
TEXT_BYTES, DOCS_AT_ONCE = 4 << 20, 2048
#: Words that a worker remembers, at about 200 bytes each.
REMEMBERED = 250_000
NONE = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: the byte's own where it is
    printable Latin-1, otherwise the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {chr(b if b in shown else next(spare)): b for b in range(256)}


class Merges:
    """A merge table as sorted keys, and the rounds over it.

    merges: rows (left, right, made) in order of rank; lengths: bytes of each id.
    """

    def __init__(self, merges: np.ndarray, lengths: np.ndarray):
        left, right, made = np.asarray(merges, np.int64).reshape(-1, 3).T
        born = np.full(len(lengths), -1)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge must make a new token, of tokens that earlier merges made")
        self.size = len(lengths)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = made.astype(np.int32)
        self.span = 3 * int(lengths.max(initial=1))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE without a merge."""
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], NONE) if len(self.keys) else np.full(len(keys), NONE)

    def contract(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in one array, and how many each word has. symbols: one a byte, of
        words (none empty) of these lengths."""
        n = len(symbols)
        ends = np.cumsum(lengths)
        symbols = np.append(symbols, -1)  # the last place stands for no symbol
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - lengths] = n, n
        rank = np.full(n + 1, NONE)
        opens = np.flatnonzero(after[:n] < n)
        rank[opens] = self.ranks(symbols[opens], symbols[opens + 1])

        blocks = np.maximum(1, lengths // self.span)
        word = np.repeat(np.arange(len(lengths)), blocks)
        place = np.arange(len(word)) - (np.cumsum(blocks) - blocks)[word]
        starts = (ends - lengths)[word] + place * self.span
        first, last = place == 0, place == blocks[word] - 1
        block_of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, n)))
        alive = np.ones(n, bool)
        while True:
            low = np.minimum.reduceat(rank[:n], starts)
            if (low == NONE).all():
                break
            least = low.copy()
            least[1:][~first[1:]] = np.minimum(least[1:], low[:-1])[~first[1:]]
            least[:-1][~last[:-1]] = np.minimum(least[:-1], low[1:])[~last[:-1]]
            least[least == NONE] = -1
            at = np.flatnonzero(rank[:n] == least[block_of])
            if not len(at):  # cannot be: the least pair of a word is the least of its blocks
                raise AssertionError("no pair to contract")
            # overlapping equal pairs: all or none, every second one
            back = before[at]
            overlaps = rank[back] == rank[at]
            joined = overlaps & np.append(False, back[1:] == at[:-1])
            heads = np.flatnonzero(~joined)
            run = np.cumsum(~joined) - 1
            within = np.arange(len(at)) - heads[run]
            at = at[~(overlaps & ~joined)[heads][run] & (within % 2 == 0)]
            gone = after[at]
            symbols[at] = self.made[rank[at]]
            alive[gone], rank[gone] = False, NONE
            after[at] = after[gone]
            before[after[at]] = at
            before[n] = n
            for left in (at, before[at][before[at] < n]):
                right = after[left]
                rank[left] = np.where(right < n, self.ranks(symbols[left], symbols[right]), NONE)
        kept = np.add.reduceat(alive.astype(np.int64), ends - lengths) if len(lengths) else lengths
        return symbols[:n][alive], kept


class Coder:
    """A byte-level BPE tokenizer file, for one worker."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and split and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
        if not plain or any(model[k] for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{name} is not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what is around them are not supported")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
        spelled |= {i: t.encode() for t, i in self.added.items()}
        self.size = max(spelled) + 1
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(self.size)], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(self.size)), np.uint8)
        self.single = np.full(256, -1, np.int32)
        for c, b in letters.items():
            self.single[b] = vocabulary[c]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges(np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]), self.lengths)
        self.find = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.words = Cache(self.encode_words, REMEMBERED)
        self.segments = Known(self.encode_segments)

    def matches(self, text: str) -> list[str]:
        """The text as the library's own pre-tokenizer cuts it."""
        return [text[a:b] for _, (a, b) in self.split(text)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")  # words of like length need like numbers of rounds
        order = order[np.searchsorted(lengths[order], 1) :]
        filled = np.cumsum(lengths[order])
        i = 0
        while i < len(order):
            done = filled[i] - lengths[order[i]]
            j = max(i + 1, int(np.searchsorted(filled, done + BYTES_AT_ONCE, "right")))
            part = order[i:j]
            symbols = self.single[np.frombuffer(b"".join([words[k] for k in part]), np.uint8)]
            ids, kept = self.merges.contract(symbols, lengths[part])
            data, cuts = ids.astype("<i4").tobytes(), (np.append(0, np.cumsum(kept)) * 4).tolist()
            for k, a, b in zip(part.tolist(), cuts, cuts[1:], strict=False):
                out[k] = data[a:b]
            i = j
        return out

    def encode_segments(self, keys: list[str]) -> list[bytes]:
        split = []
        for k in keys:
            if k.isascii() and k.isalpha():
                split.append([b" " + k.encode()])
            elif k.isascii() and (word := stem(k)):
                split.append([b" " + word.encode(), k[-1:].encode()])
            else:
                split.append([w.encode() for w in self.matches(raw(k))])
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(distinct, self.words.look_up(distinct), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        texts = texts.cast(pa.large_string()).fill_null("")
        marked = pc.match_substring_regex(texts, self.find.pattern) if self.find else None
        if marked is None or not pc.any(marked).as_py():
            return encode_texts(texts, self.segments, self.matches)
        # what stands between added tokens is split and encoded as a text of its own
        pieces, owners, closed = [], [], []
        for i, (text, has) in enumerate(zip(texts.to_pylist(), marked.to_pylist(), strict=True)):
            at = 0
            for m in self.find.finditer(text) if has else ():
                pieces.append(text[at : m.start()])
                closed.append(self.added[m.group()])
                owners.append(i)
                at = m.end()
            pieces.append(text[at:])
            closed.append(-1)
            owners.append(i)
        ids, bounds = encode_texts(pa.array(pieces, pa.large_string()), self.segments, self.matches)
        closed, owners = np.array(closed, np.int32), np.array(owners)
        ids = np.insert(ids, bounds[1:][closed >= 0], closed[closed >= 0])
        ends = bounds[1:] + np.cumsum(closed >= 0)
        last = np.append(owners[1:] != owners[:-1], True)
        return ids, np.append(0, ends[last])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each document's ids."""
        known = (ids >= 0) & (ids < self.size)
        if not known.all():
            bounds = np.append(0, np.cumsum(known))[bounds]
            ids = ids[known]
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(total)]
        cuts = np.append(0, ends)[bounds].astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        try:
            return made.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.large_string())


def coder(tokenizer: str) -> Coder:
    """This worker's, until it holds something else."""
    return held((Coder, tokenizer, "numpy"), lambda: Coder(tokenizer))


def _parts(b: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents of bounded size."""
    data, offsets = utf8(b.column(text))
    for i, j, _, _ in chunks(data, offsets, TEXT_BYTES, DOCS_AT_ONCE):
        yield b.slice(i, j - i)


def encode(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, ids: str | None = "ids", packed: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with the ids of each text, in the forms that are named: ids, an array of int;
    packed, little-endian unsigned 32-bit integers; decoded, the text that decode() makes of them."""
    made = [c for c in (ids, packed, decoded) if c]
    kept = [c for c in df.columns if c not in made]
    types = {ids: T.ArrayType(T.IntegerType(), False), packed: T.BinaryType(), decoded: T.StringType()}
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, types[c], False) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for whole in batches:
            for b in _parts(whole, text):
                found, bounds = c.encode(b.column(text))
                new = []
                if ids:
                    new.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found)))
                if packed:
                    cuts = np.ascontiguousarray(bounds, np.int64) * 4
                    new.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(found, "<i4"))]).cast(pa.binary()))
                if decoded:
                    new.append(c.decode(found, bounds).cast(pa.string()))
                del found
                give_back()
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), *new], schema.names)

    return df.select(*kept, *([] if text in kept else [text])).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER, decoded: str = "decoded") -> DataFrame:
    """df with the text that each array of ids stands for; null: empty."""
    kept = [c for c in df.columns if c != decoded]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                lists = b.column(ids).cast(pa.list_(pa.int32()))
                bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
                found = lists.flatten().fill_null(-1).to_numpy()
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), c.decode(found, bounds).cast(pa.string())], schema.names)

    return df.select(kept).mapInArrow(run, schema)


def digests(df: DataFrame, packed: str = "packed", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the other columns."""
    return df.withColumns({
        "n_tokens": (F.octet_length(packed) / 4).cast("long"),
        "ids_sha256": F.sha2(packed, 256),
        "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256),
    })
