"""Exact cuts of texts where byte-level BPE never merges across.

The split pattern of these tokenizers starts a new match at a space that stands
before a character which is no white space, and around a lone line feed. So a
text is cut there, and each distinct segment of a batch is encoded once.

A segment is named by a key: "\\r" + raw text, "\\n" for a line feed, and
otherwise the raw text without its leading space.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)

#: White space of Unicode besides space and line feed, the four controls that some
#: count as such, and pairs: where these occur the pattern itself cuts the text.
ODD = r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"


def raw(key: str) -> str:
    first = key[:1]
    return key[1:] if first == "\r" else key if first == "\n" else " " + key


def cut(texts: pa.Array, matches: Callable[[str], list[str]] = PATTERN.findall) -> pa.ListArray:
    """The keys of each text, in order; their raw texts joined are the text. matches: how
    the split pattern cuts a text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.match_substring_regex(texts, ODD)
    plain = texts.filter(pc.invert(odd))
    marked = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), pc.replace_substring(plain, "\n", " \n \r"), pa.scalar("", pa.large_string()))
    keys = pc.split_pattern(marked, " ")
    if len(plain) == len(texts):
        return keys
    rest = pa.array([["\r" + w for w in matches(t)] for t in texts.filter(odd).to_pylist()], keys.type)
    odd = odd.to_numpy(zero_copy_only=False)
    place = np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
    return pa.concat_arrays([keys, rest]).take(pa.array(place))


class Known:
    """The ids of segments met in this worker, as Arrow arrays of some 40 bytes a
    segment. Its size is bounded: beyond the limit the later half goes, as frequent
    segments come early. It changes speed only."""

    def __init__(self, coded: Callable[[list[str]], list[bytes]], limit: int = 1_000_000):
        self.coded, self.limit = coded, limit
        self.keys, self.ids = pa.array([], pa.large_string()), int_lists([])

    def look_up(self, keys: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Id lists, and which of them each of the distinct keys has."""
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(at.is_null())
        at = at.to_numpy(zero_copy_only=False).astype(np.float64)
        missing = np.isnan(at)
        at[missing] = len(self.ids) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, int_lists(self.coded(new.to_pylist()))]) if len(new) else self.ids
        if len(new):
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), ids
            if len(self.keys) > self.limit:
                first = pa.array(np.arange(self.limit // 2))
                self.keys, self.ids = self.keys.take(first), self.ids.take(first)
        return ids, at.astype(np.int64)


def encode(texts: pa.Array, known: Known, matches: Callable[[str], list[str]] = PATTERN.findall) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in one array, and where each text's begin."""
    keys = cut(texts, matches)
    bounds = np.asarray(keys.offsets) - keys.offsets[0].as_py()
    distinct = keys.flatten().dictionary_encode()
    ids, at = known.look_up(distinct.dictionary)
    spelled = ids.take(pa.array(at[distinct.indices.to_numpy()]))
    offsets = np.asarray(spelled.offsets).astype(np.int64) if len(spelled) else np.zeros(1, np.int64)
    return np.asarray(spelled.flatten()), offsets[bounds]


#: Marks that never join a letter before them in one match of the pattern.
CLOSERS = frozenset(".,;:!?")


def stem(key: str) -> str | None:
    """The key of a plain word that one closing mark follows, without the mark."""
    return key[:-1] if key[-1:] in CLOSERS and key[:-1].isalpha() else None


def int_lists(values: list[bytes]) -> pa.ListArray:
    """A list column of 32-bit integers from their bytes."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), "<i4")))


class Cache(dict):
    """What words became in this worker, bounded likewise."""

    def __init__(self, encode: Callable[[list], list], limit: int, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest

    def look_up(self, keys: list) -> list:
        """The values of distinct keys; what is new is encoded together."""
        found = list(map(self.get, keys))
        at = [i for i, v in enumerate(found) if v is None]
        if at:
            for i, v in zip(at, self.encode([keys[i] for i in at]), strict=True):
                found[i] = v
                if len(keys[i]) <= self.longest:
                    self[keys[i]] = v
            if len(self) > self.limit:
                for k in [*self][self.limit // 2 :]:
                    del self[k]
        return found
