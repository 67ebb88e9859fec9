"""Fill-in-middle transformation by an event scan.

A text is cut into units (`Units`), and a prefix, middle and suffix of whole units are written in
one of three forms: plain, the text; psm, prefix, suffix, middle; spm, suffix, prefix,
middle, each behind its sentinel.

One automaton (Aho-Corasick) finds what matters in a text: the ASCII characters that
close a unit, and the sentinels, which a text must not hold. Between such events lies a gap,
whose units follow from its length by arithmetic, so the events and the running count
of units at each are all that is kept; where unit number r ends is found by binary search
in those counts, and by arithmetic in the gap that it falls into.

All choices come from a hash of the seed and the document's id, so a task that is run again
gives the same rows. Documents stay in their partitions: nothing is shuffled.

Edge cases: a null or empty text has no units and is plain; a text that holds a sentinel
is plain; a null id is hashed as an empty one; repeated rows are treated alike; texts of any
length are cut whole; extra columns stay, but those made are replaced; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import chunks, held, unused, utf8

#: Bytes of texts that are handled together, and their number.
TEXT_BYTES, DOCS_AT_ONCE = 4 << 20, 2048
MADE = T.StructType([
    T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType(), False),
])


@dataclass(frozen=True)
class Units:
    """What a unit is: it ends behind a character of `closers` (ASCII), after `longest` code
    points, or with the text. As a pattern, for closers C: `[^C]{longest}|[^C]*[C]|[^C]+`."""

    closers: str = "\n"
    longest: int | None = None

    def __post_init__(self):
        if not self.closers.isascii() or self.longest is not None and self.longest < 1:
            raise ValueError("closers are ASCII characters, longest is at least 1")


LINES = Units()
WORDS = Units(" \t\n\r\x0b\x0c")
CHARACTERS = Units("", 1)


@dataclass(frozen=True)
class Sentinels:
    """The marks before each piece. No mark may hold another, nor begin with the end of one:
    so each is found where it was written, whatever stands beside it."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("three different sentinels are needed")
        for a in marks:
            for b in marks:
                if a != b and a in b or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can overlap")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Scanner:
    """The automaton of one worker."""

    def __init__(self, units: Units, sentinels: Sentinels):
        self.longest = units.longest
        self.automaton = ahocorasick.Automaton()
        for c in units.closers:
            self.automaton.add_word(c, True)
        for s in sentinels.all:
            self.automaton.add_word(s, False)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Where each closed stretch ends (the text's own end last), the units up to there, and
        whether the text holds a sentinel."""
        closed, marked = [], False
        for end, closes in self.automaton.iter(text):
            if closes:
                closed.append(end + 1)
            else:
                marked = True
        open_end = not closed or closed[-1] < len(text)
        if open_end:
            closed.append(len(text))
        ends = np.array(closed, np.int64)
        lengths = np.diff(ends, prepend=0)
        if self.longest:  # a closer ends the unit that it falls into, or is one
            units = (lengths - 1) // self.longest + 1
            if open_end:
                units[-1] = -(-lengths[-1] // self.longest)
        else:
            units = np.minimum(lengths, 1)
        return ends, np.cumsum(units), marked

    def end_of(self, rank: int, ends: np.ndarray, counts: np.ndarray) -> int:
        """Where the first `rank` units end, in code points."""
        if rank == 0:
            return 0
        k = int(np.searchsorted(counts, rank))
        if not self.longest or counts[k] == rank:
            return int(ends[k])
        before, start = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, 0)
        return start + (rank - before) * self.longest


def draws(seed: int, doc_id: str | Column) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of 8 hexadecimal digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, units: Units = LINES, sentinels: Sentinels | None = None
) -> DataFrame:
    """df with n (units), form, prefix_chars and middle_chars (null if plain) and output.

    rate: per cent of the documents that are not plain; spm_rate: per cent of those in
    the form spm. For n units, the cuts are two draws modulo n + 1.
    """
    sentinels = sentinels or Sentinels()
    kept = [c for c in df.columns if c not in MADE.names]
    drawn = unused([*df.columns, *MADE.names], "h1", "h2", "h3", "h4")
    given = df.select(*kept, *([] if text in kept else [text]), *(h.alias(c) for h, c in zip(draws(seed, doc_id), drawn, strict=True)))
    schema = T.StructType([*(df.schema[c] for c in kept), *MADE])
    p, s, m = sentinels.all

    def made(scanner: Scanner, text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        ends, counts, marked = scanner.scan(text)
        n = int(counts[-1])
        if not text or marked or h3 % 100 >= rate:
            return n, "plain", None, None, text
        a, b = (scanner.end_of(r, ends, counts) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held((Scanner, units, sentinels), lambda: Scanner(units, sentinels))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for whole in batches:
            data, offsets = utf8(whole.column(text))
            for i, j, _, _ in chunks(data, offsets, TEXT_BYTES, DOCS_AT_ONCE):
                b = whole.slice(i, j - i)
                columns = (b.column(c).to_pylist() for c in drawn)
                rows = [made(scanner, t or "", *h) for t, *h in zip(b.column(text).to_pylist(), *columns, strict=True)]
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], schema.names)

    return given.mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that an output of transform() was made from. The sentinels stand once each in
    it, so each piece is what lies between two of them."""
    p, s, m = (sentinels or Sentinels()).all

    def behind(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    def between(first: str, last: str) -> Column:
        return F.substring_index(F.substring_index(output, last, 1), first, -1)

    psm = F.concat(between(p, s), behind(m), between(s, m))
    spm = F.concat(between(p, m), behind(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
