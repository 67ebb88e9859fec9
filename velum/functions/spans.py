"""Matches of patterns as rows with their offsets, and interval helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.text import FOLD_FROM, FOLD_TO

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
#: Matches that a task holds before it hands them on; texts that it holds at once.
_ROWS, _TEXTS = 20_000, 256


@dataclass(frozen=True)
class Pattern:
    """A kind of match. folded: looked for in the folded text; needs: what a text must hold
    (a pattern, cheap to look for) to have any match; words: of which the folded text must hold one.

    edge: the pattern is nothing but words (with a group around them, if grouped) that no character of this class
    may border on, in a folded text; it is not run at all then.
    starts: of which the folded text holds one wherever a match begins, not behind a plain letter; it is tried there alone.
    """

    kind: str
    order: int
    regex: str
    folded: bool = False
    needs: str = ""
    words: tuple[str, ...] = ()
    edge: str = ""
    starts: tuple[str, ...] = ()


MATCH = [
    T.StructField("kind", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("value_start", T.IntegerType()), T.StructField("value", T.StringType()),
    T.StructField("g", T.ArrayType(T.StringType())), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
]


#: Bytes that are enough work for a core; an input of less for each core is dealt out first.
_SPLIT = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is small: a small file often is a single split. Patterns cost
    far more than such a shuffle; a large input has splits enough and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().analyzed().stats().sizeInBytes()
    return df.repartition(cores) if size < cores * _SPLIT else df


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.StringType(): pa.string(), T.IntegerType(): pa.int32()}.get(kind, pa.list_(pa.string()))


#: Letters that a pattern without regard to case takes for others than folding does.
_ODD_CASE = re.compile("[ſıK]")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Matcher:
    """The patterns as a task runs them over one text after the other."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = []
        for i, p in enumerate(patterns):
            # a folded text has no capitals, so regard to case changes nothing there but the time
            regex, any_case = re.compile(p.regex.removeprefix("(?i)") if p.folded else p.regex), re.compile(p.regex)
            self.patterns.append((i, p, regex, any_case, re.compile(p.needs) if p.needs else None, 1 << i if p.words or p.starts else 0))
        self.edges = [(set(re.findall(p.edge, "abcdefghijklmnopqrstuvwxyz0123456789")) if p.edge else None) for p in patterns]
        found: dict[str, tuple[int, list[int], list[int]]] = {}
        for i, p in enumerate(patterns):
            for w in (*p.words, *p.starts):
                bits, lists, tried = found.get(w, (0, [], []))
                starts = w in p.starts
                found[w] = (bits if starts else bits | 1 << i), [*lists, i] if p.edge else lists, [*tried, i] if starts else tried
        self.automaton = ahocorasick.Automaton()
        for w, (bits, lists, tried) in found.items():
            self.automaton.add_word(w, (len(w), bits, tuple(lists), tuple(tried)))
        if found:
            self.automaton.make_automaton()
        self.words = bool(found)

    def _words(self, t: str, folded: str) -> tuple[int, dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
        """Bits of the patterns that have a word here, start and negative length of the words of lists, and where other patterns may begin."""
        bits, lists, tried = 0, {}, {}
        if self.words:
            for end, (n, own, of, begins) in self.automaton.iter(folded):
                bits |= own
                start = end + 1 - n
                if begins and (start == 0 or t[start - 1] not in _LETTERS):
                    for i in begins:
                        bits |= 1 << i
                        if i in tried:
                            tried[i].append(start)
                        else:
                            tried[i] = [start]
                for i in of:
                    edge = self.edges[i]
                    if (start == 0 or folded[start - 1] not in edge) and folded[end + 1 : end + 2] not in edge:
                        lists.setdefault(i, []).append((start, -n))
        return bits, lists, tried

    @staticmethod
    def _at(regex: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
        """The matches that finditer gives of a pattern that begins nowhere else."""
        at = 0
        for start in sorted(starts):
            if start >= at and (m := regex.match(text, start)):
                at = m.end()
                yield m

    def matches(self, t: str) -> Iterator[tuple]:
        plain = t.isascii()
        folded = t.lower() if plain else t.translate(_FOLD).lower()
        bits, lists, tried = self._words(t, folded)
        odd = not plain and _ODD_CASE.search(t) is not None
        if odd:
            bits = -1
        held: dict[str, bool] = {"": True}
        for i, p, regex, any_case, needs, own in self.patterns:
            if own and not bits & own:
                continue
            if p.edge:  # of words that begin together the longest is taken, and what it covers is passed over
                at = 0
                for start, n in sorted(lists.get(i, ())):
                    if start >= at:
                        at = start - n
                        yield p.kind, p.order, start, at, t[start:at], start, t[start:at], [folded[start:at]] * regex.groups, t[max(0, start - 32) : start], t[at : at + 28]
                continue
            if p.needs not in held:
                held[p.needs] = needs.search(t) is not None
            if not held[p.needs]:
                continue
            read = folded if p.folded else t
            for m in any_case.finditer(read) if odd else self._at(regex, read, tried[i]) if p.starts else regex.finditer(read):
                start, end, last = m.start(), m.end(), m.lastindex or 0
                low, high = m.span(last)
                yield p.kind, p.order, start, end, t[start:end], low, t[low:high], list(m.groups()), t[max(0, start - 32) : start], t[end : end + 28]


def scan(units: DataFrame, patterns: list[Pattern], keys: list[str], text: str = "text") -> DataFrame:
    """A row for each match: the keys of its unit, kind, ord, start, end, text, the last group
    that took part (value, at value_start; the match without groups), all groups g, and
    32 and 28 characters of context. Offsets count code points; null text has no matches.

    The texts are read once, for all patterns; only matches leave the task. One automaton finds the words of all
    patterns in a single pass; it gives the matches of lists of words, and says which other patterns to try.
    """
    schema = T.StructType([*(units.schema[k] for k in keys), *MATCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matcher(patterns).matches

        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(at, _TEXTS)
                rows, of = [], []

                def out(b=b) -> pa.RecordBatch:
                    columns = [pa.array(c, _arrow(f.dataType)) for c, f in zip(zip(*rows, strict=True), MATCH, strict=True)]
                    return pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of)) for k in keys), *columns], schema.names)

                for i, t in enumerate(b.column(text)):
                    for m in matches(t.as_py() or ""):
                        rows.append(m)
                        of.append(i)
                        if len(rows) >= _ROWS:
                            yield out()
                            rows.clear()
                            of.clear()
                if rows:
                    yield out()

    return spread(units.select(*keys, *([] if text in keys else [text]))).mapInArrow(run, schema)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end and n of the intervals that remain when those of one key that touch
    or overlap are joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = df.withColumn("_opens", opens).withColumn("_island", island).groupBy(*keys, "_island")
    return joined.agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")
