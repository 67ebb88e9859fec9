"""Hard negatives by distributed radix selection over integer scores.

A row's vector becomes integers, floor(scale * x), and its score for an anchor is their inner product.
An anchor's positives are its best rows of the same label. A negative of an anchor and a positive
is one of the best rows of another label whose score is between `low` and `high` per
cent of the positive's.

Both are selections: the best k rows of a window of scores. No window's rows are brought together
or sorted. A pass over all rows counts, for each window, the scores by their highest digit that is
still open; summed over all tasks, the counts say which digit holds the kth score, and the
next pass counts within it alone, until the kth score is known. Then one pass gathers the rows
above it, fewer than k, and the smallest ids among those that tie with it, at most k for each task, however
many copies tie. A task reports no digit behind the one in which its own rows
reach k, as the kth score of all rows cannot lie there; so it reports k digits a window at most.

Rows are packed once into blocks of BLOCK vectors, dealt evenly over partitions of
bounded size; anchors are packed likewise and sent, with their windows, to each partition. Scores are
products of matrices, block against block; they are counted where they are made.

Edge cases: rows with a null id, label or vector, or with any null or non-finite
component, take no part; a row is compared only with vectors of its own width; a row with an
anchor's own id is neither a positive nor a negative of it; rows that repeat are rows of
their own, also as anchors; ties go to the smaller id; a positive whose window is empty (as
with a negative score) has no negatives; an empty table, or one without anchors, gives an
empty result; extra columns are ignored, whatever their names. Scores are exact; one that could exceed 62
bits raises an error before any is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.common import discard, materialize

#: Vectors of a block of rows, of a block of anchors; bits of a digit; bytes of rows that a task holds.
BLOCK, ANCHORS, DIGIT, TASK_BYTES = 512, 256, 10, 128 << 20

BLOCKS = "p int, block bigint, width int, kind string, peak double, square double, ids binary, labels binary, vectors binary"
WINDOW = ["a", "i", "w"]
#: An anchor is row i of block a, w its window: lo and hi enclose the kth score, need is how many
#: rows are still to be found there, top is where the window ends.
STATE = "a bigint, i int, w int, anchor_id bigint, positive_id bigint, positive_score bigint, lo bigint, hi bigint, top bigint, need int"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector of double) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)


def _pack(rows: DataFrame, scale: int, size: int, parts: int) -> DataFrame:
    """rows in blocks of at most `size` vectors of one width, with p, the partition of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(width: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors = (np.concatenate(x) for x in zip(*waiting.pop(width), strict=True))
            peak, square = (float(f(x, initial=0)) for f, x in ((np.max, np.abs(vectors)), (np.max, np.square(vectors).sum(axis=1))))
            kind = next((k for k, most in (("<i2", 2.0**15), ("<i4", 2.0**31)) if peak < most), "<f8")
            made += 1
            values = [p, p * 2**32 + made, width, kind, peak, square, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), vectors.astype(kind).tobytes()]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                widths = np.diff(np.asarray(b.column("vector").offsets))
                flat = np.floor(scale * b.column("vector").flatten().to_numpy())
                starts = np.cumsum(widths) - widths
                ids, labels = (b.column(c).to_numpy() for c in ("id", "label"))
                for width in np.unique(widths).tolist():
                    of = np.flatnonzero(widths == width)
                    vectors = flat[starts[of, None] + np.arange(width)] if width else np.zeros((len(of), 0))
                    have = waiting.setdefault(width, [])
                    if sum(len(x[0]) for x in have) + len(of) > size:
                        yield block(width)
                        have = waiting.setdefault(width, [])
                    have.append((ids[of], labels[of], vectors))
        for width in [*waiting]:
            yield block(width)

    return rows.repartition(parts).mapInArrow(run, BLOCKS)


class Block:
    """Rows or anchors as a task reads them."""

    def __init__(self, width: int, kind: str, ids: bytes, labels: bytes, vectors: bytes, exact: str):
        self.width = width
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, kind).reshape(len(self.ids), width).astype(exact)


class Windows:
    """The windows of a block of anchors, as columns."""

    def __init__(self, anchors: Block, windows: pa.StructArray, same: bool):
        self.anchors, self.same = anchors, same
        self.i, self.w, self.lo, self.hi, self.top, self.need = (windows.field(c).to_numpy(zero_copy_only=False) for c in ("i", "w", "lo", "hi", "top", "need"))

    def scores(self, rows: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each window and row: the score, and whether the row may be chosen at all."""
        a = self.anchors
        scores = (a.vectors @ rows.vectors.T).astype(np.int64)
        open_ = ((a.labels[:, None] == rows.labels) == self.same) & (a.ids[:, None] != rows.ids)
        return scores[self.i], open_[self.i]


def _histograms(windows: Windows, rows: list[Block], shift: int) -> list[np.ndarray]:
    """i, w, digit, n of the digits that the kth score of each window may have."""
    size = 1 << DIGIT
    counts = np.zeros(len(windows.i) * size, np.int64)
    for block in rows:
        scores, chosen = windows.scores(block)
        of, at = np.nonzero(chosen & (scores >= windows.lo[:, None]) & (scores <= windows.hi[:, None]))
        counts += np.bincount(of * size + ((windows.hi[of] - scores[of, at]) >> shift), minlength=len(counts))
    counts = counts.reshape(-1, size)
    of, digit = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < windows.need[:, None]))
    return [windows.i[of], windows.w[of], digit, counts[of, digit]]


def _gathered(windows: Windows, rows: list[Block], shift: int) -> list[np.ndarray]:
    """i, w, id, score of the rows above the kth score, and of the smallest ids that tie with it."""
    above, ties = [[np.zeros(0, np.int64)] * 3], np.zeros((0, 2), np.int64)
    for block in rows:
        scores, chosen = windows.scores(block)
        of, at = np.nonzero(chosen & (scores > windows.lo[:, None]) & (scores <= windows.top[:, None]))
        above.append([of, block.ids[at], scores[of, at]])
        of, at = np.nonzero(chosen & (scores == windows.lo[:, None]))
        ties = np.concatenate([ties, np.stack([of, block.ids[at]], axis=1)])
        ties = ties[np.lexsort((ties[:, 1], ties[:, 0]))]
        place = np.arange(len(ties)) - np.searchsorted(ties[:, 0], ties[:, 0])
        ties = ties[place < windows.need[ties[:, 0]]]
    of, ids, scores = (np.concatenate(x) for x in zip(*above, [ties[:, 0], ties[:, 1], windows.lo[ties[:, 0]]], strict=True))
    return [windows.i[of], windows.w[of], ids, scores]


class Selection:
    """Passes of all anchors' windows over all rows."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, parts: int, exact: str):
        self.rows, self.anchors, self.parts, self.exact = rows, anchors, parts, exact

    def scan(self, state: DataFrame, same: bool, made: Callable, columns: str, shift: int = 0) -> DataFrame:
        """What `made` reports of each block of anchors in each partition of rows."""
        exact = self.exact
        windows = state.groupBy("a").agg(F.collect_list(F.struct("i", "w", "lo", "hi", "top", "need")).alias("windows"))
        packed = self.anchors.withColumnRenamed("block", "a").drop("p").join(windows, "a").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        rows = self.rows.withColumnRenamed("block", "a").withColumn("windows", F.lit(None).cast(packed.schema["windows"].dataType))
        # each partition reads its rows first, then anchors as they come
        both = rows.unionByName(packed).repartitionById(self.parts, "p").sortWithinPartitions("p", F.col("windows").isNotNull())
        names = [c.split()[0] for c in columns.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                for k in range(b.num_rows):
                    p, a = b.column("p")[k].as_py(), b.column("a")[k].as_py()
                    if p != now:
                        now, held = p, []
                    block = Block(*(b.column(c)[k].as_py() for c in ("width", "kind", "ids", "labels", "vectors")), exact)
                    if not b.column("windows")[k].is_valid:
                        held.append(block)
                        continue
                    found = made(Windows(block, b.column("windows")[k].values, same), [r for r in held if r.width == block.width], shift)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), a, np.int64)), *(pa.array(x.astype(t)) for x, t in zip(found, ("i4", "i4", "i8", "i8"), strict=True))], names)

        return both.mapInArrow(run, columns)

    def best(self, state: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """state's windows with the rows chosen: a, i, w, ..., id, score, rank. state is deleted."""
        while True:
            widest = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
            if not widest:
                break
            shift = max(0, int(widest).bit_length() - DIGIT)
            counted = self.scan(state.where("lo < hi"), same, _histograms, "a bigint, i int, w int, digit bigint, n bigint", shift)
            digits = counted.groupBy(*WINDOW, "digit").agg(F.sum("n").alias("n"))
            upto = digits.withColumn("upto", F.sum("n").over(Window.partitionBy(*WINDOW).orderBy("digit")))
            with_need = upto.join(state.select(*WINDOW, "need"), WINDOW)
            found = with_need.where("upto >= need and upto - n < need").select(*WINDOW, "digit", (F.col("upto") - F.col("n")).cast("int").alias("before"))
            hi = F.when(F.col("digit").isNotNull(), F.col("hi") - F.col("digit") * (1 << shift)).otherwise(F.col("lo"))  # fewer than k rows: all of them
            joined = state.join(found, WINDOW, "left").withColumn("upper", F.when(F.col("lo") < F.col("hi"), hi).otherwise(F.col("hi")))
            nxt = materialize(joined.select(
                *WINDOW, "anchor_id", "positive_id", "positive_score", F.greatest("lo", F.col("upper") - ((1 << shift) - 1)).alias("lo"), F.col("upper").alias("hi"), "top",
                (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"),
            ), name)
            discard(state)
            state = nxt
        rows = self.scan(state, same, _gathered, "a bigint, i int, w int, id bigint, score bigint")
        order = Window.partitionBy(*WINDOW).orderBy(F.desc("score"), "id")
        chosen = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = materialize(chosen.join(state.select(*WINDOW, "anchor_id", "positive_id", "positive_score"), WINDOW), f"{name}_rows")
        discard(state)
        return out


def mine(
    df: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of
    df that `anchors` accepts and each of its best rows of the same label, the best
    rows of other labels that score between low and high per cent of that positive."""
    spark = df.sparkSession
    given, asked = usable(df, vec_id, vector, label), usable(df.where(anchors), vec_id, vector, label)
    n_rows, bytes_ = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0))).first()
    n_anchors = asked.count()
    if not n_rows or not n_anchors:
        return spark.createDataFrame([], RESULT)
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(-(-n_rows // BLOCK), 2 * cores), -(-bytes_ // TASK_BYTES))
    rows = materialize(_pack(given, scale, BLOCK, parts), "rows")
    queries = materialize(_pack(asked, scale, ANCHORS, -(-n_anchors // ANCHORS)), "anchors")
    peak, square, width = rows.agg(F.max("peak"), F.max("square"), F.max("width")).first()
    bound = peak * peak * max(width, 1)
    if bound >= 2.0**62:
        raise OverflowError("scores may exceed 62 bits: use a smaller scale")
    selection = Selection(rows, queries, parts, "f8" if bound < 2.0**53 else "i8")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = int(np.ceil(np.sqrt(square) * (1 + 1e-9))) + 1
        for b in batches:
            for a, s, ids in zip(*(b.column(c).to_pylist() for c in ("block", "square", "ids")), strict=True):
                found = np.frombuffer(ids, "<i8")
                n, edge = len(found), most * (int(np.ceil(np.sqrt(s) * (1 + 1e-9))) + 1)
                same = [np.full(n, v, t) for v, t in ((a, "i8"), (0, "i4"), (0, "i8"), (0, "i8"), (-edge, "i8"), (edge, "i8"), (edge, "i8"), (positives, "i4"))]
                columns = [same[0], np.arange(n, dtype="i4"), same[1], found, *same[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in STATE.split(", ")])

    state = materialize(queries.select("block", "square", "ids").mapInArrow(first, STATE), "positives")
    chosen = selection.best(state, True, positives, "positives")
    at_least = F.ceil(F.lit(low) * F.col("score").cast("decimal(30,0)") / 100).cast("long")
    at_most = F.floor(F.lit(high) * F.col("score").cast("decimal(30,0)") / 100).cast("long")
    windows = chosen.select(
        "a", "i", (F.col("rank") - 1).cast("int").alias("w"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        at_least.alias("lo"), at_most.alias("hi"), at_most.alias("top"), F.lit(negatives).alias("need"),
    )
    state = materialize(windows.where("lo <= hi"), "negatives")
    discard(chosen)
    found = selection.best(state, False, negatives, "negatives")
    discard(rows, queries)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
