"""De-identification of documents as they arrive.

Every rule is scoped to a document. Where a document is a row, a micro-batch is complete in
itself and no state is kept between batches. Where its units arrive apart, state holds them until all are there:
each unit says how many its document has. A batch that is run again after a failure writes
the same folder again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velum.plans import pipeline


def redact_stream(docs: DataFrame, out: str, checkpoint: str, purpose: str = "educacion", available_now: bool = False) -> StreamingQuery:
    """Write new texts (doc_id, new_text) and the matrix of a stream of documents (doc_id,
    text) under out, a partition for each batch."""

    def batch(df: DataFrame, number: int) -> None:
        done = pipeline.process(pipeline.units_of(df), purpose).cached()
        done.units.select("doc_id", "new_text").write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
        done.matrix.write.mode("overwrite").parquet(f"{out}/matrix/batch={number}")
        done.release()

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: What becomes of a unit: its document is whole; it came when the document had left already; it came
#: twice; the rest of its document did not come in time; it says something else than the units before it.
WHOLE, LATE, REPLAYED, INCOMPLETE, CONTRADICTORY = "whole", "late", "replayed", "incomplete", "contradictory"
ASSEMBLED = "doc_id long, unit_seq int, text string, fate string"
_STATE = "n int, left boolean, seqs array<int>, texts array<string>"


def assemble(units: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """Units of a stream (doc_id, unit_seq, n_units, text), each with its fate, once that is known.

    A document leaves when its last unit comes, whatever their order and batches. What then still comes is
    late, or replayed if it is a unit that was there before; both, and the units of documents that are not whole
    after wait_ms without another unit, are rows of their own, so that nothing is lost in silence. State is a document's
    units until it leaves, and their numbers for another wait_ms.
    """

    def step(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, left, seqs, texts = state.get if state.exists else (0, False, [], [])
        have: dict = dict(zip(seqs, texts or [None] * len(seqs), strict=True))
        out: list[tuple] = []
        if state.hasTimedOut:
            if not left:
                out += [(s, t, INCOMPLETE) for s, t in sorted(have.items())]
            state.remove()
        else:
            rows = pd.concat(list(pages)).sort_values("unit_seq", kind="stable")
            for seq, total, text in zip(rows["unit_seq"], rows["n_units"], rows["text"], strict=True):
                seq, text = int(seq), None if pd.isna(text) else text
                if seq in have:
                    out.append((seq, text, REPLAYED))
                elif left:
                    out.append((seq, text, LATE))
                elif n and total != n:
                    out.append((seq, text, CONTRADICTORY))
                else:
                    n, have[seq] = int(total), text
                    if len(have) >= n:
                        out += [(s, t, WHOLE) for s, t in sorted(have.items())]
                        left = True
            state.update((n, left, list(have), [] if left else list(have.values())))
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["doc_id", "unit_seq", "text", "fate"])

    return units.groupBy("doc_id").applyInPandasWithState(step, ASSEMBLED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def redact_units_stream(units: DataFrame, out: str, checkpoint: str, purpose: str = "educacion", wait_ms: int = 600_000, every: str = "10 seconds") -> StreamingQuery:
    """As redact_stream, for units that arrive apart (doc_id, unit_seq, n_units, text): new texts by unit, the
    matrix, and what was not taken under rejects (doc_id, unit_seq, fate; no text, as it holds identifiers).
    It runs until it is stopped, as time alone can decide on a document."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        if df.isEmpty():
            df.unpersist()
            return
        whole = pipeline.units_of(df.where(df.fate == WHOLE), unit_seq="unit_seq")
        done = pipeline.process(whole, purpose).cached()
        done.units.select("doc_id", "unit_seq", "new_text").write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
        done.matrix.write.mode("overwrite").parquet(f"{out}/matrix/batch={number}")
        df.where(df.fate != WHOLE).select("doc_id", "unit_seq", "fate").write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        done.release()
        df.unpersist()

    return assemble(units, wait_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
