"""Matches of one pattern with their offsets, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velum.functions.spans import spread


def matches(df: DataFrame, keys: list[str], text: str, regex: str) -> DataFrame:
    """keys, start, end, text of each match of a pattern that is never empty, in Java's syntax (with (?U), classes
    mean what they mean in other scanners). Offsets count code points; null text has no matches.

    A text is cut at the matches, so the lengths of the gaps and matches before one add up to its start. They are
    added up over the rows of matches, which alone are shuffled; texts without a match are passed over.
    """
    t = F.col(text)
    parts = F.arrays_zip(F.transform(F.split(t, regex, -1), lambda g: F.length(g)).alias("gap"), F.regexp_extract_all(t, F.lit(regex), F.lit(0)).alias("text"))
    cut = spread(df.select(*keys, *([] if text in keys else [text]))).where(t.rlike(regex)).select(*keys, F.monotonically_increasing_id().alias("_row"), parts.alias("_parts"))
    each = cut.select(*keys, "_row", F.posexplode("_parts").alias("_at", "_p")).where("_p.text is not null")
    each = each.select(*keys, "_row", "_at", F.col("_p.gap").alias("_gap"), F.col("_p.text").alias("_text"))
    before = Window.partitionBy("_row").orderBy("_at")
    end = F.sum(F.col("_gap") + F.length("_text")).over(before).cast("int")
    return each.withColumn("_end", end).select(*keys, (F.col("_end") - F.length("_text")).alias("start"), F.col("_end").alias("end"), F.col("_text").alias("text"))
