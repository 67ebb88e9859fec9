"""Runs: a folder each, listed once it is whole and deleted as a whole; Spark's file systems only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.operators import audit
from velum.plans.pipeline import WARNING


#: The marker of a run that was written to its end.
WHOLE = "_WHOLE"


def reconstruction_notes(notes: Column) -> Column:
    """What could not be rebuilt of a file (an array of texts), and the warning that always follows."""
    return F.concat(F.array_join(F.coalesce(notes, F.array().cast("array<string>")), "\n"), F.lit("\n\n" + WARNING))


def write(base: str, run: str, results: DataFrame, matrix: DataFrame) -> None:
    """The results, the matrix (masked and hashed) and the audit of a run, and a marker last, without which
    it is not listed: a run that dies in between does not look whole. Identifiers are not written."""
    spark = results.sparkSession
    results.write.parquet(f"{base}/run={run}/results")
    matrix.write.parquet(f"{base}/run={run}/matrix")
    audit.documents_json(results, matrix, {"id": run}).write.parquet(f"{base}/run={run}/audit")
    marker, system = _folder(spark, f"{base}/run={run}/{WHOLE}")
    system.create(marker, True).close()


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def runs(spark: SparkSession, base: str) -> list[str]:
    """The names of all whole runs, the newest last if names begin with their time."""
    folder, system = _folder(spark, base)
    below = [s.getPath() for s in system.listStatus(folder)] if system.exists(folder) else []
    found = [p.getName() for p in below if system.exists(_folder(spark, f"{p}/{WHOLE}")[0])]
    return sorted(n.removeprefix("run=") for n in found if n.startswith("run="))


def delete(spark: SparkSession, base: str, run: str) -> bool:
    """Delete all that a run has written; whether there was anything."""
    if not run or "/" in run or ".." in run:
        raise ValueError(f"no name of a run: {run}")
    folder, system = _folder(spark, f"{base}/run={run}")
    return system.delete(folder, True)
