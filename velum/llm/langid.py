"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed letter trigrams (bytes of the lower-cased
text, runs of other characters as one space), scaled to length 1. For each
language, spherical k-means over a bounded sample of labelled texts gives
CENTROIDS centroids; a text takes the language of the centroid with the greatest
cosine, and is rejected where that cosine is under SLACK times the least cosine that
the centroid's own sample rows had (their 1 % quantile).

The centroids are fitted on at most PER_LANGUAGE different labelled texts of each
language, those with the smallest hash, so a text that repeats counts once; document
frequencies are counted over all labelled rows. Prediction reads every text whole, row by
row, without a shuffle.

Edge cases: rows that repeat each other get equal results; a text of any length is one
vector, of bounded size; a null text or one without a letter is `und`, score 0, rejected; equal
cosines go to the language first in order; labels that are null are never learned;
without any learned row everything is `und`; an empty table gives an empty result;
extra columns stay, but lang_pred, score and rejected are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import chunks, discard, let_go, materialize, unused, utf8

DIMENSIONS = 8192
PER_LANGUAGE, CENTROIDS, ROUNDS = 600, 4, 12
SLACK = 0.3
#: Documents whose vectors a task holds at once.
DOCS_AT_ONCE = 128

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTERS[[*range(65, 91)]] = [*range(97, 123)]


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Trigram counts (documents x DIMENSIONS, float32) of runs of the texts."""
    let_go()
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    for i, j, data, offsets in chunks(*utf8(spaced), docs=DOCS_AT_ONCE):
        n = j - i
        letters = _LETTERS[data]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        kept = np.ones(len(letters), bool)
        kept[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (doc[1:] != doc[:-1])
        letters, doc = letters[kept].astype(np.uint32), doc[kept]
        if len(letters) < 3:
            yield np.zeros((n, DIMENSIONS), np.float32)
            continue
        code = letters[:-2] | (letters[1:-1] << np.uint32(8)) | (letters[2:] << np.uint32(16))
        at = (code * np.uint32(2654435761)) >> np.uint32(19)  # 13 bits
        inside = doc[:-2] == doc[2:]
        found = np.bincount(doc[:-2][inside] * DIMENSIONS + at[inside], minlength=n * DIMENSIONS)
        yield found.reshape(n, DIMENSIONS).astype(np.float32)


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Centroids:
    """A fitted classifier: a few dozen kilobytes for each language."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray


def _kmeans(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from evenly spaced rows: centroids and 1 % quantile cosines.
    Clusters of a few stray rows are dropped."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    cosines = vectors @ centres.T
    own = cosines.argmax(axis=1)
    sizes = np.bincount(own, minlength=len(centres))
    kept = [c for c in range(len(centres)) if sizes[c] >= 0.02 * sizes.max() and sizes[c]]
    return centres[kept], np.array([np.quantile(cosines[own == c, c], 0.01) for c in kept])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Centroids:
    """Learn from rows with a label and a text; which of them: see the module."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    hashed = materialize(rows.select("lang", F.xxhash64("text").alias("h")).distinct(), "langid_texts")
    counts = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    # hashes are even, so the smallest lie below this share of their range, of which few more are sorted
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_language + 64) / n))))
    low = hashed.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    low = low.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "h")
    chosen = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(low), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # at most per_language hashes of each
    sample = materialize(chosen, "langid_sample")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for f in features(b.column("text")):
                total, n = total + np.count_nonzero(f, axis=0), n + len(f)
        yield pa.RecordBatch.from_pydict({"at": np.arange(DIMENSIONS + 1, dtype=np.int32), "n": np.append(total, n)})

    totals = rows.select("text").mapInArrow(document_counts, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 rows
    df = np.zeros(DIMENSIONS + 1)
    df[[r["at"] for r in totals]] = [r["n"] for r in totals]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.concatenate([_scaled(f, idf) for f in features(pa.array(pdf["text"].sort_values(), pa.large_string()))])
        centres, floors = _kmeans(vectors, centroids)
        return pd.DataFrame({"lang": key[0], "centroid": [c.tolist() for c in centres], "floor": floors})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, floor double").collect()
    discard(hashed, sample)
    found = sorted(found, key=lambda r: (r.lang, r.centroid))
    return Centroids(idf, np.array([r.centroid for r in found], np.float32), [r.lang for r in found], np.array([r.floor for r in found]))


def predict(df: DataFrame, model: Centroids, text: str = "text", slack: float = SLACK) -> DataFrame:
    """df with lang_pred, score (the cosine, 0 to 1) and rejected."""
    made = ["lang_pred", "score", "rejected"]
    kept = [c for c in df.columns if c not in made]
    (letter,) = unused(df.columns, "letters")
    types = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, types[c]) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, cosine = [np.zeros(0, np.int64)], [np.zeros(0)]
            for f in features(b.column(text)):
                if model.languages:
                    near = _scaled(f, model.idf) @ model.centroids.T
                    best.append(near.argmax(axis=1))
                    cosine.append(near.max(axis=1).astype(np.float64))
                else:
                    best.append(np.zeros(len(f), np.int64))
                    cosine.append(np.zeros(len(f)))
            best, cosine = np.concatenate(best), np.clip(np.concatenate(cosine), 0, 1)
            known = b.column(letter).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            floors = model.floors[best] * slack if model.languages else np.ones(len(best))
            langs = np.array([*model.languages, "und"], object)[np.where(known, best, len(model.languages))]
            out = [pa.array(langs, pa.string()), pa.array(np.where(known, cosine, 0.0)), pa.array(~known | (cosine < floors))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *out], schema.names)

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter)
    return df.select(*kept, letters).mapInArrow(run, schema)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


def fit_folds(documents: DataFrame) -> Centroids:
    """Fit on the rows whose fold is not 1."""
    return fit(documents.where(fold() != 1).select("text", "lang"))
