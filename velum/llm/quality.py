"""Document quality by hierarchical empirical Bayes.

1. A classifier gives each document's evidence: a logistic model over the presence of
   hashed words and a few measures of style, fitted on at most SAMPLE different labelled
   texts (those with the smallest hash). Every document is scored once, and what it scored
   is written.
2. Grouped aggregation over all documents gives each path (section of a host) and each
   host its number of documents and of good ones: the label where there is one, the
   classifier's probability elsewhere.
3. Hosts shrink toward the global rate and paths toward their host, by prior weights
   estimated from how much hosts vary around that rate and paths around their own host, beyond
   chance (method of moments).
4. A document's posterior log odds are its evidence plus the log odds of its path
   relative to the global rate, weighted by PRIOR_WEIGHT. What the document itself, label
   or evidence, adds to the rates of its path and host is left out of its own.

Edge cases: rows that repeat each other count as documents of their own and get equal
results; texts of any length are read whole; null and empty texts have the evidence of an empty document; a null or
unparsable site is the host and path ''; null labels are no labels; a document with
several labels counts with their mean; without labels of both kinds the evidence is 0
and every rate a half; an empty table gives an empty result; extra columns stay, but
those made are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import NOT_WORD, SPACES, Words, chunks, discard, let_go, materialize, utf8

BITS, SAMPLE, LEAST_DOCUMENTS = 20, 6000, 4
ROUNDS, RATE, PENALTY = 150, 0.3, 2e-4
PRIOR_WEIGHT, CLIP = 1.0, 8.0
STYLE = 8


def _measures(w: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Style of each document: shares of capitals, digits, symbols and line feeds, length of
    words, share of distinct words, share of the most frequent word, log of length."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def share(inside: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(inside)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    words = np.maximum(w.counts, 1)
    doc = np.repeat(np.arange(n), w.counts)
    order = np.lexsort((w.hashes, doc))
    d, h = doc[order], w.hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, d[first], runs)
    capitals, digits = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    symbols = NOT_WORD[data] & ~SPACES[data]
    lengths = np.bincount(doc, (w.ends - w.starts).astype(float), minlength=n)
    return np.stack([
        share(capitals) * 5, share(digits) * 5, share(symbols) * 5, share(data == 10) * 20, lengths / words / 5,
        np.bincount(d[first], minlength=n) / words, most / words, np.log1p(w.counts) / 5,
    ], axis=1)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: style, and document and bucket of each distinct word."""
    let_go()
    texts = texts.cast(pa.large_string()).fill_null("")
    lower = pc.ascii_lower(texts)
    raw, offsets = utf8(texts)
    low, _ = utf8(lower)
    for i, j, data, part in chunks(raw, offsets):
        w = Words(low[offsets[i] : offsets[j]], part, NOT_WORD)
        doc = np.repeat(np.arange(j - i, dtype=np.int64), w.counts)
        bucket = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        both = np.unique(doc << BITS | bucket)
        yield _measures(w, data, part), both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Evidence:
    """A fitted classifier; words has 2 ** BITS weights, 4 MB."""

    words: np.ndarray
    style: np.ndarray
    bias: float

    def log_odds(self, style: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        z = style @ self.style + self.bias + np.bincount(doc, self.words[bucket], minlength=len(style))
        return np.clip(z, -CLIP, CLIP)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Fit on rows (text, label); label is 1 for good and 0 for bad."""
    rows = labelled.where(F.col("label").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    return _fit(rows.select("h", F.col("h").alias("id"), "label"), rows.select(F.col("h").alias("id"), "text"), sample)


def _fit(marks: DataFrame, texts: DataFrame, sample: int) -> Evidence:
    """marks: (h, id, label) of every labelled text, h its hash; texts: (id, text) of all texts."""
    none = Evidence(np.zeros(1 << BITS, np.float32), np.zeros(STYLE), 0.0)
    cut = marks.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return none
    # copies of a text are one row with their number; of differing labels their mean counts
    chosen = marks.where(F.col("h") <= cut).groupBy("h").agg(F.min("id").alias("id"), F.round(F.avg("label")).alias("label"), F.count(F.lit(1)).alias("copies"))
    # at most `sample` rows are broadcast, so no text moves but theirs
    chosen = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for style, doc, bucket in features(b.column("text")):
                cuts = np.searchsorted(doc, np.arange(len(style) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(style), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32))), b.column("label").slice(at, len(style)), b.column("copies").slice(at, len(style))], ["style", "words", "label", "copies"]
                )
                at += len(style)

    rows = chosen.select("text", F.col("label").cast("double").alias("label"), "copies").mapInArrow(read, "style array<double>, words array<int>, label double, copies long").toPandas()  # at most `sample` rows
    if rows.empty or rows["label"].nunique() < 2:
        return none
    rows = rows.sort_values(["label"], kind="stable", ignore_index=True)
    y = rows["label"].to_numpy()
    style = np.stack(rows["style"])
    doc = np.repeat(np.arange(len(rows)), rows["words"].map(len))
    bucket, at = np.unique(np.concatenate(rows["words"].to_list()).astype(np.int64), return_inverse=True)
    copies = rows["copies"].to_numpy(float)
    seen = np.bincount(at, copies[doc])
    kept = (seen >= LEAST_DOCUMENTS)[at]
    doc, at = doc[kept], at[kept]
    good = max(float((y * copies).sum() / copies.sum()), 1e-6)
    weight = np.where(y > 0.5, 0.5 / good, 0.5 / max(1 - good, 1e-6)) * copies / copies.sum()  # both kinds weigh the same
    w, s, bias = np.zeros(len(bucket)), np.zeros(STYLE), 0.0
    gw, gs, gb = np.full(len(bucket), 1e-8), np.full(STYLE, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = style @ s + bias + np.bincount(doc, w[at], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        dw, ds, db = np.bincount(at, error[doc], minlength=len(bucket)) + PENALTY * w, style.T @ error, error.sum()
        gw, gs, gb = gw + dw**2, gs + ds**2, gb + db**2
        w, s, bias = w - RATE * dw / np.sqrt(gw), s - RATE * ds / np.sqrt(gs), bias - RATE * db / math.sqrt(gb)
    words = np.zeros(1 << BITS, np.float32)
    words[bucket] = w
    return Evidence(words, s, float(bias))


def score(df: DataFrame, model: Evidence, made: str, text: str = "text") -> DataFrame:
    """df with the evidence of each document in log odds."""
    kept = [c for c in df.columns if c != made]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(made, T.DoubleType(), False)])
    weights = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [weights.value.log_odds(*f) for f in features(b.column(text))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate([np.zeros(0), *found]))], schema.names)

    return df.select(kept).mapInArrow(run, schema)


def site(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL or of `host/path`: without scheme, query and fragment; the
    path is its first part."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/]*)", 1))
    return host, F.concat(host, F.lit("/"), F.regexp_extract(bare, r"^[^/]*/([^/]*)", 1))


def _prior_weight(groups: DataFrame, centres: int) -> float:
    """The documents that a prior counts as, from groups (n, good, centre): how much their rates vary around
    their centres, less chance. Each centre is itself an average of its groups, which takes up one of their
    free choices; centres: how many there are."""
    chance = F.col("centre") * (1 - F.col("centre"))
    spread = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("centre"), 2)
    r = groups.agg(F.sum(spread).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.avg(chance).alias("chance")).first()
    if not r.n or r.k <= centres or not r.chance or r.chance <= 0:
        return 100.0
    between = max((r.s - (r.k - centres) * r.chance) / r.n, 1e-6)
    return float(np.clip(r.chance / between, 2.0, 10_000.0))


def posteriors(docs: DataFrame) -> DataFrame:
    """docs (host, path, evidence, label) with host_rate, path_rate, prior_shift."""
    chance = 1 / (1 + F.exp(-F.col("evidence")))
    good = F.coalesce(F.col("label").cast("double"), chance)
    paths = docs.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("paths"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(max((total.good + 1) / (total.n + 2), 1e-4), 1 - 1e-4) if total.n else 0.5
    # paths vary around their host; a host with one path says nothing of that
    several = hosts.where("paths > 1")
    around = paths.join(several.select("host", (F.col("good") / F.col("n")).alias("centre")), "host")
    m_host, m_path = _prior_weight(hosts.withColumn("centre", F.lit(rate)), 1), _prior_weight(around, several.count())
    sums = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host").drop("host")
    # written, so that a path of very many documents can be split in the join
    out = docs.join(materialize(sums, "paths"), "path").withColumn("own", good)
    host_rate = (F.col("host_good") - F.col("own") + m_host * rate) / (F.col("host_n") - 1 + m_host)
    path_rate = (F.col("good") - F.col("own") + m_path * F.col("host_rate")) / (F.col("n") - 1 + m_path)
    out = out.withColumn("host_rate", host_rate).withColumn("path_rate", F.greatest(F.lit(1e-6), F.least(path_rate, F.lit(1 - 1e-6))))
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - math.log(rate / (1 - rate))
    return out.withColumn("prior_shift", odds)


def assess(df: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", url: Column | None = None, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """df without its text and with evidence, host, path, host_rate, path_rate, prior_shift
    and the probability of label = 1."""
    made = ["evidence", "host", "path", "host_rate", "path_rate", "prior_shift", "probability"]
    kept = [c for c in df.columns if c not in made]
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(F.col(label)).alias("label"))
    host, path = site(F.col("url") if url is None else url)
    docs = df.select(F.struct(*(c for c in kept if c != text)).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), host.alias("host"), path.alias("path"))
    hashed = docs.where("text is not null").select("id", F.xxhash64("text").alias("h"))
    marks = materialize(hashed.join(known, "id").select("h", "id", F.round("label").alias("label")), "labelled")
    model = _fit(marks, docs.select("id", "text"), SAMPLE)
    discard(marks)
    scored = score(docs, model, "evidence").drop("text")
    scored = materialize(scored.join(known, "id", "left").drop("id"), "scored")
    out = posteriors(scored)
    out = out.withColumn("probability", 1 / (1 + F.exp(-(F.col("evidence") + prior_weight * F.col("prior_shift")))))
    return out.select("row.*", *made)
