"""Document quality by hierarchical empirical Bayes.

A naive Bayes classifier over hashed words gives every document evidence for and against quality.  Labelled
documents give hosts, and paths inside hosts, a rate of good documents: a path's rate is shrunk toward its
host's, a host's toward that of the whole corpus, the more the fewer labels there are; how much is estimated
from how the rates of hosts, and of paths inside hosts, spread.  The posterior combines the path's rate with
the document's evidence.  Rates are aggregates over all labels; the classifier is fitted on a bounded sample.

Defined results: a null or empty text has no evidence and gets its path's rate; words that no labelled
document has say nothing; unlabelled or null-labelled
rows teach nothing; a null host or path is a site of its own; repeated label rows count as often as they
occur; a document that has several labels counts once for each; with no labels at all every posterior is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import raw, slices
from .staging import stage

#: Hashed words: the classifier has this many weights whatever the corpus.
FEATURES = 1 << 16
BATCH_BYTES = 4_000_000
#: Evidence is the mean log ratio of a document's words times at most this many words: words of one
#: document are far from independent, and more would leave a site's rate no say.
EVIDENCE_WORDS = 4
#: The classifier learns from at most this many labels, those of least hash; site rates use all of them.
SAMPLE_LABELS = 50_000
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
KEEP_FROM = 0.2


def features(text: bytes) -> np.ndarray:
    """The hashed words of a text."""
    found = text.lower().split()
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (FEATURES - 1)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(feature, good, bad): how often labelled documents (text, quality) have each hashed word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        for batch in slices(batches, BATCH_BYTES):
            data, bounds = raw(batch.column("text"))
            data, quality = data.tobytes(), batch.column("quality").to_pylist()
            for a, b, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), quality):
                counts[q] += np.bincount(features(data[a:b]), minlength=FEATURES) if b - a > 4 * FEATURES else 0
                if b - a <= 4 * FEATURES:
                    np.add.at(counts[q], features(data[a:b]), 1)
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])],
                                         ["feature", "good", "bad"])

    return labelled.select("text", "quality").mapInArrow(run, "feature long, good long, bad long").groupBy(
        "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def weights(counts: DataFrame) -> np.ndarray:
    """The log ratio of every feature, smoothed by one; zeros with no labels of one kind."""
    out = np.zeros(FEATURES, np.float64)
    rows = counts.toPandas()    # at most FEATURES rows
    if len(rows) and rows["good"].sum() and rows["bad"].sum():
        good, bad = (rows[c].to_numpy(float) for c in ("good", "bad"))
        out[rows["feature"]] = np.log((good + 1) / (good.sum() + FEATURES)) - np.log((bad + 1) / (bad.sum() + FEATURES))
    return out


def evidence(docs: DataFrame, log_ratios: np.ndarray) -> DataFrame:
    """``docs`` with ``evidence``, the log odds its words speak for."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in slices(batches, BATCH_BYTES):
            data, bounds = raw(batch.column("text"))
            data, found = data.tobytes(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                words = features(data[a:b])
                found.append(float(ratio[words].mean()) * min(len(words), EVIDENCE_WORDS) if len(words) else 0.0)
            yield batch.drop_columns(["text"]).append_column("evidence", pa.array(found, pa.float64()))

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, StructType(fields + StructType.fromDDL("evidence double").fields))


def strength(groups: DataFrame, rate: Column, mean: Column) -> float:
    """How many labels a group needs to be worth as much as what is above it, by moments.

    ``groups`` has good and n per group; the spread of rates beyond that of chance says how alike groups are.
    """
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("between"), F.sum("n").alias("n"),
        F.sum(F.pow("n", 2)).alias("nn"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")).alias("chance")).first()
    if not row["n"] or row["k"] < 2 or not row["chance"]:
        return MAX_STRENGTH
    spare = row["n"] - row["nn"] / row["n"]
    spread = (row["between"] - (row["k"] - 1) * row["chance"]) / spare if spare > 0 else 0.0
    if spread <= 0:
        return MAX_STRENGTH
    return float(min(MAX_STRENGTH, max(MIN_STRENGTH, row["chance"] / spread - 1)))


def site_rates(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(host, host_rate), (host, path, path_rate) and the rate of all labels of (host, path, quality)."""
    paths = stage(labelled.groupBy("host", "path").agg(F.sum("quality").alias("good"), F.count("quality").alias("n")))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = (whole["good"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5
    hosts = stage(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    top = strength(hosts, F.col("good") / F.col("n"), F.lit(rate))
    host_rates = stage(hosts.select("host", ((F.col("good") + top * rate) / (F.col("n") + top)).alias("host_rate")))
    joined = paths.join(host_rates.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site"))).drop("site")
    below = strength(joined, F.col("good") / F.col("n"), F.col("host_rate"))
    path_rates = stage(joined.select("host", "path", (
        (F.col("good") + below * F.col("host_rate")) / (F.col("n") + below)).alias("path_rate")))
    return host_rates, path_rates, rate


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep_from: float = KEEP_FROM,
             sample: int = SAMPLE_LABELS) -> DataFrame:
    """(doc_id, host, path, evidence, prior, posterior, keep) of every row of ``docs`` (doc_id, text, ...)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                     F.col("quality").cast("int").alias("quality"))
    # texts stay where they are: the sample has a fixed size and is broadcast
    learned = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    log_ratios = weights(word_counts(rows.join(F.broadcast(learned), "doc_id")))
    host_rates, path_rates, rate = site_rates(rows.select("doc_id", "host", "path").join(known, "doc_id"))
    scored = evidence(rows, log_ratios)
    scored = scored.join(host_rates.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    scored = scored.join(path_rates.toDF("h", "p", "path_rate"),
                         F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    prior = F.coalesce("path_rate", "host_rate", F.lit(rate))
    odds = F.log(prior / (1 - prior)) + F.col("evidence")
    return scored.select("doc_id", "host", "path", "evidence", prior.alias("prior"),
                         (1 / (1 + F.exp(-odds))).alias("posterior")).withColumn("keep", F.col("posterior") >= keep_from)
