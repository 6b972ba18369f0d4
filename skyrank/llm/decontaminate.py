"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside one input partition.  Its words become numbers; words that no
test phrase holds, and runs of known words shorter than the shortest phrase, cannot be part of an
occurrence and fold into the mark that ends a run.  All test phrases are then searched backward in the
shard's index, located by sampled suffix positions, and their word ranges merged to removal spans.
Documents are never shuffled.

The test phrases of a block of benchmark items are broadcast; blocks are cut by their measured bytes,
and documents pass through one block after the other.

Defined results: null or empty texts have no words and no spans; empty items have no phrase; repeated
documents keep their rows, repeated items count by item_id once; a null item_id reads as ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import gathered, raw, repeat_ranges
from .fm_index import FMIndex
from .staging import around

PHRASE = 13
SHARD_BYTES = 12_000_000
BLOCK_BYTES = 8_000_000

#: Lower-cases A-Z and makes every byte a blank that is no word byte (digits, letters, all beyond ASCII).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = "n_words: long, n_hit: long, spans: array<struct<start: long, end: long>>, items: array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """The test phrases of some items: a vocabulary, phrases by length, and whose they are."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[at:at + size]), set()).add(number[name])
        self.by_length = {}
        for size in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == size]
            of = [sorted(owners[p]) for p in some]
            counts = np.array([len(x) for x in of])
            self.by_length[size] = (np.array(some), np.concatenate([np.array(x) for x in of]),
                                    np.cumsum(counts) - counts, counts)

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def known_runs(ids: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of words in runs of at least ``shortest`` known words of one document."""
    known = ids > 0
    edge = np.flatnonzero(np.diff(known, prepend=False) | (np.diff(doc, prepend=-1) != 0))
    sizes = np.diff(edge, append=len(ids))
    good = known[edge] & (sizes >= shortest) if len(edge) else np.zeros(0, bool)
    return repeat_ranges(edge[good], sizes[good])


def search_shard(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word whether it is hit; (document, item) of all occurrences.

    ``ids`` are the numbers of the shard's words and ``doc`` their documents, ascending.
    """
    hit, none = np.zeros(len(ids) + 1, np.int64), np.zeros(0, np.int64)
    at = known_runs(ids, doc, phrases.shortest) if phrases.by_length else none
    if not len(at):
        return hit[:-1] > 0, none, none
    new = (np.diff(at, prepend=-2) != 1) | (np.diff(doc[at], prepend=-1) != 0)
    new[0] = False
    where = np.arange(len(at)) + np.cumsum(new)    # a mark goes before each further run
    text = np.zeros(int(where[-1]) + 2, np.int64)
    text[where] = ids[at]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    word = np.zeros(len(text), np.int64)
    word[where] = at
    pairs = []
    for size, (some, owners, first, counts) in phrases.by_length.items():
        low, high = index.search(some)
        which, places = index.occurrences(low, high)
        start = word[places]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + size, -1)
        seen = np.unique(np.stack([doc[start], which]), axis=1)
        pairs.append(np.stack([np.repeat(seen[0], counts[seen[1]]),
                               owners[repeat_ranges(first[seen[1]], counts[seen[1]])]]))
    found = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return np.cumsum(hit[:-1]) > 0, found[0], found[1]


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def shard_results(text: pa.Array, phrases: Phrases) -> list[pa.Array]:
    """n_words, n_hit, spans and items of the documents of one shard."""
    data, bounds = raw(text)
    data, n = data.tobytes(), len(text)
    sizes, parts = np.zeros(n, np.int64), []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        found = words(data[a:b])
        sizes[i] = len(found)
        parts.append(np.fromiter(map(phrases.vocabulary.get, found, repeat_zero(len(found))), np.int64, len(found)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    hit, of, item = search_shard(ids, doc, phrases)
    begin = np.cumsum(sizes) - sizes
    at = np.flatnonzero(hit)
    fresh = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(doc[at], prepend=-1) != 0))
    start, length = at[fresh], np.diff(fresh, append=len(at))
    span_doc = doc[start]
    spans = pa.StructArray.from_arrays(
        [pa.array(start - begin[span_doc]), pa.array(start - begin[span_doc] + length)], ["start", "end"])
    names = pa.array(phrases.names, pa.string())
    return [pa.array(sizes), pa.array(np.bincount(doc[at], minlength=n)), _lists(span_doc, n, spans),
            _lists(of, n, names.take(pa.array(item)))]


def repeat_zero(n: int) -> Iterator[int]:
    return iter(bytes(n))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of at most ``block_bytes``, but for a single larger item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + size // block_bytes
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        over = items.groupBy(block.alias("block")).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
        if over.where((F.col("b") > block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    for k in range(n):
        rows = items.where(block == k).collect()    # at most block_bytes, or one item
        yield [(r["item"], r["text"].encode()) for r in rows]


def search(docs: DataFrame, benchmark: DataFrame, width: int = PHRASE, shard_bytes: int = SHARD_BYTES,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``contamination``: n_words, n_hit, spans (word ranges) and items.

    Every other column stays as it is; a column of that name is replaced.
    """
    spark, out = docs.sparkSession, docs.drop("contamination")
    keep = out.columns
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                     F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
                     F.array().cast("array<string>").alias("items"))
    for number, items in enumerate(benchmark_blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast(Phrases(items, width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, shard_bytes):
                found = pa.StructArray.from_arrays(
                    shard_results(batch.column("text"), shared.value), ["n_words", "n_hit", "spans", "items"])
                yield batch.append_column(f"part_{number}", found)

        result = StructType.fromDDL(f"part_{number} struct<{RESULT}>")
        out = out.mapInArrow(run, StructType(out.schema.fields + result.fields))
    parts = [c for c in out.columns if c not in keep]
    if not parts:
        return out.withColumn("contamination", empty)
    if len(parts) == 1:
        return out.withColumnRenamed(parts[0], "contamination")
    spans = merged(F.flatten(F.array(*[F.col(f"{p}.spans") for p in parts])))
    out = out.withColumn("spans_", spans)
    return out.withColumn("contamination", F.struct(
        F.col(f"{parts[0]}.n_words").alias("n_words"),
        F.aggregate("spans_", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.col("spans_").alias("spans"),
        F.array_distinct(F.flatten(F.array(*[F.col(f"{p}.items") for p in parts]))).alias("items"))).select(
        *keep, "contamination")


def merged(spans):
    """Overlapping and touching ranges of an array put together."""
    kind = "array<struct<start:long,end:long>>"

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(
            F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def is_contaminated(share: float = 0.05):
    """The rule: at least one word hit, and at least that share of all words."""
    c = F.col("contamination")
    return (c["n_hit"] > 0) & (c["n_hit"] * round(1 / share) >= c["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return around(docs, "contamination", lambda rows: search(rows, benchmark, **how).where(~is_contaminated(share)))
