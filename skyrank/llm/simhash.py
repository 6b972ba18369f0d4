"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint from its word shingles.  Bit ``i`` of a fingerprint carries
a non-zero vector of ``radius + 1`` bits, and table ``v`` keeps the bits whose vector has an odd
product with ``v``.  Up to ``radius`` differing bits span less than the whole vector space, so some
table drops all of them: two fingerprints within the radius always meet in one of the
``2 ** (radius + 1) - 1`` tables, and no pair is missed.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated
rows keep their rows; a null doc_id is kept and never names a component (null if no other id is in it);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import raw
from .components import components
from .staging import shuffled, stage

SEED = 42
#: A bucket with more fingerprints than this is linked by midpoints, in any number of tasks.
BUCKET_LIMIT = 20_000


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """The eight bytes of a text's fingerprint, highest bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    last = ends[width - 1:].tolist() or [len(joined)]
    counts, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, 32768):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + 32768], last[at:at + 32768])])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, row_hash=None) -> DataFrame:
    """(doc_id, row_hash, fp) with the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = raw(batch.column("text"))
            data = data.tobytes()
            found = b"".join(fingerprint(data[a:b], width) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(np.frombuffer(found, ">i8").astype(np.int64))],
                ["doc_id", "row_hash", "fp"])

    row_hash = F.lit(0) if row_hash is None else row_hash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       row_hash.cast("long").alias("row_hash"))
    return rows.mapInArrow(run, "doc_id long, row_hash long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The bits each covering table keeps, as signed longs."""
    top = (1 << (radius + 1)) - 1
    found = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(bits) if ((1 + i % top) & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a bucket the least one it is joined to.

    Every fingerprint is a pivot once and meets only those not joined yet; those it reaches
    become pivots themselves.
    """
    fps = np.sort(fps)
    bits, root = fps.view(np.uint64), np.empty(len(fps), np.int64)
    left = np.arange(len(fps))
    while len(left):
        head, queue, left = left[0], [left[0]], left[1:]
        root[head] = head
        while queue and len(left):
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]) <= radius
            if near.any():
                joined = left[near]
                root[joined] = head
                queue.extend(joined.tolist())
                left = left[~near]
    return np.stack([fps, fps[root]])


def bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """(a, b) links inside each (table_no, part), which hold a bounded number of fingerprints each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [linked(np.asarray(x, np.int64), radius) for x in batch.column("fps").to_pylist()]
            if pairs:
                a, b = np.concatenate(pairs, axis=1)
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return (members.groupBy("table_no", "part").agg(F.collect_list("fp").alias("fps")).select("fps")
            .mapInArrow(run, "a long, b long"))


def midpoint_links(fps: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """(a, b) links among any number of fingerprints, without pairs.

    Two fingerprints within an even radius have a value half-way, and two that have a value half-way
    are within the radius; each is linked with the least one around every value.
    """
    if radius % 2:
        raise ValueError("values half-way need an even radius")
    rows = fps.select("fp", F.col("fp").alias("mid"), F.lit(0).alias("last"))
    for _ in range(radius // 2):    # flip one further bit, or none
        rows = rows.select("fp", "mid", "last", F.explode(F.sequence("last", F.lit(bits))).alias("bit")).where(
            "bit > last or bit = 0").select(
            "fp", F.expr("mid ^ if(bit = 0, 0L, shiftleft(1L, bit - 1))").alias("mid"), F.col("bit").alias("last"))
    least = rows.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("mid", "b")
    return shuffled(rows).join(least, "mid").where("fp > b").select(F.col("fp").alias("a"), "b")


def meetings(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(table_no, part, fp, n) of every fingerprint in every bucket that holds more than one."""
    tables = F.array(*[F.struct(F.lit(i).alias("table_no"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
                       for i, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("t.table_no", "t.part", "fp")
    shared = rows.groupBy("table_no", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shuffled(rows).join(shared, ["table_no", "part"])


def links(fps: DataFrame, radius: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) links that join all fingerprints within the radius; ``fps`` holds each once."""
    members = stage(meetings(fps, radius))
    found = bucket_links(members.where(F.col("n") <= bucket_limit), radius)
    large = members.where(F.col("n") > bucket_limit).select("fp").distinct()
    if not large.isEmpty():
        found = found.unionByName(midpoint_links(stage(large), radius))
    return found


def classes(prints: DataFrame, radius: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint.

    Copies share a fingerprint, so tables and links only ever hold distinct fingerprints.
    """
    firsts = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), radius, bucket_limit))
    named = shuffled(firsts).join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return shuffled(named).join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4,
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = stage(fingerprints(docs, width))
    return shuffled(prints).join(classes(prints, radius, bucket_limit), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of every component, with the columns of ``docs``: that of its least doc_id, null last.

    Rows with the same doc_id are told apart by a hash of the whole row; of equal rows one stays.
    """
    row_hash = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    prints = stage(fingerprints(docs, width, row_hash))
    named = shuffled(prints).join(classes(prints, radius, bucket_limit), "fp")
    rows = named.groupBy("root", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "n")
    kept = stage(rows.groupBy("root").agg(F.min(key).alias("k")).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.row_hash").alias("kept_hash"), F.col("k.n").alias("kept_n")))
    again = kept.where("kept_n > 1")

    def rows_of(some: DataFrame) -> DataFrame:
        return shuffled(docs).join(some, docs["doc_id"].cast("long").eqNullSafe(some["kept_id"]) & (row_hash == some["kept_hash"]), "left_semi")

    once = rows_of(kept.where("kept_n = 1"))
    return once if again.isEmpty() else once.unionByName(rows_of(again).dropDuplicates())
