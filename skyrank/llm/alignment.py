"""Cross-tokenizer alignment: groups of tokens that end together, and how often every pair of ids is linked.

1. Documents are encoded by both tokenizers in chunks of a few megabytes.  Byte offsets where both end a token cut
   groups; each stretch between two token ends is one link.  The chunk's pair-document records are radix-partitioned by
   the B id and written as runs, sorted by pair (B id first) and compressed with zstd: a block lists pairs with their totals
   and numbers of records, and apart from it the records, (document, links) in the same order.
2. Counting reads only the lists of pairs.  A task merges the blocks of one partition with a heap, at most ``FAN_IN``
   runs at a time, in as many rounds as that takes; the last round sees all pairs of a B id together and in
   order, so the highest count of the id is known as it streams.
3. The counts of a partition meet its runs again, in slices of ``SLICE`` chunks, and each run yields one
   compressed list of (document, best links, sum of counts); lists are added up by chunk.

A pair that stands in a third of all documents has one record per document, and those are spread over slices like any other;
what is counted of it is one total per chunk.  All steps are written tables: a lost executor re-reads files.

Defined results: a text that is null, empty, or not spelled exactly by the tokens of one side has no
tokens, and zeros; the strings of special tokens inside texts are plain text; repeated rows count each; a null doc_id
stays null; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .arrow import gathered, raw, repeat_ranges
from .staging import stage

CHUNK_BYTES = 4_000_000
#: Radix of the partitions of pairs.
PARTS = 64
#: Pairs in a block of a run.
BLOCK = 16_384
FAN_IN = 256
SLICE = 512
A_BITS = 16    # a pair is B id * 2**16 + A id
_A_LIMIT = 1 << A_BITS

ENCODED = ("chunk string, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "part int, first long, pairs binary, members binary")
MERGED = "part int, round long, first long, pairs binary"
TOTALS = "part int, first long, pairs binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed one behind the other."""
    n = len(columns[0])
    body = b"".join(np.ascontiguousarray(c, "<i8").tobytes() if c.dtype.itemsize == 8 else np.ascontiguousarray(c, "<u4").tobytes() for c in columns)
    kinds = bytes(1 if c.dtype.itemsize == 8 else 0 for c in columns)
    return bytes([len(columns)]) + kinds + n.to_bytes(8, "little") + zstandard.compress(body, 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    k = blob[0]
    n = int.from_bytes(blob[1 + k:9 + k], "little")
    body, at, out = zstandard.decompress(blob[9 + k:]), 0, []
    for kind in blob[1:1 + k]:
        width = 8 if kind else 4
        out.append(np.frombuffer(body, "<i8" if kind else "<u4", n, at).astype(np.int64))
        at += n * width
    return out


@lru_cache(2)
def _spellings(path_a: str, path_b: str) -> tuple:
    return tokens.byte_level_spellings(path_a), tokens.piece_spellings(path_b)


@lru_cache(1)
def _numerals(limit: int) -> pa.Array:
    """Every id in decimal, in front of each separator."""
    return pa.array([b"%d%s" % (i, mark) for mark in (b",", b"|", b";", b"") for i in range(limit)], pa.large_binary())


def _text(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all entries of a binary array, and the n + 1 offsets into them."""
    _, offsets, data = array.buffers()
    return data.to_pybytes() if data is not None else b"", np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]


def part_of(b: np.ndarray) -> np.ndarray:
    """The partition of a B id: some bits of a product hash, so that neighbouring ids part."""
    return ((b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PARTS


def _spelled(ids: np.ndarray, sizes: np.ndarray, entries: pa.Array, data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Which documents are spelled exactly by their tokens."""
    written, offsets = _text(entries.take(pa.array(ids)))
    at = offsets[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return np.array([written[a:b] == data[c:d] for a, b, c, d in zip(at[:-1], at[1:], bounds[:-1].tolist(), bounds[1:].tolist())], bool)


def aligned_chunk(text: pa.Array, path_a: str, path_b: str) -> dict:
    """Groups and links of some documents: columns per document and the pair-document records."""
    (entry_a, long_a), (entry_b, long_b) = _spellings(path_a, path_b)
    n = len(text)
    text = pc.fill_null(text.cast(pa.large_string()), "")
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, bounds = raw(pc.if_else(pc.equal(text, none), none, pc.binary_join_element_wise(space, text, none)))
    given, good = data.tobytes(), np.diff(bounds) > 0
    found = [memo.encode(data, bounds) for memo in (tokens.byte_bpe(path_a, True), tokens.pieces(path_b))]
    for (ids, sizes), entries in zip(found, (entry_a, entry_b)):
        good &= _spelled(ids, sizes, entries, given, bounds)
    (a, n_a), (b, n_b) = [(ids[np.repeat(good, sizes)], np.where(good, sizes, 0)) for ids, sizes in found]
    end_a, end_b = np.cumsum(long_a[a]), np.cumsum(long_b[b])    # in the bytes of all good documents together
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    ends = np.concatenate([end_a, end_b])
    ends.sort(kind="stable")
    twice = np.diff(ends, append=-1) == 0
    both, ends = ends[twice], ends[~twice]
    at_a = np.searchsorted(end_a, ends)    # the token over each link
    link_a, link_b, link_doc = a[at_a], b[np.searchsorted(end_b, ends)], doc_a[at_a]
    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)    # the group of every token
    # a1,a2|b1,b2; - every id with the mark behind it, at its place
    limit = max(len(entry_a), len(entry_b))
    mark_a = np.where(np.diff(group_a, append=-1) != 0, 1, 0)
    mark_b = np.where(np.diff(doc_b, append=-1) != 0, 3, np.where(np.diff(group_b, append=-1) != 0, 2, 0))
    code = np.zeros(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + mark_a * limit
    code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + mark_b * limit
    written, offsets = _text(_numerals(limit).take(pa.array(code)))
    at = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    record = (link_b * _A_LIMIT + link_a) * n + link_doc    # pair-document records
    record.sort()
    first = np.flatnonzero(np.diff(record, prepend=-1) != 0)
    links = np.diff(first, append=len(record))
    record = record[first]
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[mark_a == 1], minlength=n), "n_links": np.bincount(link_doc, minlength=n),
            "groups": [written[x:y] for x, y in zip(at[:-1], at[1:])], "pair": record // n, "doc": record % n, "links": links}


def runs_of(done: dict, block: int = BLOCK) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(partition, first pair, pairs, members): the chunk's records in sorted compressed blocks."""
    pair, doc, links = done["pair"], done["doc"], done["links"]
    first = np.flatnonzero(np.diff(pair, prepend=-1) != 0)
    sizes = np.diff(first, append=len(pair))
    totals = np.add.reduceat(links, first) if len(first) else first
    part = part_of(pair[first] >> A_BITS)
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        for i in range(0, len(mine), block):
            which = mine[i:i + block]
            rows = repeat_ranges(first[which], sizes[which])
            yield (p, int(pair[first[which[0]]]), pack(pair[first[which]], totals[which].astype(np.uint32), sizes[which].astype(np.uint32)),
                   pack(doc[rows].astype(np.uint32), links[rows].astype(np.uint32)))


def _encode(path_a: str, path_b: str, digest: bool, chunk_bytes: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(gathered(batches, chunk_bytes)):
            chunk, n = f"{task}-{number}", batch.num_rows
            done = aligned_chunk(batch.column("text"), path_a, path_b)
            text = [hashlib.sha256(g).hexdigest() if g else "" for g in done["groups"]] if digest else [g.decode() for g in done["groups"]]
            none = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n, pa.string()), pa.array(np.arange(n), pa.int32()), batch.column("doc_id"),
                 *[pa.array(done[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(text, pa.string()),
                 none(pa.int32(), n), none(pa.int64(), n), none(pa.binary(), n), none(pa.binary(), n)], schema=schema)
            for p, first, pairs, members in runs_of(done, block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), none(pa.int32(), 1), *[none(pa.int64(), 1)] * 5, none(pa.string(), 1), pa.array([p], pa.int32()),
                     pa.array([first], pa.int64()), pa.array([pairs], pa.binary()), pa.array([members], pa.binary())], schema=schema)
    return run


def _arrow_schema() -> pa.Schema:
    kind = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kind[of]) for name, of in (x.split() for x in ENCODED.split(", "))])


class Merge:
    """A merge of sorted blocks that arrive by their first pair.

    A heap holds the open blocks by the pair each stands at.  Whatever lies before the newest first pair can no longer be met by a block
    still to come, so it is counted and leaves.
    """

    def __init__(self, flush: int = 1_000_000):
        self.heap: list = []
        self.held, self.next, self.number, self.flush = 0, flush, 0, flush

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take a block; give the pairs that are certain, with their counts, once many wait."""
        if self.held >= self.next:
            yield self.before(int(pairs[0]))
            self.next = self.held + self.flush
        heappush(self.heap, (int(pairs[0]), self.number, pairs, counts))
        self.number += 1
        self.held += len(pairs)

    def before(self, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All pairs below ``bound`` (None: all), in order, counted over the blocks."""
        pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, number, p, c = heappop(self.heap)
            cut = len(p) if bound is None else int(np.searchsorted(p, bound))
            pairs.append(p[:cut])
            counts.append(c[:cut])
            self.held -= cut
            if cut < len(p):
                heappush(self.heap, (int(p[cut]), number, p[cut:], c[cut:]))
        pairs, counts = np.concatenate(pairs), np.concatenate(counts)
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1) != 0)
        return pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def _merged_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """The merged (pairs, counts) of consecutive rows of one key."""
    rows = (r for b in batches for r in zip(*[b.column(k).to_pylist() for k in keys], b.column("pairs")))
    row = next(rows, None)
    while row is not None:
        key = row[:-1]

        def stream() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal row
            merge = Merge()
            while row is not None and row[:-1] == key:
                pairs, counts = unpack(row[-1].as_py())[:2]
                yield from merge.add(pairs, counts)
                row = next(rows, None)
            yield merge.before(None)

        yield key, stream()


def _merge_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (part, round_), merged in _merged_groups(batches, ["part", "round"]):
        for pairs, counts in merged:
            for i in range(0, len(pairs), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([round_], pa.int64()), pa.array([int(pairs[i])], pa.int64()),
                     pa.array([pack(pairs[i:i + BLOCK], counts[i:i + BLOCK])], pa.binary())], names=["part", "round", "first", "pairs"])


def best_of(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their B id; all pairs of each id are given, in order."""
    b = pairs >> A_BITS
    first = np.flatnonzero(np.diff(b, prepend=-1) != 0)
    top = np.maximum.reduceat(counts, first) if len(first) else counts
    return counts == np.repeat(top, np.diff(first, append=len(b)))


def _final_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all pairs with a mark at the best of each B id; an id's pairs wait until the next id begins."""
    for (part,), merged in _merged_groups(batches, ["part"]):
        def rows(pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            best = best_of(pairs, counts).astype(np.uint32)
            for i in range(0, len(pairs), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([int(pairs[i])], pa.int64()),
                     pa.array([pack(pairs[i:i + BLOCK], counts[i:i + BLOCK], best[i:i + BLOCK])], pa.binary())],
                    names=["part", "first", "pairs"])

        pairs = counts = np.zeros(0, np.int64)
        for more, n in merged:
            pairs, counts = np.concatenate([pairs, more]), np.concatenate([counts, n])
            cut = int(np.searchsorted(pairs, pairs[-1] >> A_BITS << A_BITS)) if len(pairs) else 0
            yield from rows(pairs[:cut], counts[:cut])
            pairs, counts = pairs[cut:], counts[cut:]
        yield from rows(pairs, counts)


def counted(runs: DataFrame, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Corpus-wide counts of all pairs, from the runs of that many chunks."""
    rows = runs.select("part", F.xxhash64("chunk").alias("run"), "first", "pairs")
    while chunks > fan_in:
        chunks = -(-chunks // fan_in)
        rows = stage(rows.withColumn("round", F.pmod("run", F.lit(chunks))).drop("run").repartition("part", "round")
                     .sortWithinPartitions("part", "round", "first").mapInArrow(_merge_round, MERGED)).withColumnRenamed("round", "run")
    return stage(rows.select("part", "first", "pairs").repartition("part").sortWithinPartitions("part", "first")
                 .mapInArrow(_final_round, TOTALS))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are the counts of a partition, then its runs in one slice, chunk by chunk."""
    names, key, chunk, best, total = ["part", "slice", "kind", "chunk"], None, None, None, None
    pairs = counts = top = np.zeros(0, np.int64)

    def result() -> Iterator[pa.RecordBatch]:
        if chunk is not None:
            doc = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([pack(doc, best[doc], total[doc])], pa.binary())],
                                             names=["chunk", "sums"])

    for batch in batches:
        for *new, kind, of, block, members in zip(*[batch.column(c).to_pylist() for c in names], batch.column("pairs"), batch.column("members")):
            if new != key or of != chunk:
                yield from result()
                chunk, best, total = (of, np.zeros(0, np.int64), np.zeros(0, np.int64)) if kind else (None, None, None)
            if new != key:
                key, pairs, counts, top = new, *[np.zeros(0, np.int64)] * 3
            if kind == 0:
                p, c, t = unpack(block.as_py())
                pairs, counts, top = np.concatenate([pairs, p]), np.concatenate([counts, c]), np.concatenate([top, t])
                continue
            p, _, sizes = unpack(block.as_py())
            doc, links = unpack(members.as_py())
            at = np.searchsorted(pairs, p)
            size = max(len(total), int(doc.max()) + 1)
            best, total = (np.concatenate([x, np.zeros(size - len(x), np.int64)]) for x in (best, total))
            np.add.at(total, doc, links * np.repeat(counts[at], sizes))
            np.add.at(best, doc, links * np.repeat(top[at], sizes))
    yield from result()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk are its lists of sums, then its documents."""
    chunk, best, total = None, None, None
    given = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    for batch in batches:
        of, sums, row = batch.column("chunk").to_pylist(), batch.column("sums"), batch.column("row").to_pylist()
        out_best, out_total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i, (c, r) in enumerate(zip(of, row)):
            if c != chunk:
                chunk, best, total = c, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if r is None:
                doc, b, t = unpack(sums[i].as_py())
                size = max(len(total), int(doc.max()) + 1) if len(doc) else len(total)
                best, total = (np.concatenate([x, np.zeros(size - len(x), np.int64)]) for x in (best, total))
                best[doc] += b
                total[doc] += t
            elif r < len(total):
                out_best[i], out_total[i] = best[r], total[r]
        docs = pa.array([r is not None for r in row])
        found = pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], pa.array(out_best), pa.array(out_total)],
                                           names=[*given, "n_best", "count_sum"])
        yield found.filter(docs)


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, fan_in: int = FAN_IN, slice_chunks: int = SLICE,
          chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> DataFrame:
    """Per row of (doc_id, text): numbers of tokens, groups and links, the groups, and what the links' counts come to.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, ids in decimal, or its SHA-256 where ``digest`` is set.
    """
    encoded = stage(docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b, digest, chunk_bytes, block), ENCODED))
    runs, rows = encoded.where("part is not null"), encoded.where("part is null")
    chunks = rows.select("chunk").distinct().count()
    totals = counted(runs.select("part", "chunk", "first", "pairs"), chunks, fan_in)
    slices = max(1, -(-chunks // slice_chunks))
    empty = F.lit(None).cast("binary")
    met = totals.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("kind"),
                        F.lit("").alias("chunk"), "first", "pairs", empty.alias("members")).unionByName(
        runs.select("part", F.pmod(F.xxhash64("chunk"), F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "chunk", "first", "pairs", "members"))
    order = ["part", "slice", "kind", "chunk", "first"]
    sums = stage(met.repartition("part", "slice").sortWithinPartitions(*order).mapInArrow(_contributions, "chunk string, sums binary"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    both = rows.select("chunk", "row", *columns, empty.alias("sums")).unionByName(sums, allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", F.col("row").asc_nulls_first()).mapInArrow(
        _documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
