"""Token ids as files of length-delimited records, with a separate offset index.

A record is framed as: length (8 bytes), masked CRC-32C of those 8 bytes, the data, masked CRC-32C of the data;
all numbers are little-endian.  The data of a record are the ids of one document, 2 bytes each where the vocabulary
allows it and 4 otherwise; the manifest tells which.  Beside every
record file lies an index of fixed-width entries (doc_id, whether it is null, offset, ids), so single
records can be read in any order.

``token_records`` is a Spark data source.  Each task encodes its texts and writes files of about ``FILE_BYTES`` under
names nobody else uses, so texts reach one Python worker a task and ids none; the commit writes a manifest that lists them in order.  Readers go by the manifest, so files of
failed or repeated attempts are never seen.  The folder must be one that ``pyarrow.fs`` reaches
(a path, or file:, hdfs:, s3:, gs:).

Defined results: a null text is empty and has the end id alone; null doc_ids come first; rows of one doc_id are ordered by
a hash of their text; repeated rows keep a record each; an empty table gives a manifest without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import crc, tokens
from .arrow import gathered, raw, slices

FILE_BYTES = 128_000_000
READ_BYTES = 8_000_000
TEXT_BYTES = 4_000_000
END_ID = 0
MANIFEST = "manifest.json"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])
HEAD, TAIL = 12, 4    # bytes of a frame before and behind the data
RECORDS = "doc_id long, start long, n_tokens long, ids binary"
ENTRIES = "doc_id long, start long, n_tokens long, file string, offset long, width int"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def framed(data: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Frames in pieces to be written one after the other, and the size of each frame."""
    sizes = np.array([len(x) for x in data], "<u8")
    lengths = np.frombuffer(sizes.tobytes(), np.uint8)
    of_length = crc.masked(crc.crc32c(lengths, np.arange(len(data)) * 8, np.full(len(data), 8)))
    body = np.frombuffer(b"".join(data), np.uint8)
    of_data = crc.masked(crc.crc32c(body, np.cumsum(sizes.astype(np.int64)) - sizes.astype(np.int64), sizes.astype(np.int64)))
    pieces = []
    for x, n, a, b in zip(data, sizes, of_length.astype("<u4"), of_data.astype("<u4")):
        pieces += [n.tobytes() + a.tobytes(), x, b.tobytes()]
    return pieces, sizes.astype(np.int64) + HEAD + TAIL


class CorruptRecord(ValueError):
    """A record whose checksum or length does not fit."""


def unframed(block: bytes, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The data of the frames at these offsets of ``block``, checked; ``sizes`` are those the index tells."""
    view = np.frombuffer(block, np.uint8)
    number = lambda at, kind: np.array([np.frombuffer(block, kind, 1, a)[0] for a in at.tolist()], np.int64)
    if (number(offsets, "<u8") != sizes).any():
        raise CorruptRecord("a record is not as long as the index says")
    stored = number(offsets + 8, "<u4"), number(offsets + HEAD + sizes, "<u4")
    found = (crc.masked(crc.crc32c(view, offsets, np.full(len(offsets), 8))),
             crc.masked(crc.crc32c(view, offsets + HEAD, sizes)))
    if any((s != f.astype(np.int64)).any() for s, f in zip(stored, found)):
        raise CorruptRecord("a record's checksum does not fit")
    return [block[a:a + n] for a, n in zip((offsets + HEAD).tolist(), sizes.tolist())]


def widened(data: list[bytes], width: int) -> pa.Array:
    """The ids of records as 4 bytes each."""
    return pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in data], pa.binary())


@dataclass
class _Written(WriterCommitMessage):
    """The files of one task in order: [partition, number, name, records, ids, bytes], and the bytes of an id."""

    files: list[list]
    width: int


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of (doc_id, text): the ids of each whole text and the end id, ``width`` bytes each."""
    memo = tokens.byte_bpe(tokenizer)
    for part in gathered(batches, TEXT_BYTES):
        ids, sizes = memo.encode(*raw(part.column("text")))
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        last = np.zeros(int(bounds[-1]), bool)
        last[bounds[1:] - 1] = True
        ended = np.full(len(last), end_id, f"<u{width}")
        ended[~last] = ids
        records = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds * width), pa.py_buffer(ended)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), records.cast(pa.binary())], names=["doc_id", "ids"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.limit, self.width = options["path"], int(options["file_bytes"]), int(options["width"])
        self.tokenizer, self.end_id = options["tokenizer"], int(options["end_id"])
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = opened(self.root)
        context = TaskContext.get()
        task = f"{self.run}-{context.partitionId():06d}-{context.taskAttemptId()}"
        files, out, entries, at = [], None, [], 0

        def close() -> None:
            out.close()
            index = np.concatenate(entries)
            name = files[-1][2]
            with where.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(index.tobytes())
            files[-1][3:] = [len(index), int(index["n_tokens"].sum()), at]

        where.create_dir(root, recursive=True)
        for whole in encoded(iterator, self.tokenizer, self.end_id, self.width):
            for batch in slices([whole], min(READ_BYTES, self.limit), "ids"):
                data = batch.column("ids").to_pylist()
                pieces, sizes = framed(data)
                if out is None:
                    files.append([context.partitionId(), len(files), f"{task}-{len(files):04d}"])
                    out, entries, at = where.open_output_stream(f"{root}/{files[-1][2]}.rec"), [], 0
                index = np.zeros(len(data), INDEX)
                ids = batch.column("doc_id")
                index["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
                index["is_null"] = ids.is_null().to_numpy(zero_copy_only=False)
                index["offset"] = at + np.cumsum(sizes) - sizes
                index["n_tokens"] = (sizes - HEAD - TAIL) // self.width
                entries.append(index)
                out.write(b"".join(pieces))
                at += int(sizes.sum())
                if at >= self.limit:
                    close()
                    out = None
        if out is not None:
            close()
        return _Written(files, self.width)

    def commit(self, messages: list) -> None:
        """One small entry per file; they become visible together."""
        where, root = opened(self.root)
        files, start = [], 0
        for _, _, name, records, ids, size in sorted(f for m in messages if m for f in m.files):
            files.append({"name": name, "records": records, "start": start, "ids": ids, "bytes": size})
            start += ids
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{MANIFEST}.{self.run}") as f:
            f.write(json.dumps({"files": files, "ids": start, "width": self.width}).encode())
        where.move(f"{root}/{MANIFEST}.{self.run}", f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        where, root = opened(self.root)
        for m in messages:
            for f in m.files if m else []:
                for kind in ("rec", "idx"):
                    where.delete_file(f"{root}/{f[2]}.{kind}")


@dataclass
class _File(InputPartition):
    name: str
    start: int
    width: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.entries = options["path"], options.get("part", "records") == "index"

    def partitions(self) -> list[_File]:
        where, root = opened(self.root)
        with where.open_input_stream(f"{root}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        return [_File(x["name"], x["start"], manifest["width"]) for x in manifest["files"]]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where, root = opened(self.root)
        with where.open_input_stream(f"{root}/{partition.name}.idx") as f:
            index = np.frombuffer(f.read(), INDEX)
        n = index["n_tokens"].astype(np.int64)
        start = partition.start + np.cumsum(n) - n
        doc = lambda a, b: pa.array(index["doc_id"][a:b], mask=index["is_null"][a:b] > 0)
        if self.entries:
            yield pa.RecordBatch.from_arrays(
                [doc(0, len(n)), pa.array(start), pa.array(n), pa.array([partition.name] * len(n), pa.string()),
                 pa.array(index["offset"].astype(np.int64)), pa.array([partition.width] * len(n), pa.int32())],
                names=["doc_id", "start", "n_tokens", "file", "offset", "width"])
            return
        sizes = partition.width * n
        ends = index["offset"] + sizes + HEAD + TAIL
        with where.open_input_stream(f"{root}/{partition.name}.rec") as f:
            a = 0
            while a < len(n):
                base = int(index["offset"][a])
                b = max(a + 1, int(np.searchsorted(ends, base + READ_BYTES, "right")))
                data = unframed(f.read(int(ends[b - 1]) - base), index["offset"][a:b].astype(np.int64) - base, sizes[a:b])
                yield pa.RecordBatch.from_arrays([doc(a, b), pa.array(start[a:b]), pa.array(n[a:b]), widened(data, partition.width)],
                                                 names=["doc_id", "start", "n_tokens", "ids"])
                a = b


class TokenRecords(DataSource):
    """``spark.read.format("token_records").load(path)``; option ``part`` = ``index`` reads the index alone."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return ENTRIES if self.options.get("part") == "index" else RECORDS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in ascending doc_id order over all partitions; rows of one doc_id may lie in several."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    key = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Encode (doc_id, text) and write the record files."""
    docs.sparkSession.dataSource.register(TokenRecords)
    width = 2 if max(tokens.largest_id(tokenizer), end_id) < 1 << 16 else 4
    in_order(docs).select("doc_id", "text").write.format("token_records").mode("append").options(
        tokenizer=tokenizer, end_id=str(end_id), file_bytes=str(file_bytes), width=str(width)).save(path)


def read(spark: SparkSession, path: str, part: str = "records") -> DataFrame:
    """Records in the order of the files, or with ``part`` = ``index`` where each lies."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").option("part", part).load(path)


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Records in an order that the seed decides: the small index is shuffled, data are fetched by offset."""
    order = F.xxhash64(F.lit(seed), "file", "offset")
    index = read(spark, path, "index").repartitionByRange(order).sortWithinPartitions(order)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = opened(path)
        for batch in batches:
            names, at, n, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "offset", "n_tokens", "width"))
            begin = 0
            while begin < len(n):    # as many records as fit in memory; each file is read front to back
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(4 * n[begin:]), READ_BYTES, "right")))
                data: list[bytes] = [b""] * (end - begin)
                some = np.arange(begin, end)
                for name in sorted(set(names[begin:end])):
                    with where.open_input_file(f"{root}/{name}.rec") as f:
                        for i in sorted(some[names[begin:end] == name].tolist(), key=lambda i: at[i]):
                            f.seek(int(at[i]))
                            size = width[i:i + 1].astype(np.int64) * n[i]
                            data[i - begin] = unframed(f.read(int(size[0]) + HEAD + TAIL), np.zeros(1, np.int64), size)[0]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "start", "n_tokens")] + [widened(data, int(width[0]))],
                                                 names=["doc_id", "start", "n_tokens", "ids"])
                begin = end

    return index.mapInArrow(fetch, RECORDS)
