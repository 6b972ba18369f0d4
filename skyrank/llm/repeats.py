"""Windows that occur again anywhere in a corpus: how they are brought together, whatever finds them.

A window is a fixed number of consecutive units (words or bytes) of one document.  Comparing every
document with the index of every other shard would grow with the square of the corpus, so text is dealt to
shards by content: every window has a minimizer, the least hash of the grams inside it, and equal windows
have equal ones.  Runs of windows with one minimizer are segments.

1. ``candidates``: minimizers that stand in two places; only documents that hold one are kept with text.  Each
   minimizer is dealt to a stretch: ``STRETCH`` neighbouring segments of one of the documents that hold it,
   the one with the least hash.  So minimizers of one passage mostly share a stretch.
2. ``segments``: neighbouring segments of a document that go to one stretch become one body, which holds their
   common text once.  Every window still lies with all its equals, as a stretch has whole minimizers.
3. ``distinct_segments``: equal segments become one row with the earliest place, so a group of copies is
   as large as one copy.
4. An operator builds an index per shard of whole groups and says which windows of a segment occur earlier.  A
   group that does not fit a shard (the surroundings of a very common passage) is dealt out again by
   minimizers of longer grams, in ``finer``, and its parts go to the same kind of shards.
   The last grams are whole windows: then a group is one window, and equal ones are one row.
5. ``removals``: at the earliest place of a segment only those windows go, elsewhere all of it goes.

A place is (doc_id, hash of the text, start).  Rows that share a doc_id are ordered by the hash, rows equal in both
are one document; a null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import gathered, raw, repeat_ranges
from .staging import discard, new_folder, stage, texts

CHUNK_BYTES = 1_000_000
CHUNK_ROWS = 50_000
STRETCH = 16
LONGEST_RUN = 4 * STRETCH
LAST = (1 << 63) - 1
MIX, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * STEP
    return x ^ (x >> np.uint64(31))


class Words:
    """Units are words; a body is words joined by one blank."""

    window, grams_of = 20, (6, 13, 20)

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash per unit, its first byte and the byte after it; ``bounds`` are those of the texts."""
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(blank.view(np.int8))
        begin = edge == -1
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        split = inner[~blank[inner] & ~blank[inner + 1]]    # a word never runs into the next text
        begin[split] = True
        end = edge == 1
        end[split] = True
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        powers, inverse = powers_of(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        return mixed((sums[last] - sums[first]) * inverse[first]), first, last

    def grams(self, hashes: np.ndarray, gram: int) -> np.ndarray:
        n = len(hashes) - gram + 1
        total = np.zeros(max(n, 0), np.uint64)
        for k in range(gram if n > 0 else 0):
            total = total * STEP + hashes[k:k + n]
        return mixed(total)

    def body(self, text: bytes) -> bytes:
        return b" ".join(text.split())

    def parts(self, body: bytes) -> list[bytes]:
        return body.split(b" ")

    def joined(self, parts: list[bytes]) -> bytes:
        return b" ".join(parts)


class Bytes:
    """Units are bytes."""

    window, grams_of = 50, (24, 37, 50)

    def units(self, data, bounds):
        at = np.arange(len(data))
        return data, at, at + 1

    def grams(self, data: np.ndarray, gram: int) -> np.ndarray:
        x = data.astype(np.uint64)
        for k in (1, 2, 4):
            x = x[:-k] | (x[k:] << np.uint64(8 * k)) if len(x) > k else x[:0]
        n = max(0, len(data) - gram + 1)
        total = np.zeros(n, np.uint64)
        for k in sorted({*range(0, gram - 7, 8), gram - 8}):    # the last eight bytes may overlap those before
            total = mixed(total * STEP + x[k:k + n])
        return total

    def body(self, text: bytes) -> bytes:
        return text

    def parts(self, body: bytes) -> bytes:
        return body

    def joined(self, parts: bytes) -> bytes:
        return parts


_POWERS: list[np.ndarray] = []


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


class Segments:
    """The segments of a chunk of texts: minimizer key, text number, first unit in the text, windows."""

    def __init__(self, units, data: np.ndarray, bounds: np.ndarray, level: int = 0):
        gram = units.grams_of[level]
        hashes, self.first, self.last = units.units(data, bounds)
        self.begin = np.searchsorted(self.first, bounds)    # the first unit of every text, and the end
        n, width = len(hashes), units.window
        self.key = self.doc = self.start = self.windows = np.zeros(0, np.int64)
        if n < width:
            return
        value = (units.grams(hashes, gram) & np.uint64(0xFFFFFFFFFFFF0000)) | (np.arange(
            n - gram + 1, dtype=np.uint64) & np.uint64(0xFFFF))
        span, done = width - gram + 1, 1
        least = value
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        at = np.arange(len(least))
        place = at + ((least.astype(np.int64) - at) & 0xFFFF)
        doc = np.searchsorted(self.begin, at, "right") - 1
        fits = at + width <= self.begin[doc + 1]
        new = np.diff(place, prepend=-1) != 0
        new |= np.diff(doc, prepend=-1) != 0
        # where the 16 bits of a place run over, a tie may go to a later gram: no two such windows share a segment
        over = at >> 16 != (at + span - 1) >> 16
        new |= over
        new[1:] |= over[:-1]
        new |= np.diff(fits, prepend=False)
        edge = np.flatnonzero(new)
        size = np.diff(edge, append=len(least))
        good = fits[edge]
        edge, self.windows = edge[good], size[good]
        self.key = (least[edge] >> np.uint64(16)).astype(np.int64)
        self.doc, self.start = doc[edge], edge - self.begin[doc[edge]]

    def take(self, keep: np.ndarray) -> None:
        self.key, self.doc, self.start, self.windows = (
            x[keep] for x in (self.key, self.doc, self.start, self.windows))

    def together(self, group: np.ndarray, differ: bool) -> None:
        """Neighbours of one group become one segment, which then has that group for a key.

        ``differ``: all windows of a segment must differ, so a minimizer the document has twice stays alone.
        """
        if not len(self.key):
            return
        new = np.ones(len(self.key), bool)
        new[1:] = ((self.doc[1:] != self.doc[:-1]) | (group[1:] != group[:-1])
                   | (self.start[1:] != self.start[:-1] + self.windows[:-1]))
        if differ:
            _, inverse, count = np.unique(self.key | (self.doc << 48), return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            new |= again
            new[1:] |= again[:-1]
        at = np.arange(len(new))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST_RUN == 0
        edge = np.flatnonzero(new)
        self.windows = np.add.reduceat(self.windows, edge)
        self.key, self.doc, self.start = group[edge], self.doc[edge], self.start[edge]

    def bodies(self, units, data: np.ndarray) -> list[bytes]:
        text = data.tobytes()
        unit = self.begin[self.doc] + self.start
        first = self.first[unit].tolist()
        last = self.last[unit + self.windows + units.window - 2].tolist()
        return [units.body(text[a:b]) for a, b in zip(first, last)]


def digests(bodies: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in bodies), np.uint64, len(bodies)).view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, CHUNK_BYTES, column):
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            yield batch.slice(at, CHUNK_ROWS)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, did, th, text): documents with the key of their place."""
    return texts(docs).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th"), "text")


def candidates(docs: DataFrame, units, own: bool) -> DataFrame:
    """(did, th, keys): documents with the minimizers they share with another place, and the stretch of each.

    ``own``: a second place in the same document counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = Segments(units, *raw(batch.column("text")))
            pair, first, count = np.unique(found.key | (found.doc << 48), return_index=True, return_counts=True)
            doc = pair >> 48 & 0xFFFF
            did, th = (np.asarray(batch.column(c)).view(np.uint64) for c in ("did", "th"))
            # any one document of those that hold a minimizer will do, if its neighbours choose the same
            rank = mixed(did * STEP + th)[doc] & np.uint64(0xFFFFFFFFFFF00000)
            number = (first - np.searchsorted(found.doc, doc)) // STRETCH & 0xFFFFF
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair & ((1 << 48) - 1)), batch.column("did").take(at), batch.column("th").take(at),
                 pa.array(count > 1), pa.array((rank | number.astype(np.uint64)).view(np.int64))],
                ["key", "did", "th", "twice", "stretch"])

    rows = docs.select("did", "th", "text").mapInArrow(run, "key long, did long, th long, twice boolean, stretch long")
    twice = F.max(F.col("twice")) if own else F.lit(False)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), twice.alias("t"), F.min("stretch").alias("group")).where(
        "n > 1 or t").select("key", "group")
    return rows.select("key", "did", "th").join(shared, "key").groupBy("did", "th").agg(
        F.collect_list(F.struct("key", "group")).alias("keys"))


def segments(held: DataFrame, units, bodies: bool, own: bool) -> DataFrame:
    """(key, sid, did, th, start, windows[, body]) of the candidate segments of ``held`` (did, th, text, keys)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, bounds = raw(batch.column("text"))
            found = Segments(units, data, bounds)
            keys = batch.column("keys")
            key, group = (np.asarray(x) for x in keys.flatten().flatten())
            wanted = key | (np.repeat(np.arange(batch.num_rows), np.asarray(keys.value_lengths())) << 48)
            order = np.argsort(wanted)
            wanted, group = wanted[order], group[order]
            mine = found.key | (found.doc << 48)
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            hit = wanted[at] == mine
            found.take(hit)
            found.together(group[at[hit]], own)
            text = found.bodies(units, data)
            at = pa.array(found.doc)
            columns = [pa.array(found.key), pa.array(digests(text)), batch.column("did").take(at), batch.column("th").take(at),
                       pa.array(found.start), pa.array(found.windows)]
            names = ["key", "sid", "did", "th", "start", "windows"]
            if bodies:
                columns.append(pa.array(text, pa.binary()))
                names.append("body")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key long, sid long, did long, th long, start long, windows long" + (", body binary" if bodies else "")
    return held.select("did", "th", "text", "keys").mapInArrow(run, schema)


def distinct_segments(held: DataFrame, units, own: bool) -> DataFrame:
    """(key, sid, body, did, th, start): every different segment once, with its earliest place."""
    start = F.col("start") if own else F.lit(-1).cast("long")
    rows = segments(held, units, True, own).withColumn("place", F.struct("did", "th", start.alias("start")))
    return earliest(rows)


def earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "sid", "body").agg(F.min("place").alias("place")).select("key", "sid", "body", "place.*")


RUNS = "key long, sid long, did long, th long, start long, runs array<struct<a: long, b: long>>"


def run_lists(row: np.ndarray, offset: np.ndarray, n: int) -> pa.Array:
    """Per row the runs [a, b) of the given offsets; pairs are sorted and different."""
    fresh = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1))
    size = np.diff(fresh, append=len(row))
    runs = pa.StructArray.from_arrays([pa.array(offset[fresh]), pa.array(offset[fresh] + size)], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[fresh], np.arange(n + 1)), pa.int32()), runs)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows sorted by key as (alone, rows): all rows of one key, or many rows that each are alone with theirs."""
    def together(parts: list[pa.RecordBatch]) -> tuple[bool, pa.RecordBatch]:
        group = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return group.num_rows == 1, group

    open_, last = [], None
    for batch in batches:
        key = np.asarray(batch.column("key"))
        if not len(key):
            continue
        edges = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
        if open_ and key[0] != last:
            yield together(open_)
            open_ = []
        # the first and the last group may go on in the neighbouring batches
        open_.append(batch.slice(0, int(edges[1])))
        if len(edges) > 2:
            yield together(open_)
            size = np.diff(edges)[1:-1]
            begin = edges[1:-2]
            if (size == 1).any():
                yield True, batch.take(pa.array(begin[size == 1]))
            for at, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
                yield False, batch.slice(at, n)
            open_ = [batch.slice(int(edges[-2]))]
        last = key[-1]
    if open_:
        yield together(open_)


def shard_runs(distinct: DataFrame, shard: Callable, limit: int) -> DataFrame:
    """``RUNS`` of the segments whose windows occur earlier, found shard by shard.

    ``shard(bodies, order, start)`` gives (row, offset) of the windows of its segments that occur earlier;
    ``order`` numbers documents by place.  A shard holds whole groups and about ``limit`` bytes.  The windows
    of one segment all differ, or are in one document where that does not count, so a group of one segment has
    nothing to be compared with and is in no index.
    """
    place = ["key", "sid", "did", "th", "start"]

    def indexed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        did, th = np.asarray(table.column("did")), np.asarray(table.column("th"))
        by = np.lexsort((th, did))
        new = (np.diff(did[by], prepend=did[by[0]]) != 0) | (np.diff(th[by], prepend=th[by[0]]) != 0)
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(new)
        row, offset = shard(table.column("body").to_pylist(), order, np.asarray(table.column("start")))
        pair = np.unique(np.stack([row, offset]), axis=1)
        return pa.RecordBatch.from_arrays(
            [table.column(c) for c in place] + [run_lists(*pair, table.num_rows)], [*place, "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, none = [], 0, np.zeros(0, np.int64)
        for alone, group in whole_groups(batches):
            if alone:
                yield pa.RecordBatch.from_arrays(
                    [group.column(c) for c in place] + [run_lists(none, none, group.num_rows)], [*place, "runs"])
                continue
            held.append(group)
            size += len(raw(group.column("body"))[0])
            if size > limit:
                yield indexed(held)
                held, size = [], 0
        if held:
            yield indexed(held)

    return distinct.repartition("key").sortWithinPartitions("key").mapInArrow(run, RUNS)


def finer(crowded: DataFrame, units, level: int) -> DataFrame:
    """(key, sid, body, place, upper, offset, windows): segments of crowded groups cut by minimizers of longer grams.

    ``upper`` is the segment that was cut and its place, ``offset`` the first window of the part in it.
    """
    kept = ["key", "sid", "did", "th", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            data, bounds = raw(batch.column("body"))
            found = Segments(units, data, bounds, level)
            text = found.bodies(units, data)
            at = pa.array(found.doc)
            before = np.asarray(batch.column("key")).view(np.uint64)[found.doc]
            key = mixed(mixed(before) + found.key.astype(np.uint64)).view(np.int64)    # parts stay inside their group
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(digests(text)), pa.array(text, pa.binary()), pa.array(found.start),
                 pa.array(found.windows)] + [batch.column(c).take(at) for c in kept],
                ["key", "sid", "body", "offset", "windows", *("upper_" + c for c in kept)])

    rows = crowded.select(*kept, "body").mapInArrow(
        run, "key long, sid long, body binary, offset long, windows long, " + ", ".join(f"upper_{c} long" for c in kept))
    # without starts in the place (see distinct_segments) a part's own offset plays no part either
    spot = F.when(F.col("upper_start") < 0, F.lit(-1)).otherwise(F.col("upper_start") + F.col("offset"))
    return rows.select("key", "sid", "body", F.struct(F.col("upper_did").alias("did"), F.col("upper_th").alias("th"), spot.alias("start")).alias("place"),
                       F.struct(*[F.col("upper_" + c).alias(c) for c in kept]).alias("upper"), "offset", "windows")


def earlier_runs(distinct: DataFrame, units, shard: Callable, shard_bytes: int, group_bytes: int, folders: list[str],
                 level: int = 0) -> DataFrame:
    """``RUNS`` of different segments: groups that fit a shard are indexed, the others cut finer until they do."""
    def kept(df: DataFrame) -> DataFrame:
        folders.append(new_folder(df.sparkSession, "repeats"))
        return stage(df, folders[-1])

    crowded = None
    if level < len(units.grams_of):
        crowded = kept(distinct.groupBy("key").agg(F.sum(F.length("body")).alias("size"), F.count(F.lit(1)).alias("n")).where(
            (F.col("size") > group_bytes) & (F.col("n") > 1)).select("key"))
    if crowded is None or crowded.isEmpty():
        return shard_runs(distinct, shard, shard_bytes)
    parts = kept(finer(distinct.join(crowded, "key", "left_semi"), units, level))
    runs = kept(earlier_runs(kept(earliest(parts)), units, shard, shard_bytes, group_bytes, folders, level + 1))
    there = runs.select("key", "sid", F.struct("did", "th", "start").alias("least"), "runs")
    some = F.when(F.col("place") == F.col("least"), F.transform("runs", lambda r: F.struct(
        (F.col("offset") + r["a"]).alias("a"), (F.col("offset") + r["b"]).alias("b")))).otherwise(
        F.array(F.struct(F.col("offset").alias("a"), (F.col("offset") + F.col("windows")).alias("b"))))
    cut = parts.drop("body").join(there, ["key", "sid"]).select("upper", some.alias("some")).groupBy("upper").agg(
        F.flatten(F.collect_list("some")).alias("runs")).select("upper.*", "runs")
    return shard_runs(distinct.join(crowded, "key", "left_anti"), shard, shard_bytes).unionByName(cut)


def removals(held: DataFrame, units, runs: DataFrame, own: bool) -> DataFrame:
    """(did, th, gone): per document the unit ranges covered by windows that occur earlier."""
    here = segments(held, units, False, own)
    there = runs.select("key", "sid", F.struct("did", "th", *(["start"] if own else [])).alias("place"), "runs")
    first = F.struct("did", "th", *(["start"] if own else [])) == F.col("place")
    gone = F.when(first, F.transform("runs", lambda r: F.struct(
        (F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + units.window - 1).alias("b")))).otherwise(
        F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + units.window - 1).alias("b"))))
    return (here.join(there, ["key", "sid"]).select("did", "th", gone.alias("gone")).where(F.size("gone") > 0)
            .groupBy("did", "th").agg(F.flatten(F.collect_list("gone")).alias("gone")))


def covered(gone: list[dict] | None, n: int) -> np.ndarray:
    """Which of n units the ranges cover."""
    mark = np.zeros(n + 1, np.int64)
    if gone:
        a, b = np.array([g["a"] for g in gone]), np.array([g["b"] for g in gone])
        np.add.at(mark, a, 1)
        np.add.at(mark, b, -1)
    return np.cumsum(mark)[:n] > 0


def remove_repeats(docs: DataFrame, units, shard: Callable, own: bool, shard_bytes: int,
                   result: Callable, schema: str, group_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id and what ``result(text, gone)`` makes of it, in the columns of ``schema``.

    Documents meet their candidates once; from then on only those with candidates carry their text.  Tables
    between the steps are deleted as soon as what was made of them is written.
    """
    spark, folders = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        folders.append(new_folder(spark, "repeats"))
        return stage(df, folders[-1])

    rows = placed(docs)
    found = kept(candidates(rows, units, own))
    names = schema.replace(",", " ").split()[::2]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with what is gone from them."""
        for batch in batches:
            data, bounds = raw(batch.column("text"))
            data, lists = data.tobytes(), batch.column("gone")
            out = [result(data[a:b], lists[i].as_py())
                   for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns_of(out, schema)], ["doc_id", *names])

    joined = rows.join(found, ["did", "th"], "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without candidates are done; the others keep their text."""
        for batch in batches:
            data, bounds = raw(batch.column("text"))
            data = data.tobytes()
            some = np.asarray(batch.column("keys").is_null())
            out = [result(data[a:b], None) if done else None
                   for done, a, b in zip(some, bounds[:-1].tolist(), bounds[1:].tolist())]
            made = columns_of([o or (None,) * len(names) for o in out], schema)
            text = pa.array([None if done else data[a:b] for done, a, b in zip(
                some, bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "did", "th")] + [text, batch.column("keys"), *made],
                ["doc_id", "did", "th", "text", "keys", *names])

    held = stage(joined.select("doc_id", "did", "th", "text", "keys").mapInArrow(
        split, f"doc_id long, did long, th long, text binary, keys array<struct<key: long, group: long>>, {schema}"))
    open_docs = held.where("keys is not null")
    discard(spark, folders)
    distinct = kept(distinct_segments(open_docs, units, own))
    runs = kept(earlier_runs(distinct, units, shard, shard_bytes, group_bytes or shard_bytes, folders))
    gone = stage(removals(open_docs, units, runs, own))
    discard(spark, folders)
    done = held.where("keys is null").select("doc_id", *names)
    changed = open_docs.select("doc_id", "did", "th", "text").join(gone, ["did", "th"], "left").select(
        "doc_id", "text", "gone").mapInArrow(rest, f"doc_id long, {schema}")
    return done.unionByName(changed)


def columns_of(rows: list[tuple], schema: str) -> list[pa.Array]:
    """The columns of rows of longs and strings."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[k] for k in schema.replace(",", " ").split()[1::2]]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
