"""Language identification with interpolated Kneser-Ney character models.

Letters in lower case are symbols; anything between them is one blank.  Character 4-grams are counted per
language over all training rows; lower orders come from continuation counts.  A model is sorted arrays of
gram hashes with their discounted shares, and of context hashes with the weight left for the next lower
order.  No gram is left out: a model of more than ``BLOCK_ENTRIES`` grams is worked out by Spark over all
of them and kept as blocks, which are asked one after the other.  A text gets the language of lowest cross-entropy per symbol, and is rejected where even that is
far above what the language's own text has.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; with nothing
to learn from, every text is; rows with a null language or null text are not learned from; repeated rows
count as often as they occur; an equal cross-entropy goes to the language first by code point; letters
beyond the basic plane share one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import raw, slices
from .staging import around, stage

ORDER = 4
#: (language, 4-gram) entries up to which all models are one broadcast, and entries of all orders in a block of larger ones.
BLOCK_ENTRIES = 1_000_000
BATCH_BYTES = 1_000_000
#: Grams of texts that are looked up in one round over the blocks.
ROUND_GRAMS = 4_000_000
#: The parts of grams, by their middle symbols, that blocks are made of: 256 for each of the two.
CELLS = 1 << 16
#: Bits above a language's own cross-entropy, and standard errors, that a text may have.
SLACK_BITS, SLACK_ERRORS = 1.5, 6.0
#: Symbols that count as evidence in a score; more add no certainty.
EVIDENCE = 60
UNKNOWN = "und"
RESULT = "pred: string, score: double, cross_entropy: double, rejected: boolean"


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def symbol_table() -> np.ndarray:
    """The symbol of every code point of the basic plane: its lower case if a letter, else 0."""
    table = np.zeros(0x10000, np.uint16)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 0xFFFF else code
    return table


def symbols(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all texts as packed numbers, the texts' sizes in grams, and in letters."""
    data, bounds = raw(column)
    text = data.tobytes()
    try:
        codes = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    except UnicodeError:
        parts = [np.frombuffer(text[a:b].decode(errors="replace").encode("utf-32-le"), np.uint32)
                 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        codes = np.concatenate(parts)
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    n = len(bounds) - 1
    wide = codes > 0xFFFF
    found = table[np.where(wide, 0, codes)]
    if wide.any():
        found[wide] = [0xFFFF if chr(c).isalpha() else 0 for c in codes[wide]]
    doc = np.repeat(np.arange(n), np.diff(begins))
    before = np.zeros(len(found), np.uint16)
    before[1:] = found[:-1]
    before[begins[:-1][begins[:-1] < len(found)]] = 0
    keep = (found != 0) | (before != 0)
    found, doc = found[keep], doc[keep]
    sizes = np.bincount(doc, minlength=n)
    letters = np.bincount(doc[found != 0], minlength=n)
    # every text starts after ORDER - 1 blanks
    padded = np.zeros(len(found) + (ORDER - 1) * n, np.uint64)
    at = np.arange(len(found)) + (doc + 1) * (ORDER - 1)
    padded[at] = found
    grams = padded.copy()
    for k in range(1, ORDER):
        grams[k:] |= padded[:-k] << np.uint64(16 * k)
    return grams[at], sizes, letters


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = symbol_table(), {}, 0

        def flush():
            for lang, parts in held.items():
                keys = np.concatenate([p[0] for p in parts])
                order = np.argsort(keys)
                keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
                first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(first), pa.string()), pa.array(keys[first].view(np.int64)),
                     pa.array(np.add.reduceat(counts, first))], ["lang", "gram", "n"])

        for batch in slices(batches, BATCH_BYTES):
            grams, sizes, _ = symbols(batch.column("text"), table)
            langs = batch.column("lang").dictionary_encode()
            of = np.repeat(np.asarray(langs.indices), sizes)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.sort(grams[of == k])
                if len(mine):
                    first = np.flatnonzero(np.diff(mine, prepend=mine[:1] + np.uint64(1)))
                    held.setdefault(lang, []).append((mine[first], np.diff(first, append=len(mine))))
                    size += len(first)
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def mixed(keys: np.ndarray) -> np.ndarray:
    """A hash of packed grams that no two share."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(27))


class SortedHashes:
    """Values of grams by binary search in their sorted hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        hashes = mixed(keys)
        order = np.argsort(hashes)
        self.hashes, self.values, self.missing = hashes[order], values[order].astype(np.float32), missing

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), self.missing)
        hashes = mixed(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], self.missing)


def discount_of(once: int, twice: int) -> float:
    """What every count gives to the next lower order, from how many are 1 and 2."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


class KneserNey:
    """The model of one language from its 4-gram counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        levels, keys, n = [], grams, counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            discount = discount_of((n == 1).sum(), (n == 2).sum())
            context, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(inverse, n)
            levels.append((SortedHashes(keys, (n - discount) / total[inverse], 0.0),
                           SortedHashes(context, discount * np.bincount(inverse) / total, 1.0)))
            if order == 1:
                self.uniform = 1.0 / (len(keys) + 1)
                break
            # how many symbols come before what is left of the gram without its first
            keys, n = np.unique(keys & np.uint64((1 << (16 * (order - 1))) - 1), return_counts=True)
            n = n.astype(np.float64)
        self.levels = levels[::-1]
        bits = self.bits(grams)
        self.mean = float(np.average(bits, weights=counts))
        self.deviation = float(np.sqrt(np.average((bits - self.mean) ** 2, weights=counts)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Minus log2 of the probability of each gram's last symbol after the others."""
        p = np.full(len(grams), self.uniform)
        for order, (shares, left) in enumerate(self.levels, 1):
            key = grams & np.uint64((1 << (16 * order)) - 1)
            p = shares.get(key) + left.get(key >> np.uint64(16)) * p
        return -np.log2(p)


class Part(KneserNey):
    """What one block has of the model of one language."""

    def __init__(self, levels: list[tuple[SortedHashes, SortedHashes]], uniform: float):
        self.levels, self.uniform = levels, uniform


class Blocks:
    """Models of all languages in blocks, each for the grams of a range of cells."""

    def __init__(self, names: list[str], means: np.ndarray, deviations: np.ndarray,
                 parts: list[tuple[int, int, Broadcast]]):
        self.names, self.means, self.deviations, self.parts = names, means, deviations, parts

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram under each model, a row per model; one block is held at a time."""
        out = np.zeros((len(self.names), len(grams)), np.float32)
        cells = cell(grams >> np.uint64(16))
        for low, high, shared in self.parts:
            at = np.flatnonzero((cells >= low) & (cells < high))
            if len(at):
                for k, model in enumerate(shared.value):
                    out[k, at] = model.bits(grams[at])
                model = None
                vars(shared).pop("_value", None)
        return out


def cell(contexts: np.ndarray) -> np.ndarray:
    """The cell of grams by the last two symbols of their contexts."""
    last, before = contexts & np.uint64(0xFFFF), (contexts >> np.uint64(16)) & np.uint64(0xFFFF)
    spread = lambda s: ((s * np.uint64(40503)) & np.uint64(0xFFFF)) >> np.uint64(8)
    return (spread(last) << np.uint64(8) | spread(before)).astype(np.int64)


def cell_column(context: Column) -> Column:
    """:func:`cell` as a column."""
    spread = lambda s: F.shiftright((s * 40503).bitwiseAND(0xFFFF), 8)
    return (spread(context.bitwiseAND(0xFFFF)) * 256 + spread(F.shiftrightunsigned(context, 16).bitwiseAND(0xFFFF))).cast("int")


def cell_ranges(weights: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of cells of at most ``most`` entries each; a cell is never split."""
    bounds, size = [0], 0
    for at in sorted(weights):
        if size and size + weights[at] > most:
            bounds.append(at)
            size = 0
        size += weights[at]
    return list(zip(bounds, bounds[1:] + [CELLS]))


def in_blocks(counts: DataFrame) -> Blocks:
    """Models from staged ``counts`` (lang, gram, n), worked out by Spark over all grams."""
    spark = counts.sparkSession
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1
    tables = {ORDER: counts.select(number.cast("int").alias("l"), F.col("gram").alias("key"), "n")}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))
        # how many symbols come before what is left of the gram without its first
        tables[order] = stage(tables[order + 1].groupBy("l", shorter.alias("key")).agg(F.count("*").alias("n")))
    discounts, sums = {}, {}
    for order, rows in tables.items():
        found = {r["l"]: r for r in rows.groupBy("l").agg(
            F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"),
            F.count("*").alias("kinds"), F.sum("n").alias("total")).collect()}
        sums[order] = [found[k] for k in range(len(names))]
        discounts[order] = [discount_of(r["once"], r["twice"]) for r in sums[order]]
    uniform = [1.0 / (r["kinds"] + 1) for r in sums[1]]
    rest = [d * r["kinds"] / r["total"] for d, r in zip(discounts[1], sums[1])]

    def of(values: list[float]) -> Column:
        """The value of each row's language."""
        return F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("l"))

    context = F.shiftrightunsigned("key", 16).alias("context")
    first = tables[1].select("l", "key", ((F.col("n") - of(discounts[1])) / of([r["total"] for r in sums[1]])).alias("share"))
    lower = first.select("l", "key", (F.col("share") + of([a * b for a, b in zip(rest, uniform)])).alias("p"))
    entries = [first.select("l", F.lit(1).alias("level"), F.lit(False).alias("left"), "key", F.col("share").alias("value"),
                            F.lit(0).alias("cell"))]
    for order in range(2, ORDER + 1):
        rows = tables[order].select("*", context)
        left = stage(rows.groupBy("l", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).select(
            "l", "context", "total", (of(discounts[order]) * F.col("kinds") / F.col("total")).alias("left")))
        shares = rows.join(left, ["l", "context"]).select(
            "l", "key", "context", "n", "left", ((F.col("n") - of(discounts[order])) / F.col("total")).alias("share"),
            F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("shorter"))
        lower = stage(shares.join(lower.select("l", F.col("key").alias("shorter"), "p"), ["l", "shorter"]).select(
            "l", "key", "context", "n", "share", (F.col("share") + F.col("left") * F.col("p")).alias("p")))
        entries += [
            lower.select("l", F.lit(order), F.lit(False), "key", "share", cell_column(F.col("context"))),
            left.select("l", F.lit(order), F.lit(True), "context", "left", cell_column(F.col("context")))]
    bits = -F.log2("p")
    fit = {r["l"]: r for r in lower.groupBy("l").agg(
        (F.sum(F.col("n") * bits) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * bits * bits) / F.sum("n")).alias("square")
    ).collect()}
    means = np.array([fit[k]["mean"] for k in range(len(names))])
    squares = np.array([fit[k]["square"] for k in range(len(names))])

    every = entries[0]
    for part in entries[1:]:
        every = every.union(part)
    every = stage(every.withColumn("value", F.col("value").cast("float")).sortWithinPartitions("level", "cell"))
    weights = {r[0]: r[1] for r in every.where("level > 2").groupBy("cell").agg(F.count("*")).collect()}
    parts = []
    for low, high in cell_ranges(weights, BLOCK_ENTRIES):
        # shorter grams do not have the symbol that parts a cell from its neighbours, so they stand in each block they touch
        mine = F.col("cell").between(low, high - 1) | (F.col("level") == 1) | (
            (F.col("level") == 2) & F.shiftright("cell", 8).between(low >> 8, (high - 1) >> 8))
        table = every.where(mine).toPandas()
        models = []
        for k in range(len(names)):
            own = table[table["l"] == k]
            levels = []
            for order in range(1, ORDER + 1):
                at = own[own["level"] == order]
                pair = []
                for left, missing in ((False, 0.0), (True, 1.0)):
                    some = at[at["left"] == left]
                    pair.append(SortedHashes(some["key"].to_numpy(np.int64).view(np.uint64), some["value"].to_numpy(), missing))
                levels.append(tuple(pair))
            levels[0] = levels[0][0], SortedHashes(np.zeros(1, np.uint64), np.array([rest[k]]), 1.0)
            models.append(Part(levels, uniform[k]))
        parts.append((low, high, spark.sparkContext.broadcast(models)))
    return Blocks(names, means, np.sqrt(np.maximum(squares - means ** 2, 0)), parts)


def train(docs: DataFrame, max_entries: int | None = None) -> dict[str, KneserNey] | Blocks:
    """Models of all languages of ``docs`` (lang, text); counted on the cluster.

    Every gram counts, unless a caller asks for the ``max_entries`` commonest only.
    """
    counts = stage(gram_counts(docs))
    size = counts.count()
    if max_entries is not None and size > max_entries:
        by_n = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
        rows = F.sum("k").over(Window.orderBy(F.desc("n")))    # one row per distinct count
        least = by_n.withColumn("rows", rows).where(F.col("rows") <= max_entries).agg(F.min("n")).first()[0]
        counts = counts.where(F.col("n") >= F.lit(least)) if least is not None else counts.limit(0)
        size = max_entries
    if size > BLOCK_ENTRIES:
        return in_blocks(counts)
    table = counts.toPandas()
    return {lang: KneserNey(part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy())
            for lang, part in sorted(table.groupby("lang"))}


class Scorer:
    """Bits per gram under every model, for grams as they come up."""

    SLOT_BITS, MOST = 20, 2_000_000

    def __init__(self, models: dict[str, KneserNey] | Blocks):
        self.names = list(models)
        if isinstance(models, Blocks):
            self._bits, self.means, self.deviations = models.bits, models.means, models.deviations
        else:
            each = list(models.values())
            self._bits = lambda keys: np.stack([m.bits(keys) for m in each]).astype(np.float32)
            self.means, self.deviations = np.array([m.mean for m in each]), np.array([m.deviation for m in each])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1, np.uint64)
        self.bits = self._bits(self.keys)
        self.slots = np.zeros(1 << self.SLOT_BITS, np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (mixed(grams) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)

    def _find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.slots[self._slot(grams)]
        miss = np.flatnonzero(self.keys[at] != grams)
        if len(miss):
            at[miss] = np.minimum(np.searchsorted(self.keys, grams[miss]), len(self.keys) - 1)
            miss = miss[self.keys[at[miss]] != grams[miss]]
        return at, miss

    def index(self, grams: np.ndarray) -> np.ndarray:
        """Where the grams' bits stand in ``bits``."""
        at, miss = self._find(grams)
        if len(miss):
            if len(self.keys) > self.MOST:
                self.clear()
                miss = np.arange(len(grams))
            fresh = np.setdiff1d(grams[miss], self.keys)
            keys = np.concatenate([self.keys, fresh])
            bits = np.concatenate([self.bits, self._bits(fresh)], axis=1)
            order = np.argsort(keys)
            self.keys, self.bits = keys[order], bits[:, order]
            self.slots[self._slot(self.keys)] = np.arange(len(self.keys))
            at, _ = self._find(grams)
        return at

    def sums(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits of each text under each model, a row per model."""
        out = np.zeros((len(self.names), len(sizes)))
        full = np.flatnonzero(sizes)
        if len(full):
            at = self.index(grams)
            starts = (np.cumsum(sizes) - sizes)[full]
            for k in range(len(self.names)):
                out[k, full] = np.add.reduceat(self.bits[k][at], starts, dtype=np.float64)
        return out


def rounds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Batches with their symbols, put together until they have ``most`` grams."""
    table, held, size = symbol_table(), [], 0
    for batch in slices(batches, BATCH_BYTES):
        held.append((batch, *symbols(batch.column("text"), table)))
        size += len(held[-1][1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def labelled(scorer: Scorer | None, batch: pa.RecordBatch, grams: np.ndarray, sizes: np.ndarray,
             letters: np.ndarray) -> pa.RecordBatch:
    """``batch`` with its ``language``."""
    n = len(sizes)
    good = (letters > 0) & (scorer is not None)
    if scorer is None:
        best, score, bits, over = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
    else:
        each = scorer.sums(grams, sizes) / np.maximum(sizes, 1)
        best = each.argmin(axis=0)
        bits = each[best, np.arange(n)]
        weight = np.log(2) * np.minimum(sizes, EVIDENCE)
        score = 1 / np.exp(-(each - bits) * weight).sum(axis=0)
        mean = scorer.means[best]
        error = scorer.deviations[best] / np.sqrt(np.maximum(sizes, 1))
        over = bits > mean + SLACK_BITS + SLACK_ERRORS * error
    names = pa.array(scorer.names if scorer else [UNKNOWN], pa.string()).take(pa.array(best))
    result = pa.StructArray.from_arrays([
        pa.array([x if ok else UNKNOWN for x, ok in zip(names.to_pylist(), good)], pa.string()),
        pa.array(np.where(good, score, 0.0)),
        pa.array(bits, mask=~good), pa.array(np.where(good, over, True))],
        ["pred", "score", "cross_entropy", "rejected"])
    return batch.append_column("language", result)


def identify(docs: DataFrame, models: dict[str, KneserNey] | Blocks) -> DataFrame:
    """``docs`` with a struct ``language``: pred, score from 0 to 1, cross_entropy and rejected.

    Every other column stays as it is; a column of that name is replaced.
    """
    rows = docs.drop("language")
    blocks = models if isinstance(models, Blocks) else None
    shared = None if blocks else rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blocks or shared.value
        scorer = Scorer(known) if known else None
        for held in rounds(batches, ROUND_GRAMS if blocks else 1):
            if blocks:
                scorer.index(np.unique(np.concatenate([h[1] for h in held])))
            yield from (labelled(scorer, *h) for h in held)

    return rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL(f"language struct<{RESULT}>").fields))


def learn_and_identify(docs: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Learn from the rows that are not held out, then identify all."""
    return identify(docs, train(docs.where(~held_out(F.col("doc_id"))), max_entries))


def keep_identified(docs: DataFrame, max_entries: int | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return around(docs, "language", lambda rows: learn_and_identify(rows, max_entries).where(~F.col("language.rejected")))
