"""Fill-in-the-middle transformation: a document is cut in three and its middle moved to the end.

The places where a code point may begin are kept as a compressed set of byte positions, one set for a
few megabytes of documents (:mod:`.boundaries`).  Cut points are numbers of code points; the set's
select turns both cuts of every document into byte offsets, and no text is ever decoded.

What is drawn for a document comes from the SHA-256 of ``seed:doc_id`` alone, so a rerun or a lost task
changes nothing.  No shuffle takes place and every row is one document.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stays plain (the
parts could not be told apart again); a null doc_id draws as ''; repeated rows give the same output each.
Further columns stay; those named ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import raw, slices
from .boundaries import BoundarySet

#: Marks in front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 documents: how many are transformed, and of those how many with the suffix in front.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SHARD_BYTES = 4_000_000
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transform_shard(ids: list, text: pa.Array, seed: int, transformed: int, suffix_first: int,
                    sentinels: tuple[str, str, str]) -> list[pa.Array]:
    """The result columns for a run of documents."""
    data, bounds = raw(text)
    starts = np.flatnonzero((data & 0xC0) != 0x80)    # every byte that is not a continuation
    boundary = BoundarySet(np.append(starts, len(data)))
    rank = np.searchsorted(starts, bounds)    # code points before each document
    n = np.diff(rank)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    first, second = (boundary.select(rank[:-1] + cuts[:, j]) for j in (0, 1))
    mark = [s.encode() for s in sentinels]
    whole, forms, outputs = data.tobytes(), [], []
    for a, x, y, b, (_, _, h3, h4) in zip(bounds[:-1].tolist(), first.tolist(), second.tolist(), bounds[1:].tolist(), h.tolist()):
        if a == b or h3 % 100 >= transformed or any(whole.find(m, a, b) >= 0 for m in mark):
            forms.append("plain")
            outputs.append(whole[a:b])
            continue
        prefix, suffix = mark[0] + whole[a:x], mark[1] + whole[y:b]
        spm = h4 % 100 < suffix_first
        forms.append("spm" if spm else "psm")
        outputs.append((suffix + prefix if spm else prefix + suffix) + mark[2] + whole[x:y])
    plain = np.array([f == "plain" for f in forms], bool)
    return [pa.array(n), pa.array(forms, pa.string()), pa.array(cuts[:, 0], mask=plain),
            pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
                   transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with the number of code points, the form, the lengths of prefix and middle, and the output."""
    added = StructType.fromDDL(RESULT)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in (key, text) or c not in added.names])
    base = base.withColumn(text, F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SHARD_BYTES, text):
            columns = transform_shard(part.column(key).to_pylist(), part.column(text), seed, transformed, suffix_first, sentinels)
            for name, column in zip(added.names, columns):
                part = part.append_column(name, column)
            yield part

    return base.mapInArrow(run, StructType(base.schema.fields + added.fields))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made from."""
    p, s, m = sentinels
    rest = lambda mark: F.substr(output, F.instr(output, mark) + len(mark))    # all behind the first such mark
    between = lambda a, b: F.substr(output, F.instr(output, a) + len(a), F.instr(output, b) - F.instr(output, a) - len(a))
    return (F.when(form == "psm", F.concat(between(p, s), rest(m), between(s, m)))
            .when(form == "spm", F.concat(between(p, m), rest(m), between(s, p)))
            .otherwise(output))
