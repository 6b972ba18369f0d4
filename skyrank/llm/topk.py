"""Exact top-k inner products with a vector-approximation file.

Vectors become integers, floor(256 x), and every component a cell of a few bits, in the scale of its own
vector.  The file holds cells and exact components in columns of their own.  A task scans the cells of its vectors for lower and upper bounds
of the scores of all queries; it then reads exact vectors from the best bound down until no bound left
reaches the kth score it has.  The best of all tasks are merged per query.

Queries go to the tasks in blocks of bounded size; every block meets all vectors.

Integers are held as doubles, which are whole numbers exactly; products that could pass 2 ** 53 are added as
Python integers, and the bounds are widened by what their own additions can lose.

Defined results: vectors that are null, or hold a null or non-finite component (or one so large that 256 times
it is no finite double), take no part; ranks follow the exact scores, and a score beyond 64 bits is
returned as the nearest long; a query only meets vectors of its own dimension; rows with the query's vec_id are the query
itself, and repeated query rows count once; repeated candidate rows each have a rank; a null vec_id is
never a query and comes last among ties; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

SCALE = 256
EXACT = float(2 ** 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
CELL_BITS = 6
QUERY_BLOCK = 1024
SCAN_ROWS = 1024
READ_AHEAD = 16


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    # beyond 2 ** 53 a double is whole already, and a long could not hold it
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    return vectors.where(v.isNotNull()).where(fine).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: whole(x * SCALE)).alias("v"))


def approximation_file(vectors: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """(vec_id, dim, v, shift, cells): ``shift`` is how many bits of a component of that vector a cell leaves out."""
    top = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(1.0)))
    # a logarithm may be off in its last digits; a bit more than needed does no harm
    shift = F.greatest(F.lit(0), (F.floor(F.log2(top) + 1e-9) + 2 - bits).cast("int"))
    return vectors.select("vec_id", F.size("v").alias("dim"), "v", shift.alias("shift")).withColumn("cells", F.transform(
        "v", lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("shift"))).cast("byte" if bits <= 8 else "int")))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole numbers held as doubles, without rounding."""
    if not rows.size:
        return [0] * len(rows)
    if np.abs(rows).max() * np.abs(query).max() * len(query) < EXACT:
        return [int(s) for s in rows @ query]
    whole = [int(x) for x in query]
    return [sum(int(x) * y for x, y in zip(row, whole)) for row in rows]


def below(score: int) -> float:
    """A double that is not above ``score``."""
    try:
        near = float(score)
    except OverflowError:
        return -np.inf if score < 0 else float(np.finfo(float).max)
    return near if near <= score else float(np.nextafter(near, -np.inf))


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.ids, self.k, self.q = ids, k, queries
        self.up, self.down = np.maximum(self.q, 0).T.copy(), np.minimum(self.q, 0).T.copy()
        self.found: list[list[tuple[int, int, int | None]]] = [[] for _ in ids]

    def bounds(self, cells: np.ndarray, shift: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        scale = np.ldexp(1.0, shift)[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            # a component is its cell's least value plus 0 to width
            least, width = cells.astype(np.float64) @ self.q.T * scale, scale - 1
            slack = np.abs(self.q).sum(axis=1) * scale * ((self.q.shape[1] + 4) * 2.0 ** (bits - 50))
            lower, upper = least + width * self.down.sum(axis=0) - slack, least + width * self.up.sum(axis=0) + slack
        return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)

    def scan(self, vec_ids: list, exact: np.ndarray, cells: np.ndarray, shift: np.ndarray, bits: int) -> None:
        lower, upper = self.bounds(cells, shift, bits)
        own = np.array([-1 if v is None else v for v in vec_ids])
        known = np.array([v is not None for v in vec_ids])
        same = (own[:, None] == self.ids[None, :]) & known[:, None]
        upper[same], lower[same] = -np.inf, -np.inf
        enough = np.array([below(f[-1][0]) if len(f) == self.k else -np.inf for f in self.found], float)
        if len(vec_ids) >= self.k:
            enough = np.maximum(enough, np.partition(lower, len(vec_ids) - self.k, axis=0)[len(vec_ids) - self.k])
        row, col = np.nonzero((upper >= enough) & ~same)
        order = np.lexsort((-upper[row, col], col))
        row, col = row[order], col[order]
        edges = np.searchsorted(col, np.arange(len(self.ids) + 1))
        for q in np.unique(col):
            self._read(q, row[edges[q]:edges[q + 1]], upper[:, q], exact, vec_ids)

    def _read(self, q: int, rows: np.ndarray, upper: np.ndarray, exact: np.ndarray, vec_ids: list) -> None:
        best = self.found[q]
        for at in range(0, len(rows), READ_AHEAD):
            some = rows[at:at + READ_AHEAD]
            if len(best) == self.k and upper[some[0]] < below(best[-1][0]):
                return
            scores = exact_scores(exact[some], self.q[q])
            none = 1 << 63
            more = [(s, -(none if vec_ids[r] is None else vec_ids[r]), vec_ids[r]) for s, r in zip(scores, some)]
            best[:] = sorted(best + more, key=lambda x: x[:2], reverse=True)[:self.k]


def block_search(file: DataFrame, bits: int, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, vec_id, score): of every task the best k for each query of a block; scores are decimal text."""
    by_dim: dict[int, tuple[list[int], list[list[float]]]] = {}
    for vec_id, v in queries:
        ids, rows = by_dim.setdefault(len(v), ([], []))
        ids.append(vec_id)
        rows.append(v)
    shared = file.sparkSession.sparkContext.broadcast(
        {d: (np.array(ids), np.array(rows, np.float64).reshape(len(ids), d)) for d, (ids, rows) in by_dim.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(rows, ids, k) for d, (ids, rows) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(at, SCAN_ROWS)
                dims = np.asarray(part.column("dim"))
                for d in np.unique(dims):
                    if d in best:
                        mine = part.filter(pa.array(dims == d))
                        shape = (mine.num_rows, d)
                        best[d].scan(mine.column("vec_id").to_pylist(),
                                     np.asarray(mine.column("v").flatten()).reshape(shape),
                                     np.asarray(mine.column("cells").flatten()).reshape(shape),
                                     np.asarray(mine.column("shift")), bits)
        rows = [(int(q), v, str(s)) for b in best.values() for q, found in zip(b.ids, b.found) for s, _, v in found]
        query, vec, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.string())],
            ["query_id", "vec_id", "score"])

    return file.mapInArrow(run, "query_id long, vec_id long, score string")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = CELL_BITS,
          block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, v) for each query row."""
    file = stage(approximation_file(vectors, bits))
    queries = file.where(F.col("vec_id").isNotNull() & is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stage(queries)
    blocks = max(1, -(-queries.count() // block))
    found = None
    for number in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        part = block_search(file, bits, [(r["vec_id"], r["v"]) for r in mine], k)
        found = part if found is None else found.unionByName(part)
    # decimal text in the order of the numbers it stands for: sign, digits, then the digits themselves
    minus, digits = F.col("score").startswith("-"), F.length("score")
    order = Window.partitionBy("query_id").orderBy(
        minus, F.when(minus, -digits).otherwise(digits).desc(), F.when(~minus, F.col("score")).desc(),
        F.when(minus, F.col("score")), F.asc_nulls_last("vec_id"))
    score = F.coalesce(F.col("score").try_cast("long"), F.when(minus, F.lit(LEAST)).otherwise(F.lit(MOST)))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score.alias("score"))
