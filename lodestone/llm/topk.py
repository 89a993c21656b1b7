"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._base import checkpoint_root, ship
from lodestone.llm.vectors import matrix, scaled, widened

#: Rows of a block of sorted lists; a task's first blocks are smaller, so that later ones start with a good k-th score.
BLOCKS = (256, 1024, 4096)
#: Queries that go out together, and those whose bounds are held at once in a task.
QUERY_BLOCK, QUERY_SLICE = 4096, 256
#: Lists are read in so many equal parts, at most.
PARTS = 8

FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Lists:
    """Each component of a block of rows as a list sorted by value, read in step from both ends.

    A query with a positive weight takes a component's list from its large end, one with a negative weight from its small
    end. What a list hasn't given yet is at most its last value read and at least its other end.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.depth = rows, 0
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, 0)
        self.known = np.zeros((2, *rows.shape))
        self.seen = np.zeros((2, *rows.shape), bool)

    def read_to(self, depth: int) -> None:
        n, columns = len(self.rows), np.arange(self.rows.shape[1])
        for end, new in ((0, slice(n - depth, n - self.depth)), (1, slice(self.depth, depth))):
            self.known[end, self.order[new], columns] = self.values[new]
            self.seen[end, self.order[new], columns] = True
        self.depth = depth

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, rows by queries."""
        n, weights = len(self.rows), (np.maximum(queries, 0).T, np.minimum(queries, 0).T)
        frontier, far = (self.values[n - self.depth], self.values[self.depth - 1]), (self.values[0], self.values[-1])
        lower, upper = (sum(np.where(self.seen[e], self.known[e], rest[e]) @ weights[e] for e in (0, 1)) for rest in (far, frontier))
        return lower, upper


class Best:
    """The k best rows so far of each query: larger scores first, then smaller ids, rows without an id last."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q = self.score = self.id = np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        q, score, ids, no_id = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.no_id, no_id)))
        order = np.lexsort((ids, no_id, -score, q))
        first = np.searchsorted(q[order], np.arange(self.n))
        order = order[np.arange(len(order)) - first[q[order]] < self.k]
        self.q, self.score, self.id, self.no_id = q[order], score[order], ids[order], no_id[order]

    def scores(self) -> np.ndarray:
        """k x n, with minus infinity where there are fewer."""
        out = np.full((self.k, self.n), -np.inf)
        out[np.arange(len(self.q)) - np.searchsorted(self.q, np.arange(self.n))[self.q], self.q] = self.score
        return out


def read_block(rows: np.ndarray, ids: np.ndarray, no_id: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> float:
    """Adds a block's rows to the best of each query; the share of the lists that was read, as a mean over the queries.

    All queries read in step. A row whose upper bound lies below the k-th largest lower bound (of this block's rows and the
    best rows so far) can't qualify. A query stops once few rows are left that can, and the scores of these are resolved;
    at the lists' end all bounds are scores.
    """
    n, k, read = len(rows), best.k, 0
    lists, open_, sure = Lists(rows), np.arange(len(queries)), best.scores()
    floor = sure[k - 1].copy()
    for part in range(1, PARTS + 1):
        lists.read_to(max(1, n * part // PARTS))
        still = []
        for at in range(0, len(open_), QUERY_SLICE):
            some = open_[at : at + QUERY_SLICE]
            lower, upper = lists.bounds(queries[some])
            own = (ids[:, None] == query_ids[some]) & ~no_id[:, None]
            lower[own] = upper[own] = -np.inf
            top = np.partition(lower, n - k, axis=0)[n - k :] if n > k else lower
            floor[some] = np.maximum(floor[some], np.partition(np.vstack([sure[:, some], top]), -k, axis=0)[-k])
            inside = (upper >= floor[some]) & ~own
            ends = (inside.sum(0) <= max(k, n // 16)) | (lists.depth == n)
            still.append(some[~ends])
            read += lists.depth * int(ends.sum())
            row, column = np.nonzero(inside & ends)
            q = some[column]
            score = np.concatenate([np.einsum("ij,ij->i", rows[row[i : i + 8192]], queries[q[i : i + 8192]]) for i in range(0, len(row), 8192)] or [np.zeros(0)])
            best.add(q, score.astype(np.int64), ids[row], no_id[row])
        open_ = np.concatenate(still)
        if not len(open_):
            break
    return read / max(1, n * len(queries))


def search(batches: Iterator[pa.RecordBatch], numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query among a partition's rows."""
    best, held, blocks = Best(len(queries), k), [], 0
    size = 0

    def take(up_to: int) -> None:
        nonlocal held, size
        rows, ids, no_id = ([x[i] for x in held] for i in range(3))
        width = max(queries.shape[1], *(x.shape[1] for x in rows))
        rows, ids, no_id = np.vstack([widened(x, width) for x in rows]), np.concatenate(ids), np.concatenate(no_id)
        read_block(rows[:up_to].astype(float), ids[:up_to], no_id[:up_to], widened(queries, width).astype(float), query_ids, best)
        held = [(rows[up_to:], ids[up_to:], no_id[up_to:])] if len(rows) > up_to else []
        size -= up_to

    for batch in batches:
        ids = batch.column("id")
        held.append((matrix(batch.column("x")), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        while size >= (want := BLOCKS[min(blocks, len(BLOCKS) - 1)]):
            take(want)
            blocks += 1
    if size:
        take(size)
    if len(best.q):
        vec_id = pa.array(best.id, mask=best.no_id)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.q]), pa.array(query_ids[best.q]), vec_id, pa.array(best.score)], schema=FOUND)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(running numbers, ids, vectors) of QUERY_BLOCK queries each; the driver holds one block and one partition's queries."""
    held, start = [], 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = max(len(r["x"]) for r in held)
        rows = np.zeros((len(held), width), np.int64)
        for i, r in enumerate(held):
            rows[i, : len(r["x"])] = r["x"]
        return np.arange(start, start + len(held)), np.array([r["id"] for r in held], np.int64), rows

    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield block()
            start, held = start + QUERY_BLOCK, []
    if held:
        yield block()


def top_k(rows: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest integer inner product for each row that is_query marks.

    Components count as floor(scale * component). Each partition keeps its rows as sorted lists in blocks of at most 4,096
    rows and answers all queries of a query block from them (`read_block`); k rows of each query leave a task, and a window
    over a query's rows picks the best. The queries go out in blocks of 4,096, one pass over the rows each, so that nothing
    held by the driver or a task grows with the table. What a block found is written to the shared folder.

    Vectors that are null or hold null or non-finite components are neither queries nor candidates. A row is no candidate
    for queries of its own id. Shorter vectors count as filled up with zeros; an empty one scores 0. Equal scores: smaller id
    first, rows without an id last (they are candidates, never queries). Repeated ids: each row is a candidate, each query row
    gets its own k rows. Fewer than k candidates: all of them. An empty table or one without queries gives no rows. Scaled
    components of 2 ** 23 or more raise an error. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    ints = scaled(rows, scale, id_col, vector_col)
    path = f"{checkpoint_root(spark)}/lodestone/topk-{uuid.uuid4().hex}"
    kinds = "q long, query_id long, vec_id long, score long"
    spark.createDataFrame([], kinds).write.parquet(path)
    wanted = scaled(rows.where(F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False))), scale, id_col, vector_col)
    for block in query_blocks(wanted):
        sent = spark.sparkContext.broadcast((*block, k))
        ints.mapInArrow(lambda batches, sent=sent: search(batches, *sent.value), kinds).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(kinds).parquet(path)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
