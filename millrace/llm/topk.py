"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation [operator 3].

Candidates are cut into blocks and indexed by postings: for each dimension the
places and weights of the rows that aren't zero there.  A query walks its own
non-zero dimensions and scatters weight times posting into a dense array of
scores, one for each row of the block.  A partition selection takes the block's
best k; a merge takes the best over the blocks of a task, another one those over
all tasks.

Candidates are moved once, to tasks that hold some blocks each.  The queries lie in
files of the shared folder, which every task reads through, a block at a time.  So a
task holds its candidates, one block of queries and their k best, and what is
shuffled is the candidates and k rows a query and task, whatever the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, written

#: Candidates of a block, blocks that a task holds at once, and queries that it reads at once.
BLOCK, BLOCKS, QUERY_BLOCK = 8_192, 64, 4_096
_MOST = (1 << 63) - 1


class Postings:
    """The postings of one block; rows are told apart by ``rows``, their ids ascend."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, vectors = rows[order], ids[order], vectors[order]
        self.places, self.weights = [], []
        for t in range(vectors.shape[1]):
            column = vectors[:, t]
            places = np.flatnonzero(column)
            # more than a quarter filled: a posting for every row, zeros and all, adds up faster
            dense = 4 * len(places) > len(column)
            self.places.append(None if dense else places)
            self.weights.append(np.ascontiguousarray(column if dense else column[places]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids), query.dtype)
        for t in np.flatnonzero(query[: len(self.weights)]):
            if self.places[t] is None:
                out += query[t] * self.weights[t]
            else:
                out[self.places[t]] += query[t] * self.weights[t]
        return out

    def best(self, row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows, ties to the smaller id, without the query's own."""
        scores, others = self.scores(query), np.flatnonzero(self.rows != row)
        chosen = others[most(scores[others], k)]
        return self.ids[chosen], scores[chosen]


def most(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the earlier place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, shorter ones padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _kind(queries: np.ndarray, rows: np.ndarray) -> object:
    """The narrowest type that holds every partial sum."""
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    top = largest(queries) * largest(rows) * queries.shape[1]
    return np.int32 if top < 1 << 31 else np.int64 if top < 1 << 62 else object


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    limit = float(1 << 62)
    floor = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-limit)), F.lit(limit))).cast("long")
    return x.select("vec_id", F.transform("x", floor).alias("v"))


def _queries(folder: str) -> Iterator[pa.RecordBatch]:
    """The query rows (row, vec_id, v) below a folder, a block at a time."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=QUERY_BLOCK, columns=["row", "vec_id", "v"])


def search(vectors: DataFrame, k: int = 20, scale: int = 64, query_divisor: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score long): each query's k best other rows.

    Queries are the rows whose id ``query_divisor`` divides.  A component x becomes
    floor(scale * x).  Rows with a null id, a null vector or a null or non-finite component
    take no part; rows with one id are rows of their own, each a candidate of the others and, if
    the id is a query's, each a query; a shorter vector counts as padded with zeros, an
    empty one as zeros alone; scores beyond 64 bits are held at their limit; ties go to the
    smaller id; an empty table gives no row; other columns are not read.
    """
    spark, folder = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = quantized(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    rows = written(spark, rows.select("row", "vec_id", "v"), folder, "vectors")
    written(spark, rows.where(F.col("vec_id") % query_divisor == 0), folder, "queries")
    n = max(1, rows.count())
    tasks = max(min(math.ceil(n / BLOCK), 4 * spark.sparkContext.defaultParallelism), math.ceil(n / (BLOCK * BLOCKS)))
    block, held_at_once, query_folder = BLOCK, BLOCK * BLOCKS, f"{folder}/queries"

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda name: np.concatenate([b.column(name).to_numpy() for b in held])
        own, ids, every = column("row"), column("vec_id"), [_matrix(b.column("v")) for b in held]
        matrix = np.zeros((len(ids), max(m.shape[1] for m in every)), np.int64)
        at = 0
        for m in every:
            matrix[at : at + len(m), : m.shape[1]] = m
            at += len(m)
        index: dict[object, list[Postings]] = {}
        for part in _queries(query_folder):
            queries = _matrix(part.column("v"))
            kind = _kind(queries, matrix)
            if kind not in index:
                index.clear()
                typed = matrix.astype(kind)
                index[kind] = [Postings(own[i : i + block], ids[i : i + block], typed[i : i + block]) for i in range(0, len(ids), block)]
            found_ids, found_scores, sizes = [], [], []
            for row, query in zip(part.column("row").to_pylist(), queries.astype(kind), strict=True):
                best = [p.best(row, query, k) for p in index[kind]]
                i, x = np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])
                order = np.argsort(i, kind="stable")
                chosen = order[most(x[order], k)]
                found_ids.append(i[chosen])
                found_scores += [max(-_MOST, min(_MOST, v)) for v in x[chosen].tolist()]
                sizes.append(len(chosen))
            of = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(of)), part.column("vec_id").take(pa.array(of)), pa.array(np.concatenate(found_ids), pa.int64()), pa.array(found_scores, pa.int64())], ["row", "query_id", "vec_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= held_at_once:
                yield from answer(held)
                held, size = [], 0
        if held:
            yield from answer(held)

    best = rows.repartition(tasks).mapInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
t AS MATERIALIZED (SELECT r, vec_id, unnest([0] || v) AS w, unnest(range(0, len(v) + 1)) AS t FROM x),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
      FROM t q JOIN t c ON q.t = c.t AND q.r <> c.r WHERE q.vec_id % 20 = 0 GROUP BY q.r, q.vec_id, c.r, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
