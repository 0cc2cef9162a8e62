"""Dense search: exact cosine top-k of a batch of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import runtime
from .sparse import top_k

#: queries whose vectors are broadcast together; more are searched in blocks
BLOCK = 4096
#: scores that a task holds at once
CELLS = 4_000_000


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 50, threshold: float | None = 0.60, where=None) -> DataFrame:
    """vectors (chunk_id, vector), queries (query_id, vector) → (query_id,
    chunk_id, score, rnk).

    Every task scores its rows against the broadcast query matrix, a matrix
    product for some rows at a time, and passes on a row only where it is among
    the task's best k for a query so far; the exact top-k of those is the
    result. Scores below the threshold are dropped first,
    and ``where`` filters the vectors before anything is scored. Queries beyond
    BLOCK take further passes over the vectors. k <= 0 keeps everything.
    """
    spark = vectors.sparkSession
    runtime.send_package(spark)
    v = (vectors.where(where) if where is not None else vectors).where("vector IS NOT NULL").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    id_type = v.schema["chunk_id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    q_arrow = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {q_type}, chunk_id {id_type}, score double"

    def one(ids: list, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, _unit(matrix)))

        def run(batches):
            ids, m = shared.value
            id_array = pa.array(ids, q_arrow)
            step = max(64, CELLS // max(1, len(ids)))
            best = np.full((len(ids), k), -np.inf) if 0 < k * len(ids) <= CELLS else None
            for b in batches:
                for lo in range(0, b.num_rows if len(ids) else 0, step):
                    some = b.slice(lo, step)
                    s = m @ _unit(_rows(some.column("vector"))).T
                    keep = np.ones(s.shape, bool) if threshold is None else s >= threshold
                    if best is not None:
                        # the k best so far; rows that equal the last of them
                        # after rounding stay, for ties by id
                        pool = np.concatenate([best, np.where(keep, s, -np.inf)], axis=1)
                        best = np.partition(pool, -k, axis=1)[:, -k:]
                        keep &= s >= best.min(axis=1, keepdims=True) - 1e-8
                    i, j = np.nonzero(keep)
                    yield pa.record_batch({"query_id": id_array.take(pa.array(i)), "chunk_id": some.column("chunk_id").take(pa.array(j)), "score": pa.array(s[i, j])})

        return v.mapInArrow(run, schema)

    q = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    parts, ids, rows = [], [], []
    for r in q.toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["vector"])
        if len(ids) == BLOCK:
            parts.append(one(ids, np.array(rows)))
            ids, rows = [], []
    if ids or not parts:
        parts.append(one(ids, np.array(rows) if rows else np.zeros((0, 0))))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return top_k(found, k)
