"""Best rows per user, found in tasks that read a shared table piece by piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from quillrank.operators.cut import stream

FOUND = "user_id string, split string, article_id string, score double, rank int"


class Order:
    """Numbers in the order of their ids for the articles of a stored table, to break ties by."""

    def __init__(self, files: list[str]):
        ids = pa.chunked_array([b.column("article_id").cast("large_string") for b in stream(files, ["article_id"], 100_000)] or [pa.array([], "large_string")])
        by = pc.sort_indices(ids)
        self.ids = ids.take(by).combine_chunks()
        self._code = np.empty(len(by), np.int64)
        self._code[by.to_numpy()] = np.arange(len(by))

    def codes(self, start: int, n: int) -> np.ndarray:
        """Of the ``n`` rows from ``start`` on, in the order in which ``stream`` gives them."""
        return self._code[start : start + n]


class Best:
    """The ``k`` highest scores of each user so far, equal ones by their article's number."""

    def __init__(self, users: int, k: int):
        self.k = k
        self.score = np.full((users, k), -np.inf)
        self.code = np.full((users, k), -1, np.int64)

    def chances(self, scores: np.ndarray, users, error, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of ``scores`` of ``users``, known within ``error``, that may be among the best (``positive``: and over 0)."""
        least = self.score[users, -1] - error
        short = np.flatnonzero(least == -np.inf) if scores.shape[1] >= self.k else ()
        if len(short):
            margin = np.broadcast_to(error, len(least))[short]
            least[short] = np.partition(scores[short], -self.k, axis=1)[:, -self.k].astype(np.float64) - 2 * margin
        if scores.dtype == np.float32:
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        if positive:
            least = np.maximum(least, np.nextafter(scores.dtype.type(0), scores.dtype.type(1)))
        return np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])

    def add(self, users: np.ndarray, code: np.ndarray, score: np.ndarray) -> None:
        if not len(users):
            return
        touched, new = np.unique(users, return_inverse=True)
        old = np.repeat(np.arange(len(touched)), self.k)
        row, c, s = np.concatenate([old, new]), np.concatenate([self.code[touched].ravel(), code]), np.concatenate([self.score[touched].ravel(), score])
        by = np.lexsort((c, -s, row))
        row = row[by]
        by = by[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.code[touched], self.score[touched] = c[by].reshape(-1, self.k), s[by].reshape(-1, self.k)

    def rows(self, users: pa.RecordBatch, order: Order) -> pa.RecordBatch:
        """``FOUND`` of the users, each with as many rows as it has articles."""
        i, j = np.nonzero(self.code >= 0)
        names = users.select(["user_id", "split"]).take(pa.array(i))
        ids = order.ids.take(pa.array(self.code[i, j])).cast("string")
        return pa.RecordBatch.from_arrays([*names.columns, ids, pa.array(self.score[i, j]), pa.array((j + 1).astype(np.int32))], ["user_id", "split", "article_id", "score", "rank"])


def user_blocks(spark: SparkSession, users: int, article_blocks: int, block_users: int) -> int:
    """Blocks of users: of bounded size, and enough of them to occupy all cores."""
    wanted = -(-spark.sparkContext.defaultParallelism // article_blocks)
    return max(1, -(-users // block_users), min(wanted, -(-users // 50)))
