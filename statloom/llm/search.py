"""Exact top-k search by inner product through multi-resolution segment statistics.

A vector's segments have a mean and a deviation (the length of what is left without the mean). By Cauchy and Schwarz a segment adds at most
length * mean_q * mean_x + deviation_q * deviation_x to the inner product, that is, it bounds the distance from below. Bounds go from one
segment to many; only pairs whose bound reaches the k-th best product so far are looked at more finely, and the last
survivors are multiplied out in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = (1, 4, 16)
#: Queries that are sent to executors at once; queries and rows that are compared at once.
QUERY_BLOCK, QUERY_TILE, ROW_TILE = 8192, 512, 4096
#: Share of pairs from which on a level is computed for all pairs of a tile.
DENSE = 0.2


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Vectors whose inner products are the bounds at one level: per segment sqrt(length) * mean, then the deviations."""
    pad = -x.shape[1] % segments
    parts = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), segments, -1).astype(np.float64)
    mean = parts.mean(axis=2)
    rest = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return np.concatenate([mean * np.sqrt(parts.shape[2]), rest], axis=1)


class TopK:
    """The k best (score, id) of each query over rows given in any pieces; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.filled = np.zeros(len(ids), np.int64)
        self.compared = self.exact = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        at, tile = 0, max(self.k * 2, 64)
        while at < len(ids):  # a small first tile sets the bounds
            part = slice(at, at + tile)
            levels = [statistics(rows[part], s) for s in LEVELS]
            for q in range(0, len(self.ids), QUERY_TILE):
                self._tile(slice(q, q + QUERY_TILE), ids[part], rows[part], levels)
            at, tile = at + tile, ROW_TILE

    def _tile(self, own: slice, ids: np.ndarray, rows: np.ndarray, levels: list[np.ndarray]) -> None:
        vectors, mine = self.vectors[own], self.ids[own]
        least = np.where(self.filled[own] < self.k, -np.inf, self.score[own][:, -1].astype(np.float64))
        q = x = None
        for level, (a, b) in enumerate(zip(self.levels, levels)):
            a = a[own]
            slack = 1e-6 + 1e-9 * np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1).max())
            if q is None:
                keep = a @ b.T >= (least - slack)[:, None]
                if level == 0:
                    keep &= mine[:, None] != ids[None, :]
                    alive = keep
                else:
                    alive &= keep
                if alive.mean() < DENSE:
                    q, x = np.nonzero(alive)
            else:
                bound = np.concatenate([np.einsum("ij,ij->i", a[q[i : i + 500_000]], b[x[i : i + 500_000]]) for i in range(0, len(q), 500_000)] or [np.zeros(0)])
                stay = bound >= (least - slack)[q]
                q, x = q[stay], x[stay]
        self.compared += alive.size
        if q is None:
            q, x = np.nonzero(alive)
            top = float(np.abs(vectors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * vectors.shape[1]
            score = (vectors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)[q, x] if top < 2**53 else (vectors @ rows.T)[q, x]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", vectors[q[i : i + 500_000]], rows[x[i : i + 500_000]]) for i in range(0, len(q), 500_000)] or [np.zeros(0, np.int64)])
        self.exact += len(q)
        live = np.arange(self.k)[None, :] < self.filled[own][:, None]
        old_q, old_k = np.nonzero(live)
        q, score, found = np.r_[old_q, q], np.r_[self.score[own][old_q, old_k], score], np.r_[self.id[own][old_q, old_k], ids[x]]
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        first = rank < self.k
        self.score[own][q[first], rank[first]], self.id[own][q[first], rank[first]] = score[first], found[first]
        self.filled[own] = np.minimum(np.bincount(q, minlength=len(mine)), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r = np.nonzero(np.arange(self.k)[None, :] < self.filled[:, None])
        return self.ids[q], self.id[q, r], self.score[q, r]


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """Rows (key, v): floor(scale * x) of each component; without rows whose key or vector is null or whose vector has a null or non-finite component."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    return table.where(F.col(key).isNotNull() & x.isNotNull() & finite).select(F.col(key).cast("bigint").alias(key), whole.alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one matrix; shorter vectors end in zeros."""
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    flat = np.asarray(lists.flatten())
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of greatest inner product for each query row, among all rows with another key; rows (query_id, rank, key, score).

    ``vectors`` is (key, v) as of ``whole_vectors``. Ties go to the smaller key. Queries of one key and vector count once; repeated rows are
    candidates each. An empty table gives no rows. Queries go out in blocks of at most ``block``, so what is
    broadcast does not grow with the input; every task keeps k rows a query of its block, and these partial lists are merged.
    """
    asked = vectors.where(is_query).dropDuplicates([key, "v"])
    count = asked.count()
    blocks = -(-count // block)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64(key, "v"), F.lit(max(1, blocks * 2 if blocks > 1 else 1))))
    spark, parts = vectors.sparkSession, []
    for i in range(blocks * 2 if blocks > 1 else blocks):
        chosen = numbered.where(F.col("block") == i).select(key, "v").orderBy(key).collect()
        if not chosen:
            continue
        width = max(len(r.v) for r in chosen)
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in chosen], np.int64), np.array([r.v + [0] * (width - len(r.v)) for r in chosen], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, own = sent.value
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = _matrix(batch.column(1), own.shape[1])
                if best is None or rows.shape[1] > best.vectors.shape[1]:
                    wide = TopK(ids, np.pad(own, ((0, 0), (0, rows.shape[1] - own.shape[1]))), k)
                    if best is not None:
                        wide.score, wide.id, wide.filled = best.score, best.id, best.filled
                    best = wide
                elif rows.shape[1] < best.vectors.shape[1]:
                    rows = np.pad(rows, ((0, 0), (0, best.vectors.shape[1] - rows.shape[1])))
                best.add(np.asarray(batch.column(0)), rows)
            if best is not None:
                q, x, s = best.rows()
                for a in range(0, len(q), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (q, x, s)], names=["query_id", key, "score"])

        parts.append(vectors.mapInArrow(run, f"query_id bigint, `{key}` bigint, score bigint"))
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{key}` bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
