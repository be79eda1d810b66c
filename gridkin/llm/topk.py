"""Exact top-k inner products, block at a time.

The terms of a vector are its dimensions, its weights whole numbers. The index lays rows down by
cell (the nearest in direction of CELLS sampled rows), so that a block, consecutive rows of one
cell, holds alike rows; a block has a forward index (its matrix of weights) and, for each term, the
largest and smallest weight. The sum over terms of what a query could get at most bounds its score
in a block. Each query takes the blocks in order of falling bounds and passes over those whose bound
is under its k-th score so far, which it carries from batch to batch of a partition; a block scores
all queries that reach it in the same turn at once. Partitions answer for their rows, and the best k
of their answers are the answer.

Queries come in portions of a fixed size, so that what goes to every partition is bounded; each
portion reads the index once, and its answers are written before the next one is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.llm._common import find_package, partitions, removed, shared_dir, written

#: Rows of a block at most.
BLOCK = 64
#: Rows that the cells are named after; the index holds every row, whatever its cell.
CELLS = 256
#: Queries that are sent to the partitions at a time.
PORTION = 16384
#: Sums below this are whole in float64.
EXACT = float(1 << 53)


def weights_of(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, as whole numbers; null if the vector is null or has a
    component that is null, infinite or not a number."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * factor)))


class Search:
    """The k best rows for each query among the rows that it has been shown; scored counts (query, block) pairs
    that were scored, passed those that the bounds ruled out."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.scored, self.passed = ids, queries, k, 0, 0
        self.best, self.best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def show(self, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
        """Rows by cell, then id."""
        new = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(ids)]])
        starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(new[:-1], new[1:], strict=True)])
        stops = np.append(starts[1:], len(ids))
        high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
        q = self.queries
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        turn = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(q))
        for t in range(len(starts)):
            blocks = turn[live, t]
            going = bound[live, blocks] >= self.best[live, -1]  # a tie can still win by its id
            self.passed += int((~going).sum()) * (len(starts) - t)
            live, blocks = live[going], blocks[going]
            if not len(live):
                break
            self.scored += len(live)
            order = np.argsort(blocks, kind="stable")
            edges = np.flatnonzero(np.diff(blocks[order])) + 1
            for own in np.split(live[order], edges):
                b = turn[own[0], t]
                self._score(own, ids[starts[b] : stops[b]], rows[starts[b] : stops[b]])

    def _score(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score = self.queries[own] @ rows.T
        score[ids[None, :] == self.ids[own][:, None]] = -np.inf
        found = np.broadcast_to(ids, score.shape)
        s = np.concatenate([self.best[own], score], 1)
        i = np.concatenate([self.best_id[own], np.where(np.isneginf(score), np.iinfo(np.int64).max, found)], 1)
        keep = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.best[own], self.best_id[own] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)

    def answers(self) -> pd.DataFrame:
        q, r = np.nonzero(~np.isneginf(self.best))
        return pd.DataFrame({"query_id": self.ids[q], "id": self.best_id[q, r], "score": self.best[q, r].astype(np.int64)})


def _matrix(vectors: pd.Series | list, width: int) -> np.ndarray:
    """One row for each vector; a shorter one ends in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _laid_out(index: DataFrame, width: int, folder: str) -> DataFrame:
    """The index by cell: id, w, cell."""
    spark = index.sparkSession
    heads = index.orderBy(F.xxhash64("id"), "id").limit(CELLS).select("w").collect()
    centers = _matrix([r.w for r in heads], width)
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast(centers)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.argmax(_matrix(batch, width) @ shared.value.T, axis=1).astype(np.int32))

    celled = index.withColumn("cell", F.pandas_udf(place, "int")("w"))
    return written(celled.repartitionByRange(partitions(spark), "cell", "id").sortWithinPartitions("cell", "id"), folder, "cells")


def top_k(
    rows: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k rows of highest inner product for each query row,
    all if there are fewer; ties go to the smaller id.

    A vector counts as floor(factor * x) for each component x, a shorter one as if it ended in
    zeros. Rows that have the query's id are the query's own and no candidates. Rows whose vector is
    null or has a null or non-finite component, and rows with a null id, take no part; repeated
    query rows answer once (of several vectors, for the least); empty tables give no rows. Sums stay
    exact below 2**53, and an index that could pass that is refused. Other columns are left alone.
    """
    find_package(rows.sparkSession)
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), weights_of(F.col(vector_col), factor).alias("w"))
        return own.where(F.col("id").isNotNull() & F.col("w").isNotNull())

    index = written(clean(rows), folder, "index")
    asked = written(clean(queries).groupBy("id").agg(F.min("w").alias("w")).withColumn("portion", F.pmod(F.xxhash64("id"), F.lit(1 << 30))), folder, "queries")
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    most = index.agg(F.max(size("w")).alias("w"), F.max(F.size("w")).alias("n")).first()
    n_asked, asked_most, asked_n = asked.agg(F.count(F.lit(1)), F.max(size(F.col("w"))), F.max(F.size("w"))).first()
    width = max(most.n or 0, asked_n or 0)
    if (most.w or 0) * (asked_most or 0) * width >= EXACT:
        raise ValueError("inner products of these vectors can pass 2**53")
    index = _laid_out(index, width, folder)
    removed(spark, folder, "index")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    portions = max(1, -(-n_asked // (PORTION // 2)))
    for p in range(portions):
        own = asked.where(F.pmod("portion", F.lit(portions)) == p).select("id", "w").collect()  # near PORTION / 2 rows
        own.sort(key=lambda r: r.id)
        shared = spark.sparkContext.broadcast((np.array([r.id for r in own], np.int64), _matrix([r.w for r in own], width)))

        def answer(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            search = Search(*shared.value, k)
            for batch in batches:
                if len(batch) and len(search.ids):
                    search.show(batch["id"].to_numpy(), _matrix(batch["w"], width), batch["cell"].to_numpy())
            yield search.answers()

        found = index.mapInPandas(answer, "query_id long, id long, score long")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        written(found, f"{folder}/answers", f"portion={p}")
        shared.destroy()
    ranked = spark.read.schema("query_id long, id long, score long, rank int").parquet(f"{folder}/answers/portion=*")
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
