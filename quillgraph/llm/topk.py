"""Exact top-k search with Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt by hash into blocks and queries into blocks; a task takes one pair of blocks. In a block
each dimension has its list of candidates sorted by component, read from the top where the query's component is
positive and from the bottom where it is negative; where it is zero the list is not read. Lists are read to equal
depth, in steps that double; a candidate met for the first time is scored in full; the threshold is the score that the components at this depth would give. Reading stops
when the threshold is below the kth score so far: nothing unread can reach it, ties included. The k best of each
block are then merged.

Both sides are dealt in blocks of a bounded number of rows, so a task's memory does not follow the input.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors of another
length than the query's are no candidates of it; equal scores go to the smaller vec_id; fewer candidates than k
give them all; an empty table gives no rows; repeated rows are separate candidates except those with the query's
own vec_id; of query rows with one vec_id the least vector counts. Components are floor(scale * x); scores are exact while they stay below 2^63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
OUT = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long; only whole, finite vectors."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (
        table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    )


def sorted_lists(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Of one block: in each dimension the rows by ascending component (order) and those components (at)."""
    order = np.argsort(vectors, axis=0, kind="stable")
    return {"order": order, "at": np.take_along_axis(vectors, order, axis=0)}


def threshold_search(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int, lists: dict, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of one block for one query. read: gets the depth at which reading stopped."""
    n = len(ids)
    dims = np.flatnonzero(query)
    if not len(dims):  # nothing to read: all scores are 0
        keep = np.sort(ids[ids != own], kind="stable")[:k]
        return keep, np.zeros(len(keep), np.int64)
    q, up = query[dims], query[dims] > 0
    order, at = lists["order"], lists["at"]
    met = np.zeros(n, bool)
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step = 0, max(2, k // 4)
    while depth < n:
        reach = min(n, depth + step)
        new = np.concatenate([order[n - reach : n - depth][:, dims[up]].ravel(), order[depth:reach][:, dims[~up]].ravel()])
        new = np.unique(new[~met[new]])
        met[new] = True
        new = new[ids[new] != own]
        depth, step = reach, step * 2
        if len(new):
            best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, vectors[new] @ query])
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        edge = np.where(up, at[n - depth, dims], at[depth - 1, dims])
        if len(best) == k and int(edge @ q) < best[-1]:
            break
    if read is not None:
        read.append(depth)
    return best_ids, best


def _search_block(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = rows["v"].map(len).to_numpy() if len(rows) else np.empty(0, np.int64)
        for size, asked in queries.groupby(queries["v"].map(len)) if len(queries) else ():
            held = rows[lengths == size]
            if not len(held):
                continue
            ids = held["vec_id"].to_numpy(np.int64)
            if size == 0:
                vectors = np.zeros((len(ids), 0), np.int64)
            else:
                vectors = np.stack(held["v"].to_numpy()).astype(np.int64)
            lists = sorted_lists(vectors)
            for q, v in zip(asked["vec_id"], asked["v"]):
                got, score = threshold_search(ids, vectors, np.asarray(v, np.int64), q, k, lists)
                out.append(pd.DataFrame({"query_id": np.full(len(got), q, np.int64), "vec_id": got, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors and queries (vec_id, v array<long>): query_id, rank, vec_id, score."""
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    asked = max(1, -(-queries.count() // BLOCK_QUERIES))
    rows = vectors.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("qb")
    )
    wanted = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(
        "vec_id", "v", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(asked)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cb"),
    )
    found = wanted.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb")).applyInPandas(_search_block(k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
