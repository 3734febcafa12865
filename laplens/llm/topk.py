"""Exact top-k search by inner product, with one KD-tree per shard.

Vectors are dealt over shards of bounded size. Each shard builds a KD-tree by median splits on the widest side, down
to leaves with tight bounding boxes. A query's inner product with any vector of a box is at most the sum of the
larger products with the box's two faces. Leaves are visited best bound first, until the bound falls below the kth
score so far. That score is propagated: a first pass searches only one shard per query, and the others start from
its kth score. Queries go in blocks, so a task holds one shard and one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplens.session import hold, ship

LONG = np.iinfo(np.int64)
#: Below every score, and its negative is a long too.
NONE = LONG.min + 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as an integral double. Rows with a null id, a null vector or a null or
    non-finite component take no part; equal rows count once."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0 ** 52, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return (vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
            .filter(~F.exists("x", odd)).select("vec_id", whole.alias("v")).distinct())


def build_tree(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a KD-tree: median splits on the widest side."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) > leaf else np.zeros(1)
        if not spread.any():
            leaves.append(rows)
            continue
        side = int(spread.argmax())
        half = len(rows) // 2
        order = np.argpartition(points[rows, side], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return leaves


def products(queries: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products. Doubles hold them exactly while sums stay below 2**53; beyond that Python integers do, and
    scores outside the 64-bit range are set near its ends."""
    if exact:
        return (queries @ points.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in points], object).T
    return np.array([[min(max(int(x), NONE + 1), LONG.max) for x in row] for row in big], np.int64)


def search_shard(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, leaf: int):
    """Best ``k`` of a shard for each query: row numbers of queries, ids and scores. ``floor`` is a score that k vectors
    elsewhere reach at least (a very small number if unknown); what lies below it is not needed."""
    with np.errstate(over="ignore", invalid="ignore"):
        exact = bool(np.abs(points).max(initial=0.0) * np.abs(queries).max(initial=0.0) * max(points.shape[1], 1) < 2.0 ** 53)
    if not points.shape[1]:  # vectors without components: every product is 0
        points, queries = np.zeros((len(points), 1)), np.zeros((len(queries), 1))
    leaves = build_tree(points, leaf)
    low = np.stack([points[r].min(axis=0) for r in leaves])
    high = np.stack([points[r].max(axis=0) for r in leaves])
    if exact:
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    else:
        bounds = np.full((len(queries), len(leaves)), np.inf)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best = np.full((n, k), NONE, np.int64)
    who = np.full((n, k), LONG.max, np.int64)
    full = np.zeros(n, np.int64)
    active = np.arange(n)
    for step in range(len(leaves)):  # every query visits its next best leaf; queries at the same leaf share the product
        at = order[active, step]
        kth = np.where(full[active] >= k, np.maximum(best[active, -1], floor[active]), floor[active])
        active = active[bounds[active, at] >= kth]
        if not len(active):
            break
        at = order[active, step]
        for box in np.unique(at):
            rows, members = active[at == box], leaves[box]
            for lo in range(0, len(members), 4096):
                part = members[lo: lo + 4096]
                s = products(queries[rows], points[part], exact)
                same = ids[part][None, :] == own[rows][:, None]
                all_s = np.concatenate([best[rows], np.where(same, NONE, s)], axis=1)
                all_i = np.concatenate([who[rows], np.where(same, LONG.max, np.broadcast_to(ids[part], s.shape))], axis=1)
                pick = _pick(all_s, all_i, k)
                best[rows] = np.take_along_axis(all_s, pick, 1)
                who[rows] = np.take_along_axis(all_i, pick, 1)
                full[rows] += (~same).sum(axis=1)
    there = who != LONG.max
    q, _ = np.nonzero(there)
    return q, who[there], best[there]


def _pick(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending)."""
    if scores.shape[1] <= 4 * k:
        return np.lexsort((ids, -scores), axis=1)[:, :k]
    kth = np.partition(scores, -k, axis=1)[:, -k]  # ties with the kth score are all looked at
    many = int((scores >= kth[:, None]).sum(axis=1).max())
    part = np.argpartition(-scores, min(many, scores.shape[1] - 1) - 1, axis=1)[:, :many]
    sub = np.lexsort((np.take_along_axis(ids, part, 1), -np.take_along_axis(scores, part, 1)), axis=1)[:, :k]
    return np.take_along_axis(part, sub, 1)


def _search(k: int, leaf: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, ids, scores = search_shard(np.array(points["v"].tolist(), float).reshape(len(points), -1), points["vec_id"].to_numpy(np.int64),
                                      np.array(queries["v"].tolist(), float).reshape(len(queries), -1), queries["vec_id"].to_numpy(np.int64),
                                      queries["floor"].to_numpy(np.int64), k, leaf)
        return pd.DataFrame({"query_id": queries["vec_id"].to_numpy(np.int64)[q], "vec_id": ids, "score": scores})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
          shard_rows: int = 16_384, block_rows: int = 4_096, leaf: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other vectors for each query, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. A query's own id is never among its results. Vectors of another length than the
    query's have no product with it and are not candidates. See :func:`quantised` for rows that take no part. With fewer than ``k``
    candidates all come. Further columns are not read. An empty table gives no rows."""
    ship(vectors.sparkSession)
    held = hold(quantised(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")), "vectors")
    query_rows = held.filter(is_query)
    n, q = held.count(), query_rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_rows))
    points = held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = (query_rows.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("home", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")))
    spread_points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block", "dim"]
    schema = "query_id long, vec_id long, score long"

    def searched(queries: DataFrame) -> DataFrame:
        queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of their own, as both sides are one table
        return spread_points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k, leaf), schema)

    first = hold(searched(asked.select(F.col("home").alias("shard"), "block", "dim", "vec_id", "v", F.lit(NONE).alias("floor"))), "home-hits")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    floor = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(NONE))
    rest = (asked.join(kth, asked["vec_id"] == kth["query_id"], "left")
            .select("home", "block", "dim", "vec_id", "v", F.coalesce(floor, F.lit(NONE)).alias("floor"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard != home"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(searched(rest)) if shards > 1 else first
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
