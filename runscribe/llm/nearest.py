"""Approximate nearest neighbours by collision-counting hashing.

Largest inner product becomes smallest distance by one more coordinate: data x -> (x, sqrt(M^2 - |x|^2)),
queries q -> (q, 0), M the largest norm.  Each projection of a block of vectors on a random line is a sorted
array.  A query opens a window around its own projection in every array; windows widen together by virtual
rehashing (radius 1, c, c^2, ...) without new arrays; a vector that lies in at least ``threshold`` of the
windows is verified by its exact inner product.  A query stops widening when it has verified its share.

The index is built over blocks of rows; each block of queries meets each block of vectors in one task and
keeps k rows a query.  All rows are indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return table.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & some).select("vec_id", v.cast("array<double>").alias("vector"))


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The inner product of each row with ``query``, added up from the first component to the last.

    A library's matrix product adds in an order that depends on a row's place, so equal rows could differ in their last bits.
    """
    out = np.zeros(len(rows))
    for column, weight in zip(np.ascontiguousarray(rows.T), query, strict=True):
        out += column * weight
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is: by a 64-bit hash of their bits, or by sorting rows where two share one."""
    rows = np.ascontiguousarray(rows + 0.0)  # one zero
    factors = np.random.default_rng(3).integers(1, 1 << 63, rows.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = ((rows.view(np.uint64) >> np.uint64(20)) * factors + rows.view(np.uint64) * factors[::-1]).sum(axis=1, dtype=np.uint64)
    _, first, group = np.unique(hashed, return_index=True, return_inverse=True)
    if (rows[first][group] != rows).any():
        distinct, group = np.unique(rows, axis=0, return_inverse=True)
        return distinct, group.ravel()
    return rows[first], group.ravel()


def block_search(data_ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, largest: float, projections: int, threshold: float, verify_share: float, widen: float, verify_least: int = 600, seed: int = 7) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, inner product) of up to k candidates of each query, best first, by collision counting.

    Equal vectors are counted and verified as one, so they are found together and differ by vec_id only.
    """
    data, group = distinct_rows(data)
    by_group = np.lexsort((data_ids, group))
    starts = np.searchsorted(group[by_group], np.arange(len(data) + 1))
    n, dim = data.shape
    lines = np.random.default_rng(seed).standard_normal((dim + 1, projections))
    last = np.sqrt(np.maximum(0.0, largest**2 - np.einsum("ij,ij->i", data, data)))
    at = data @ lines[:-1] + last[:, None] * lines[-1]
    centre = queries @ lines[:-1]
    order = np.argsort(at, axis=0)
    arrays = np.take_along_axis(at, order, axis=0)
    columns = [np.ascontiguousarray(arrays[:, j]) for j in range(projections)]
    needed = max(1, math.ceil(threshold * projections))
    wanted = min(n, k + 1 + max(verify_least, math.ceil(verify_share * n)))
    spread = float(np.median(arrays[-1] - arrays[0])) or 1.0
    radii = spread / 8 * widen ** np.arange(math.ceil(math.log(32, widen)) + 1)
    # each sorted array is 255 equal runs, and a window ends between two of them
    run = np.arange(n + 1) * 255 // n
    place = np.empty((projections, n), np.uint8)
    np.put_along_axis(place, order.T, np.broadcast_to(run[:-1].astype(np.uint8), place.shape), axis=1)
    lows = np.stack([run[np.searchsorted(a, c[:, None] - radii, "left")] for a, c in zip(columns, centre.T, strict=True)], axis=1)
    highs = np.stack([run[np.searchsorted(a, c[:, None] + radii, "right")] for a, c in zip(columns, centre.T, strict=True)], axis=1)
    lows[:, :, -1], highs[:, :, -1] = 0, 255  # the last radius holds all
    lows, widths = lows.astype(np.uint8), (highs - lows).astype(np.uint8)
    out, at_radius = [], len(radii) // 2
    for q in range(len(queries)):
        low, width = lows[q], widths[q]

        def within(t: int) -> np.ndarray:
            inside = (place - low[:, t, None]) < width[:, t, None]  # differences wrap, so vectors below the window are far
            return np.flatnonzero(inside.sum(axis=0, dtype=np.uint8) >= needed)

        # windows only grow, so the first radius with enough collisions is walked to from that of the query before
        found = within(at_radius)
        if len(found) >= wanted:
            while at_radius and len(fewer := within(at_radius - 1)) >= wanted:
                at_radius, found = at_radius - 1, fewer
        else:
            while at_radius < len(radii) - 1 and len(found) < wanted:
                at_radius += 1
                found = within(at_radius)
        score = inner_products(data[found], queries[q])
        order = np.argsort(-score, kind="stable")
        found, score = found[order], score[order]
        last = 0  # groups that are needed: k distinct ids, and all groups that tie with the last of them
        ids: set[int] = set()
        while last < len(found) and (len(ids) < k or score[last] == score[last - 1]):
            own = data_ids[by_group[starts[found[last]] : starts[found[last] + 1]]]
            ids.update(own[own != query_ids[q]].tolist())
            last += 1
        members = [data_ids[by_group[starts[g] : starts[g + 1]]] for g in found[:last]]
        scores = np.repeat(score[:last], [len(m) for m in members])
        members = np.concatenate(members) if members else np.empty(0, np.int64)
        seen: set[int] = {int(query_ids[q])}
        for i in np.lexsort((members, -scores)).tolist():
            if (v := int(members[i])) not in seen:
                seen.add(v)
                out.append((int(query_ids[q]), v, float(scores[i])))
                if len(seen) > k:
                    break
    return out


def search(table: DataFrame, is_query, k: int = 20, block_rows: int = 8192, block_queries: int = 1024, projections: int = 96, threshold: float = 0.8, verify_share: float = 0.12, widen: float = 1.1) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by inner product, ties to the smaller vec_id.

    ``table``: vec_id, embedding; ``is_query``: a condition on it.  Vectors that are null or zero, or hold null
    or non-finite components, and rows without vec_id take no part; vectors of different lengths never meet.
    Rows that repeat a vec_id are one candidate, with their best score, and one query, by its smallest vector.
    There are under 256 projections.  With fewer than k candidates all are returned; an empty table gives no rows; extra columns are ignored.
    """
    vectors = valid_vectors(table).withColumn("dim", F.size("vector"))
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    queries = vectors.where(is_query).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    row = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.sqrt(F.max(squared)).alias("largest")).first()
    n_data, n_query, largest = max(1, math.ceil(row["n"] / block_rows)), max(1, math.ceil(row["q"] / block_queries)), row["largest"] or 0.0
    data_block, query_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_data)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query))
    data = vectors.select("dim", data_block.alias("db"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("qb"), F.lit(0).alias("kind"), "vec_id", "vector")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_data - 1).cast("long"))).alias("db"), query_block.alias("qb"), F.lit(1).alias("kind"), "vec_id", "vector")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        own, ask = block[block["kind"] == 0], block[block["kind"] == 1]
        rows = []
        if len(own) and len(ask):
            rows = block_search(own["vec_id"].to_numpy(), np.stack(own["vector"].to_list()), ask["vec_id"].to_numpy(), np.stack(ask["vector"].to_list()), k, largest, projections, threshold, verify_share, widen)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = data.unionByName(asked).groupBy("dim", "db", "qb").applyInPandas(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
