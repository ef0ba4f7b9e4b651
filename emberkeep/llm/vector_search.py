"""Nearest neighbours by inner product: one-bit codes choose the vectors that are scored exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.llm.rotated_codes import encode, estimates, matrix, units, usable

QUERY_BLOCK, ROW_BLOCK, SCORED_AT_ONCE = 2_048, 8_192, 256
TINY = 1e-9


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            ids, asked = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            vectors, sought = matrix(rows.column("vector")), matrix(queries.column("vector"))
            directions, lengths = units(vectors)
            codes, fit = encode(directions)
            query_directions, query_lengths = units(sought)
            for first in range(0, len(asked), SCORED_AT_ONCE):
                part = slice(first, first + SCORED_AT_ONCE)
                cosine, error = estimates(codes, fit, query_directions[part])
                middle = cosine * lengths[:, None].astype(np.float32)
                spread = (error * lengths)[:, None].astype(np.float32)
                middle[ids[:, None] == asked[None, part]] = -np.inf
                lower = middle - spread
                place = max(len(ids) - k, 0)
                # What can't beat k lower bounds isn't scored.
                floor = np.partition(lower, place, axis=0)[place] if len(ids) > k else np.full(lower.shape[1], -np.inf, np.float32)
                for j, column in enumerate((middle + spread >= floor).T):
                    at = np.flatnonzero(column & (middle[:, j] > -np.inf))
                    scores = np.einsum("ij,j->i", vectors[at], sought[first + j])
                    best = np.lexsort((ids[at], -scores))[:k]
                    found.append((np.full(len(best), asked[first + j]), ids[at][best], scores[best]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, (np.int64, np.int64, np.float64)[i]) for i in range(3)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k rows of largest inner product for each query, itself left out.

    Blocks of queries meet blocks of rows.  In a pair of blocks the one-bit
    codes bound every inner product; rows that can be among the k best are
    scored in double precision on the original vectors, best first, ties to the
    smaller id; then the blocks' bests merge.  The bounds are four standard
    deviations wide.

    Null, zero and non-finite vectors and null ids take no part; vectors only
    meet those of their own length.  Ids identify rows: of rows that repeat one
    the same vector counts once.  Fewer than k rows give fewer results.
    """
    def held(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return own.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["vec_id", "vector"]).withColumn("dim", F.size("vector"))

    rows, asked = held(vectors), held(queries)
    row_blocks, query_blocks = -(-max(vectors.count(), 1) // ROW_BLOCK), -(-max(queries.count(), 1) // QUERY_BLOCK)

    def own_block(blocks: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")

    def all_blocks(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = rows.select("*", own_block(row_blocks).alias("r")).select("*", all_blocks(query_blocks).alias("q"))
    right = asked.select("*", own_block(query_blocks).alias("q")).select("*", all_blocks(row_blocks).alias("r"))
    found = left.groupBy("r", "q", "dim").cogroup(right.groupBy("r", "q", "dim")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
