"""Many-query cosine search and similarity joins as blocked matrix products.

Nothing here emits a candidate pair: a task multiplies two bounded blocks and
only keeps what belongs in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.functions.vectors import SCORE_DECIMALS
from emberkeep.session import work_dir

QUERY_BYTES_LIMIT = 64 << 20  # largest query matrix sent to every executor
BLOCK_ROWS = 20_000  # rows per side of one matrix product
PART_ROWS, PART_QUERIES = 2_000, 500  # of one product in a many-query search: 8 MB of scores
LEAST_PIVOTS = 16
PRODUCT_ROWS = 250  # left rows of one matrix product in a block
PAIRS = "id_a string, id_b string, score double"
MATCH_SCHEMA = "query_id string, id string, score double"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of an Arrow list column whose lists share one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a @ b.T, SCORE_DECIMALS)


def _usable(df: DataFrame, dim: int) -> DataFrame:
    """Rows of the right dimension whose vector is finite, without nulls and not all zeros."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where((F.size("embedding") == dim) & sound & F.exists("embedding", lambda x: x != 0))


class _Best:
    """The k best (score, id) pairs per query seen so far in one task."""

    def __init__(self, query_ids: list[str], k: int):
        self.query_ids, self.k = query_ids, k
        self.ids = [np.empty(0, dtype=object)] * len(query_ids)
        self.scores = [np.empty(0)] * len(query_ids)
        self.floor = np.full(len(query_ids), -np.inf)  # what a score has to reach once k are held

    def add_all(self, wanted: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Every query, a row of ``wanted``, against every row of ``matrix``, in products of bounded size."""
        for row in range(0, len(ids), PART_ROWS):
            part, names = matrix[row:row + PART_ROWS], ids[row:row + PART_ROWS]
            for first in range(0, len(wanted), PART_QUERIES):
                self.add(names, _scores(wanted[first:first + PART_QUERIES], part), first)

    def add(self, ids: np.ndarray, scores: np.ndarray, first: int = 0) -> None:
        """``scores`` has one row per query, from the one at ``first`` on, and one column per id."""
        # Most batches improve few queries; the others are settled by their maximum.
        for at in np.flatnonzero(scores.max(axis=1) >= self.floor[first:first + len(scores)]):
            q = first + at
            row, held = scores[at], self.scores[q]
            if len(row) > self.k:
                pick = np.flatnonzero(row >= max(np.partition(row, -self.k)[-self.k], self.floor[q]))
            else:
                pick = np.arange(len(row))
            all_scores = np.concatenate([held, row[pick]])
            all_ids = np.concatenate([self.ids[q], ids[pick]])
            order = sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))[: self.k]
            self.scores[q], self.ids[q] = all_scores[order], all_ids[order]
            if len(order) == self.k:
                self.floor[q] = self.scores[q][-1]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What is held, some queries at a time."""
        for at in range(0, len(self.query_ids), PART_ROWS):
            ids, scores = self.ids[at:at + PART_ROWS], self.scores[at:at + PART_ROWS]
            names = np.repeat(np.array(self.query_ids[at:at + PART_ROWS], dtype=object), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate(ids), pa.string()), pa.array(np.concatenate(scores), pa.float64())], schema=MATCH_TYPE)


MATCH_TYPE = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])


def _final_topk(partial: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_topk_batch(
    entries: DataFrame, queries: DataFrame, k: int, dim: int, query_bytes_limit: int = QUERY_BYTES_LIMIT
) -> DataFrame:
    """Exact top-k per query: ``queries`` has (query_id, embedding), both ids are strings.

    A query matrix within the byte limit is measured first and then sent to
    every executor, so the entries never shuffle; a task multiplies a bounded
    part of either side at a time.  A larger one goes through
    the block grid, where each cell holds one bounded block of each side.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    entries = _usable(entries.select("id", "embedding"), dim)
    queries = _usable(queries.select("query_id", "embedding"), dim)
    n_queries = queries.count()
    if n_queries * (dim * 8 + 64) > query_bytes_limit:
        return _final_topk(_grid_topk(entries, queries, k, n_queries), k)
    local = queries.toArrow()
    if not local.num_rows:
        return entries.sparkSession.createDataFrame([], MATCH_SCHEMA + ", rank int")
    names = local.column("query_id").to_pylist()
    shared = entries.sparkSession.sparkContext.broadcast(_matrix(local.column("embedding")))

    def kernel(batches):
        best = _Best(names, k)
        for batch in batches:
            if batch.num_rows:
                best.add_all(shared.value, np.array(batch.column("id").to_pylist(), dtype=object), _matrix(batch.column("embedding")))
        yield from best.batches()

    return _final_topk(entries.mapInArrow(kernel, MATCH_SCHEMA), k)


def _hash_block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _grid_topk(entries: DataFrame, queries: DataFrame, k: int, n_queries: int) -> DataFrame:
    e_blocks = max(1, math.ceil(entries.count() / BLOCK_ROWS))
    q_blocks = max(1, math.ceil(n_queries / BLOCK_ROWS))
    left = entries.select("id", F.col("embedding").alias("embedding")).withColumns({
        "e": _hash_block("id", e_blocks), "q": F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))})
    right = queries.select("query_id", F.col("embedding").alias("embedding")).withColumns({
        "q": _hash_block("query_id", q_blocks), "e": F.explode(F.sequence(F.lit(0), F.lit(e_blocks - 1)))})

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return MATCH_TYPE.empty_table()
        best = _Best(b.column("query_id").to_pylist(), k)
        best.add_all(_matrix(b.column("embedding")), np.array(a.column("id").to_pylist(), dtype=object), _matrix(a.column("embedding")))
        return pa.Table.from_batches(best.batches(), MATCH_TYPE)

    return left.groupBy("e", "q").cogroup(right.groupBy("e", "q")).applyInArrow(kernel, MATCH_SCHEMA)


def distinct_vectors(df: DataFrame) -> DataFrame:
    """One row per distinct vector: the smallest id stands for all its copies.

    The aggregate combines before it shuffles, so a vector that makes up a
    third of the table costs one row per task.
    """
    return df.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def copy_members(df: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, representative): expands a result over representatives to all rows."""
    return df.join(distinct.select("embedding", F.col("id").alias("representative")), "embedding").select("id", "representative")


PIVOT_BYTES = 64 << 20  # most that the pivots may take in every task
SAMPLED = 4_000  # vectors that the order of the dimensions is taken from
SLACK = 1e-9


def pivot_count(rows: int, dim: int) -> int:
    """Half the square root of the row count, as far as that fits in every task."""
    return max(1, min(max(LEAST_PIVOTS, math.isqrt(rows) // 2), PIVOT_BYTES // (8 * dim)))


def leading_rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix that puts the directions in which a sample varies most first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1].copy()


def block_matches(x: np.ndarray, y: np.ndarray, threshold: float, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of rotated unit rows with cosine >= ``threshold``: places, scores, and how many pairs were multiplied in full.

    What the dimensions after the first m add to a product is no more than the
    product of the rests' lengths.  A quarter of the dimensions bounds all
    pairs in one matrix product, half of them the pairs that are left, and only
    those that still may reach the threshold are multiplied.  ``wanted`` rules
    out pairs by a truth value each.
    """
    dim = x.shape[1]

    def rest(rows: np.ndarray, m: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", rows[:, :m], rows[:, :m])))

    first, second = max(1, dim // 4), max(1, dim // 2)
    bounds = x[:, :first] @ y[:, :first].T + np.outer(rest(x, first), rest(y, first))
    near = bounds >= threshold - SLACK
    if wanted is not None:
        near &= wanted
    rows, cols = np.nonzero(near)
    bound = np.einsum("ij,ij->i", x[rows, :second], y[cols, :second]) + rest(x, second)[rows] * rest(y, second)[cols]
    kept = bound >= threshold - SLACK
    rows, cols = rows[kept], cols[kept]
    scores = np.round(np.einsum("ij,ij->i", x[rows], y[cols]), SCORE_DECIMALS)
    found = scores >= threshold
    return rows[found], cols[found], scores[found], len(rows)


def _grid_blocks(rows: int) -> int:
    """Blocks of ``GRID_ROWS``, or smaller ones that give more than a task or two."""
    return max(math.ceil(rows / GRID_ROWS), min(8, math.ceil(rows / 1_000)), 1)


def _staged(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back, so that passes over it don't repeat what made it."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pivots:
    """Reference directions in two levels: every pivot belongs to the nearest of a few tops."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        self.tops = centers[: max(1, math.isqrt(len(centers)))]
        top = (centers @ self.tops.T).argmax(axis=1)
        top[: len(self.tops)] = np.arange(len(self.tops))  # a top is its own, also beside an equal one
        self.children = [np.flatnonzero(top == t) for t in range(len(self.tops))]

    @staticmethod
    def _angles(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(rows @ centers.T, -1, 1))

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the nearest pivot below its nearest top, the angle to it, and the angle to the top."""
        to_top = self._angles(rows, self.tops)
        top = to_top.argmin(axis=1)
        home, angle = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            angles = self._angles(rows[mine], self.centers[self.children[t]])
            best = angles.argmin(axis=1)
            home[mine], angle[mine] = self.children[t][best], angles[np.arange(len(mine)), best]
        return home, angle, to_top[np.arange(len(rows)), top]

    def reachable(self, rows: np.ndarray, reach: float, radius: np.ndarray) -> list[list[int]]:
        """The pivots whose rows may lie within ``reach`` of each row; ``radius`` is the widest angle of each pivot's rows, -inf for none.

        A top is passed over by the widest angle from it to any row of its
        pivots, which the pivot's angle and radius bound.
        """
        out: list[list[int]] = [[] for _ in range(len(rows))]
        to_top = self._angles(rows, self.tops)
        for t, children in enumerate(self.children):
            spread = (self._angles(self.tops[t : t + 1], self.centers[children])[0] + radius[children]).max()
            near = np.flatnonzero(to_top[:, t] <= reach + spread)
            if len(near):
                inside = self._angles(rows[near], self.centers[children]) <= reach + radius[children]
                for i, held in zip(near.tolist(), inside):
                    out[i] += children[held].tolist()
        return out


GRID_ROWS = 25_000  # rows of one block where every block meets every other
PAIR_ROWS = 50_000  # pairs that are multiplied in double precision at a time


def dense_matches(x: np.ndarray, y: np.ndarray, threshold: float, above: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of unit rows with cosine >= ``threshold``, a bounded number at a time: places and scores.

    A product in single precision, which is off by less than the margin, rules
    out most pairs.  With ``above`` only those whose second place is the later.
    """
    margin = 2.4e-7 * (x.shape[1] + 4)
    small_x, small_y = x.astype("f4"), y.astype("f4").T
    for at in range(0, len(x), PRODUCT_ROWS):
        near = small_x[at:at + PRODUCT_ROWS] @ small_y >= threshold - margin
        rows, cols = np.divmod(np.flatnonzero(near), len(y))
        rows += at
        if above:
            later = cols > rows
            rows, cols = rows[later], cols[later]
        for i in range(0, len(rows), PAIR_ROWS):
            r, c = rows[i:i + PAIR_ROWS], cols[i:i + PAIR_ROWS]
            scores = np.round(np.einsum("ij,ij->i", x[r], y[c]), SCORE_DECIMALS)
            found = scores >= threshold
            yield r[found], c[found], scores[found]


def _grid_join(left: DataFrame, right: DataFrame | None, blocks: tuple[int, int], threshold: float, carry: list[str], schema: str) -> DataFrame:
    """All pairs in cells of one block a side; a block and itself make one cell, and two blocks of one side another."""

    def cells(df: DataFrame, side: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - side] - 1)))
        placed = df.withColumns({"side": F.lit(side), "own": _hash_block("id", blocks[side]), "other": other})
        low, high = (F.least("own", "other"), F.greatest("own", "other")) if right is None else (("own", "other") if side == 0 else ("other", "own"))
        first = (F.col("own") == low) if right is None else F.lit(side == 0)
        return placed.select("id", "embedding", *carry, first.alias("first"), F.col("side"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in ((low, "a"), (high, "b"))])

    placed = cells(left, 0) if right is None else cells(left, 0).unionByName(cells(right, 1))
    one_sided = right is None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        shown, matrix = rows.select(["id", *carry]), _matrix(rows.column("embedding"))
        itself = one_sided and rows.column("a")[0].as_py() == rows.column("b")[0].as_py()
        first = rows.column("first").to_numpy()
        x, y = (np.arange(len(matrix)),) * 2 if itself else (np.flatnonzero(first), np.flatnonzero(~first))
        if not len(x) or not len(y):
            return
        order = np.unique(np.array(rows.column("id").to_pylist(), dtype=object), return_inverse=True)[1] if one_sided else None
        for r, c, scores in dense_matches(matrix[x], matrix[y], threshold, itself):
            i, j = x[r], y[c]
            if one_sided:
                kept = order[i] != order[j]
                i, j, scores = i[kept], j[kept], scores[kept]
                i, j = np.where(order[i] < order[j], i, j), np.where(order[i] < order[j], j, i)
            if len(i):
                one, two = shown.take(i).combine_chunks(), shown.take(j).combine_chunks()
                columns = [one.column("id"), two.column("id"), pa.chunked_array([pa.array(scores)]), *[t.column(n) for n in carry for t in (one, two)]]
                names = ["id_a", "id_b", "score", *[f"{n}_{side}" for n in carry for side in "ab"]]
                yield from pa.table(columns, names=names).to_batches()

    return placed.groupBy("a", "b").applyInArrow(kernel, schema)


def similarity_join(
    a: DataFrame, b: DataFrame | None, threshold: float, dim: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every pair with cosine >= ``threshold``; without ``b``, each pair of ``a`` once.

    Exact pruning in two ways.  Angles obey the triangle inequality: rows of
    the right side live with a pivot, whose widest angle is known, and a left
    row only visits pivots that can hold a partner.  There are as many pivots
    as half the square root of the rows, in two levels, so finding them costs
    each row little.  Inside a block the leading dimensions bound a pair before
    it is multiplied.  Crowded pivots split by hash on both sides, so a task
    holds ``block_rows`` rows of a side.  Both sides should hold distinct
    vectors (``distinct_vectors``), since copies would multiply in the result.
    Where a row would visit as many pivots as there are blocks of rows, as at a
    low threshold or with vectors at nearly one angle from all others, every
    block meets every other instead.  Columns to ``carry`` come along from both
    sides, as ``name_a`` and ``name_b``, without another join.
    """
    one_sided, carry = b is None, list(carry)
    kinds = dict(a.dtypes)
    schema = ", ".join([PAIRS, *[f"`{c}_{side}` {kinds[c]}" for c in carry for side in "ab"]])
    left = _staged(_usable(a.select("id", "embedding", *carry), dim).where(F.col("id").isNotNull() | F.lit(not one_sided)), "left")
    right = left if one_sided else _staged(_usable(b.select("id", "embedding", *carry), dim), "right")
    total = right.count()
    if not total:
        return a.sparkSession.createDataFrame([], schema)
    wanted = min(total, pivots or pivot_count(total, dim))
    drawn = min(1.0, 1.2 * (max(wanted, min(SAMPLED, total)) + 10) / total)
    sample = _matrix(right.select("embedding").sample(drawn, seed=11).toArrow().column("embedding")) if drawn < 1 else _matrix(right.select("embedding").toArrow().column("embedding"))
    if not len(sample):
        sample = np.eye(dim)[:1]  # any direction serves as a pivot
    index, rotation = Pivots(sample[:wanted]), leading_rotation(sample[:SAMPLED])
    reach = math.acos(max(-1.0, min(1.0, threshold - 10.0**-SCORE_DECIMALS))) + 1e-6
    blocks = _grid_blocks(total)
    if pivots is None:
        homes, angles, _ = index.home(sample)
        widest = np.full(len(index.centers), -np.inf)
        np.maximum.at(widest, homes, angles)
        if np.mean([len(x) for x in index.reachable(sample[:SAMPLED // 8], reach, widest)]) >= blocks:
            return _grid_join(left, None if one_sided else right, (blocks if one_sided else _grid_blocks(left.count()), blocks), threshold, carry, schema)

    @F.arrow_udf("struct<home:int,angle:double>")
    def nearest(v: pa.Array) -> pa.Array:
        home, angle, _ = index.home(_matrix(v))
        return pa.StructArray.from_arrays([pa.array(home, pa.int32()), pa.array(angle)], ["home", "angle"])

    homed = right.withColumn("at", nearest("embedding")).select("id", "embedding", *carry, "at.home", "at.angle")
    sizes = homed.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    radius, b_split = np.full(len(index.centers), -np.inf), {}
    for row in sizes.collect():  # one row a pivot
        radius[row.home], b_split[row.home] = row.radius + 1e-9, math.ceil(row.n / block_rows)

    @F.arrow_udf("array<int>")
    def reachable(v: pa.Array) -> pa.Array:
        return pa.array(index.reachable(_matrix(v), reach, radius), pa.list_(pa.int32()))

    visits = _staged(left.withColumn("homes", reachable("embedding")), "visits").select("id", "embedding", *carry, F.explode("homes").alias("home"))
    a_split = {r.home: math.ceil(r.n / block_rows) for r in visits.groupBy("home").agg(F.count("*").alias("n")).collect()}
    splits = a.sparkSession.createDataFrame(
        [(h, a_split.get(h, 1), n) for h, n in sorted(b_split.items())], "home int, splits_a int, splits_b int")  # a pivot each

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        # Aliases give both sides columns of their own where they come from one table.
        placed = df.select(*[F.col(c).alias(c) for c in ("id", "embedding", *carry, "home")]).join(F.broadcast(splits), "home")
        return placed.select(
            "id", "embedding", *carry, "home", F.pmod(F.xxhash64("id"), F.col(f"splits_{own}")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"splits_{other}") - 1)).alias(other))

    lhs, rhs = cells(visits, "a", "b"), cells(homed, "b", "a")
    pair_names = ["id_a", "id_b", "score", *[f"{c}_{side}" for c in carry for side in "ab"]]

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        out_type = pa.schema([("id_a", pa.string()), ("id_b", pa.string()), ("score", pa.float64()), *[(f"{c}_{side}", x.schema.field(c).type) for c in carry for side in "ab"]])
        if not x.num_rows or not y.num_rows:
            return out_type.empty_table()
        ids_x, ids_y = (np.array(t.column("id").to_pylist(), dtype=object) for t in (x, y))
        mx, my = _matrix(x.column("embedding")) @ rotation, _matrix(y.column("embedding")) @ rotation
        parts = []
        for at in range(0, len(ids_x), PRODUCT_ROWS):
            order = ids_x[at:at + PRODUCT_ROWS, None] < ids_y[None, :] if one_sided else None
            rows, cols, scores, _ = block_matches(mx[at:at + PRODUCT_ROWS], my, threshold, order)
            brought = [t.column(c).combine_chunks().take(pa.array(i)) for c in carry for t, i in ((x, at + rows), (y, cols))]
            parts.append(pa.table([pa.array(ids_x[at + rows], pa.string()), pa.array(ids_y[cols], pa.string()), pa.array(scores), *brought], names=pair_names))
        return pa.concat_tables(parts)

    keys = ["home", "a", "b"]
    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInArrow(kernel, schema)
