"""Near-duplicate vectors by cosine: buckets of rotated signs, bounds from one-bit codes, exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkeep.llm.common import staged
from emberkeep.llm.components import components
from emberkeep.llm.rotated_codes import encode, estimates, matrix, rotation, units, usable

BUCKET_ROWS = 128  # what an even table would put in a bucket
BLOCK_ROWS = 2_048  # a larger bucket is compared block by block
MISS = 1e-4  # chance that a pair at the threshold meets in no table
AT_ONCE = 512


def table_plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket key and number of tables: a pair at the threshold meets somewhere but for ``MISS``."""
    bits = min(max(4, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1))), 30)
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - together))


def bucket_keys(directions: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows x tables) keys from the signs under further rotations."""
    dim = directions.shape[1]
    turns = -(-bits * tables // dim)
    signs = np.concatenate([directions @ rotation(dim, 1 + i) > 0 for i in range(turns)], axis=1)[:, : bits * tables]
    return signs.reshape(len(directions), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _keys(bits: int, tables: int) -> Callable:
    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                keys[rows] = bucket_keys(units(matrix(vectors.take(pa.array(rows))))[0], bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    return run


def _roots(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The first row of each row's group, from linked pairs."""
    root = np.arange(n)
    while True:
        before = root
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            root = new
        root = root[root]
        if (root == before).all():
            return root


def _compare(bits: int, tables: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        number, low, high = (table.column(c)[0].as_py() for c in ("table_no", "low", "high"))
        ids, copies, block = (table.column(c).to_numpy() for c in ("vec_id", "copies", "block"))
        directions, _ = units(matrix(table.column("vector")))
        keys = bucket_keys(directions, bits, number + 1)
        codes, fit = encode(directions)
        links, pairs = np.zeros(len(ids), np.int64), []
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        for first in range(0, len(right), AT_ONCE):
            some = right[first : first + AT_ONCE]
            cosine, error = estimates(codes[left], fit[left], directions[some])
            maybe = cosine + error[:, None] >= threshold
            if low == high:
                maybe &= left[:, None] < some[None, :]
            i, j = np.nonzero(maybe)
            i, j = left[i], some[j]
            sure = np.einsum("ij,ij->i", directions[i], directions[j]) >= threshold
            i, j = i[sure], j[sure]
            # A pair belongs to the first table in which it meets.
            fresh = ~(keys[i, :number] == keys[j, :number]).any(axis=1)
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            if len(i):
                pairs.append((i, j))
        at = np.flatnonzero(links)
        root = _roots(pairs, len(ids)) if pairs else np.arange(len(ids))
        return pa.table([ids[at], links[at], ids[root[at]]], names=["vec_id", "links", "root"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row; pairs of cosine ``threshold`` or more are linked.

    Equal vectors collapse first.  Each remaining vector enters one bucket of
    each table, chosen by signs under random rotations; the number of tables
    follows from the row count so that a pair at the threshold meets in one of
    them but for a chance of 1e-4.  In a bucket the one-bit code of one vector
    and the rotated other give an estimate with a bound; pairs whose bound
    reaches the threshold are recomputed in double precision, and only those
    count.  No pair leaves its bucket: links are counted there and components
    leave as one edge per row.  A bucket of many vectors is compared in blocks,
    each pair of blocks a group of its own.

    Null, zero or non-finite vectors link with nothing; vectors of different
    lengths aren't compared.  A null id has a null component and is kept; rows
    that repeat an id with the same vector link like any equal vectors.
    """
    held = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    held = held.withColumn("sound", F.col("vec_id").isNotNull() & usable(F.col("vector")))
    distinct = held.where("sound").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = staged(distinct.select("vec_id", "vector", "copies"), "vectors")
    bits, tables = table_plan(distinct.count(), threshold)
    keyed = distinct.mapInArrow(_keys(bits, tables), "vec_id long, vector array<double>, copies long, keys array<long>")
    spot = ["table_no", "dim", "key"]
    placed = keyed.select("vec_id", "vector", "copies", F.size("vector").alias("dim"), F.posexplode("keys").alias("table_no", "key"))
    sizes = placed.groupBy(*spot).agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = staged(sizes.select(*spot, F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "buckets")
    blocked = placed.join(sizes, spot).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = blocked.select(*spot, "low", "high", "block", "vec_id", "copies", "vector").groupBy(*spot, "low", "high").applyInArrow(
        _compare(bits, tables, threshold), "vec_id long, links long, root long")
    found = staged(found, "links")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = distinct.join(counted, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    known = staged(known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "vec_id").alias("least")), "known")
    sound = held.where("sound").join(known, "vector").select("vec_id", F.col("links").alias("n_links"), F.col("least").alias("component_id"))
    rest = held.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
