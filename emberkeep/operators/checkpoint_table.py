"""A stored checkpoint table in hash buckets: a merge writes only the buckets that its updates touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # a stored table keeps its number; choose it so that a bucket is about a file
FOLDED = "agent_id string, data string, created_at long, updated_at long, bucket int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def fold_rows(rows: DataFrame) -> DataFrame:
    """One row an agent from rows of any age: the newest data, the first and the last time.

    The fold is the same for rows that it has seen before and for any order, so
    a merge that is run again changes nothing.
    """
    return rows.groupBy("agent_id").agg(
        F.max_by("data", F.struct("updated_at", "data")).alias("data"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored checkpoints: agent_id, data, size_bytes, created_at, updated_at; an unwritten table is empty."""
    if not exists(spark, f"{path}/table"):
        return spark.createDataFrame([], FOLDED).select(*_shown())
    return spark.read.schema(FOLDED).parquet(f"{path}/table").select(*_shown())


def _shown() -> list[Column | str]:
    return ["agent_id", "data", F.octet_length("data").cast("long").alias("size_bytes"), "created_at", "updated_at"]


def merge_into_table(spark: SparkSession, path: str, updates: DataFrame, merge_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Fold updates (agent_id, data, created_at, updated_at) into the table below ``path`` and return it.

    The folded buckets are first written apart, under ``merge_id``; then they
    replace theirs in the table by dynamic partition overwrite.  A merge that
    broke off between the two goes on from what was written apart, so a bucket
    that was already taken away isn't lost; one that is run again as a whole
    leaves the same rows.  Updates are reduced per agent before they meet the
    table, of which only their buckets are read.
    """
    apart, table = f"{path}/merges/{merge_id}", f"{path}/table"
    if not exists(spark, f"{apart}/_SUCCESS"):
        latest = fold_rows(updates.select("agent_id", "data", "created_at", "updated_at"))
        known = latest.withColumn("bucket", bucket_of(F.col("agent_id"), buckets))
        merged = known
        if exists(spark, table):
            touched = sorted(r.bucket for r in known.select("bucket").distinct().collect())  # no more than there are buckets
            before = spark.read.schema(FOLDED).parquet(table).where(F.col("bucket").isin(touched))
            merged = fold_rows(known.unionByName(before)).withColumn("bucket", bucket_of(F.col("agent_id"), buckets))
        merged.write.mode("overwrite").parquet(apart)
    folded = spark.read.schema(FOLDED).parquet(apart).repartition("bucket")
    folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    return read_table(spark, path)
