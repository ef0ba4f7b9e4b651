"""Start a stream over what is there, wait for it, and read its sink."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkeep.session import STATE_STORE, work_dir

SLICES = 3
ROWS_PER_FILE = 1_000_000
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder as a file stream; schema and files are those of the table, be it one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")  # a pattern may match a file, a plain path may not


def sliced_stream(rows: DataFrame, time_col: str, closing: dict[str, Any] | None = None, slices: int = SLICES) -> DataFrame:
    """Rows of a table as a file stream of ``slices`` micro-batches in order of ``time_col``.

    ``closing`` is one row more, in a micro-batch of its own after the others.
    With a time far ahead it lets the watermark pass everything, so windows and
    sessions at the end of the data close as well.
    """
    spark = rows.sparkSession
    path = work_dir(spark, "slices")
    points = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    seen = rows.agg(F.count("*").alias("n"), F.percentile_approx(F.unix_micros(time_col), points).alias("cuts")).first()
    files = max(1, seen.n // ROWS_PER_FILE)  # as many files in each slice, so that a trigger takes one slice
    number = sum(((F.unix_micros(time_col) > F.lit(cut)).cast("int") for cut in seen.cuts or []), F.lit(0))
    for n in range(slices):
        rows.where(number == n).repartition(files).write.mode("append").parquet(path)
    if closing is not None:
        spark.createDataFrame([tuple(closing.get(c) for c in rows.columns)], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Append the stream's closed results to Parquet and read them back."""
    spark = stream.sparkSession
    base = work_dir(spark, label)
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(f"{base}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_batches(
    stream: DataFrame, label: str, mode: str, prepare: Callable[[DataFrame], DataFrame] | None = None, base: str | None = None,
    empty_batches: bool = True,
) -> DataFrame:
    """Write every micro-batch as ``batch_id=N`` and read all of them.

    A batch that is replayed overwrites its own folder, so a restart neither
    loses nor doubles rows.  ``base`` is the folder of an earlier run to go on
    with.  State that expires by the clock asks for one batch more without end;
    such a stream runs without ``empty_batches``.
    """
    spark = stream.sparkSession
    base = base or work_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{base}/table/batch_id={batch_id}")

    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, str(empty_batches).lower())
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)  # the query keeps the settings that it started with
    query.awaitTermination()
    return spark.read.parquet(f"{base}/table").withColumn("batch_id", F.col("batch_id").cast("long"))


def needs_state_store(spark: SparkSession) -> None:
    """Timers and state that expires need the store that keeps them; a session's own choice is left as it is."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
