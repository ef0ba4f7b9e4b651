"""Agent checkpoints: keyed upserts, size routing, lifecycle status, outputs."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkeep.operators.running import running

DEFAULT_MAX_BYTES = 50 * 1024 * 1024
PARTS_PER_ROW = 10_000  # text parts joined into one output row


def upsert_checkpoints(target: DataFrame | None, updates: DataFrame) -> DataFrame:
    """Insert by agent_id, or replace data, size and updated_at but keep created_at.

    ``updates`` has (agent_id, data, written_at) and may hold many writes of one
    key; it is reduced per key before it meets the target, so only touched
    target rows take part in the merge.
    """
    size = F.octet_length(F.col("data")).cast("long")
    latest = updates.groupBy("agent_id").agg(
        F.max_by("data", F.struct("written_at", "data")).alias("data"),
        F.min("written_at").alias("first_at"),
        F.max("written_at").alias("updated_at"),
    )
    if target is None:
        return latest.select("agent_id", "data", size.alias("size_bytes"), F.col("first_at").alias("created_at"), "updated_at")
    before = target.select("agent_id", "created_at")
    merged = latest.join(before, "agent_id", "left").select(
        "agent_id", "data", size.alias("size_bytes"), F.coalesce("created_at", "first_at").alias("created_at"), "updated_at"
    )
    untouched = target.join(latest.select("agent_id"), "agent_id", "left_anti")
    return untouched.select(*merged.columns).unionByName(merged)


def route_payload(df: DataFrame, payload: str, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Add the UTF-8 size and where the payload goes."""
    sized = df.withColumn("size_bytes", F.octet_length(F.col(payload)).cast("long"))
    oversize = F.col("size_bytes") > max_bytes
    return sized.withColumns({
        "status": F.when(oversize, "streaming_to_disk").otherwise("pending"), "in_memory": ~oversize})


def get_many(checkpoints: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk read; an unknown id stays, with nulls."""
    return ids.join(checkpoints, "agent_id", "left")


def inject_upstream(consumers: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """consumer_id -> map of each dependency to its output; misses are null.

    A dependency that is listed twice counts once.  Only the consumer's own list
    is gathered again, so its size bounds a group.
    """
    wanted = consumers.select("consumer_id", F.posexplode_outer(F.array_distinct("depends_on")).alias("pos", "agent_id"))
    found = wanted.join(checkpoints.select("agent_id", "data"), "agent_id", "left")
    entry = F.when(F.col("agent_id").isNotNull(), F.struct("pos", F.col("agent_id").alias("key"), F.col("data").alias("value")))
    listed = found.groupBy("consumer_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    pairs = F.transform("entries", lambda e: F.struct(e["key"], e["value"]))
    return listed.select("consumer_id", F.map_from_entries(pairs).alias("inputs"))


# Order of events that carry the same time.
EVENT_RANK = {"registered": 0, "committed": 1, "evicted": 2, "resolved": 3}


def event_rank(event_type: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in EVENT_RANK.items():
        out = out.when(event_type == name, rank)
    return out


def status_aggregates(max_bytes: int = DEFAULT_MAX_BYTES) -> list[Column]:
    """The lifecycle fold as aggregates that merge in any order.

    What matters is only which of a few last events came later: an eviction
    names the status only if it follows the last commit, and residency is what
    the last event that touches it says.
    """
    kind = F.col("event_type")
    at = F.struct("at_ms", event_rank(kind).alias("rank"))
    resident = (
        F.when(kind == "registered", F.coalesce(F.col("size_bytes"), F.lit(0)) <= max_bytes)
        .when(kind == "evicted", F.lit(False))
        .when(kind == "resolved", F.lit(True))
    )
    return [
        F.max(F.when(kind == "registered", at)).alias("last_registered"),
        F.max(F.when(kind.isin("committed", "resolved"), at)).alias("last_committed"),
        F.max(F.when(kind == "evicted", at)).alias("last_evicted"),
        F.max(F.when(resident.isNotNull(), F.struct(at.alias("at"), resident.alias("value")))).alias("last_resident"),
        F.max(F.when(kind == "registered", F.struct(at.alias("at"), F.col("size_bytes").alias("value")))).alias("last_size"),
        F.max("at_ms").alias("updated_ms"),
    ]


def status_columns(max_bytes: int = DEFAULT_MAX_BYTES) -> dict[str, Column]:
    committed = F.col("last_committed").isNotNull() & (
        F.col("last_registered").isNull() | (F.col("last_committed") > F.col("last_registered")))
    evicted_after = F.coalesce(F.col("last_evicted") > F.col("last_committed"), F.lit(False))
    oversize = F.col("last_size.value") > max_bytes
    status = (
        F.when(committed & evicted_after, "evicted")
        .when(committed, "committed")
        .when(oversize, "streaming_to_disk")
        .when(F.col("last_registered").isNotNull(), "pending")
    )
    return {"status": status, "in_memory": F.coalesce(F.col("last_resident.value"), F.lit(False))}


def current_status(events: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Fold (agent_id, event_type, at_ms, size_bytes) events to one status row per agent."""
    folded = events.where(event_rank(F.col("event_type")).isNotNull()).groupBy("agent_id").agg(*status_aggregates(max_bytes))
    shown = status_columns(max_bytes)
    return folded.select(
        "agent_id", shown["status"].alias("status"), shown["in_memory"].alias("in_memory"),
        F.col("last_size.value").alias("size_bytes"), "updated_ms")


def snapshot_summary(status: DataFrame) -> DataFrame:
    """Counts over current statuses; ``evicted`` is our addition to the usual set."""

    def having(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    return status.agg(
        F.count("*").alias("total"),
        F.count_if("in_memory").alias("in_memory"),
        F.count_if(~F.col("in_memory")).alias("on_disk_only"),
        having("pending").alias("pending"),
        having("committed").alias("committed"),
        having("streaming_to_disk").alias("streaming"),
        having("evicted").alias("evicted"),
    )


def pending_writes(events: DataFrame, now_ms: int) -> DataFrame:
    """Each registration with the first commit at or after it, or as pending.

    One backward running minimum replaces the interval join, so registrations
    and commits of one agent never meet as pairs.
    """
    relevant = events.where(F.col("event_type").isin("registered", "committed")).withColumn(
        "__rank", event_rank(F.col("event_type")))
    commit_at = F.when(F.col("event_type") == "committed", F.col("at_ms"))
    ahead = running(relevant, ["agent_id"], "at_ms", ["__rank"], {"committed_ms": ("min", commit_at)}, descending=True)
    return ahead.where("event_type = 'registered'").select(
        "agent_id", F.col("at_ms").alias("registered_ms"), "committed_ms",
        F.col("committed_ms").isNull().alias("pending"),
        (F.coalesce("committed_ms", F.lit(now_ms)) - F.col("at_ms")).alias("wait_ms"),
    )


def checkpoint_outputs(turns: DataFrame, order: str, parts_per_row: int = PARTS_PER_ROW) -> DataFrame:
    """Join the non-empty text parts of each agent with newlines, in order.

    An agent with more parts than fit one row continues in further rows
    (``row_no`` 1, 2, ...), so no agent is gathered whole.
    """
    texts = turns.where(F.col("text").isNotNull() & (F.col("text") != ""))
    numbered = running(texts, ["agent_id"], order, [], {"part_no": ("count", F.lit(1))})
    chunk = F.floor((F.col("part_no") - 1) / parts_per_row).cast("long")
    listed = numbered.groupBy("agent_id", chunk.alias("row_no")).agg(
        F.sort_array(F.collect_list(F.struct("part_no", "text"))).alias("parts"))
    return listed.select("agent_id", "row_no", F.array_join("parts.text", "\n").alias("output"))


# --- compression --------------------------------------------------------------


def compress_payload(payload: Column, level: int = 6) -> Column:
    """zlib bytes; Spark has no native zlib, so this is an Arrow batch."""
    if not 1 <= level <= 9:
        raise ValueError("the level must lie in 1..9")

    @F.arrow_udf("binary")
    def deflate(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else zlib.compress(v, level) for v in values.to_pylist()], pa.binary())

    return deflate(payload.cast("binary"))


def decompress_payload(data: Column) -> Column:
    """struct<data, error>; bytes that are not zlib give an error, not a failed job."""

    @F.arrow_udf("struct<data:binary,error:string>")
    def inflate(values: pa.Array) -> pa.Array:
        out, errors = [], []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else zlib.decompress(v))
                errors.append(None)
            except zlib.error as exc:
                out.append(None)
                errors.append(str(exc))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["data", "error"])

    return inflate(data)


def compression_report(payloads: DataFrame, payload: str, group: list[str], level: int = 6) -> DataFrame:
    """Original and compressed bytes and their ratio per group."""
    packed = payloads.select(
        *group, F.octet_length(F.col(payload)).cast("long").alias("before"),
        F.octet_length(compress_payload(F.col(payload), level)).cast("long").alias("after"))
    return packed.groupBy(*group).agg(
        F.count("*").alias("payloads"), F.sum("before").alias("original_bytes"), F.sum("after").alias("compressed_bytes"),
        F.round(F.try_divide(F.sum("after"), F.sum("before")), 6).alias("ratio"))
