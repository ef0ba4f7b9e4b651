"""Streams over entries, checkpoints, lifecycle events and request logs.

Every function maps streaming DataFrames to a streaming DataFrame and works on
batch DataFrames as well, which gives each stream a batch twin to test against.
State is built-in aggregation, window and join state, and two keyed processors
with timers and state that expires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkeep.functions.codes import case_of
from emberkeep.operators import checkpoints as C
from emberkeep.operators.checkpoint_table import BUCKETS, exists, merge_into_table, read_table
from emberkeep.session import work_dir
from emberkeep.streaming.runner import needs_state_store, run_batches
from emberkeep.streaming.stateful import CHANGE, FOLD, TEXT, LatestEvents, LiveEntries, fields

# Alert thresholds of the service objectives.
SLO = {"p99_ms": 500.0, "error_rate": 0.01, "hit_rate": 0.90, "fetch_failures": 0.005}
AUTH_FAILURES, AUTH_WINDOW = 10, "15 minutes"


def live_changes(puts: DataFrame, delay: str, ends_only: bool = False) -> DataFrame:
    """What happens to entries as puts (key, value, ts, ttl_ms) come: (key, live, value, puts, first_put_ms, put_ms, expires_ms, changed_at).

    A put restarts the clock of its key with a time to live of its own; one that
    is null or not above 0 has no end.  A row with ``live`` is the latest state
    of a key, one without says that a life has ended, once and for all, when
    the watermark passed its end.
    """
    needs_state_store(puts.sparkSession)
    shown = puts.withWatermark("ts", delay).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts", F.unix_millis("ts").alias("ts_ms"),
        F.coalesce(F.col("ttl_ms").cast("long"), F.lit(0)).alias("ttl_ms"))
    return shown.groupBy("key").transformWithStateInPandas(
        LiveEntries(ends_only), CHANGE, "append" if ends_only else "update", "EventTime", eventTimeColumnName="changed_at" if ends_only else "")


def ttl_table_stream(puts: DataFrame, delay: str, label: str = "ttl", base: str | None = None) -> DataFrame:
    """Run ``live_changes`` to the end of what is there; returns the live entries and the lives that ended."""
    return fold_lives(run_batches(live_changes(puts, delay), label, "update", base=base))


def fold_lives(changes: DataFrame) -> DataFrame:
    """(key, value, puts, first_put_ms, put_ms, expires_ms, live): every ended life, and of each key the latest life unless it ended.

    Changes merge in any order: a life is known by its last put, later puts
    make it another one, and of a life seen twice the one with more puts is
    the newer.
    """
    shown = ["value", "puts", "first_put_ms", "put_ms", "expires_ms"]
    ended = changes.where("not live").select("key", *shown, F.lit(False).alias("live")).distinct()
    newest = F.max(F.struct("put_ms", F.col("value").isNotNull().alias("some"), "value", (~F.col("live")).alias("gone"), "puts", "first_put_ms", "expires_ms"))
    latest = changes.groupBy("key").agg(newest.alias("n")).where("not n.gone")
    return ended.unionByName(latest.select("key", *[F.col(f"n.{c}").alias(c) for c in shown], F.lit(True).alias("live")))


def expiry_counts_stream(puts: DataFrame, interval: str, delay: str) -> DataFrame:
    """Expirations per reaper interval: lives end in one stateful step, windows over their ends count them in the next.

    A put that another one follows in time doesn't expire.
    """
    ends = live_changes(puts, delay, ends_only=True)
    return ends.groupBy(F.window("changed_at", interval).alias("w")).agg(F.count("*").alias("expired")).select(
        F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "expired")


def write_behind_stream(updates: DataFrame, label: str = "write-behind", base: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Persist checkpoint updates as they come; returns the stored table.

    Each micro-batch is reduced per agent and written as a delta, which is
    cheap.  When the stream has ended, the deltas since the last merge are
    folded into a table of hash buckets, of which only those are written again
    that the deltas touch.  ``base`` is the folder of an earlier run to go on
    with.
    """

    def reduce_batch(batch: DataFrame) -> DataFrame:
        return batch.groupBy("agent_id").agg(
            F.max_by("data", F.struct("written_at", "data")).alias("data"),
            F.min("written_at").alias("created_at"), F.max("written_at").alias("updated_at"))

    spark = updates.sparkSession
    base = base or work_dir(spark, label)
    deltas = run_batches(updates, label, "append", reduce_batch, base=base)
    newest = deltas.agg(F.max("batch_id").alias("n")).first().n
    if newest is None:
        return read_table(spark, f"{base}/checkpoints")
    merged = f"{base}/merged"
    done = spark.read.schema("upto long").json(merged).agg(F.max("upto")).first()[0] if exists(spark, merged) else None
    if done is None or newest > done:
        merge_into_table(spark, f"{base}/checkpoints", deltas.where(F.col("batch_id") > (-1 if done is None else done)), f"upto-{newest}", buckets)
        spark.range(1).select(F.lit(newest).alias("upto")).write.mode("append").json(merged)
    return read_table(spark, f"{base}/checkpoints")


IDLE_MS = 7 * 24 * 3_600_000


def status_stream(
    events: DataFrame, max_bytes: int = C.DEFAULT_MAX_BYTES, label: str = "status", idle_ms: int = IDLE_MS, base: str | None = None,
) -> DataFrame:
    """Current status per agent, written whenever it changes; returns the latest ones.

    The state holds the last event of each kind and lets go of agents that were
    idle for ``idle_ms``.  What is written are such last events too, which
    merge in any order, so an agent that comes back after it left the state
    still has its whole past in the table.
    """
    needs_state_store(events.sparkSession)
    kind, at = F.col("event_type"), F.col("at_ms") * len(C.EVENT_RANK) + C.event_rank(F.col("event_type"))
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    resident = F.when(kind == "registered", size <= max_bytes).when(kind == "evicted", False).when(kind == "resolved", True)
    rows = events.where(C.event_rank(kind).isNotNull()).select(
        F.col("agent_id").cast("string").alias("key"), F.when(kind == "registered", at).alias("last_registered"),
        F.when(kind.isin("committed", "resolved"), at).alias("last_committed"), F.when(kind == "evicted", at).alias("last_evicted"),
        (2 * at + resident.cast("long")).alias("last_resident"), F.when(kind == "registered", at).alias("size_at"),
        F.when(kind == "registered", F.col("size_bytes").cast("long")).alias("size_bytes"), F.col("at_ms").alias("updated_ms"))
    folded = rows.groupBy("key").transformWithState(LatestEvents(idle_ms), fields(key=TEXT, **{f.name: f.dataType for f in FOLD}), "update", "ProcessingTime")
    return latest_status(run_batches(folded, label, "update", base=base, empty_batches=False), max_bytes)


def latest_status(changes: DataFrame, max_bytes: int = C.DEFAULT_MAX_BYTES) -> DataFrame:
    """The status that the last events of each kind, merged over all changes, amount to."""
    lasts = [F.max(c).alias(c) for c in ("last_registered", "last_committed", "last_evicted", "last_resident", "updated_ms")]
    merged = changes.groupBy(F.col("key").alias("agent_id")).agg(*lasts, F.max_by("size_bytes", F.struct("size_at", "size_bytes")).alias("size_bytes"))
    held = merged.withColumns({
        "last_size": F.struct(F.col("size_bytes").alias("value")), "last_resident": F.struct((F.col("last_resident") % 2 == 1).alias("value"))})
    shown = C.status_columns(max_bytes)
    return held.select("agent_id", shown["status"].alias("status"), shown["in_memory"].alias("in_memory"), "size_bytes", "updated_ms")


def coalesce_requests(reads: DataFrame, keys: list[str], window: str) -> DataFrame:
    """One row per burst: the first read of a key passes, reads that follow another within the window are suppressed.

    A burst is a session whose gap is the window, so the answer depends on
    event times alone; it is emitted when the watermark closes the burst.
    """
    bursts = reads.withWatermark("ts", window).groupBy(*keys, F.session_window("ts", window).alias("burst"))
    return bursts.agg(F.count("*").alias("reads")).select(*keys, F.col("burst.start").alias("ts"), "reads")


def rate_limit_stream(requests: DataFrame, limits: dict[str, int], delay: str, window: str = "1 minute") -> DataFrame:
    """Requests over the limit of their endpoint group, per user and window."""
    counted = requests.withWatermark("ts", delay).groupBy(
        "user_id", "operation", F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"))
    limit = case_of(F.col("operation"), limits)
    return counted.where(F.col("requests") > limit).select(
        "user_id", "operation", F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "requests",
        (F.col("requests") - limit).alias("over_limit"))


def auth_failure_stream(requests: DataFrame, delay: str, limit: int = AUTH_FAILURES, window: str = AUTH_WINDOW) -> DataFrame:
    """Addresses with more failed logins in a window than allowed."""
    failed = requests.where(F.col("status").isin(401, 403)).withWatermark("ts", delay)
    counted = failed.groupBy("remote_addr", F.window("ts", window).alias("w")).agg(F.count("*").alias("failures"))
    return counted.where(F.col("failures") > limit).select("remote_addr", F.col("w.start").alias("from_at"), "failures")


SKETCH_K = 4_096  # quantile sketches are exact up to this many values; beyond, ranks are off by less than 0.2 %


def slo_stream(log: DataFrame, delay: str, window: str = "5 minutes", slide: str = "1 minute", slo: dict[str, float] = SLO) -> DataFrame:
    """Objectives per sliding window and which of them are broken.

    Rows are counted once, in panes as long as the slide; a window merges the
    counts and quantile sketches of its panes, so no row is copied to each of
    its windows and the second step holds one row a pane.
    """
    panes = log.withWatermark("ts", delay).groupBy(F.window("ts", slide).alias("pane")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(SKETCH_K)).alias("durations"),
        F.count_if(F.col("status") >= 400).alias("errors"), F.count_if("is_hit").alias("hits"),
        F.count_if((F.col("operation") == "GET") & (F.col("status") == 404)).alias("missed"))
    seen = panes.groupBy(F.window("pane", window, slide).alias("w")).agg(
        F.sum("n").alias("requests"), F.kll_merge_agg_double("durations").alias("durations"),
        *[F.sum(c).alias(c) for c in ("errors", "hits", "missed")])

    def share(count: str) -> Column:
        return F.col(count) / F.col("requests")

    p99 = F.when(F.kll_sketch_get_n_double("durations") > 0, F.kll_sketch_get_quantile_double("durations", F.lit(0.99)))
    rated = seen.select("w", "requests", p99.alias("p99_ms"), share("errors").alias("error_rate"), share("hits").alias("hit_rate"), share("missed").alias("fetch_failures"))
    return rated.select(
        F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "requests", "p99_ms", "error_rate", "hit_rate", "fetch_failures",
        (F.col("p99_ms") > slo["p99_ms"]).alias("slow"), (F.col("error_rate") > slo["error_rate"]).alias("failing"),
        (F.col("hit_rate") < slo["hit_rate"]).alias("cold"), (F.col("fetch_failures") > slo["fetch_failures"]).alias("missing"))


def session_stream(lookups: DataFrame, gap: str, delay: str) -> DataFrame:
    """Hits and misses per user session."""
    sessions = lookups.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return sessions.agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses")).select(
        "user_id", F.col("s.start").alias("from_at"), F.col("s.end").alias("to_at"), "hits", "misses")


def commit_latency_stream(registered: DataFrame, committed: DataFrame, bound: str, delay: str) -> DataFrame:
    """Registrations with their commit inside the bound, or none once it has passed."""
    r = registered.withWatermark("registered_at", delay).select("agent_id", "registered_at")
    c = committed.withWatermark("committed_at", delay).select(F.col("agent_id").alias("c_agent_id"), "committed_at")
    within = (
        (F.col("agent_id") == F.col("c_agent_id")) & (F.col("committed_at") >= F.col("registered_at"))
        & (F.col("committed_at") <= F.col("registered_at") + F.expr(f"interval {bound}"))
    )
    joined = r.join(c, within, "left_outer")
    latency = F.unix_millis("committed_at") - F.unix_millis("registered_at")
    return joined.select("agent_id", "registered_at", "committed_at", latency.alias("latency_ms"), F.col("committed_at").isNull().alias("pending"))


ALL_NAMESPACES = "*"


def invalidation_stream(changes: DataFrame, entries: DataFrame, label: str = "invalidation") -> DataFrame:
    """Entries that outlive the data changes (namespace or null, at_ms) seen so far.

    A batch leaves the newest change per namespace; entries are tested against
    the newest of all batches, in which order they came does not matter.
    """

    def newest(batch: DataFrame) -> DataFrame:
        scope = F.coalesce("namespace", F.lit(ALL_NAMESPACES)).alias("namespace")
        return batch.groupBy(scope).agg(F.max("at_ms").alias("changed_ms"))

    return apply_invalidations(run_batches(changes, label, "append", newest), entries)


def apply_invalidations(newest: DataFrame, entries: DataFrame) -> DataFrame:
    last = newest.groupBy("namespace").agg(F.max("changed_ms").alias("changed_ms"))
    everywhere = last.where(F.col("namespace") == ALL_NAMESPACES).agg(F.coalesce(F.max("changed_ms"), F.lit(-1))).scalar()
    joined = entries.join(last, "namespace", "left")
    kept = (F.col("inserted_ms") > F.coalesce("changed_ms", F.lit(-1))) & (F.col("inserted_ms") > everywhere)
    return joined.where(kept).drop("changed_ms")


def event_fanout_stream(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each lifecycle event to each enabled subscriber: a stream-static join.

    Write it partitioned by ``hook_id``; ``at_ms`` keeps the order of a subscriber.
    """
    wanted = subscriptions.where("enabled").select("hook_id", F.explode("events").alias("event"))
    return events.join(wanted, "event").select("hook_id", "event", "artefact_id", "at_ms")
