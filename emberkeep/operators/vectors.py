"""The embedding store: entries, search, expiry, retention, flushes and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.functions import vectors as V
from emberkeep.operators.running import running
from emberkeep.operators.selection import key_at, key_literal, sort_key

ENTRY_OVERHEAD = 128  # bytes charged per entry besides 4 per dimension
DEFAULT_TOP_K = 10
DEFAULT_THRESHOLD = 0.8


def build_entries(
    df: DataFrame, id: str, embedding: str, namespace: str | None, ttl_ms: int | Column, now_ms: int | Column,
    metadata: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of the entry table, and the rows refused for an empty vector."""
    vector = F.col(embedding)
    usable = vector.isNotNull() & (F.size(vector) > 0)
    now = F.lit(now_ms).cast("long")
    ttl = F.lit(ttl_ms).cast("long")
    entries = df.where(usable).select(
        F.col(id).alias("id"),
        vector.alias("embedding"),
        F.size(vector).alias("dimension"),
        V.l2_norm(vector).alias("norm"),
        (F.col(metadata) if metadata else F.create_map().cast("map<string,string>")).alias("metadata"),
        (F.col(namespace) if namespace else F.lit(None).cast("string")).alias("namespace"),
        now.alias("inserted_ms"),
        F.when(ttl > 0, now + ttl).otherwise(F.lit(0).cast("long")).alias("expires_ms"),
        now.alias("last_accessed_ms"),
        (F.size(vector).cast("long") * 4 + ENTRY_OVERHEAD).alias("estimated_bytes"),
    )
    rejects = df.where(~F.coalesce(usable, F.lit(False))).select(F.col(id).alias("id"), F.lit("EMPTY_VECTOR").alias("reason"))
    return entries, rejects


def with_norm(entries: DataFrame) -> DataFrame:
    """Add dimension and norm to a table that stores only the vector."""
    return entries.withColumns({"dimension": F.size("embedding"), "norm": V.l2_norm(F.col("embedding"))})


def live_entries(entries: DataFrame, now_ms: int | Column) -> DataFrame:
    return entries.where((F.col("expires_ms") == 0) | (F.col("expires_ms") >= F.lit(now_ms)))


def same_dimension(entries: DataFrame, dim: int) -> DataFrame:
    return entries.where(F.size("embedding") == dim)


# --- search ---------------------------------------------------------------


def _scored(entries: DataFrame, query: list[float], now_ms: int | None) -> DataFrame:
    if not query or not any(query):
        raise ValueError("the query vector is empty or has norm zero")
    rows = entries if now_ms is None else live_entries(entries, now_ms)
    rows = same_dimension(rows, len(query))
    norm = F.col("norm") if "norm" in entries.columns else V.l2_norm(F.col("embedding"))
    return rows.withColumn("score", V.score_against(F.col("embedding"), norm, query)).where(F.col("score").isNotNull())


def search_topk(entries: DataFrame, query: list[float], k: int = DEFAULT_TOP_K, now_ms: int | None = None) -> DataFrame:
    """The k best live entries; each task keeps k rows, the driver merges them."""
    if k <= 0:
        raise ValueError("k must be positive")
    return _scored(entries, query, now_ms).orderBy(F.desc("score"), F.asc("id")).limit(k)


def search_threshold(
    entries: DataFrame, query: list[float], threshold: float = DEFAULT_THRESHOLD, now_ms: int | None = None
) -> DataFrame:
    """Every live entry scoring at least ``threshold``, best first."""
    if not -1.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [-1, 1]")
    return _scored(entries, query, now_ms).where(F.col("score") >= threshold).orderBy(F.desc("score"), F.asc("id"))


# --- flush and invalidation -------------------------------------------------


def flush_condition(
    mode: str = "all", namespace: str | None = None, now_ms: int | None = None, older_than_ms: int = 600_000,
    session_id: str | None = None,
) -> tuple[Column, str]:
    """The rows a flush removes, and the reason it records."""
    if mode == "all":
        return F.lit(True), "flushAll"
    if mode == "namespace":
        return F.col("namespace") == namespace, f"flushNamespace({namespace})"
    if mode == "expired":
        return V.expired(F.col("expires_ms"), now_ms), "flushExpired"
    if mode == "older_than":
        return F.col("inserted_ms") < now_ms - older_than_ms, f"flush_older_than_{older_than_ms}ms"
    if mode == "session":
        return V.expired(F.col("expires_ms"), now_ms), f"onSessionStart(sessionId={session_id})"
    raise ValueError(f"unknown flush mode {mode!r}")


def flush_summary(removed: DataFrame, reason: str) -> DataFrame:
    return removed.agg(
        F.count("*").alias("removed_count"),
        F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("long").alias("freed_bytes"),
        F.lit(reason).alias("reason"),
    )


def flush_where(entries: DataFrame, condition: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, summary).  A condition that is null for a row keeps the row."""
    doomed = F.coalesce(condition, F.lit(False))
    return entries.where(~doomed), flush_summary(entries.where(doomed), reason)


def on_data_changed(entries: DataFrame, namespace: str | None) -> tuple[DataFrame, DataFrame]:
    """Invalidate one namespace, or everything when it is null."""
    return flush_where(entries, *(flush_condition("all") if namespace is None else flush_condition("namespace", namespace)))


# --- keyed reads and writes -------------------------------------------------


def lookup(entries: DataFrame, keys: DataFrame, now_ms: int, key: str = "id") -> DataFrame:
    """Every key with its live entry; absent or expired keys are misses."""
    live = live_entries(entries, now_ms).withColumn("is_hit", F.lit(True))
    joined = keys.withColumnRenamed(key, "id").join(live, "id", "left")
    return joined.withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))


def contains(entries: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """The keys that have a live entry."""
    return keys.join(live_entries(entries, now_ms), "id", "left_semi")


def remove(entries: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, removed)."""
    return entries.join(keys, key, "left_anti"), entries.join(keys, key, "left_semi")


def upsert_entries(entries: DataFrame, batch: DataFrame, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(table after the batch, rows it displaced); the last write of a key wins.

    The batch is reduced to one row per key by an aggregate that combines
    before the shuffle, so a key written a billion times is no hot task.
    """
    columns = entries.columns
    latest = batch.groupBy("id").agg(
        F.max_by(F.struct(*[c for c in columns if c != "id"]), F.col(sequence)).alias("row")
    ).select("id", "row.*").select(*columns)
    displaced = entries.join(latest.select("id"), "id", "left_semi")
    untouched = entries.join(latest.select("id"), "id", "left_anti")
    return untouched.unionByName(latest), displaced


def intersect_live(a: DataFrame, b: DataFrame, now_ms: int) -> DataFrame:
    """Keys live in both snapshots."""
    return live_entries(a, now_ms).select("id").intersect(live_entries(b, now_ms).select("id"))


def all_keys(*snapshots: DataFrame) -> DataFrame:
    """Every key, also of entries that expired but were not reaped."""
    return reduce(DataFrame.union, [s.select("id") for s in snapshots]).distinct()


# --- retention --------------------------------------------------------------


def retain_recent(
    df: DataFrame, part: list[str], order_col: str, n: int, id_col: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): the n most recent rows per partition, or overall without one.

    Ordering by insertion gives FIFO, by last access LRU.  The rank filter lets
    Spark cut every task to n rows per key before it shuffles, and the evicted
    rows come from an anti join on the unique id, so neither side has hot keys.
    Without a partition the cut is one key, found by counting: both sides are
    filters of the table, whatever n is.
    """
    newest = [F.desc(order_col), F.desc(id_col)]
    if not part:
        found = key_at(df, [order_col, id_col], max(0, df.count() - n)) if n > 0 else None
        if found is None:
            return df.where(F.lit(False)), df
        oldest = sort_key([order_col, id_col]) >= key_literal(found[0], found[1])
        return df.where(oldest), df.where(~oldest)
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(*newest))
    kept_ids = df.select(*dict.fromkeys([*part, order_col, id_col])).withColumn("__rank", rank).where(f"__rank <= {n}").select(id_col)
    return df.join(kept_ids, id_col, "left_semi"), df.join(kept_ids, id_col, "left_anti")


def enforce_memory_ceiling(entries: DataFrame, max_bytes: int, part: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): drop the least recently accessed until the bytes fit; 0 is off."""
    if max_bytes <= 0:
        return entries, entries.limit(0)
    summed = running(
        entries, part or [], "last_accessed_ms", ["id"],
        {"kept_bytes": ("sum", F.col("estimated_bytes"))}, descending=True,
    )
    return summed.where(F.col("kept_bytes") <= max_bytes), summed.where(F.col("kept_bytes") > max_bytes)


# --- statistics ---------------------------------------------------------------


def cache_stats(lookups: DataFrame, entries: DataFrame, max_bytes: int, evictions: int = 0) -> DataFrame:
    """One row of counters.  Entries that expired but were not reaped still count."""
    calls = lookups.agg(
        F.count_if(F.col("is_hit")).alias("hits"), F.count_if(~F.col("is_hit")).alias("misses")
    )
    held = entries.agg(
        F.count("*").alias("size"), F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("long").alias("used_bytes")
    )
    rate = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0))
    both = calls.select("*", held.select(F.struct("size", "used_bytes")).scalar().alias("held"))
    return both.select(
        "hits", "misses", F.round(rate, 6).alias("hit_rate"), F.round(rate * 100, 2).alias("hit_rate_pct"),
        "held.size", "held.used_bytes", F.lit(max_bytes).cast("long").alias("max_bytes"),
        F.round(F.col("held.used_bytes") * 100.0 / max_bytes, 1).alias("usage_pct"),
        F.lit(evictions).cast("long").alias("evictions"),
    )


def namespace_stats(entries: DataFrame, now_ms: int) -> DataFrame:
    """Size, bytes and expired count per namespace, with the grand total."""
    return entries.rollup("namespace").agg(
        F.grouping("namespace").cast("int").alias("is_total"),
        F.count("*").alias("size"),
        F.sum("estimated_bytes").cast("long").alias("bytes"),
        F.count_if(V.expired(F.col("expires_ms"), now_ms)).alias("expired"),
    ).withColumn("namespace", F.when(F.col("is_total") == 1, F.lit("(all)")).otherwise(F.col("namespace")))


def session_counters(lookups: DataFrame, part: list[str], order: str, ties: list[str], start: Column) -> DataFrame:
    """Hits and misses since each session start; the epoch before the first is 0."""
    marked = running(
        lookups, part, order, ties, {"session_no": ("sum", F.when(start, 1).otherwise(0))}
    )
    lookup_row = ~start
    return marked.groupBy(*part, "session_no").agg(
        F.count_if(lookup_row & F.col("is_hit")).alias("hits"),
        F.count_if(lookup_row & ~F.col("is_hit")).alias("misses"),
    )
