"""Streams over several micro-batches against their batch twins."""

import random
import time

from pyspark.sql import functions as F

from emberkeep.operators import checkpoints as C
from emberkeep.streaming import streams as S
from emberkeep.streaming.runner import run_to_table, table_stream
from emberkeep.streaming.stateful import FOLD, greatest


def in_batches(spark, tmp_path, df, batches, order):
    """A file stream that delivers ``df`` in several micro-batches, ordered by ``order``."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // batches)
    for n in range(batches):
        part = spark.createDataFrame(rows[n * size:(n + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_status_stream_equals_batch(spark, tmp_path):
    kinds = ["registered", "committed", "evicted", "resolved"]
    rows = [(f"a{i % 7}", kinds[(i * 5 + i // 7) % 4] if i >= 7 else "registered", i, 5) for i in range(60)]
    events = spark.createDataFrame(rows, "agent_id string, event_type string, at_ms long, size_bytes int")
    streamed = S.status_stream(in_batches(spark, tmp_path, events, 3, "at_ms"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, C.current_status(events).collect()))


def test_write_behind_equals_one_upsert(spark, tmp_path):
    updates = spark.createDataFrame([(f"a{i % 5}", f"data {i}", i) for i in range(40)], "agent_id string, data string, written_at long")
    columns = ["agent_id", "data", "size_bytes", "created_at", "updated_at"]
    streamed = S.write_behind_stream(in_batches(spark, tmp_path, updates, 4, "written_at")).select(*columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, C.upsert_checkpoints(None, updates).select(*columns).collect()))


def seconds(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")


PUT = "key string, value string, s long, ttl_ms long"


def batch_lives(rows, watermark):
    """Lives of puts (key, value, second, ttl) by plain loops: those that ended up to the watermark, and each key's last."""
    out = set()
    for key in {r[0] for r in rows}:
        life, lives = None, []
        for _, value, s, ttl in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            end = s * 1000 + ttl if ttl and ttl > 0 else 0
            if life and life[4] and s * 1000 > life[4]:
                lives.append(life)
                life = None
            life = (value, life[1] + 1 if life else 1, life[2] if life else s * 1000, s * 1000, end)
        lives.append(life)
        out |= {(key, *x, False) for x in lives if 0 < x[4] <= watermark * 1000}
        if not 0 < life[4] <= watermark * 1000:
            out.add((key, *life, True))
    return out


def test_live_table_equals_its_batch_twin(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(6)}", f"v{i}", rng.randrange(1, 900), rng.choice([0, None, 20_000, 60_000, 200_000])) for i in range(80)]
    rows += [("always", str(i), i * 20 + 1, 50_000) for i in range(50)]
    table = S.ttl_table_stream(in_batches(spark, tmp_path, seconds(spark, rows, PUT), 4, "ts"), "30 seconds")
    got = {(r.key, r.value, r.puts, r.first_put_ms, r.put_ms, r.expires_ms, r.live) for r in table.collect()}
    assert got == batch_lives(rows, max(r[2] for r in rows) - 30)


def test_only_the_last_put_of_a_life_expires(spark, tmp_path):
    rows = [("busy", str(i), i * 60 + 60, 3_600_000) for i in range(50)] + [("twice", "a", 1, 60_000), ("twice", "b", 62, 60_000), ("never", "x", 5, 0), ("z", "end", 10**9, 0)]
    counts = S.expiry_counts_stream(in_batches(spark, tmp_path, seconds(spark, rows, PUT), 3, "ts"), "1 hour", "0 seconds")
    got = run_to_table(counts, "expiry-test").collect()
    assert sorted((int(r.from_at.timestamp()), r.expired) for r in got) == [(0, 2), (3_600, 1)]


def test_late_puts_are_dropped(spark, tmp_path):
    first = seconds(spark, [("a", "1", 1000, 60_000), ("b", "1", 5000, 60_000)], PUT)
    # The watermark a batch earns screens late rows from the batch after next on.
    mid = seconds(spark, [("b", "2", 5010, 60_000)], PUT)
    late = seconds(spark, [("a", "late", 10, 60_000)], PUT)
    for part in (first, mid, late):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lives = S.ttl_table_stream(stream, "0 seconds").collect()
    assert {(r.key, r.value, r.live) for r in lives} == {("a", "1", False), ("b", "2", True)}


def test_idle_agents_leave_the_state_and_come_back(spark, tmp_path):
    """One checkpoint over two runs: the second finds the idle agent's state gone, and its table still whole."""
    schema = "agent_id string, event_type string, at_ms long, size_bytes int"
    base, path = f"file://{tmp_path}/out", str(tmp_path / "in")
    first = [("idle", "registered", 10, 5), ("idle", "committed", 20, None), ("busy", "registered", 10, 500)]
    second = [("idle", "evicted", 30, None), ("busy", "committed", 40, None), ("new", "registered", 50, 1)]
    for rows, wait in ((first, 4), (second, 0)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        table = S.status_stream(stream, 100, idle_ms=2_000, base=base)
        time.sleep(wait)
    events = spark.createDataFrame(first + second, schema)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, C.current_status(events, 100).collect()))
    changes = spark.read.parquet(f"{base}/table")
    # A fold that went on would still know the registration.
    assert changes.where("key = 'idle' and last_evicted is not null and last_registered is null").count() == 1


def test_repeated_reads_collapse(spark, tmp_path):
    reads = seconds(spark, [("k", 0), ("k", 5), ("k", 50), ("m", 9), ("k", 200), ("z", 10_000)], "key string, s long")
    for batches in (1, 3):
        source = in_batches(spark, tmp_path / str(batches), reads, batches, "ts")
        got = run_to_table(S.coalesce_requests(source, ["key"], "1 minute"), "reads-test").collect()
        assert sorted((r.key, int(r.ts.timestamp()), r.reads) for r in got) == [("k", 0, 3), ("k", 200, 1), ("m", 9, 1)]


def test_invalidation_of_all_namespaces(spark, tmp_path):
    changes = spark.createDataFrame([("n", 50), (None, 20), ("n", 30)], "namespace string, at_ms long")
    entries = spark.createDataFrame([("a", "n", 40), ("b", "n", 60), ("c", "m", 10), ("d", "m", 25)], "id string, namespace string, inserted_ms long")
    kept = S.invalidation_stream(in_batches(spark, tmp_path, changes, 2, "at_ms"), entries)
    assert sorted(r.id for r in kept.collect()) == ["b", "d"]


def test_windows_merge_their_panes(spark, tmp_path):
    rng = random.Random(9)
    rows = [("GET" if i % 3 else "PUT", rng.choice([200, 404, 500]), rng.uniform(1, 900), i % 4 > 0, rng.randrange(1, 1_500)) for i in range(400)]
    log = seconds(spark, [*rows, ("GET", 200, 1.0, True, 10**8)], "operation string, status int, duration_ms double, is_hit boolean, s long")
    got = run_to_table(S.slo_stream(in_batches(spark, tmp_path, log, 3, "ts"), "10 seconds"), "slo-test").collect()
    want = {}
    for start in range(-240, 1_500, 60):
        held = [r for r in rows if start <= r[4] < start + 300]
        if held:
            times = sorted(r[2] for r in held)
            want[start] = (len(held), times[-(-99 * len(held) // 100) - 1], sum(r[1] >= 400 for r in held) / len(held))
    assert {int(r.from_at.timestamp()): (r.requests, r.p99_ms, r.error_rate) for r in got} == want


def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 5}", f"data {i}", i) for i in range(40)], "agent_id string, data string, written_at long")
    rows.repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "apart"))
    next((tmp_path / "apart").glob("*.parquet")).rename(tmp_path / "file.parquet")
    for name in ("folder", "file"):
        assert run_to_table(table_stream(spark, str(tmp_path), name), name).count() == 40
        assert S.write_behind_stream(table_stream(spark, str(tmp_path), name)).count() == 5


def test_greatest_of_a_key_passes_over_nulls():
    names = FOLD.names
    rows = [dict(last_registered=4, size_at=4, size_bytes=9, updated_ms=1), dict(last_committed=7, updated_ms=3), dict(last_registered=8, size_at=8, updated_ms=2)]
    held = dict(zip(names, greatest([tuple(r.get(n) for n in names) for r in rows])))
    assert held == dict(last_registered=8, last_committed=7, last_evicted=None, last_resident=None, size_at=8, size_bytes=None, updated_ms=3)
    tied = [dict(size_at=8), dict(size_at=8, size_bytes=0)]
    assert dict(zip(names, greatest([tuple(r.get(n) for n in names) for r in tied])))["size_bytes"] == 0
