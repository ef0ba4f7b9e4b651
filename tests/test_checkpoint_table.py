"""The stored checkpoint table: what a merge writes, replays, and merges that broke off."""

import glob
import os
import shutil

from emberkeep.operators import checkpoints as C
from emberkeep.operators.checkpoint_table import bucket_of, merge_into_table, read_table
from emberkeep.streaming import streams as S

SCHEMA = "agent_id string, data string, created_at long, updated_at long"


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/table/bucket=*/part-*")}


def rows_of(df):
    return sorted(map(tuple, df.select("agent_id", "data", "size_bytes", "created_at", "updated_at").collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path)
    first = spark.createDataFrame([(f"a{i}", f"d{i}", i, i) for i in range(200)], SCHEMA)
    merge_into_table(spark, path, first, "one", buckets=8)
    before = files(path)
    later = spark.createDataFrame([("a3", "new é", 900, 900), ("a3", "older", 800, 800), ("a3", None, 950, 950)], SCHEMA)
    table = merge_into_table(spark, path, later, "two", buckets=8)
    after = files(path)
    (touched,) = {r.b for r in later.select(bucket_of(later.agent_id, 8).alias("b")).collect()}
    assert {f for f in before if f"bucket={touched}/" not in f} == {f for f in after if f"bucket={touched}/" not in f}
    assert {f for f in before if f"bucket={touched}/" in f}.isdisjoint(after)
    want = {r[0]: r for r in rows_of(table)}
    assert want["a3"] == ("a3", None, None, 3, 950) and want["a4"] == ("a4", "d4", 2, 4, 4) and len(want) == 200


def test_a_merge_that_is_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    for n in range(3):
        part = spark.createDataFrame([(f"a{i % 7}", f"{n}-{i}", n * 100 + i, n * 100 + i) for i in range(20)], SCHEMA)
        once = rows_of(merge_into_table(spark, path, part, f"m{n}", buckets=4))
        assert rows_of(merge_into_table(spark, path, part, f"m{n}", buckets=4)) == once
        assert rows_of(merge_into_table(spark, path, part, f"again{n}", buckets=4)) == once


def test_a_merge_that_broke_off_goes_on(spark, tmp_path):
    path = str(tmp_path)
    first = spark.createDataFrame([(f"a{i}", f"d{i}", i, i) for i in range(40)], SCHEMA)
    merge_into_table(spark, path, first, "one", buckets=2)
    update = spark.createDataFrame([("a1", "x", 99, 99)], SCHEMA)
    whole = rows_of(merge_into_table(spark, path, update, "two", buckets=2))
    # As a lost commit leaves it: the old bucket gone, the new one not there.
    for bucket in glob.glob(f"{path}/table/bucket=*"):
        shutil.move(bucket, str(tmp_path / f"away-{os.path.basename(bucket)}"))
        break
    assert len(rows_of(read_table(spark, path))) < 40
    merge_into_table(spark, path, first, "one", buckets=2)
    assert rows_of(merge_into_table(spark, path, update, "two", buckets=2)) == whole


def test_write_behind_goes_on_where_it_stopped(spark, tmp_path):
    base, source = f"file://{tmp_path}/out", str(tmp_path / "in")
    updates = [(f"a{i % 5}", f"data {i}", i) for i in range(40)]
    schema = "agent_id string, data string, written_at long"
    kept = set()
    for part in (updates[:25], updates[25:], []):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        table = S.write_behind_stream(stream, base=base, buckets=4)
        kept = rows_of(table)
    assert kept == rows_of(C.upsert_checkpoints(None, spark.createDataFrame(updates, schema)))
    assert read_table(spark, str(tmp_path / "nothing")).collect() == []
