"""Registered queries over the embedding store."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberkeep.functions import vectors as V
from emberkeep.operators import similarity as S
from emberkeep.operators import vectors as O
from emberkeep.plans.registry import query
from emberkeep.plans.views import EPOCH_MS, table, view, with_views

SCORE = ("round(list_dot_product(e.embedding::double[], q.embedding::double[]) / "
         "(sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * "
         "sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 9)")
NOW_SQL = "(select max(inserted_ms) + 3600000 from v1)"
LIVE_SQL = f"(expires_ms = 0 or expires_ms >= {NOW_SQL})"


def now_of(v1) -> int:
    """The fixture's clock: an hour after the last insert."""
    return v1.agg(F.max("inserted_ms")).first()[0] + 3_600_000


def query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


SPOILT = "id like '%13'"  # entries whose vectors hold an infinity or none of the numbers at all


def with_spoilt(v1):
    bad = F.when(F.col("id").endswith("113"), F.lit(float("nan"))).otherwise(F.lit(float("inf"))).cast("float")
    return v1.withColumn("embedding", F.when(F.expr(SPOILT), F.concat(F.array(bad), F.slice("embedding", 2, 63))).otherwise(F.col("embedding")))


@query(with_views("v1", f"""
select e.id, {SCORE} as score from v1 e, (select embedding from v1 where id = 'vec:0') q
where {LIVE_SQL} and not e.{SPOILT} order by score desc, e.id limit 10"""))
def search_topk(spark, sf_dir):
    v1 = with_spoilt(view(spark, sf_dir, "v1"))
    hits = O.search_topk(v1, query_vector(spark, sf_dir), 10, now_of(v1))
    return hits.select("id", "score")


@query(with_views("v1", f"""
select e.id, {SCORE} as score from v1 e, (select embedding from v1 where id = 'vec:0') q
where {LIVE_SQL} and {SCORE} >= 0.2 and not e.{SPOILT}"""))
def search_threshold(spark, sf_dir):
    v1 = with_spoilt(view(spark, sf_dir, "v1"))
    hits = O.search_threshold(v1, query_vector(spark, sf_dir), 0.2, now_of(v1))
    return hits.select("id", "score")


@query(with_views("v1", f"""
select query_id, id, score, rank from (
  select q.id as query_id, e.id, {SCORE} as score,
         row_number() over (partition by q.id order by round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) desc, e.id) as rank
  from v1 e, v1 q where q.namespace = 'label:3')
where rank <= 5"""))
def search_topk_batch(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    wanted = v1.where("namespace = 'label:3'").select(F.col("id").alias("query_id"), "embedding")
    found = S.search_topk_batch(v1, wanted, 5, 64)
    return found.select("query_id", "id", "score", "rank")


# Every third entry has a near copy, whose vector is turned a little towards that of its neighbour.
NEAR = 0.35


@query(with_views("v1", f"""
with n as (select e.id || '~' as id, list_transform(range(1, 65), lambda i: (e.embedding[i] + {NEAR}::float * f.embedding[i])::float) as embedding
  from embeddings x join v1 e on e.id = 'vec:' || x.vec_id join v1 f on f.id = 'vec:' || (x.vec_id + 1) where x.vec_id % 3 = 0),
u as (select id, embedding from v1 union all select * from n), d as (select embedding, min(id) as id, count(*) as copies from u group by embedding)
select e.id as id_a, q.id as id_b, {SCORE} as score, e.copies as copies_a, q.copies as copies_b
from d e, d q where e.id < q.id and {SCORE} >= 0.35
"""))
def similarity_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    turned = F.zip_with("embedding", "other", lambda x, y: (x + F.lit(NEAR).cast("float") * y).cast("float"))
    near = e.where("vec_id % 3 = 0").join(following, "vec_id").select(F.concat(F.lit("vec:"), "vec_id", F.lit("~")).alias("id"), turned.alias("embedding"))
    d = S.distinct_vectors(view(spark, sf_dir, "v1").select("id", "embedding").unionByName(near))
    return S.similarity_join(d, None, 0.35, 64, carry=("copies",))


@query("""
select 'vec:' || vec_id as id, 64 as dimension, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm,
  'label:' || label as namespace, 1704067200000 as inserted_ms,
  case when vec_id % 5 = 0 then 0 else 1704067200000 + (vec_id % 5) * 3600000 end as expires_ms,
  64 * 4 + 128 as estimated_bytes, 'vec ' || vec_id as title
from embeddings""")
def build_entries(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("vec:"), "vec_id").alias("id"), "embedding", F.concat(F.lit("label:"), "label").alias("namespace"),
        (F.col("vec_id") % 5 * 3_600_000).alias("ttl"),
        F.create_map(F.lit("title"), F.concat(F.lit("vec "), "vec_id")).alias("metadata"),
    )
    entries, _ = O.build_entries(source, "id", "embedding", "namespace", F.col("ttl"), EPOCH_MS, "metadata")
    return entries.select(
        "id", "dimension", F.round("norm", 6).alias("norm"), "namespace", "inserted_ms", "expires_ms",
        "estimated_bytes", F.col("metadata")["title"].alias("title"),
    )


@query(with_views("v1", f"select id, namespace from v1 where {LIVE_SQL}"))
def live_entries(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    return O.live_entries(v1, now_of(v1)).select("id", "namespace")


@query("select 'vec:' || vec_id as id from embeddings where vec_id % 7 <> 0")
def same_dimension(spark, sf_dir):
    shortened = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    mixed = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec:"), "vec_id").alias("id"), shortened.alias("embedding"))
    return O.same_dimension(mixed, 64).select("id")


@query(with_views("v1", f"""
select count(*) as removed_count, cast(coalesce(sum(estimated_bytes), 0) as bigint) as freed_bytes, 'flushExpired' as reason
from v1 where expires_ms > 0 and {NOW_SQL} > expires_ms
union all select count(*), cast(coalesce(sum(estimated_bytes), 0) as bigint), 'flush_older_than_600000ms' from v1 where inserted_ms < {NOW_SQL} - 600000 - 3600000
union all select count(*), cast(sum(estimated_bytes) as bigint), 'flushNamespace(label:3)' from v1 where namespace = 'label:3'
union all select count(*), cast(sum(estimated_bytes) as bigint), 'flushAll' from v1"""))
def flush_summary(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    now = now_of(v1)
    modes = [("expired", None, now), ("older_than", None, now - 3_600_000), ("namespace", "label:3", now), ("all", None, now)]
    parts = [O.flush_where(v1, *O.flush_condition(m, ns, at))[1] for m, ns, at in modes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(with_views("v1", f"select id from v1 where not (expires_ms > 0 and {NOW_SQL} > expires_ms)"))
def flush_where(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    kept, _ = O.flush_where(v1, *O.flush_condition("expired", now_ms=now_of(v1)))
    return kept.select("id")


@query(with_views("v1", "select id, namespace from v1 where namespace <> 'label:4'"))
def on_data_changed(spark, sf_dir):
    kept, _ = O.on_data_changed(view(spark, sf_dir, "v1"), "label:4")
    return kept.select("id", "namespace")


@query(with_views("v1 v3", f"""
select k.event_id, k.lookup_key as id, e.id is not null as is_hit, coalesce(e.namespace, '-') as namespace
from v3 k left join (select * from v1 where {LIVE_SQL}) e on k.lookup_key = e.id"""))
def lookup(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    keys = view(spark, sf_dir, "v3").select("event_id", "lookup_key")
    found = O.lookup(v1, keys, now_of(v1), "lookup_key")
    return found.select("event_id", "id", "is_hit", F.coalesce("namespace", F.lit("-")).alias("namespace"))


@query(with_views("v1 v3", f"""
select k.event_id, k.lookup_key as id from v3 k where exists (select 1 from v1 e where e.id = k.lookup_key and {LIVE_SQL})"""))
def contains(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    keys = view(spark, sf_dir, "v3").select("event_id", F.col("lookup_key").alias("id"))
    return O.contains(v1, keys, now_of(v1)).select("event_id", "id")


@query(with_views("v1 v3", """
select id, 'removed' as side from v1 where id in (select lookup_key from v3 where operation = 'PUT')
union all select id, 'kept' from v1 where id not in (select lookup_key from v3 where operation = 'PUT')"""))
def remove(spark, sf_dir):
    keys = view(spark, sf_dir, "v3").where("operation = 'PUT'").select(F.col("lookup_key").alias("id"))
    kept, removed = O.remove(view(spark, sf_dir, "v1"), keys)
    return removed.select("id", F.lit("removed").alias("side")).unionByName(kept.select("id", F.lit("kept").alias("side")))


@query(with_views("v1 v3", """
with puts as (select lookup_key as id, max(event_id) as last_put from v3 where operation = 'PUT' group by lookup_key)
select coalesce(v1.id, puts.id) as id, coalesce(last_put + 1704067200000, inserted_ms) as inserted_ms,
       v1.id is not null and puts.id is not null as displaced
from v1 full outer join puts on v1.id = puts.id"""))
def upsert_entries(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1").select("id", "inserted_ms")
    puts = view(spark, sf_dir, "v3").where("operation = 'PUT'").select(
        F.col("lookup_key").alias("id"), (F.col("event_id") + EPOCH_MS).alias("inserted_ms"), F.col("event_id").alias("seq"))
    after, displaced = O.upsert_entries(v1, puts, "seq")
    flags = displaced.select("id", F.lit(True).alias("displaced"))
    return after.join(flags, "id", "left").select("id", "inserted_ms", F.coalesce("displaced", F.lit(False)).alias("displaced"))


@query(with_views("v1", f"""
select id, 'live in both' as kind from v1 where {LIVE_SQL} and id in (select id from v1 where last_accessed_ms > inserted_ms + 300000)
union all select distinct id, 'any' from v1"""))
def intersect_live(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    warm = v1.where("last_accessed_ms > inserted_ms + 300000")
    both = O.intersect_live(v1, warm, now_of(v1))
    return both.withColumn("kind", F.lit("live in both")).unionByName(O.all_keys(v1, warm).withColumn("kind", F.lit("any")))


@query(with_views("v1", """
select id, namespace, case when row_number() over (partition by namespace order by last_accessed_ms desc, id desc) <= 7 then 'kept' else 'evicted' end as side,
  case when row_number() over (order by inserted_ms desc, id desc) <= (select count(*) // 2 from v1) then 'kept' else 'evicted' end as overall
from v1"""))
def retain_recent(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1").select("id", "namespace", "last_accessed_ms", "inserted_ms")
    kept, evicted = O.retain_recent(v1, ["namespace"], "last_accessed_ms", 7)
    newest, rest = O.retain_recent(v1, [], "inserted_ms", v1.count() // 2)
    per = kept.withColumn("side", F.lit("kept")).unionByName(evicted.withColumn("side", F.lit("evicted")))
    overall = newest.select("id", F.lit("kept").alias("overall")).unionByName(rest.select("id", F.lit("evicted").alias("overall")))
    return per.join(overall, "id").select("id", "namespace", "side", "overall")


@query(with_views("v1", """
select id, namespace,
  case when sum(estimated_bytes) over (partition by namespace order by last_accessed_ms desc, id desc rows unbounded preceding) <= 5000 then 'kept' else 'evicted' end as side,
  case when sum(estimated_bytes) over (order by last_accessed_ms desc, id desc rows unbounded preceding) <= 40000 then 'kept' else 'evicted' end as overall
from v1"""))
def enforce_memory_ceiling(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1").select("id", "namespace", "last_accessed_ms", "estimated_bytes")

    def sides(part, ceiling, name):
        kept, evicted = O.enforce_memory_ceiling(v1, ceiling, part)
        return kept.select("id", "namespace", F.lit("kept").alias(name)).unionByName(
            evicted.select("id", "namespace", F.lit("evicted").alias(name)))

    return sides(["namespace"], 5_000, "side").join(sides([], 40_000, "overall").drop("namespace"), "id")


@query(with_views("v1 v3", """
select (select count(*) from v3 where is_hit) as hits, (select count(*) from v3 where not is_hit) as misses,
  round((select avg(case when is_hit then 1.0 else 0.0 end) from v3), 6) as hit_rate,
  round(100 * (select avg(case when is_hit then 1.0 else 0.0 end) from v3), 2) as hit_rate_pct,
  count(*) as size, cast(sum(estimated_bytes) as bigint) as used_bytes, 268435456 as max_bytes,
  round(sum(estimated_bytes) * 100.0 / 268435456, 1) as usage_pct, 0 as evictions
from v1"""))
def cache_stats(spark, sf_dir):
    return O.cache_stats(view(spark, sf_dir, "v3"), view(spark, sf_dir, "v1"), 268_435_456)


@query(with_views("v1", f"""
select case when grouping(namespace) = 1 then '(all)' else namespace end as namespace, grouping(namespace) as is_total, count(*) as size,
  cast(sum(estimated_bytes) as bigint) as bytes, count(*) filter (expires_ms > 0 and {NOW_SQL} > expires_ms) as expired
from v1 group by rollup(namespace)"""))
def namespace_stats(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    return O.namespace_stats(v1, now_of(v1))


@query(with_views("v3", """
with s as (select *, sum(case when operation = 'SESSION_START' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as session_no from v3)
select user_id, cast(session_no as bigint) as session_no, count(*) filter (operation <> 'SESSION_START' and is_hit) as hits,
  count(*) filter (operation <> 'SESSION_START' and not is_hit) as misses
from s group by user_id, session_no"""))
def session_counters(spark, sf_dir):
    calls = view(spark, sf_dir, "v3").select("user_id", "event_id", "operation", "is_hit")
    return O.session_counters(calls, ["user_id"], "event_id", [], F.col("operation") == "SESSION_START")


@query("""
select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm,
  round(list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) /
   (sqrt(list_dot_product(embedding::double[], embedding::double[])) * (select sqrt(list_dot_product(embedding::double[], embedding::double[])) from embeddings where vec_id = 0)), 6) as cosine
from embeddings""")
def vector_expressions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = query_vector(spark, sf_dir)
    literal = F.array(*[F.lit(x) for x in q])
    normed = e.withColumn("n", V.l2_norm(F.col("embedding")))
    return normed.select(
        "vec_id", F.round("n", 6).alias("norm"),
        F.round(V.cosine(F.col("embedding"), literal, F.col("n"), V.l2_norm(literal)), 6).alias("cosine"))


@query(with_views("v1", f"""
select id, case when expires_ms = 0 then -1 else greatest(expires_ms - {NOW_SQL}, 0) end as ttl_left from v1"""))
def remaining_ttl(spark, sf_dir):
    v1 = view(spark, sf_dir, "v1")
    return v1.select("id", V.remaining_ttl(F.col("expires_ms"), now_of(v1)).alias("ttl_left"))
