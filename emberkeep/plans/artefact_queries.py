"""Registered queries over the artefact registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberkeep.functions import versions as X
from emberkeep.operators import artefacts as R
from emberkeep.plans.registry import query
from emberkeep.plans.views import table, view, with_views
from emberkeep.session import work_dir
from emberkeep.sources import artefacts as S

MEMBERS = [("u0", "ns0", "viewer"), ("u1", "ns0", "contributor"), ("u1", "ns1", "reviewer"),
           ("u2", "ns2", "admin"), ("u3", "ns3", "viewer")]
MEMBERS_SQL = "(values " + ", ".join(str(m) for m in MEMBERS) + ") as m(user_id, namespace, role)"
SV = "(string_split(version, '.')[1]::int * 1000000 + string_split(version, '.')[2]::int * 1000 + string_split(version, '.')[3]::int)"


def versions(spark, sf_dir):
    model = F.struct("model", F.lit(8_000).alias("min_context"), (F.col("doc_id") % 2 == 0).alias("recommended"))
    return view(spark, sf_dir, "v5").withColumns({
        "tags": F.array("tag_lang", "tag_source"), "compatible_models": F.array(model), "compatible_frameworks": F.array(F.lit("core"))})


@query(with_views("v5", """
select id, version from v5 where namespace = 'ns3' and status = 'verified' and tag_lang = 'en' and model = 'model-a'"""))
def list_artefacts(spark, sf_dir):
    found = R.list_artefacts(versions(spark, sf_dir), namespace="ns3", status="verified", tags=["en"], model="model-a", framework="core")
    return found.select("id", "version")


@query(with_views("v5", """
select doc_id, concat_ws(',', case when doc_id % 10 = 0 then 'INVALID_NAMESPACE' end, case when doc_id % 6 = 0 then 'INVALID_NAME' end,
  case when doc_id % 5 = 0 then 'INVALID_TYPE' end, case when doc_id % 8 = 0 then 'INVALID_BUMP' end,
  case when doc_id % 9 = 0 then 'MISSING_CONTENT' end) as errors from v5"""))
def validate_artefacts(spark, sf_dir):
    def damaged(every, bad, good):
        return F.when(F.col("doc_id") % every == 0, F.lit(bad)).otherwise(F.col(good) if isinstance(good, str) else good)

    drafts = view(spark, sf_dir, "v5").select(
        "doc_id", damaged(10, "Bad NS", "namespace").alias("namespace"), damaged(6, "x" * 129, "slug").alias("name"),
        damaged(5, "poem", "type").alias("type"), damaged(8, "huge", F.lit("minor")).alias("bump"),
        damaged(9, "  ", F.lit("You are kind.")).alias("system"), F.lit(None).cast("string").alias("user_template"))
    return R.validate_artefacts(drafts).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query(with_views("v5", """
select id, version, case when doc_id % 6 = 0 and status <> 'verified' then 'deleted' else status end as status,
  case when doc_id % 6 = 0 and status = 'verified' then 'DEPRECATE_FIRST' else '' end as error from v5"""))
def soft_delete(spark, sf_dir):
    v = versions(spark, sf_dir)
    after = R.soft_delete(v, v.where("doc_id % 6 = 0"))
    return after.select("id", "version", "status", F.coalesce("error", F.lit("")).alias("error"))


RESOLVE_SQL = f"""
with r as (select distinct id, pin from v5, (values (''), ('1'), ('2.0'), ('2.1.0'), ('9')) as t(pin)
  union all select 'ns9/none', ''),
vv as (select r.id, r.pin, arg_max(version, {SV}) as version from r join v5 on v5.id = r.id and status = 'verified'
  and (pin = '' or version = pin or starts_with(version, pin || '.')) group by r.id, r.pin),
dd as (select id, arg_max(version, {SV}) as version from v5 where status = 'draft' group by id)
select r.id, r.pin, coalesce(vv.version, case when r.pin = '' then dd.version end, '-') as version,
  vv.version is null and r.pin = '' and dd.version is not null as is_draft,
  case when coalesce(vv.version, case when r.pin = '' then dd.version end) is null then 'NOT_FOUND' else '' end as error
from r left join vv on vv.id = r.id and vv.pin = r.pin left join dd on dd.id = r.id
"""


@query(with_views("v5", RESOLVE_SQL))
def resolve_versions(spark, sf_dir):
    v = versions(spark, sf_dir)
    pins = F.explode(F.array(*map(F.lit, ["", "1", "2.0", "2.1.0", "9"])))
    asked = v.select("id").distinct().select("id", pins.alias("pin")).union(spark.createDataFrame([("ns9/none", "")], "id string, pin string"))
    got = R.resolve_versions(v, asked)
    return got.withColumns({"version": F.coalesce("version", F.lit("-")), "error": F.coalesce("error", F.lit(""))})


@query(with_views("v5", f"""
select p.id, p.version as old_version, arg_max(v.version, {SV.replace('version', 'v.version')}) as new_version, 'minor' as allow
from v5 p join v5 v on v.id = p.id and v.status = 'verified' and split_part(v.version, '.', 1) = split_part(p.version, '.', 1) and v.version > p.version
group by p.id, p.version
union all
select p.id, p.version, arg_max(v.version, {SV.replace('version', 'v.version')}), 'major'
from v5 p join v5 v on v.id = p.id and v.status = 'verified' and v.version > p.version group by p.id, p.version"""))
def pin_updates(spark, sf_dir):
    v = versions(spark, sf_dir)
    pins = v.select("id", "version")
    minor, major = (R.pin_updates(pins, v, a).withColumn("allow", F.lit(a)) for a in ("minor", "major"))
    return minor.unionByName(major)


@query(with_views("v5", """
select id, version, 'VERSION_EXISTS' as error from v5 where doc_id % 3 = 0"""))
def version_conflicts(spark, sf_dir):
    v = versions(spark, sf_dir)
    bumped = F.when(F.col("doc_id") % 3 == 0, F.col("version")).otherwise(F.lit("7.0.0"))
    return R.version_conflicts(v, v.select("id", bumped.alias("version"))).select("id", "version", "error")


@query(with_views("v5", f"""
select m.user_id, v5.id, v5.version from v5 join {MEMBERS_SQL} on v5.namespace = m.namespace
where m.role <> 'viewer' or v5.status = 'verified'"""))
def visible_artefacts(spark, sf_dir):
    members = spark.createDataFrame(MEMBERS, "user_id string, namespace string, role string")
    return R.visible_artefacts(versions(spark, sf_dir), members).select("user_id", "id", "version")


@query(with_views("v5", """
with q as (select doc_id as request_no, id, version, status as from_status,
    case doc_id % 4 when 0 then 'review' when 1 then 'verified' when 2 then 'deprecated' else 'draft' end as to_status,
    case doc_id % 3 when 0 then 'contributor' when 1 then 'reviewer' else 'admin' end as role,
    doc_id % 5 <> 0 as has_successor from v5),
j as (select *, case from_status || '>' || to_status when 'draft>review' then 2 when 'review>verified' then 3 when 'review>draft' then 3 when 'verified>deprecated' then 4 end as need,
   case role when 'contributor' then 2 when 'reviewer' then 3 else 4 end as have from q)
select id, version, case when need is null then 'INVALID_TRANSITION' when have < need then 'FORBIDDEN'
  when to_status = 'deprecated' and not has_successor then 'SUCCESSOR_REQUIRED' else from_status || ' to ' || to_status end as outcome,
  case when need is null or have < need or (to_status = 'deprecated' and not has_successor) then from_status else to_status end as status
from j"""))
def promote(spark, sf_dir):
    v = versions(spark, sf_dir)
    d = F.col("doc_id")
    asked = v.select(
        d.alias("request_no"), "id", "version",
        F.when(d % 4 == 0, "review").when(d % 4 == 1, "verified").when(d % 4 == 2, "deprecated").otherwise("draft").alias("to_status"),
        F.col("author").alias("user_id"),
        F.when(d % 3 == 0, "contributor").when(d % 3 == 1, "reviewer").otherwise("admin").alias("role"),
        F.lit("batch").alias("comment"), F.when(d % 5 != 0, F.lit("9.9.9")).alias("successor"))
    updated, audit, rejected = R.promote(v, asked)
    outcome = audit.select("id", "version", F.concat_ws(" to ", "from_status", "to_status").alias("outcome")).unionByName(
        rejected.select("id", "version", F.col("error").alias("outcome")))
    return updated.select("id", "version", "status").join(outcome, ["id", "version"])


@query(with_views("v5", """
select id, version, published_ms, 7 as page, 20 as "limit", (select count(*) from v5) as total,
  cast(ceil((select count(*) from v5) / 20.0) as bigint) as pages
from v5 order by published_ms, id, version limit 20 offset 120"""))
def paginate(spark, sf_dir):
    v = versions(spark, sf_dir).select("id", "version", "published_ms")
    return R.paginate(v, ["published_ms", "id", "version"], 7, 20)


@query(with_views("v5", """
select id, version, namespace from v5 where (namespace, id, version) > ('ns1', 'ns1/doc-21', '1.1.0') order by namespace, id, version limit 20"""))
def paginate_after(spark, sf_dir):
    v = versions(spark, sf_dir).select("id", "version", "namespace")
    return R.paginate_after(v, ["namespace", "id", "version"], ["ns1", "ns1/doc-21", "1.1.0"]).select("id", "version", "namespace")


@query(with_views("v5", """
with t as (select id, version, list_filter(regexp_split_to_array(lower(slug || ' ' || content_system), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from v5 where status = 'verified'),
c as (select id, version, len(list_filter(w, lambda x: x = 'ing')) as a, len(list_filter(w, lambda x: x = 'ble')) as b from t),
s as (select count(*) as n, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c)
select id, version, round(a * (ln((n + 1) / (da + 1)) + 1) + b * (ln((n + 1) / (db + 1)) + 1), 6) as score
from c, s where a + b > 0 order by score desc, id, version limit 10"""))
def keyword_search(spark, sf_dir):
    found = R.keyword_search(versions(spark, sf_dir), "ing ble", ["slug", "content_system"], snippet_col="content_system")
    return found.select("id", "version", "score")


@query(with_views("v5", """
with e as (select v5.id, v5.version, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 9) as score
  from v5 join embeddings on vec_id = doc_id where type = 'skill')
select id, version, score from e order by score desc, id || '@' || version limit 10"""))
def semantic_search(spark, sf_dir):
    v = versions(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    vectors = v.select("doc_id", "id", "version").join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").select("id", "version", "embedding")
    q = list(e.where("vec_id = 0").select("embedding").first()[0])
    return R.semantic_search(v, vectors, q, type="skill")


@query(with_views("v6", """
select subject as artefact_id, count(*) as fetches from v6 where event_type = 'artefact.fetch'
group by subject order by fetches desc, artefact_id limit 10"""))
def top_artefacts(spark, sf_dir):
    fetches = view(spark, sf_dir, "v6").where("event_type = 'artefact.fetch'").select(F.col("subject").alias("artefact_id"))
    return R.top_artefacts(fetches, 10)


@query(with_views("v5", """
with a as (select id, [tag_lang, tag_source] as tags from v5 where version = '2.1.0'),
p as (select x.id, y.id as related_id, len(list_intersect(x.tags, y.tags)) as c from a x, a y where x.id <> y.id),
r as (select id, related_id, round(c / (4 - c), 6) as score, row_number() over (partition by id order by round(c / (4 - c), 6) desc, related_id) as rank from p where c > 0)
select * from r where rank <= 3"""))
def related_artefacts(spark, sf_dir):
    return R.related_artefacts(versions(spark, sf_dir).where("version = '2.1.0'").select("id", "tags"), 3)


MODEL_SETS = "case cast(floor(doc_id / 4) as bigint) % 3 when 0 then {0}('m1', 'm2') when 1 then {0}('m2', 'm3', 'm4') else {0}('m' || cast(floor(doc_id / 4) as bigint) % 7) end"


def _jaccard_sql(name: str, column: str) -> str:
    return f"""{name} as (select id, related_id, place, '{name}' as how from (select x.id, y.id as related_id, row_number() over (partition by x.id order by
  round(len(list_intersect(x.{column}, y.{column})) / (len(x.{column}) + len(y.{column}) - len(list_intersect(x.{column}, y.{column}))), 6) desc, y.id) as place
  from a x, a y where x.id <> y.id and len(list_intersect(x.{column}, y.{column})) > 0) where place <= 12)"""


@query(with_views("v5", f"""
with a as (select doc_id, id, list_distinct([tag_lang, tag_source]) as tags, {MODEL_SETS.format('list_value')} as models from v5 where version = '2.1.0'),
{_jaccard_sql('tags', 'tags')}, {_jaccard_sql('models', 'models')},
e as (select id, embedding::double[] as embedding from a join embeddings on vec_id = doc_id),
vector as (select id, related_id, place, 'vector' as how from (select x.id, y.id as related_id,
  row_number() over (partition by x.id order by round(list_cosine_similarity(x.embedding, y.embedding), 9) desc, y.id) as place from e x, e y where x.id <> y.id) where place <= 12),
f as (select id, related_id, round(sum(1.0::double / (60 + place)), 9) as score, max(place) filter (how = 'tags') as by_tags, max(place) filter (how = 'models') as by_models,
  max(place) filter (how = 'vector') as by_vector from (select * from tags union all select * from models union all select * from vector) group by 1, 2)
select * from (select *, row_number() over (partition by id order by score desc, related_id) as rank from f) where rank <= 3"""))
def related_by_all(spark, sf_dir):
    v = versions(spark, sf_dir).where("version = '2.1.0'").select("doc_id", "id", F.array_distinct("tags").alias("tags"), F.expr(MODEL_SETS.format("array")).alias("models"))
    vectors = v.select("doc_id", "id").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select("id", "embedding")
    return R.related_by_all(v, vectors, 3, 64)


@query(with_views("v5", """
select * from (select id, version, status, author, row_number() over (partition by id order by version desc) as position from v5) where position <= 3"""))
def version_history(spark, sf_dir):
    return R.version_history(versions(spark, sf_dir), 3).select("id", "version", "status", "author", "position")


@query(with_views("v5", """
select id, version, coalesce(lag(version) over w, '-') as previous, coalesce(lag(model) over w, '-') as previous_model,
  case when lag(version) over w is null then 'patch' when model <> lag(model) over w then 'major' when tag_lang <> lag(tag_lang) over w then 'minor' else 'patch' end as inferred_bump
from v5 window w as (partition by id order by version)"""))
def consecutive_diff(spark, sf_dir):
    pairs = R.consecutive_diff(versions(spark, sf_dir).select("id", "version", "model", "tag_lang"), ["model", "tag_lang"])
    no = F.lit(False)
    bump = X.infer_bump(
        F.coalesce(F.col("model") != F.col("previous_model"), no), no, F.coalesce(F.col("tag_lang") != F.col("previous_tag_lang"), no))
    return pairs.select(
        "id", "version", F.coalesce("previous", F.lit("-")).alias("previous"),
        F.coalesce("previous_model", F.lit("-")).alias("previous_model"), bump.alias("inferred_bump"))


@query(with_views("v5", """
with recursive p as (select id, doc_id as publish_no, case doc_id % 5 when 0 then 'major' when 1 then 'minor' when 2 then 'minor' else 'patch' end as bump,
    row_number() over (partition by id order by doc_id) as n from v5),
b as (select id, max(version) as base from v5 group by id),
f as (select p.id, 0::bigint as n, case when base is null then 1 else split_part(base, '.', 1)::int end as a, case when base is null then 0 else split_part(base, '.', 2)::int end as b,
    case when base is null then 0 else split_part(base, '.', 3)::int end as c, base is null as fresh, null::bigint as publish_no, null::varchar as bump
    from (select distinct id from p) p left join b on b.id = p.id
  union all
  select f.id, p.n, case when f.fresh then a when p.bump = 'major' then a + 1 else a end,
    case when f.fresh then b when p.bump = 'major' then 0 when p.bump = 'minor' then b + 1 else b end,
    case when f.fresh then c when p.bump = 'patch' then c + 1 else 0 end, false, p.publish_no, p.bump
  from f join p on p.id = f.id and p.n = f.n + 1)
select id, publish_no, bump, a || '.' || b || '.' || c as version from f where n > 0""").replace("with v5", "with recursive v5").replace("recursive p as", "p as"))
def next_version(spark, sf_dir):
    v = versions(spark, sf_dir)
    d = F.col("doc_id")
    bump = F.when(d % 5 == 0, "major").when(d % 5 <= 2, "minor").otherwise("patch")
    return R.next_version(v.select("id", d.alias("publish_no"), bump.alias("bump")), v)


@query(with_views("v5", """
with o as (select id, unnest(string_split(content_system, chr(10))) as line from v5 where version = '1.0.0'),
n as (select id, unnest(string_split(content_system, chr(10))) as line from v5 where version = '2.1.0'),
d as (select id, line, 'removed' as side from (select * from o except all select * from n)
  union all select id, line, 'added' from (select * from n except all select * from o))
select id, line, side, count(*) as copies from d group by id, line, side"""))
def version_diff(spark, sf_dir):
    v = versions(spark, sf_dir)
    return R.version_diff(v.where("version = '1.0.0'"), v.where("version = '2.1.0'"), ["id"], "content_system")


@query(with_views("v5", """
with v as (select id, version, list_value({'name': 'title', 'required': true}, {'name': 'lang', 'required': doc_id % 3 = 0}, {'name': 'v' || doc_id % 3, 'required': false}) as vars,
  [tag_lang, tag_source] as tags from v5),
p as (select o.id, o.vars as ov, n.vars as nv, o.tags as ot, n.tags as nt from v o join v n on o.id = n.id where o.version = '1.0.0' and n.version = '2.1.0')
select id,
  array_to_string(list_filter(list_transform(nv, lambda x: x.name), lambda x: not list_contains(list_transform(ov, lambda y: y.name), x)), ',') as added,
  array_to_string(list_filter(list_transform(ov, lambda x: x.name), lambda x: not list_contains(list_transform(nv, lambda y: y.name), x)), ',') as removed,
  array_to_string(list_transform(list_filter(nv, lambda x: list_contains(list_transform(ov, lambda y: y.name), x.name) and not list_contains(ov, x)), lambda x: x.name), ',') as modified,
  array_to_string(list_filter(nt, lambda x: not list_contains(ot, x)), ',') as tags_added,
  array_to_string(list_filter(ot, lambda x: not list_contains(nt, x)), ',') as tags_removed
from p"""))
def variable_diff(spark, sf_dir):
    d = F.col("doc_id")

    def var(name, required):
        return F.struct(name.alias("name"), required.alias("required"))

    held = F.array(
        var(F.lit("title"), F.lit(True)), var(F.lit("lang"), d % 3 == 0),
        var(F.concat(F.lit("v"), (d % 3).cast("string")), F.lit(False)))
    v = versions(spark, sf_dir).select("id", "version", held.alias("vars"), "tags")
    old = v.where("version = '1.0.0'").select("id", F.col("vars").alias("old_vars"), F.col("tags").alias("old_tags"))
    both = old.join(v.where("version = '2.1.0'"), "id")
    both = both.withColumns({
        "diff": R.variable_diff(F.col("old_vars"), F.col("vars")), "tag_diff": R.array_field_diff(F.col("old_tags"), F.col("tags"))})
    names = {"added": "diff.added", "removed": "diff.removed", "modified": "diff.modified",
             "tags_added": "tag_diff.added", "tags_removed": "tag_diff.removed"}
    return both.select("id", *[F.array_join(path, ",").alias(n) for n, path in names.items()])


@query()
def unified_diff(spark, sf_dir):
    pairs = R.consecutive_diff(versions(spark, sf_dir).select("id", "version", "content_system"), ["content_system"])
    text = R.unified_diff(F.col("previous_content_system"), F.col("content_system"), F.col("previous"), F.col("version"))
    return pairs.where("previous is not null").select("id", "version", text.alias("diff"))


@query(with_views("v5", """
select id, version, status, author, tag_lang || ',' || tag_source as tags, model, content_system as system, 'team ' || doc_id % 7 as team, 'org' || doc_id % 3 as organisation,
  'sha256:' || sha256(content_system) as checksum, 'changed ' || version as changelog, 'about ' || slug as description, slug || ' use,other' as use_cases, 'core' as frameworks,
  'n|5|a;b' as variable, '{"type":"' || lang || '"}' as output_schema, doc_id % 100 / 2.0::double as risk_score, 'INJ-' || doc_id % 9 as finding, doc_id * 1.5::double as latency,
  case when status = 'deprecated' then 'ns/next' else '-' end as successor from (select v5.*, tag_lang as lang from v5)"""))
def read_artefacts(spark, sf_dir):
    v = versions(spark, sf_dir)
    no, text = F.col("doc_id"), F.col("doc_id").cast("string")

    def struct(**columns):
        return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in columns.items()])

    discovery = struct(description=F.concat(F.lit("about "), "slug"), use_cases=F.array(F.concat("slug", F.lit(" use")), F.lit("other")), compatible_frameworks=F.array(F.lit("core")))
    envelope = F.struct(
        "id", "type", "version", "status", F.concat(F.lit("sha256:"), F.sha2("content_system", 256)).alias("checksum"),
        struct(name=F.col("author"), team=F.concat(F.lit("team "), (no % 7).cast("string"))).alias("author"), F.concat(F.lit("org"), (no % 3).cast("string")).alias("organisation"),
        "namespace", F.concat(F.lit("changed "), "version").alias("changelog"), "tags", "compatible_models", discovery.alias("metadata"),
        struct(system=F.col("content_system"), output_schema=struct(type=F.col("tag_lang"))).alias("content"),
        F.array(struct(name="n", type="int", default=5, values=F.array(F.lit("a"), F.lit("b")))).alias("variables"),
        struct(risk_score=no % 100 / 2.0, findings=F.array(struct(id=F.concat(F.lit("INJ-"), (no % 9).cast("string")), severity="low"))).alias("security"),
        struct(avg_latency_ms=no * 1.5).alias("performance"), F.when(F.col("status") == "deprecated", struct(successor="ns/next")).alias("deprecation"))
    path = work_dir(spark, "artefacts")
    v.select(F.to_json(envelope).alias("value")).write.text(path)
    read, _ = S.read_artefacts(spark, path)
    variable = F.col("variables")[0]
    return read.select(
        "id", "version", "status", F.col("author.name").alias("author"), F.array_join("tags", ",").alias("tags"), F.col("compatible_models")[0]["model"].alias("model"),
        F.col("content.system").alias("system"), F.col("author.team").alias("team"), "organisation", "checksum", "changelog", "description",
        F.array_join("use_cases", ",").alias("use_cases"), F.array_join("compatible_frameworks", ",").alias("frameworks"),
        F.concat_ws("|", variable["name"], variable["default"], F.array_join(variable["values"], ";")).alias("variable"), F.col("content.output_schema").alias("output_schema"),
        F.col("security.risk_score").alias("risk_score"), F.col("security.findings")[0]["id"].alias("finding"), F.col("performance.avg_latency_ms").alias("latency"),
        F.coalesce("deprecation.successor", F.lit("-")).alias("successor"))


@query(with_views("v5", f"""
select distinct 'tag' as kind, tag_lang as key, id as value from v5 union select distinct 'tag', tag_source, id from v5
union all select distinct 'model', model, id from v5
union all select 'version', v5.id || '@' || version, status || ' of ' || n || ', verified ' || coalesce(lv, '-') || ', draft ' || coalesce(ld, '-')
from v5 join (select id, count(*) as n, arg_max(version, {SV}) filter (status = 'verified') as lv, arg_max(version, {SV}) filter (status = 'draft') as ld from v5 group by id) x on x.id = v5.id"""))
def build_registry_indexes(spark, sf_dir):
    index = S.build_registry_indexes(versions(spark, sf_dir))
    parts = [index[n].select(F.lit(k).alias("kind"), "key", F.col("artefact_id").alias("value")) for n, k in (("tags", "tag"), ("models", "model"))]
    shown = F.concat(
        "status", F.lit(" of "), "n_versions", F.lit(", verified "), F.coalesce("latest_verified", F.lit("-")),
        F.lit(", draft "), F.coalesce("latest_draft", F.lit("-")))
    listed = index["versions"].select(F.lit("version").alias("kind"), F.concat_ws("@", "artefact_id", "version").alias("key"), shown.alias("value"))
    return parts[0].unionByName(parts[1]).unionByName(listed)


@query(with_views("v5", """
select doc_id, split_part(id, '/', 1) as namespace, split_part(id, '/', 2) as name, case when doc_id % 3 = 0 then '-' else version end as version,
  case when doc_id % 7 = 0 then 'INVALID_VERSION' else '' end as error, split_part(version, '.', 1)::int as major, version > '1.5.0' as is_newer
from (select doc_id, id, case when doc_id % 7 = 0 then 'x' || version else version end as version, version as plain from v5 where doc_id % 7 <> 0)
union all
select doc_id, split_part(id, '/', 1), split_part(id, '/', 2), 'x' || version, 'INVALID_VERSION', split_part(version, '.', 1)::int, version > '1.5.0' from v5 where doc_id % 7 = 0"""))
def parse_artefact_ref(spark, sf_dir):
    d = F.col("doc_id")
    version = F.when(d % 7 == 0, F.concat(F.lit("@x"), "version")).when(d % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("@"), "version"))
    v = view(spark, sf_dir, "v5").withColumn("ref", X.parse_artefact_ref(F.concat("id", version)))
    return v.select(
        "doc_id", "ref.namespace", "ref.name", F.coalesce("ref.version", F.lit("-")).alias("version"),
        F.coalesce("ref.error", F.lit("")).alias("error"), X.semver(F.col("version"))["major"].alias("major"),
        (X.semver_cmp(F.col("version"), F.lit("1.5.0")) > 0).alias("is_newer"))
