"""DuckDB SQL for the numbered queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, case when len(ws) < 2 then ws
    else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w
), e as (select doc_id, unnest(sh) as x from s),
l as (
  select a, b from (select p.doc_id as a, q.doc_id as b, count(*) as c from e p join e q on p.x = q.x and p.doc_id < q.doc_id group by 1, 2) i
  join s m on m.doc_id = a join s n on n.doc_id = b where 100 * c >= 80 * (len(m.sh) + len(n.sh) - c)
), u as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from s union select u.b, r.c from r join u on u.a = r.doc_id),
g as (select doc_id, min(c) as c from r group by 1)
select s.doc_id, len(s.sh)::bigint as n_shingles, g.c as component_id, s.doc_id = g.c as kept from s join g using (doc_id)
"""

_SUFFIX = "case when array_to_string(labels[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') then array_to_string(labels[-2:], '.') else labels[-1] end"
_DOMAIN = "case when array_to_string(labels[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') then array_to_string(labels[-3:], '.') else array_to_string(labels[-2:], '.') end"


def _strength(name: str, key: str) -> str:
    return f"""{name}_groups as (select {key} as k, sum(good) as good, sum(n) as n from hosts where n > 0 group by 1),
{name}_sums as (select count(*) as g, sum(good) as good, sum(n) as n, sum(n * n) as sq, sum(good * good / n) as spread from {name}_groups),
{name}_parts as (select good / n as share, n - sq / n - (g - 1) as room, g, n, spread - good * good / n as between_ from {name}_sums),
{name}_alike as (select *, case when share not in (0, 1) and room > 0 then (between_ / (share * (1 - share)) - (g - 1)) / room end as alike from {name}_parts),
{name}_level as (select coalesce(share, 0.5) as share, case when alike is null then 10.0 when alike > 0
  then round(least(greatest((1 - alike) / alike, 1.0), 1000.0), 6) else 1000.0 end as strength from {name}_alike)"""


URL_REPUTATION = rf"""
with cut as (
  select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from cut
), parsed as (
  select page_id, translate(raw_host, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from parts
), judged as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from parsed
), ruled as (
  select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as said from judged
), counted as (
  select host, count(said)::double as n, count(case when said = 'allow' then 1 end)::double as good, string_split(host, '.') as labels from ruled group by host
), hosts as (select host, n, good, {_SUFFIX} as suffix, {_DOMAIN} as domain from counted),
{_strength("suffix", "suffix")}, {_strength("domain", "domain")}, {_strength("host", "host")},
suffixes as (select suffix, (sum(good) + max(strength) * max(share)) / (sum(n) + max(strength)) as mean from hosts, suffix_level group by suffix),
domains as (
  select domain, (sum(good) + max(strength) * max(s.mean)) / (sum(n) + max(strength)) as mean
  from hosts h join suffixes s using (suffix), domain_level group by domain, suffix
), means as (
  select host, (good + strength * d.mean) / (n + strength) as m, n + strength as w from hosts h join domains d using (domain), host_level
)
select page_id, r.host, path, rule, coalesce(said, case when least(1.0, m + 1.645 * sqrt(m * (1 - m) / (w + 1))) < 0.5 then 'block' else 'allow' end) as verdict
from ruled r join means using (host)
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, step: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))))"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


_FIELDS = " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars"))


def _sides(name: str, nodes: str) -> str:
    """Digests on either side of each node that isn't a tree's last one."""
    return f"""{name} as (
  select a.lvl, a.tree, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), '') as before, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '') as after
  from {nodes} a join {nodes} b on a.lvl = b.lvl and a.tree = b.tree and a.idx // 3 = b.idx // 3 where a.n > 1 group by 1, 2, 3
)"""


def _up(name: str, leaves: str) -> str:
    return f"""{name} as (
  select 0 as lvl, tree, idx, n, h from {leaves}
  union all
  select lvl + 1, tree, idx // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by idx)) from {name} where n > 1 group by lvl, tree, idx // 3
)"""


MERKLE = f"""
with recursive hashed as (
  select doc_id, coalesce('+' || source, '') as tree, sha256({_FIELDS} || {_field("text")}) as h,
    sha256({_FIELDS} || {_field("(case when " + _CRC32.format("doc_id::varchar") + " % 2 = 0 then replace(text, chr(10), '') else text end)")}) as tampered from documents
), leaves as (select *, row_number() over (partition by tree order by doc_id) - 1 as idx, count(*) over (partition by tree) as n from hashed),
{_up("up", "leaves")}, {_sides("sides", "up")},
ends as (select tree as name, h, '' as tree, row_number() over (order by tree) - 1 as idx, count(*) over () as n from up where n = 1),
{_up("top", "ends")}, {_sides("top_sides", "top")},
walk as (
  select doc_id, tree, h as leaf, tampered as folded, '' as proof, 0 as lvl, idx, n from leaves
  union all
  select doc_id, w.tree, leaf, sha256(before || folded || after), proof || before || after, w.lvl + 1, w.idx // 3, (n + 2) // 3
  from walk w join sides s on s.lvl = w.lvl and s.tree = w.tree and s.idx = w.idx where n > 1
), over_groups as (
  select doc_id, leaf, e.h as subroot, folded, proof, 0 as lvl, e.idx, e.n from walk w join ends e on e.name = w.tree where w.n = 1
  union all
  select doc_id, leaf, subroot, sha256(before || folded || after), proof || before || after, w.lvl + 1, w.idx // 3, (n + 2) // 3
  from over_groups w join top_sides s on s.lvl = w.lvl and s.idx = w.idx where n > 1
)
select doc_id, leaf, subroot, (select h from top where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root, folded = (select h from top where n = 1) as verified
from over_groups where n = 1
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as three steps: nearest entries, floors of means, and the books of the next one."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""assigned{r} as (
  select vec_id, label, part, x, min_by(entry, d * {entries} + entry) as entry, min(d) as d
  from (select p.*, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))::bigint as d from cut p join book{r} b using (part)) group by all
)""")
        if r < rounds:
            steps.append(f"""means{r} as (
  select part, entry, list(case when s >= 0 then s // n else -((-s + n - 1) // n) end order by place) as c
  from (select part, entry, place, sum(x[place])::bigint as s, count(*) as n from assigned{r}, (select unnest(range(1, 1 + (select max(len(x)) from cut))) as place) group by 1, 2, 3) group by 1, 2
), book{r + 1} as (select part, entry, coalesce(m.c, b.c) as c from book{r} b left join means{r} m using (part, entry))""")
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 4096)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as (select vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] as x from kept, (select unnest(range({parts})) as part)),
book0 as (select part, entry, x as c from cut join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept) using (vec_id) where entry < {entries}),
{", ".join(steps)},
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as d from book{rounds}),
coded as (select vec_id, any_value(label) as label, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from assigned{rounds} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select d from digest) as codebooks_sha256 from coded
"""


VECTOR_CODES = _vector_codes()
