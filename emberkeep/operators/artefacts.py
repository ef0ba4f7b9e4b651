"""The versioned artefact registry: listing, validation, resolution, lifecycle, search, diffs."""

from __future__ import annotations

import difflib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberkeep.functions.versions import BUMPS, semver, semver_text
from emberkeep.operators.running import order_bounds, running
from emberkeep.operators.selection import key_at, key_literal, sort_key
from emberkeep.operators.similarity import search_topk_batch
from emberkeep.operators.vectors import search_topk

# Types, roles in rising order, allowed transitions and page limits.
TYPES = ["prompt", "skill", "chain", "tool"]
ROLES = ["viewer", "contributor", "reviewer", "admin"]
TRANSITIONS = [
    ("draft", "review", "contributor"),
    ("review", "verified", "reviewer"),
    ("review", "draft", "reviewer"),
    ("verified", "deprecated", "admin"),
]
SLUG = r"^[a-z0-9-]+$"
PAGE_LIMIT, MAX_PAGE_LIMIT = 20, 100
SEARCH_LIMIT = HISTORY_LIMIT = 10


def role_rank(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), role)


# --- filters and validation ---------------------------------------------------


def list_artefacts(
    v: DataFrame, namespace: str | None = None, type: str | None = None, status: str | None = None,
    tags: list[str] | None = None, model: str | None = None, framework: str | None = None,
) -> DataFrame:
    """Rows meeting every given filter; all of ``tags`` must be present."""
    for name, value in (("namespace", namespace), ("type", type), ("status", status)):
        if value is not None:
            v = v.where(F.col(name) == value)
    for tag in tags or []:
        v = v.where(F.array_contains("tags", tag))
    if model is not None:
        v = v.where(F.exists("compatible_models", lambda m: m["model"] == model))
    if framework is not None:
        v = v.where(F.array_contains("compatible_frameworks", framework))
    return v


def validate_artefacts(df: DataFrame) -> DataFrame:
    """Add ``errors``: (namespace, name, type, bump, system, user_template) rows to publish."""

    def bad_slug(column: str, limit: int) -> Column:
        c = F.col(column)
        return c.isNull() | ~c.rlike(SLUG) | (F.length(c) > limit)

    def blank(column: str) -> Column:
        return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""

    checks = [
        ("INVALID_NAMESPACE", bad_slug("namespace", 64)),
        ("INVALID_NAME", bad_slug("name", 128)),
        ("INVALID_TYPE", ~F.coalesce(F.col("type").isin(TYPES), F.lit(False))),
        ("INVALID_BUMP", ~F.coalesce(F.col("bump").isin(*BUMPS), F.lit(False))),
        ("MISSING_CONTENT", blank("system") & blank("user_template")),
    ]
    errors = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in checks]))
    return df.withColumn("errors", errors)


def soft_delete(v: DataFrame, keys: DataFrame) -> DataFrame:
    """Mark (id, version) keys deleted; a verified version is refused."""
    asked = keys.select("id", "version").distinct().withColumn("__asked", F.lit(True))
    hit = F.coalesce("__asked", F.lit(False))
    verified = F.col("status") == "verified"
    return v.join(asked, ["id", "version"], "left").withColumns({
        "error": F.when(hit & verified, "DEPRECATE_FIRST"),
        "status": F.when(hit & ~verified, "deleted").otherwise(F.col("status")),
    }).drop("__asked")


# --- resolution -----------------------------------------------------------------


def pin_index(v: DataFrame) -> DataFrame:
    """(id, pin) -> newest verified version, for pins '', 'x', 'x.y' and 'x.y.z'.

    Also holds the newest draft under '' for artefacts with nothing verified.
    Requests then resolve by one equality join instead of meeting every version.
    """
    parsed = v.withColumn("sv", semver(F.col("version"))).where("sv is not null")
    pins = F.array(
        F.lit(""), F.col("sv.major").cast("string"), F.concat_ws(".", "sv.major", "sv.minor"), F.col("version"))
    verified = (
        parsed.where("status = 'verified'").select("id", "sv", F.explode(F.array_distinct(pins)).alias("pin"))
        .groupBy("id", "pin").agg(F.max("sv").alias("sv"))
    )
    drafts = parsed.where("status = 'draft'").groupBy("id").agg(F.max("sv").alias("draft_sv"))
    newest = verified.where("pin = ''").join(drafts, "id", "full").select(
        "id", F.lit("").alias("pin"), F.coalesce("sv", "draft_sv").alias("sv"), F.col("sv").isNull().alias("is_draft"))
    return verified.where("pin <> ''").withColumn("is_draft", F.lit(False)).unionByName(newest)


def resolve_versions(v: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve requests (id, pin) to the highest matching version, or report why not."""
    wanted = requests.withColumn("pin", F.coalesce("pin", F.lit("")))
    found = wanted.join(pin_index(v), ["id", "pin"], "left")
    return found.select(
        *wanted.columns, semver_text(F.col("sv")).alias("version"),
        F.coalesce("is_draft", F.lit(False)).alias("is_draft"),
        F.when(F.col("sv").isNull(), "NOT_FOUND").alias("error"))


def pin_updates(pins: DataFrame, v: DataFrame, allow: str = "minor") -> DataFrame:
    """(id, old, new) for pins with a newer compatible version; ``major`` allows any."""
    if allow not in ("minor", "major"):
        raise ValueError("allow must be 'minor' or 'major'")
    parsed = pins.withColumn("old_sv", semver(F.col("version")))
    pin = F.lit("") if allow == "major" else F.col("old_sv.major").cast("string")
    index = pin_index(v).where("not is_draft")
    found = parsed.withColumn("pin", pin).join(index, ["id", "pin"])
    return found.where(F.col("sv") > F.col("old_sv")).select(
        "id", F.col("version").alias("old_version"), semver_text(F.col("sv")).alias("new_version"))


def version_conflicts(v: DataFrame, publishes: DataFrame) -> DataFrame:
    """Publishes of an (id, version) that exists already."""
    return publishes.join(v.select("id", "version"), ["id", "version"], "left_semi").withColumn("error", F.lit("VERSION_EXISTS"))


# --- access and lifecycle ---------------------------------------------------------


def visible_artefacts(v: DataFrame, members: DataFrame, now_ms: int | None = None) -> DataFrame:
    """What each member sees in their namespaces; viewers see verified versions only."""
    if now_ms is not None and "expires_ms" in members.columns:
        members = members.where(F.col("expires_ms").isNull() | (F.col("expires_ms") >= now_ms))
    scoped = v.join(members.select("user_id", "namespace", "role"), "namespace")
    sees_all = role_rank(F.col("role")) >= ROLES.index("contributor") + 1
    return scoped.where(sees_all | ((F.col("role") == "viewer") & (F.col("status") == "verified")))


def promote(v: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated versions, audit rows, rejected requests).

    ``requests``: request_no, id, version, to_status, user_id, role, comment,
    successor.  One request per version takes effect: the lowest request_no.
    """
    fields = ["to_status", "user_id", "role", "comment", "successor"]
    first = requests.groupBy("id", "version").agg(F.min("request_no").alias("first_no"))
    current = v.select("id", "version", F.col("status").alias("from_status"))
    judged = requests.join(first, ["id", "version"]).join(current, ["id", "version"], "left")
    needed = reduce(
        lambda acc, t: acc.when((F.col("from_status") == t[0]) & (F.col("to_status") == t[1]), ROLES.index(t[2]) + 1),
        TRANSITIONS, F.when(F.lit(False), 0))
    error = (
        F.when(F.col("from_status").isNull(), "NOT_FOUND")
        .when(F.col("request_no") != F.col("first_no"), "SUPERSEDED")
        .when(needed.isNull(), "INVALID_TRANSITION")
        .when(F.coalesce(role_rank(F.col("role")), F.lit(0)) < needed, "FORBIDDEN")
        .when((F.col("to_status") == "deprecated") & F.col("successor").isNull(), "SUCCESSOR_REQUIRED")
    )
    judged = judged.withColumn("error", error)
    accepted = judged.where("error is null").select("request_no", "id", "version", "from_status", *fields)
    change = accepted.select("id", "version", F.col("to_status").alias("__to"), F.col("successor").alias("__successor"))
    updated = v.join(change, ["id", "version"], "left").withColumns({
        "status": F.coalesce("__to", "status"), "successor": F.col("__successor")}).drop("__to", "__successor")
    rejected = judged.where("error is not null").select("request_no", "id", "version", "to_status", "error")
    return updated, accepted, rejected


# --- search -------------------------------------------------------------------------


def paginate(df: DataFrame, order: list[str], page: int = 1, limit: int = PAGE_LIMIT) -> DataFrame:
    """One page of rows in ascending order, with page, limit, total and pages.

    The page's first key is found by counting, so page 1,000,000 keeps no more
    rows in a task than page 1.  ``order`` should be total: rows alike in all
    of it are told apart by chance, and a page among them is cut from all that
    are.
    """
    limit = max(1, min(limit, MAX_PAGE_LIMIT))
    page = max(1, page)
    start, total = (page - 1) * limit, df.count()
    found = key_at(df, order, start)
    if found is None:
        slice_ = df.where(F.lit(False))
    else:
        first, kind, smaller = found
        slice_ = df.where(sort_key(order) >= key_literal(first, kind)).orderBy(*order).offset(start - smaller).limit(limit)
    return slice_.withColumns({
        "page": F.lit(page), "limit": F.lit(limit), "total": F.lit(total).cast("long"), "pages": F.lit(-(-total // limit)).cast("long")})


def paginate_after(df: DataFrame, order: list[str], after: list | None, limit: int = PAGE_LIMIT) -> DataFrame:
    """The rows that follow the last row of the page before, given by its order values.

    Deep pages cost no more than the first: the condition reaches the scan
    and each task keeps ``limit`` rows.
    """
    limit = max(1, min(limit, MAX_PAGE_LIMIT))
    if after is not None:
        here = F.struct(*[F.col(c).alias(c) for c in order])
        last = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        df = df.where((F.col(order[0]) >= F.lit(after[0])) & (here > last))
    return df.orderBy(*order).limit(limit)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def keyword_search(
    docs: DataFrame, q: str, text_cols: list[str], status: str | None = "verified", limit: int = SEARCH_LIMIT,
    snippet_col: str | None = None,
) -> DataFrame:
    """Rank by summed tf-idf of the query terms; idf is ln((n + 1) / (df + 1)) + 1.

    Terms are counted in place, so the corpus is read twice and never exploded
    or shuffled: once for the document frequencies, once for the scores.
    """
    terms = list(dict.fromkeys(t for t in _words(q)))
    if not terms:
        raise ValueError("the search has no terms")
    rows = docs if status is None else docs.where(F.col("status") == status)
    text = F.lower(F.concat_ws(" ", *text_cols))
    # Only a text that holds a term somewhere is cut into words.
    candidate = reduce(lambda a, b: a | b, [F.contains("__text", F.lit(t)) for t in terms])
    held = F.filter(tokens(F.col("__text")), lambda w: w.isin(terms))
    counts = F.transform(F.array(*map(F.lit, terms)), lambda term: F.size(F.filter("__words", lambda w: w == term)))
    counted = rows.withColumn("__text", text).withColumn(
        "__words", F.when(candidate, held).otherwise(F.array().cast("array<string>"))).withColumn("__tf", counts).drop("__text")
    stats = counted.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("__tf")[i] > 0).alias(f"d{i}") for i in range(len(terms))])
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    score = reduce(lambda a, b: a + b, [
        F.col("__tf")[i] * (F.log((F.col("__s.n") + 1) / (F.col(f"__s.d{i}") + 1)) + 1) for i in range(len(terms))])
    hits = counted.where(F.exists("__tf", lambda n: n > 0)).withColumn("__s", packed)
    ranked = hits.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.asc("id"), F.asc("version")).limit(limit)
    if snippet_col:
        pattern = "(?i)(" + "|".join(terms) + ")"
        start = F.greatest(F.regexp_instr(F.col(snippet_col), F.lit(pattern)) - 40, F.lit(1))
        around = F.substring(F.col(snippet_col), start, F.lit(160))
        ranked = ranked.withColumn("snippet", F.regexp_replace(around, pattern, "<em>$1</em>"))
    return ranked.drop("__words", "__tf", "__s")


def _words(q: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in q.lower()).split()


def semantic_search(v: DataFrame, vectors: DataFrame, query: list[float], limit: int = SEARCH_LIMIT, **filters) -> DataFrame:
    """Top-k by cosine among the artefacts that pass the filters."""
    allowed = list_artefacts(v, **filters).select("id", "version")
    wanted = vectors.join(allowed, ["id", "version"], "left_semi").withColumn("key", F.concat_ws("@", "id", "version"))
    hits = search_topk(wanted.select(F.col("key").alias("id"), "embedding"), query, limit)
    return hits.select(
        F.split_part("id", F.lit("@"), F.lit(1)).alias("id"), F.split_part("id", F.lit("@"), F.lit(2)).alias("version"), "score")


def top_artefacts(fetches: DataFrame, n: int) -> DataFrame:
    return fetches.groupBy("artefact_id").agg(F.count("*").alias("fetches")).orderBy(F.desc("fetches"), F.asc("artefact_id")).limit(n)


FUSION_OFFSET = 60  # ours: how little the first ranks differ in the fused score


def related_by_all(v: DataFrame, vectors: DataFrame, k: int, dim: int, depth: int | None = None) -> DataFrame:
    """The k artefacts related most by tags, by models and by vector together: (id, related_id, score, rank, by_tags, by_models, by_vector).

    ``v``: id, tags, models; ``vectors``: id, embedding.  Each of the three
    ranks the others of an artefact by itself, exactly, and gives its first
    ``depth`` (four times k unless said); a place in a ranking counts
    1 / (60 + rank) and the sums decide, ties by id.  The ranks are null where
    a ranking doesn't name the artefact.  Rankings only meet as lists of
    ``depth`` rows an artefact.
    """
    depth = depth or 4 * k
    tags = related_artefacts(v.select("id", "tags"), depth)
    models = related_artefacts(v.select("id", F.col("models").alias("tags")), depth)
    # An artefact finds itself among its nearest vectors, unless others are as near and come first by id.
    near = search_topk_batch(vectors, vectors.select(F.col("id").alias("query_id"), "embedding"), depth + 1, dim).where("query_id <> id")
    others = Window.partitionBy("query_id").orderBy("rank")
    near = near.select(F.col("query_id").alias("id"), F.col("id").alias("related_id"), F.row_number().over(others).alias("rank")).where(F.col("rank") <= depth)
    lists = [rows.select("id", "related_id", F.col("rank").cast("int").alias("place"), F.lit(name).alias("by")) for name, rows in (("tags", tags), ("models", models), ("vector", near))]
    fused = reduce(DataFrame.unionByName, lists).groupBy("id", "related_id").agg(
        F.round(F.sum(1.0 / (FUSION_OFFSET + F.col("place"))), 9).alias("score"), *[F.max(F.when(F.col("by") == name, F.col("place"))).alias(f"by_{name}") for name in ("tags", "models", "vector")])
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("related_id"))
    ranked = fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("id", "related_id", "score", "rank", "by_tags", "by_models", "by_vector")


def related_artefacts(v: DataFrame, k: int) -> DataFrame:
    """The k artefacts with the closest tag sets (Jaccard), ties by id.

    Artefacts with one tag set score alike against everything, so tag sets are
    compared instead of artefacts, and a set only offers its first k + 1 ids:
    later ones can never rank.  The result is exact, without artefact pairs.
    """
    tagged = v.select("id", F.array_sort(F.array_distinct("tags")).alias("tags")).where(F.size("tags") > 0)
    first_ids = Window.partitionBy("tags").orderBy("id")
    offers = tagged.withColumn("n", F.row_number().over(first_ids)).where(F.col("n") <= k + 1).select("tags", F.col("id").alias("related_id"))
    sets = tagged.select("tags").distinct()
    by_tag = sets.select("tags", F.explode("tags").alias("tag"))
    shared = (
        by_tag.join(by_tag.select(F.col("tags").alias("other"), "tag"), "tag")
        .groupBy("tags", "other").agg(F.count("*").alias("common"))
    )
    union_size = F.size("tags") + F.size("other") - F.col("common")
    scored = shared.select("tags", "other", F.round(F.col("common") / union_size, 6).alias("score"))
    best = Window.partitionBy("tags").orderBy(F.desc("score"), F.asc("related_id"))
    shortlist = (
        scored.join(offers.withColumnRenamed("tags", "other"), "other")
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("tags", "related_id", "score")
    )
    per_id = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("related_id"))
    return (
        tagged.join(shortlist, "tags").where(F.col("id") != F.col("related_id"))
        .withColumn("rank", F.row_number().over(per_id)).where(F.col("rank") <= k)
        .select("id", "related_id", "score", "rank")
    )


# --- history and bumps ------------------------------------------------------------------


def version_history(v: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest first per artefact, at most ``limit`` each."""
    newest = Window.partitionBy("id").orderBy(F.desc(semver(F.col("version"))))
    return v.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)


def version_order(version: Column) -> Column:
    """A number that never falls as versions rise; saturates at 1023 per part.

    It only places rows in buckets; the exact order comes from ``semver``.
    """
    sv = semver(version)
    minor = F.least(sv["minor"], F.lit(1023))
    patch = F.when(minor == 1023, 1023).otherwise(F.least(sv["patch"], F.lit(1023)))
    return sv["major"].cast("double") * 1048576 + minor * 1024 + patch


def consecutive_diff(v: DataFrame, carried: list[str]) -> DataFrame:
    """Each version with its predecessor: ``previous`` and ``previous_<column>``."""
    staged = v.withColumns({"__at": version_order(F.col("version")), "__sv": semver(F.col("version"))}).where("__sv is not null")
    before = running(
        staged, ["id"], "__at", ["__sv"], {"__prev": ("prev", F.struct("version", *carried))})
    return before.select(
        *v.columns, F.col("__prev.version").alias("previous"),
        *[F.col(f"__prev.{c}").alias(f"previous_{c}") for c in carried])


def next_version(publishes: DataFrame, v: DataFrame) -> DataFrame:
    """Give every publish (id, publish_no, bump) its number.

    Publishes of one artefact compound in order.  With running counts of each
    bump, a part resets at the last higher bump, which is a running maximum of
    the count seen there.
    """
    highest = v.withColumn("sv", semver(F.col("version"))).where("sv is not null").groupBy("id").agg(F.max("sv").alias("base"))
    opening = publishes.groupBy("id").agg(F.min("publish_no").alias("opening_no"))
    known = publishes.join(opening, "id").join(highest, "id", "left")
    is_first = F.col("base").isNull() & (F.col("publish_no") == F.col("opening_no"))
    known = known.withColumns({
        "step": F.when(is_first, "first").otherwise(F.col("bump")),
        "major0": F.coalesce(F.col("base.major"), F.lit(1)),
        "minor0": F.coalesce(F.col("base.minor"), F.lit(0)),
        "patch0": F.coalesce(F.col("base.patch"), F.lit(0)),
    })

    def seen(bump: str) -> tuple[str, Column]:
        return "sum", F.when(F.col("step") == bump, 1).otherwise(0)

    bounds = order_bounds(publishes, "publish_no")
    counted = running(known, ["id"], "publish_no", [], {f"n_{b}": seen(b) for b in BUMPS}, bounds)
    resets = {
        "minor_reset": ("max", F.when(F.col("step") == "major", F.col("n_minor"))),
        "patch_reset": ("max", F.when(F.col("step").isin("major", "minor"), F.col("n_patch"))),
    }
    folded = running(counted, ["id"], "publish_no", [], resets, bounds)
    minor = F.coalesce(F.col("n_minor") - F.col("minor_reset"), F.col("minor0") + F.col("n_minor"))
    patch = F.coalesce(F.col("n_patch") - F.col("patch_reset"), F.col("patch0") + F.col("n_patch"))
    return folded.select(
        "id", "publish_no", "bump", F.concat_ws(".", F.col("major0") + F.col("n_major"), minor, patch).alias("version"))


# --- diffs ----------------------------------------------------------------------------


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Lines added and removed per key as multisets: (keys, line, side, copies).

    Old and new lines are counted against each other in one aggregate that
    combines before the shuffle.
    """

    def lines(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*keys, F.explode_outer(F.split(content, "\n")).alias("line"), F.lit(sign).alias("sign"))

    net = lines(old, -1).unionByName(lines(new, 1)).groupBy(*keys, "line").agg(F.sum("sign").alias("net"))
    return net.where("net <> 0").select(
        *keys, "line", F.when(F.col("net") > 0, "added").otherwise("removed").alias("side"), F.abs("net").alias("copies"))


def variable_diff(old: Column, new: Column) -> Column:
    """struct<added, removed, modified> over arrays of structs with a ``name``."""

    def names(a: Column) -> Column:
        return F.transform(a, lambda x: x["name"])

    changed = F.filter(new, lambda n: F.exists(old, lambda o: (o["name"] == n["name"]) & (o != n)))
    return F.struct(
        F.array_except(names(new), names(old)).alias("added"),
        F.array_except(names(old), names(new)).alias("removed"),
        names(changed).alias("modified"))


def array_field_diff(old: Column, new: Column) -> Column:
    return F.struct(F.array_except(new, old).alias("added"), F.array_except(old, new).alias("removed"))


def unified_diff(old: Column, new: Column, old_name: Column, new_name: Column) -> Column:
    """A unified text diff; a stdlib call per pair inside an Arrow batch."""

    @F.arrow_udf("string")
    def diff(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, p, q in zip(a.to_pylist(), b.to_pylist(), na.to_pylist(), nb.to_pylist()):
            lines = difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), p, q, lineterm="")
            out.append("\n".join(lines))
        return pa.array(out, pa.string())

    return diff(old, new, old_name, new_name)
