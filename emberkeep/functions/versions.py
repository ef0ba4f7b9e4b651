"""Artefact references, semantic versions and version bumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMVER = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?$"
BUMPS = ("patch", "minor", "major")


def semver(s: Column) -> Column:
    """struct<major, minor, patch, release, parts, pre, text>, ordered as versions are.

    ``release`` is 0 for a pre-release, so it sorts below its release;
    ``parts`` are the dot-parts of the pre-release, numbers before and as
    numbers.  ``text`` is what was stored.  Text that is not a version, or has
    a number beyond 64 bits, gives null.
    """
    number = r"^\d+$"
    part = [F.regexp_extract(s, SEMVER, i) for i in range(1, 5)]
    parsed = F.struct(
        part[0].try_cast("bigint").alias("major"),
        part[1].try_cast("bigint").alias("minor"),
        part[2].try_cast("bigint").alias("patch"),
        F.when(part[3] == "", F.lit(1)).otherwise(F.lit(0)).alias("release"),
        F.transform(F.split(part[3], r"\."), lambda x: F.struct(
            F.when(x.rlike(number), 0).otherwise(1).alias("kind"), x.try_cast("decimal(38,0)").alias("number"), x.alias("text"))).alias("parts"),
        part[3].alias("pre"),
        s.alias("text"),
    )
    sound = F.forall(F.array(*part[:3]), lambda x: x.try_cast("bigint").isNotNull())
    return F.when(s.rlike(SEMVER) & sound, parsed)


def semver_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    left, right = (semver(x).dropFields("pre", "text") for x in (a, b))
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def semver_text(v: Column) -> Column:
    """The version as it was stored."""
    return v["text"]


def parse_artefact_ref(s: Column, default_namespace: str = "default") -> Column:
    """``namespace/name@version`` as struct<namespace, name, version, error>."""
    head = F.split_part(s, F.lit("@"), F.lit(1))
    version = F.nullif(F.split_part(s, F.lit("@"), F.lit(2)), F.lit(""))
    scoped = F.instr(head, "/") > 0
    namespace = F.when(scoped, F.split_part(head, F.lit("/"), F.lit(1))).otherwise(F.lit(default_namespace))
    name = F.when(scoped, F.regexp_extract(head, r"^[^/]*/(.*)$", 1)).otherwise(head)
    error = (
        F.when(s.isNull() | (namespace == "") | (name == ""), F.lit("INVALID_ID"))
        .when(version.isNotNull() & ~version.rlike(r"^\d+(\.\d+){0,2}(-[0-9A-Za-z.-]+)?$"), F.lit("INVALID_VERSION"))
    )
    return F.struct(
        namespace.alias("namespace"), name.alias("name"), version.alias("version"), error.alias("error")
    )


def infer_bump(removed_required: Column, output_changed: Column, added_optional: Column) -> Column:
    """The smallest honest bump for a change."""
    return (
        F.when(removed_required | output_changed, F.lit("major"))
        .when(added_optional, F.lit("minor"))
        .otherwise(F.lit("patch"))
    )


def bump_rank(bump: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BUMPS]), bump)


def understated(declared: Column, inferred: Column) -> Column:
    return bump_rank(declared) < bump_rank(inferred)
