"""Artefact envelopes as files, and the registry's index tables."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkeep.functions.versions import semver, semver_text

# The fields of an envelope.  What may hold any JSON is read as its text.
MODELS = "array<struct<model:string, min_context:int, recommended:boolean>>"
FINDINGS = "array<struct<id:string, severity:string, pattern:string, location:string, line:int, message:string>>"
DISCOVERY = f"description string, tags array<string>, use_cases array<string>, compatible_models {MODELS}, compatible_frameworks array<string>, required_capabilities array<string>"
ENVELOPE = f"""
id string, type string, version string, status string, checksum string, signature string,
author struct<name:string, email:string, team:string>, organisation string, namespace string,
created_at string, updated_at string, published_at string, changelog string, {DISCOVERY},
content struct<system:string, user_template:string, output_schema:string>,
variables array<struct<name:string, type:string, required:boolean, default:string, description:string, values:array<string>, max_length:int>>,
security struct<injection_scanned:boolean, scan_date:string, scan_version:string, risk_level:string, risk_score:double, findings:{FINDINGS},
  pii_risk:string, compliance_flags:array<string>>,
performance struct<avg_input_tokens:double, avg_output_tokens:double, avg_latency_ms:double, p95_latency_ms:double, eval_score:double,
  last_eval_date:string, estimated_cost_per_call_usd:double>,
deprecation struct<reason:string, successor:string, sunset_date:string>,
metadata struct<{DISCOVERY.replace(" array", ":array").replace("description string", "description:string")}>
"""
NESTED = ("description", "tags", "use_cases", "compatible_models", "compatible_frameworks", "required_capabilities")


def read_artefacts(spark: SparkSession, path: str, format: str = "json", one_per_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects) from JSON or YAML files below ``path``.

    JSON may be one envelope per line or one per file; YAML is one per file
    and is turned into JSON text in Arrow batches, then read the same way.
    Fields for discovery may stand at the top or below ``metadata``; they come
    out at the top.  Models may be plain names.  Times stay text, the defaults
    of variables and the output schema stay JSON text.
    """
    if format == "json":
        texts = spark.read.text(path, wholetext=one_per_file)
    elif format == "yaml":
        texts = spark.read.text(path, wholetext=True).mapInArrow(_yaml_to_json, "value string")
    else:
        raise ValueError("format must be json or yaml")
    read = texts.withColumn("envelope", F.from_json("value", ENVELOPE))
    good = F.coalesce(F.col("envelope.id").isNotNull() & F.col("envelope.version").isNotNull(), F.lit(False))
    plain = F.coalesce(F.get_json_object("value", "$.compatible_models"), F.get_json_object("value", "$.metadata.compatible_models"))
    names = F.transform(F.from_json(plain, "array<string>"), lambda m: F.named_struct(
        F.lit("model"), m, F.lit("min_context"), F.lit(None).cast("int"), F.lit("recommended"), F.lit(None).cast("boolean")))
    found = read.where(good).select(plain.rlike(r'^\s*\[\s*"').alias("named"), names.alias("names"), "envelope.*")
    top = {c: F.coalesce(c, f"metadata.{c}") for c in NESTED}
    top["compatible_models"] = F.when(F.col("named"), F.col("names")).otherwise(top["compatible_models"])
    return found.withColumns(top).drop("named", "names", "metadata"), read.where(~good).select("value")


def _yaml_to_json(batches):
    import yaml

    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            try:
                out.append(json.dumps(yaml.safe_load(text), default=str))
            except yaml.YAMLError:
                out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def build_registry_indexes(versions: DataFrame) -> dict[str, DataFrame]:
    """``tags``, ``models`` (key, artefact_id) and ``versions`` (one row per version).

    Index entries are rows rather than one list per key: a tag carried by a
    third of all artefacts is then many rows of many files, not one huge cell.
    """
    models = F.transform("compatible_models", lambda m: m["model"])

    def postings(keys) -> DataFrame:
        return versions.select(F.explode(keys).alias("key"), F.col("id").alias("artefact_id")).distinct()

    parsed = versions.withColumn("sv", semver(F.col("version")))
    latest = parsed.groupBy("id").agg(
        F.max(F.when(F.col("status") == "verified", F.col("sv"))).alias("v"),
        F.max(F.when(F.col("status") == "draft", F.col("sv"))).alias("d"),
        F.count("*").alias("n_versions"),
    )
    listed = parsed.select("id", "version", "status").join(latest, "id").select(
        F.col("id").alias("artefact_id"), "version", "status", "n_versions",
        semver_text(F.col("v")).alias("latest_verified"), semver_text(F.col("d")).alias("latest_draft"))
    return {"tags": postings(F.col("tags")), "models": postings(models), "versions": listed}
