"""Access logs (TSV), request logs (JSON lines) and the append-only audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns and the timestamp format of the access log.
ACCESS_LOG = ("timestamp timestamp, method string, path string, key string, operation string, "
              "status int, duration_ms bigint, remote_addr string")
ACCESS_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
TSV = {"sep": "\t", "header": "true", "timestampFormat": ACCESS_TIME, "quote": ""}
# The fields of the request log.
API_LOG = ("timestamp timestamp, level string, requestId string, method string, path string, status int, "
           "latencyMs bigint, userId string, orgId string, cacheHit boolean, artefactId string, artefactVersion string")
# The fields that each audited action keeps.
AUDIT_FIELDS = {
    "artefact.publish": ["user_id", "ip_address", "artefact_id", "version", "scan_result"],
    "artefact.fetch": ["user_id", "artefact_id", "version", "agent"],
    "artefact.promote": ["user_id", "artefact_id", "old_status", "new_status", "comment"],
    "artefact.deprecate": ["user_id", "artefact_id", "successor", "reason"],
    "artefact.delete": ["user_id", "artefact_id"],
    "auth.login": ["user_id", "ip_address", "method"],
    "auth.key_created": ["user_id", "key_label", "scopes"],
    "auth.key_revoked": ["user_id", "key_id"],
    "scan.blocked": ["user_id", "artefact_id", "findings"],
}


def write_access_log(df: DataFrame, path: str) -> None:
    """One folder per day; an empty key is written as ``-``."""
    names = [f.split()[0] for f in ACCESS_LOG.split(", ")]
    blank = F.coalesce(F.trim("key"), F.lit("")) == ""
    shown = df.select(*names, F.to_date("timestamp").alias("day")).withColumn("key", F.when(blank, "-").otherwise(F.col("key")))
    shown.write.mode("append").partitionBy("day").options(**TSV).csv(path)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCESS_LOG + ", day date").options(**TSV).csv(path)


def read_api_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_LOG).json(path)


def audit_rows(actions: DataFrame) -> DataFrame:
    """Every action in the audit schema: known ones keep their own fields as metadata, others all columns."""
    held = set(actions.columns)

    def fields_of(event: str):
        return F.create_map(*[x for f in AUDIT_FIELDS[event] if f in held for x in (F.lit(f), F.col(f).cast("string"))])

    rest = [c for c in actions.columns if c not in ("action", "created_at")]
    metadata = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]).cast("map<string,string>")
    for event in AUDIT_FIELDS:
        metadata = F.when(F.col("action") == event, fields_of(event)).otherwise(metadata)
    return actions.select(
        "action", "created_at", F.map_filter(metadata, lambda k, v: v.isNotNull()).alias("metadata"))


def append_audit(actions: DataFrame, path: str) -> None:
    """Append to the audit table, one folder per day."""
    rows = audit_rows(actions).withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)
