"""Store requests as JSON bodies, turned into entry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESERVED = ["embedding", "namespace"]


def read_entry_requests(requests: DataFrame, key: str = "key", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(requests as id, embedding, namespace, metadata; rejected bodies).

    Every further string field of the body becomes metadata; fields of other
    types do not.
    """
    fields = F.from_json(F.col(body), "map<string,variant>")
    typed = F.from_json(F.col(body), "embedding array<float>, namespace string")
    text = F.map_filter(fields, lambda k, v: (F.schema_of_variant(v) == "STRING") & ~k.isin(RESERVED))
    metadata = F.transform_values(text, lambda k, v: F.try_variant_get(v, "$", "string"))
    read = requests.withColumn("r", typed)
    usable = F.coalesce((F.size("r.embedding") > 0) & ~F.exists("r.embedding", lambda x: x.isNull()), F.lit(False))
    good = read.where(usable).select(F.col(key).alias("id"), "r.embedding", "r.namespace", metadata.alias("metadata"))
    bad = read.where(~usable).select(F.col(key).alias("id"), F.col(body).alias("body"), F.lit("EMBEDDING_REQUIRED").alias("error"))
    return good, bad
