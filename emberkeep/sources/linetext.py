"""Tables written as line-format documents, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberkeep.functions import text as T
from emberkeep.operators import linetext as L

END = "\n\u001e\n"  # separates documents of one file


def write_line_table(df: DataFrame, group: list[str], key: str, fields: list[str], order: str, path: str) -> None:
    """Each block of each group as a document with the directive header, one folder per group column."""
    blocks = L.encode_table(df, group, key, fields, order)
    document = F.concat_ws("\n", *[F.lit(x) for x in L.HEADER_LINES], "text")
    blocks.select(*group, document.alias("value")).write.partitionBy(*group).option("lineSep", END).text(path)


def read_line_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents written by ``write_line_table``: the text and the group columns."""
    return spark.read.option("lineSep", END).text(path).withColumnRenamed("value", "text")


def read_line_table(docs: DataFrame, schema: StructType, keep: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(typed rows, errors) of documents that hold one tabular block each.

    Lengths and widths are checked strictly: a document that breaks them gives
    an error and no rows.  Everything happens inside the row, without a shuffle.
    """
    header = L.ARRAY_HEADER

    def parsed(lines: Column) -> Column:
        heads = F.filter(lines, lambda x: x.rlike(header) & ~x.startswith(" "))
        body = F.filter(lines, lambda x: x.startswith(L.INDENT))
        return F.struct(
            F.get(heads, F.lit(0)).alias("head"),
            F.transform(body, lambda x: L.split_cells(F.trim(x), F.lit(","))).alias("rows"))

    def judged(p: Column) -> Column:
        declared = F.regexp_extract(p["head"], header, 2).try_cast("int")
        fields = F.regexp_replace(F.regexp_extract(p["head"], header, 4), r"^\{|\}$", "")
        names = F.transform(L.split_cells(fields, F.lit(",")), L._unquoted)
        return F.struct(declared.alias("declared"), names.alias("names"), p["rows"].alias("rows"), p["head"].isNull().alias("bare"))

    def outcome(j: Column) -> Column:
        counted = F.size(j["rows"])
        error = (
            F.when(j["bare"], F.lit("no array header"))
            .when(j["declared"] != counted, F.format_string("declared %d rows but got %d", j["declared"], counted))
            .when(F.exists(j["rows"], lambda r: F.size(r) != F.size(j["names"])), F.lit("row width differs from the header"))
        )
        good = F.transform(j["rows"], lambda r: F.struct(F.lit(None).cast("string").alias("error"), j["names"].alias("names"), r.alias("cells")))
        none = F.lit(None).cast("array<string>")
        bad = F.array(F.struct(error.alias("error"), none.alias("names"), none.alias("cells")))
        return F.when(error.isNull(), good).otherwise(bad)

    # One expression gives rows or the error, and the outer explode keeps the
    # optimizer from evaluating it a second time in a filter below.
    result = T.let(T.let(T.let(F.split(F.col(text_col), "\n", -1), parsed), judged), outcome)
    read = docs.select(*keep, F.explode_outer(result).alias("o"))

    def column(field) -> Column:
        cell = F.get("o.cells", F.array_position("o.names", field.name).cast("int") - 1)
        quoted = cell.startswith('"')
        value = F.when(quoted, T.unescaped(F.substring(cell, F.lit(2), F.length(cell) - 2))).when(cell != "null", cell)
        return value.try_cast(field.dataType).alias(field.name)

    typed = read.where("o.cells is not null").select(*keep, *[column(f) for f in schema.fields])
    return typed, read.where("o.error is not null").select(*keep, F.col("o.error").alias("error"))
