"""The corpus pipeline: raw documents to deduplicated, mixed and encoded ones, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkeep.llm.bottomk import bottomk_near_duplicates
from emberkeep.llm.common import staged, with_keys
from emberkeep.llm.lexicon_bpe import encode_words
from emberkeep.llm.mixing import mix_sources
from emberkeep.llm.suffix_dedup import remove_repeats
from emberkeep.llm.toxicity import fit_toxicity, score_toxicity

REPEATED_BYTES = 150  # fewer than 50 words of ordinary prose

# Which words of a text an encoding of it holds can't be said in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return scored.where("score < 0.5").select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the one of least id."""
    judged = bottomk_near_duplicates(docs, words=5, percent=80)
    dropped = staged(judged.where("not kept").select("doc_id"), "dropped")
    return with_keys(docs, dropped, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a letter that the cut leaves in part goes too."""
    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs, length=REPEATED_BYTES, carry=F.struct(F.col("text").isNull().alias("__no_text"), *[F.col(f"`{c}`") for c in others]))
    texts = cut.select("carried", "kept").mapInArrow(_as_text, T.StructType([cut.schema["carried"], T.StructField("text", T.StringType())]))
    text = F.when(~F.col("carried")["__no_text"], F.col("text"))
    shown = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return texts.select(*[shown.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def _as_text(batches):
    import pyarrow as pa

    for batch in batches:
        texts = pa.array([b.as_py().decode("utf-8", "ignore") for b in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["carried", "text"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    mixed = mix_sources(docs, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where("copies > 0")
    return mixed.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("carried.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to."""
    return encode_words(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mix_to_weights", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
