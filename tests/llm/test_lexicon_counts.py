"""The runs that the lexicon is made of are counted in all documents."""

from emberkeep.llm.lexicon_bpe import frequent_chunks


def test_counts_do_not_depend_on_partitions(spark):
    long = "x" * 150
    rows = [(i, f"once{i} everywhere {long}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parted, whole = docs.repartition(24, "doc_id"), docs.coalesce(1)
    assert frequent_chunks(parted, most=2) == frequent_chunks(whole, most=2) == ["everywhere", long]
    assert frequent_chunks(parted, most=5) == frequent_chunks(whole, most=5) == ["everywhere", long, "once0", "once1", "once10"]
