import pytest

ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from all the hunters in the wood", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from all the hunters in the wood", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from all the hunters in the wood", "a"),
    (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (None, "a text without an id of its own", "c"), (6, "one", "c"), (7, "one", None),
    (8, "word " * 30_000, "a"), (9, "x" * 200_000, "d"), (10, "é" * 70 + " ça va 😀 <|endoftext|> \x1c odd", "d"),
    (11, "Licensed under CC BY-NC 4.0. All rights reserved. CC BY cc by", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long, repeated and strange rows, with columns whose names operators use inside."""
    rows = [(i, t, s, "keep", 1.5, 7) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_shingles string, score double, value int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 1000")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
