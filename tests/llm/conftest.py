import pytest

LONG = "Lorem ipsum dolor " * 4000 + "call +1 (017) 555-7713 or mail a.b@c.de"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names operators use."""
    rows = [
        (1, "Same text here and there", "en", "a", 5), (2, "SAME text here and there", None, "b", None), (2, "SAME text here and there", None, "b", None), (3, None, None, None, None),
        (4, "", "en", "a", 0), (5, "   \n\t ", "en", None, 3), (6, LONG, "en", "a", 1), (7, LONG + " x", "en", "a", 1), (None, "No id at all, none", "en", "c", 1), (None, None, None, None, None),
        (8, "é ü ß <|endoftext|> <|im_end|> 4111 1111 1111 1111", "de", "c", 9), (9, "a", "x", "c", 1), (9, "another text with this id", "x", "a", 1), (10, "\u0000\u0001 zero", "x", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: "x" for c in ("score", "words", "key", "keys", "group", "row", "size", "shard", "taken", "copies", "keep_id", "set_hash", "a", "b", "n", "ids", "path", "value", "word", "gram", "quality", "labelled", "text_sha256", "kept", "of", "shards", "passes", "begin", "end", "begin2", "end2", "component_id", "set_hash", "least", "__gone", "__id", "__digest", "__source", "__shards", "__of", "__in", "__copy", "__labelled", "__quality", "__row", "__group", "__blocks")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
