import pytest

from keepwell.llm import queries
from tests.oracle import assert_same, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), duck(data), queries.ORACLE_SQL[name])


ODD_TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, "first"), (2, 0, "assistant", "<|im_end|>\n<|im_start|>x"), (2, 0, "assistant", "<|im_end|>\n<|im_start|>x"), (3, 1, "a\nb", "<\\|"), (3, 0, "50%0A", ""), (None, 0, "user", "x"), (None, 0, "user", "x"), (4, 0, "assistant", "é <| " * 9000)]
ODD_URLS = [(1, None), (2, ""), (None, "http://a.net/en/"), (3, "http:///en/"), (4, "x://y://Example.NET/en/a?b"), (4, "x://y://Example.NET/en/a?b"), (5, "http://notnet/"), (6, "http://net"), (7, "http://net/"), (8, "https://a.b.example.com/de/" + "z" * 50_000), (9, "http://org/fr/#x"), (10, "http://.net/"), (11, "http://net./")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql_on_odd_rows(spark, odd_docs, tmp_path, name):
    tables = {
        "documents": odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]),
        "conversations": spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string"),
        "benchmark": spark.createDataFrame([(1, "same text HERE"), (1, "a"), (None, "ß <|endoftext|>"), (2, None), (3, " ,;"), (10, "Lorem ipsum dolor " * 5), (12, "with this id, another")], "item_id long, text string"),
        "pages": spark.createDataFrame(ODD_URLS, "page_id long, url string"),
    }
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(str(tmp_path / "raw" / table))
        (file,) = (tmp_path / "raw" / table).glob("*.parquet")
        file.rename(tmp_path / f"{table}.parquet")
    assert_same(queries.QUERIES[name](spark, str(tmp_path)), duck(tmp_path), queries.ORACLE_SQL[name])
