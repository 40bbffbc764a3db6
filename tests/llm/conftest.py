import pytest

ODD = [None, "", " \n\t ", "a", "The the THE", "é x́ 😀 <|endoftext|> don't", "word " * 30_000, "z" * 50_000, "1234 %% 55"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, tied, repeated and very long texts, and a column of clashing name."""
    texts = [*ODD, "same words here again", "same words here again", None]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, "x", i, 0) for i, t in enumerate(texts)]
    rows.append(rows[-2])
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, label long, shard int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
