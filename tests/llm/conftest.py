import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "s", 36), (1, "Alpha beta gamma delta epsilon zeta.", "en", "s", 36), (2, "", "en", None, 0), (3, None, None, "s", None), (4, LONG, "de", "s", len(LONG)),
    (5, "alpha BETA gamma\tdelta epsilon zeta.", "en", "t", 36), (6, "mail a.b@c.org or +1 (555) 123-4567", "en", "t", 35), (None, "no id here", "en", "t", 10), (7, "word", "fr", "u", 4), (8, "größe ÄÖÜ 你好 🙂", "de", "u", 15),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns of clashing names."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.selectExpr("*", "'x' AS hilbert", "1 AS shard", "2 AS rank", "'y' AS digest", "0.5D AS quality_score", "'z' AS pii", "7 AS block", "'w' AS rep", "text AS ids")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
