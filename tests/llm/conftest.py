import pytest

#: Texts that every operator on documents must take: null, empty, blanks, ties, repeated rows, odd characters, one very long text; ``odd_docs`` adds one of malformed UTF-8.
TEXTS = [None, "", " \t\n", "a", "one two", "The cat sat on the mat.\nThe cat sat on the mat.\n" * 4, "x" * 3000, "naïve café ünïcödé 日本語 テキスト 👩‍👩‍👧 ́ \x1c\x85 ", "word " * 30000, "mail me: bob.smith@example.com or +1 (555) 123-4567 now"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, a repeated row, and extra columns whose names clash with results'."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), i, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "a row without an id", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string")
    malformed = spark.range(1).selectExpr("90L AS doc_id", "cast(concat(X'FF61', cast(' bad bytes' as binary), X'E28C') AS string) AS text", "'en' AS lang", "'src1' AS source", "3L AS n_chars", "0L AS n_words", "'x' AS key")
    return docs.unionByName(malformed).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
