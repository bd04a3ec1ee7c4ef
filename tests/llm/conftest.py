import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, owner string, rank int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, blanks only, unusual characters."""
    long = " ".join(f"word{k % 977} other{k % 31}." for k in range(12_000))
    body = "The quick brown fox jumps over the lazy dog. " * 3 + "It was seen by many people of the town that day. Nobody spoke of it again until the next year.\nA second line of some more ordinary words follows here."
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, body), (5, body), (6, body), (7, body + " More words at the very end of it."), (8, long),
        (9, "Mail bob.1@mail.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111, host 10.0.0.255. Again 555-2485."),
        (10, "naïve café 日本語 \x1f \x85 \u00a0 ü a  b   c <|endoftext|> 'll 12.3.4.5.6"), (None, "a row without an id"), (11, "x" * 5000), (12, "\x00\x00 zero bytes"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), 1, "o", 2) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
