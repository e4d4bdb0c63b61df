import pytest


@pytest.fixture(scope="session")
def spark():
    from peerskill.session import get_session

    return get_session(master="local[4]", shuffle_partitions=4, app="peerskill-tests")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, text_hash int, ranges string, topic string, component long, weight double, id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    passage = " ".join(f"word{i} and" for i in range(60))
    rows = [
        (1, passage + " ends here.", "en", "a"), (2, "another start " + passage, "en", "a"), (3, passage + " ends here.", "en", None),
        (3, passage + " ends here.", "en", None), (4, None, "de", "b"), (5, "", None, None), (6, " \n\t \x0b", "de", "b"), (7, "one", "en", "a"),
        (8, "one", "en", "a"), (9, "x" * 30_000, "en", "a"), (10, "ab " * 9_000, "en", "a"), (None, passage, "en", "a"), (None, None, None, None),
        (11, "é漢😀▁ ▁x\n\n  y", "fr", "c"), (12, "First text of a repeated id with quite a few words in it", "en", "a"),
        (12, "Second text of that id, which has nothing to do with it at all", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, None, None, "r", None, None, 1.0, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
