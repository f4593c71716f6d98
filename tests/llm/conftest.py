import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, size int, label string"


def filler(k: int, n: int) -> str:
    """n invented words, different for each k."""
    return " ".join(f"w{(k * 7919 + i * i * 31 + i) % 9973}x{(k + i) % 13}" for i in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, filler(4, 80), "en", "a", 9),
        (4, filler(4, 80), "en", "a", 9), (5, filler(4, 80), "de", "b", 9), (6, filler(6, 60000), "en", "b", 1), (None, filler(7, 70), "en", None, 1),
        (None, None, None, None, None), (8, "x", "fr", "a", 1), (9, "é" * 5000 + ", " + filler(9, 60), "fr", "c", 1),
    ]
    return spark.createDataFrame([(*r, 0.5, "n", 3, "l") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def of(texts, **more):
        return spark.createDataFrame([(k, t, "en", f"src{k % 3}", 0, 0.5, "n", 3, "l") for k, t in enumerate(texts)], SCHEMA)

    return of
