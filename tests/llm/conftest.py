from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and stone river mountain light window garden letter branch copper silver winter summer market bridge tower harbor forest meadow candle mirror thunder".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.1 else "") for _ in range(n)]
    return " ".join(words).capitalize() + "."


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(prose(rng, 200) for _ in range(400))  # half a million characters
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n ", "en", "a", 5), (4, "...!?", None, "b", 5), (None, "a text without an id, a short one", "en", None, 33),
        (None, None, None, None, None), (5, long, "en", "a", len(long)), (6, "x", "fr", "c", 1), (7, "password=" + "Ab3" * 8 + " end", "en", "d", 37),
        (8, "9" * 5000, "en", "e", 5000), (9, "é\U0001f600 mixed \u0000 marks " * 20, "es", "f", 300), (10, prose(rng, 80), "en", "a", 1),
    ]
    return [*rows, rows[11], rows[11], (11, rows[11][1], "en", "z", 1)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, awkward, tmp_path_factory):
    """A folder of tables with awkward rows, and one where all are empty."""
    top = tmp_path_factory.mktemp("tables")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (10, 1, 0), (10, 1, 0), (8, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "the of and"), (3, "silver winter market bridge tower"), (3, "silver winter market bridge tower")], "item_id long, text string")
    for name, df in (("documents", awkward), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{top}/some/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return top
