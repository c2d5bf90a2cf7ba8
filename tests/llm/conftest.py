import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, length string, spans int, word string, row int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); the other columns have names that operators use inside."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "k", 1, "l", 2, "w", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make
