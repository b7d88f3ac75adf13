import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = {"n": "1", "row": "'r'", "name": "'x'", "place": "2L", "pair": "3L", "label": "4", "size": "'s'", "mix_copy": "7L", "tie": "5", "sid": "6L", "points": "array(1)"}


@pytest.fixture(scope="session")
def small_batches(spark):
    """Arrow batches of a few rows, so that every state crosses batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""

    def build(rows, parts=3, clashes=True):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        return df.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASHES.items()]) if clashes else df

    return build
