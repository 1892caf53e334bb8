import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents out of (id, text[, source]) tuples, with extra columns whose names clash with the operators' own."""

    def docs(*rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("id", "v", "h", "fp", "size", "copies", "a", "b", "root", "r", "Score_", "shard", "part", "key"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return docs
