import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that an operator might use itself
            for name in ("score", "Piece", "kept", "digest", "component", "_dropped_id", "rate", "_mix_rate", "c0"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture
def tables(spark):
    from quarrion.llm.common import table

    return lambda name: table(spark, SF, name)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, one very long text, repeated rows, and a null id."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "long text here " * 40_000), (6, "x" * 200_000), (7, "twice the same"), (7, "twice the same"), (None, "no id at all"), (8, "ÄÖ ü € 😀 end"), (9, "12 34 !!")]
