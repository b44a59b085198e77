import hashlib

import duckdb
import pytest

from quarrion.llm import mixing
from quarrion.llm.queries import ORACLE, QUERIES

from .conftest import SF


def test_weights_meet_the_targets(spark, docs_of):
    rows = [(i, "word " * (10 + i % 90), ("en", "de")[i % 3 == 0], f"src{min(i % 7, 3)}") for i in range(600)]
    goal = spark.createDataFrame([("src0", 0.4), ("src1", 0.3), ("src2", 0.2), ("src3", 0.1)], "source string, share double")
    langs = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double")
    found = mixing.rates(docs_of(rows), targets={"source": goal, "lang": langs})
    cells = found.collect()
    assert sum(c.weight for c in cells) == pytest.approx(1)
    for key, want in (("source", {"src0": 0.4, "src1": 0.3, "src2": 0.2, "src3": 0.1}), ("lang", {"en": 0.5, "de": 0.5})):
        for value, share in want.items():
            assert sum(c.weight for c in cells if c[key] == value) == pytest.approx(share, abs=0.01)
    assert max(c.rate for c in cells) == 1 and all(0 <= c.rate <= 1 for c in cells)
    # rates are weights over shares, up to one factor
    total = sum(c.tokens for c in cells)
    factor = {round(c.rate / (c.weight * total / c.tokens), 5) for c in cells}
    assert len(factor) == 1
    assert {c.margin_error for c in cells} == {cells[0].margin_error} and cells[0].margin_error < 1e-13
    few = mixing.rates(docs_of(rows), targets={"source": goal, "lang": langs}, sweeps=1).collect()
    assert few[0].margin_error > 1e-9


def test_targets_that_cannot_be_met_are_reported(spark, docs_of):
    rows = [(i, "word " * 60, ("en", "de")[i % 2], ("a", "b")[i % 2]) for i in range(40)]
    goal = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double")
    langs = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double")
    assert mixing.rates(docs_of(rows), targets={"source": goal, "lang": langs}).first().margin_error > 0.3


def test_kept_tokens_follow_the_rates(docs_of):
    rows = [(i, "word " * 60, "en", ("big", "small")[i % 10 == 0]) for i in range(6000)]
    got = mixing.calibrated(docs_of(rows)).collect()
    for source in ("big", "small"):
        own = [r for r in got if r.source == source]
        assert sum(r.kept for r in own) / len(own) == pytest.approx(own[0].rate, abs=0.03)
    draw = int(hashlib.md5(b"1:17").hexdigest()[:12], 16) / 2**48
    row = next(r for r in got if r.doc_id == 17)
    assert row.kept == (draw < row.rate)


def test_topics_and_tokens(docs_of):
    df = docs_of([(1, "a | b | c | d"), (2, "x*** y$$$ z&&&"), (3, "few words"), (4, "word " * 60), (5, None)])
    got = {r.doc_id: (r.topic, r.n_tokens) for r in mixing.calibrated(df).collect()}
    assert got == {1: ("table", 8), 2: ("marked", 4), 3: ("short", 3), 4: ("prose", 61), 5: ("short", 1)}


def test_odd_rows(docs_of, odd_rows):
    df = docs_of([(*r, None if i % 2 else "en", None) for i, r in enumerate(odd_rows)], extra=True)
    got = mixing.calibrated(df)
    assert got.count() == len(odd_rows) and {r.source for r in got.collect()} == {"(none)"}
    left = mixing.sample(df)
    assert left.columns == df.columns
    assert sorted(map(repr, left.select("doc_id").collect())) == sorted(map(repr, got.where("kept").select("doc_id").collect()))
    assert mixing.calibrated(df.limit(0)).collect() == [] and mixing.sample(df.limit(0)).collect() == []


def test_no_python_on_the_main_path(tables):
    plan = mixing.calibrated(tables("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_queries_match_their_sql(spark, key):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = QUERIES[key](spark, SF), c.sql(ORACLE[key])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    assert sorted(repr([r[x] for x in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())
