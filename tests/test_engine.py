import pytest
from pyspark.sql import functions as F

from quarrion import Engine
from quarrion.errors import PlanError, QueryError
from quarrion.plans.dialect import parse
from quarrion.plans.planner import plan


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("op", "n"), [("=", 1), ("!=", 4), ("<", 2), ("<=", 3), (">", 2), (">=", 3)])
def test_comparisons(engine, op, n):
    assert engine.sql(f"SELECT name FROM people WHERE age {op} 35").count() == n


def test_select_forms(engine):
    assert engine.sql("SELECT * FROM people").columns == ["age", "name", "city", "price"]
    assert rows(engine.sql("SELECT name, age FROM people WHERE age > 40")) == [("Eve", 45)]
    assert rows(engine.sql("SELECT age, age FROM people WHERE city = 'Lyon' ORDER BY age")) == [(30, 30), (40, 40)]
    assert rows(engine.sql("SELECT name FROM people WHERE age = '25'")) == [("Alice",)]


def test_aggregates(engine):
    out = engine.sql("SELECT COUNT(*), SUM(age), MIN(age), MAX(age), AVG(age), SUM(price) FROM people")
    assert out.columns == ["COUNT(*)", "SUM(age)", "MIN(age)", "MAX(age)", "AVG(age)", "SUM(price)"]
    assert rows(out) == [(5, 175, 25, 45, 35.0, 152.5)]
    assert rows(engine.sql("SELECT COUNT(*), COUNT(*) FROM people")) == [(5, 5)]


def test_groups(engine):
    assert sorted(rows(engine.sql("SELECT city, COUNT(*), SUM(age) FROM people GROUP BY city"))) == [("Lyon", 2, 70), ("Paris", 3, 105)]
    assert rows(engine.sql("SELECT MAX(price), city, MIN(price), SUM(price) FROM people WHERE city = 'Paris' GROUP BY city")) == [(50.5, "Paris", 10.5, 91.5)]
    assert sorted(rows(engine.sql("SELECT SUM(age) FROM people GROUP BY city"))) == [(70,), (105,)]
    assert sorted(rows(engine.sql("SELECT city FROM people GROUP BY city"))) == [("Lyon",), ("Paris",)]
    assert sorted(rows(engine.sql("SELECT city, city, COUNT(age) FROM people GROUP BY city, city"))) == [("Lyon", "Lyon", 2), ("Paris", "Paris", 3)]


def test_empty_input(engine):
    assert rows(engine.sql("SELECT COUNT(*), COUNT(age), SUM(age), AVG(price) FROM people WHERE age > 100")) == [(0, 0, None, None)]
    assert rows(engine.sql("SELECT city, COUNT(*) FROM people WHERE age > 100 GROUP BY city")) == []


def test_order_and_limit(engine):
    assert rows(engine.sql("SELECT age FROM people ORDER BY age DESC LIMIT 2")) == [(45,), (40,)]
    assert rows(engine.sql("SELECT city, COUNT(*) FROM people GROUP BY city ORDER BY city DESC LIMIT 1")) == [("Paris", 3)]
    assert rows(engine.sql("SELECT age FROM people LIMIT 0")) == []
    assert engine.sql("SELECT age FROM people LIMIT 3000000000").count() == 5


def test_null_rules(spark):
    t = spark.createDataFrame([(None, "x", 10), (None, "x", 20), (7, None, 30), (7, None, 40), (None, None, 50), (None, None, None)], "a bigint, b string, v bigint")
    e = Engine(spark).register("t", t)
    assert set(rows(e.sql("SELECT a, b, SUM(v), COUNT(v), COUNT(*) FROM t GROUP BY a, b"))) == {(None, "x", 30, 2, 2), (7, None, 70, 2, 2), (None, None, 50, 1, 2)}
    assert rows(e.sql("SELECT a FROM t WHERE a != 3")) == [(7,), (7,)]
    assert [r[0] for r in rows(e.sql("SELECT v FROM t ORDER BY v"))] == [10, 20, 30, 40, 50, None]
    assert [r[0] for r in rows(e.sql("SELECT v FROM t ORDER BY v DESC"))] == [50, 40, 30, 20, 10, None]


def test_names_are_exact_even_if_they_differ_by_case(spark):
    t = spark.range(3).select(F.col("id").alias("x")).withColumn("y", F.col("x") * 10).toDF("Key", "key")
    e = Engine(spark).register("t", t)
    assert rows(e.sql("SELECT key FROM t WHERE Key = 2")) == [(20,)]
    assert rows(e.sql("SELECT SUM(Key), SUM(key) FROM t")) == [(3, 30)]
    assert rows(e.sql("SELECT * FROM t WHERE key = 10")) == [(1, 10)]
    with pytest.raises(PlanError):
        e.sql("SELECT KEY FROM t")


def test_sum_overflow_raises(spark):
    t = spark.createDataFrame([(2**63 - 1,), (1,)], "x bigint")
    with pytest.raises(Exception, match="OVERFLOW"):
        Engine(spark).register("t", t).sql("SELECT SUM(x) FROM t").collect()


@pytest.mark.parametrize(
    "query",
    [
        "SELECT nope FROM people", "SELECT name FROM people WHERE nope = 1", "SELECT SUM(nope) FROM people", "SELECT COUNT(nope) FROM people", "SELECT nope FROM people GROUP BY nope", "SELECT COUNT(*) FROM people GROUP BY nope",
        "SELECT *, COUNT(*) FROM people", "SELECT *, name FROM people", "SELECT name, COUNT(*) FROM people", "SELECT name, COUNT(*) FROM people GROUP BY city", "SELECT name FROM people GROUP BY city", "SELECT * FROM people GROUP BY city",
        "SELECT SUM(name) FROM people", "SELECT MIN(city) FROM people", "SELECT MAX(name) FROM people", "SELECT AVG(name) FROM people", "SELECT SUM(*) FROM people", "SELECT AVG(*) FROM people",
        "SELECT age FROM people ORDER BY name", "SELECT * FROM people ORDER BY age", "SELECT COUNT(*) FROM people ORDER BY age",
        "SELECT name FROM people WHERE age = 3.5", "SELECT name FROM people WHERE age = 'abc'", "SELECT name FROM people WHERE age = 9223372036854775808", "SELECT name FROM people WHERE name = 5", "SELECT name FROM people WHERE name < 'A'", "SELECT name FROM people WHERE price > 1",
        "SELECT price, COUNT(*) FROM people GROUP BY price", "SELECT name FROM people WHERE Age = 1", "SELECT name FROM nowhere",
    ],
)
def test_plan_errors(engine, query):
    with pytest.raises(PlanError, match="^sql: planner: "):
        engine.sql(query)


def test_bool_rules(spark):
    t = spark.createDataFrame([(1, True), (2, False), (3, None)], "id bigint, b boolean")
    e = Engine(spark).register("t", t)
    assert rows(e.sql("SELECT b, id FROM t ORDER BY b")) == [(False, 2), (True, 1), (None, 3)]
    assert rows(e.sql("SELECT id, b FROM t ORDER BY id")) == [(1, True), (2, False), (3, None)]
    assert rows(e.sql("SELECT COUNT(b) FROM t")) == [(2,)]
    for q in ("SELECT id FROM t WHERE b = 1", "SELECT SUM(b) FROM t", "SELECT b, COUNT(*) FROM t GROUP BY b"):
        with pytest.raises(PlanError):
            e.sql(q)


def test_spark_dialect(engine):
    assert rows(engine.sql("SELECT name FROM people WHERE price > 40.0 ORDER BY age DESC", dialect="spark")) == [("Eve",), ("Dave",)]
    assert rows(engine.sql("SELECT * FROM people ORDER BY age LIMIT 1", dialect="spark"))[0][1] == "Alice"
    assert rows(engine.sql("SELECT count(*) AS n FROM people WHERE age > 26 AND age < 41", dialect="spark")) == [(3,)]
    assert rows(engine.sql("SELECT price, COUNT(*) FROM people WHERE price < 15.0 GROUP BY price", dialect="spark")) == [(10.5, 1)]
    with pytest.raises(PlanError):
        engine.sql("SELECT SUM(name) FROM people", dialect="spark")
    with pytest.raises(QueryError):
        engine.sql("SELECT 1", dialect="other")


@pytest.mark.parametrize(
    "query",
    [
        "SELECT SUM(name) AS s FROM people WHERE age > 1 AND age < 90", "SELECT city, AVG(name) FROM people GROUP BY city HAVING COUNT(*) > 0", "SELECT MIN(age > 30) FROM people", "SELECT age FROM people WHERE age > (SELECT MAX(city) FROM people)",
        "WITH t AS (SELECT * FROM people) SELECT 1 + SUM(city) FROM t", "SELECT SUM(name) OVER (PARTITION BY city) FROM people", "SELECT age FROM people p WHERE EXISTS (SELECT SUM(name) FROM people q WHERE q.age = p.age)",
    ],
)
def test_spark_dialect_refuses_aggregates_of_text(engine, query):
    with pytest.raises(PlanError, match="is not defined for the"):
        engine.sql(query, dialect="spark")


def test_spark_dialect_takes_explicit_casts(engine):
    assert rows(engine.sql("SELECT SUM(CAST(CAST(age AS STRING) AS BIGINT)) AS n, MIN(price) AS p FROM people WHERE age > 1 AND age < 90", dialect="spark")) == [(175, 10.5)]
    assert rows(engine.sql("SELECT MAX(price) AS p FROM people WHERE age IN (SELECT MIN(age) FROM people)", dialect="spark")) == [(10.5,)]


def test_plans_push_down_and_prune(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "people.parquet"))
    e = Engine(spark).load_folder(str(tmp_path), "people")
    text = e.sql("SELECT name FROM people WHERE age > 30")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(age), GreaterThan(age,30)]" in text and "ReadSchema: struct<age:bigint,name:string>" in text
    top = e.sql("SELECT age FROM people ORDER BY age DESC LIMIT 2")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_planning_again_gives_the_same(engine, people):
    s = parse("SELECT city, COUNT(*) FROM people GROUP BY city")
    assert sorted(rows(plan(s, people))) == sorted(rows(plan(s, people)))
