import math
import random

import pytest
from pyspark.sql import functions as F

from quarrion.errors import PlanError
from quarrion.functions import aggregates as A
from quarrion.operators import aggregate, encodings, group_by, limit, order_by, project, scan, statistics, where
from quarrion.operators.ranges import ranged


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def users(spark):
    rng = random.Random(42)
    data = [(None if i % 17 == 0 else rng.randrange(90), f"user-{i}", "abcde"[i % 5], rng.randrange(1000) + 0.5) for i in range(2000)]
    return data, spark.createDataFrame(data, "age bigint, name string, city string, price double").repartition(3).cache()


def test_filters_against_a_plain_loop(users):
    data, df = users
    out = where(where(where(df, "age", ">", 30), "age", "<", 60), "age", "!=", 45)
    want = {d[1] for d in data if d[0] is not None and 30 < d[0] < 60 and d[0] != 45}
    assert {r[0] for r in rows(project(out, ["name"]))} == want
    mixed = where(where(df, "age", ">", 30), "city", "=", "c")
    assert mixed.count() == sum(d[0] is not None and d[0] > 30 and d[2] == "c" for d in data)


def test_groups_against_a_plain_loop(users):
    data, df = users
    want = {}
    for age, _, city, price in data:
        n, total, known = want.get((age, city), (0, 0.0, 0))
        want[age, city] = (n + 1, total + price, known + (age is not None))
    got = {(r[0], r[1]): r[2:] for r in rows(group_by(df, ["age", "city"], [A.count(), A.total("price"), A.count("age")]))}
    assert got == {k: (n, t, c) for k, (n, t, c) in want.items()}
    ages = [d[0] for d in data if d[0] is not None]
    assert rows(aggregate(df, [A.count(), A.count("age"), A.total("age"), A.least("age"), A.greatest("age"), A.mean("age")])) == [(2000, len(ages), sum(ages), min(ages), max(ages), sum(ages) / len(ages))]


def test_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,)], "x double")
    low, high, total, n = rows(aggregate(df, [A.least("x"), A.greatest("x"), A.total("x"), A.count("x")]))[0]
    assert low == 1.0 and math.isnan(high) and math.isnan(total) and n == 3
    assert rows(aggregate(df, [A.least("x", skip_nan=True), A.greatest("x", skip_nan=True)])) == [(1.0, 3.0)]


def test_order_limit_scan(users):
    data, df = users
    ages = [r[0] for r in rows(project(order_by(df, "age", ascending=False), ["age"]))]
    known = sorted((d[0] for d in data if d[0] is not None), reverse=True)
    assert ages == known + [None] * (len(data) - len(known))
    assert limit(df, 7).count() == 7 and limit(df, 0).count() == 0
    assert scan(df, ["city", "city"]).columns == ["city", "city"]
    assert project(df, [("age", "a"), "city"]).columns == ["a", "city"]
    assert group_by(df, ["city"], select=["city"]).count() == 5
    assert group_by(df, ["city"], [A.count(name="n")], select=["n", "city"]).columns == ["n", "city"]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c`d"])
    assert rows(aggregate(where(df, "a.b", "=", 1), [A.total("c`d")])) == [(2,)]


@pytest.mark.parametrize(
    "call",
    [
        lambda df: project(df, []), lambda df: project(df, "age"), lambda df: project(df, ["nope"]), lambda df: where(df, "nope", "=", 1), lambda df: where(df, "age", "~", 1), lambda df: where(df, "age", "=", None),
        lambda df: aggregate(df, []), lambda df: aggregate(df, [A.total("name")]), lambda df: aggregate(df, [A.Aggregate("MEDIAN", "age")]), lambda df: group_by(df, [], [A.count()]), lambda df: group_by(df, ["nope"], [A.count()]),
        lambda df: limit(df, -1), lambda df: limit(df, True), lambda df: order_by(df, "nope"), lambda df: scan(None), lambda df: scan("/path"),
    ],
)
def test_checks(users, call):
    with pytest.raises(PlanError):
        call(users[1])


def test_zone_maps(spark):
    df = spark.createDataFrame([(1, 5.0, "b", None), (2, float("nan"), "a", True), (None, 7.0, None, False)], "i bigint, f double, s string, b boolean")
    assert rows(statistics.zone_map(df, "i")) == [(1, 2, 1, 3)]
    assert rows(statistics.zone_map(df, "f")) == [(5.0, 7.0, 0, 3)]
    assert rows(statistics.zone_map(df, "s")) == [("a", "b", 1, 3)]
    assert rows(statistics.zone_map(df, "b")) == [(False, True, 1, 3)]
    assert rows(statistics.total_nulls(df)) == [(3,)]
    assert rows(statistics.zone_map(df.limit(0), "i")) == [(None, None, 0, 0)]
    assert statistics.zone_maps(df, ["i", "s"]).columns[:4] == ["i_min", "i_max", "i_nulls", "i_rows"]


@pytest.mark.parametrize("text", [False, True])
def test_block_zone_maps(spark, text):
    key = F.lpad(F.col("id").cast("string"), 5, "0") if text else F.col("id")
    df = spark.range(1000).select(key.alias("k"), (F.col("id") % 300).alias("v")).repartition(5)
    got = sorted(rows(statistics.block_zone_maps(df, "k", "v", rows=128)))
    want = []
    for b in range(8):
        v = [i % 300 for i in range(b * 128, min(1000, b * 128 + 128))]
        want.append((b, min(v), max(v), 0, len(v)))
    assert got == want


def test_logical_encodings(spark):
    values = ["x", "x", "y", None, None, "x"]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v string")
    assert sorted(rows(encodings.runs(df, "i", "v"))) == [(1, "x", 0, 2), (2, "y", 2, 1), (3, None, 3, 2), (4, "x", 5, 1)]
    assert sorted(rows(encodings.codes(df.where("v is not null"), "i", "v").select("value", "code", "uses"))) == [("x", 0, 3), ("y", 1, 1)]
    numbers = spark.createDataFrame([(1, 5), (2, 3), (3, 10)], "i bigint, v bigint")
    assert [r[2] for r in sorted(rows(encodings.deltas(numbers, "i", "v")))] == [5, -2, 7]


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "decimal(9,2)"])
def test_logical_encodings_over_many_ranges(spark, kind):
    rng = random.Random(7)
    values = [rng.choice([None, "a", "b"]) if i % 50 else "c" for i in range(700)]
    numbers = [rng.randrange(-1000, 1000) for _ in values]
    made = {"string": "lpad(cast(i as string), 6, '0')", "date": "date_add(date'1999-12-01', i)", "timestamp_ntz": "timestamp_ntz'1999-03-28 00:00:00' + make_interval(0, 0, 0, 0, 0, 7 * i)", "timestamp": "timestamp_seconds(420 * i)"}
    df = spark.createDataFrame([(i, v, n) for i, (v, n) in enumerate(zip(values, numbers, strict=True))], "i int, v string, n bigint").selectExpr("i", f"{made.get(kind, f'cast(i as {kind})')} AS k", "v", "n").repartition(5)
    want, at = [], 0
    while at < len(values):
        to = at
        while to < len(values) and values[to] == values[at]:
            to += 1
        want.append((len(want) + 1, values[at], to - at))
        at = to
    got = encodings.runs(df, "k", "v")
    assert sorted(rows(got.select("run", "value", "length"))) == want
    assert [r[0] for r in rows(got.select("start").orderBy("run"))] == [r[0] for r in rows(got.select("start").orderBy("start"))]
    assert [r[0] for r in rows(encodings.deltas(df, "k", "n").orderBy("pos").select("delta"))] == [n - m for n, m in zip(numbers, [0, *numbers], strict=False)]
    assert [r[0] for r in rows(encodings.codes(df, "k", "v").orderBy("first").select("value"))] == list(dict.fromkeys(values))
    assert sorted(r[0] for r in rows(encodings.codes(df, "k", "n").select("code"))) == list(range(len(set(numbers))))


def test_logical_encodings_of_little(spark):
    none = spark.createDataFrame([], "i bigint, v string")
    assert rows(encodings.runs(none, "i", "v")) == rows(encodings.codes(none, "i", "v")) == []
    assert rows(encodings.runs(none.selectExpr("v AS i", "v"), "i", "v")) == []
    one = spark.createDataFrame([(None, 5), (3, 7), (9, 7)], "i bigint, v bigint")
    assert sorted(rows(encodings.runs(one, "i", "v")), key=lambda r: r[0]) == [(1, 5, None, 1), (2, 7, 3, 2)]
    assert sorted(rows(encodings.deltas(one, "i", "v")), key=lambda r: r[0] or 0) == [(None, 5, 5), (3, 7, 2), (9, 7, 0)]
    parts = spark.createDataFrame([("f", 1, 5), ("f", 2, 5), ("g", 1, 5)], "f string, i bigint, v bigint")
    assert sorted(rows(encodings.runs(parts, "i", "v", within="f"))) == [("f", 1, 5, 1, 2), ("g", 1, 5, 1, 1)]
    assert sorted(rows(encodings.deltas(parts, "i", "v", within="f"))) == [("f", 1, 5, 5), ("f", 2, 5, 0), ("g", 1, 5, 5)]


def test_logical_encodings_use_several_tasks(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS v")
    assert ranged(df, "id").groupBy("_part").count().where("count between 150 and 350").count() == 4
    assert ranged(df.selectExpr("cast(id as string) AS id"), "id").groupBy("_part").count().where("count < 600").count() == 4
