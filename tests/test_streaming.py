import pytest

from quarrion.errors import PlanError
from quarrion.streaming import continuous


def test_grouped_and_plain(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    q = continuous("SELECT city, COUNT(*) FROM people WHERE age > 25 GROUP BY city ORDER BY city", stream, str(tmp_path / "c1")).format("memory").queryName("cities").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("cities").collect()] == [("Lyon", 2), ("Paris", 2)]
    q = continuous("SELECT name FROM people WHERE city = 'Lyon'", stream, str(tmp_path / "c2")).format("memory").queryName("names").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r[0] for r in spark.table("names").collect()} == {"Bob", "Dave"}
    for query in ("SELECT age FROM people ORDER BY age", "SELECT age FROM people LIMIT 3"):
        with pytest.raises(PlanError):
            continuous(query, stream, str(tmp_path / "c3"))
    with pytest.raises(PlanError):
        continuous("SELECT age FROM people", people, str(tmp_path / "c4"))
