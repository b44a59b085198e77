import io

from quarrion import Engine, shell


def talk(engine, *lines):
    out, err = io.StringIO(), io.StringIO()
    shell.run(engine, io.StringIO("\n".join(lines)), out, err)
    return out.getvalue(), err.getvalue()


def test_queries_and_commands(engine):
    out, err = talk(engine, ".help", ".schema", "", "SELECT name, price FROM people WHERE age = 25", "SELECT COUNT(*), SUM(age) FROM people WHERE age > 99", ".quit", "SELECT nope")
    assert "Aggregates: COUNT(*)" in out and "Table: people" in out and "age          bigint" in out
    assert "name   | price\n-------+-------\nAlice  | 10.50\n(1 rows)" in out
    assert "COUNT(*) | SUM(age)" in out and "0        | NULL" in out and err == ""


def test_errors_do_not_end_it(engine):
    out, err = talk(engine, "SELECT", "SELECT nope FROM people", ".what", "SELECT COUNT(*) FROM people")
    assert err.count("error:") == 2 and "unknown command .what" in err and "5" in out


def test_demo(spark):
    df = shell.demo(spark)
    assert df.columns == ["name", "age", "city", "salary"] and df.count() == 1000
    e = Engine(spark).register("people", df)
    low, high = e.sql("SELECT MIN(age), MAX(age) FROM people").first()
    assert 20 <= low and high <= 69 and e.sql("SELECT city, COUNT(*) FROM people GROUP BY city").count() == 6
