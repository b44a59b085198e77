"""An interactive shell: ``python -m quarrion.shell [FOLDER TABLE...]``; without arguments it has demo data."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.errors import QueryError
from quarrion.plans.dialect import parse
from quarrion.plans.engine import Engine

HELP = """Commands:
  .schema        columns of each table
  .help          this text
  .quit, .exit   leave
Queries:
  SELECT { * | column [, ...] | aggregate(column) [, ...] } FROM table
    [WHERE column op literal] [GROUP BY column [, ...]] [ORDER BY column [ASC|DESC]] [LIMIT n]
Aggregates: COUNT(*), COUNT, SUM, MIN, MAX, AVG
"""
#: Rows that are shown at most; more are counted only by asking.
SHOWN = 1000

# The demo table's cities.
CITIES = ("Paris", "Lyon", "Berlin", "London", "Madrid", "Rome")


def demo(spark: SparkSession, rows: int = 1000) -> DataFrame:
    """name, age (20 to 69), city (of six), salary (30 000 to 99 999.99): the same on every run."""
    draw = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    names = F.concat(F.lit("person-"), F.lpad(draw(20, 1).cast("string"), 2, "0"))
    return spark.range(rows).select(names.alias("name"), (draw(50, 2) + 20).alias("age"), F.element_at(F.array(*map(F.lit, CITIES)), (draw(6, 3) + 1).cast("int")).alias("city"), ((draw(7_000_000, 4) + 3_000_000) / 100).alias("salary"))


def shown(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:.2f}" if isinstance(value, float) else str(value)


def render(df: DataFrame, most: int = SHOWN) -> str:
    """A header, a rule, the rows, and their number."""
    names = df.columns
    rows = df.limit(most + 1).collect()  # bounded by what a screen shows
    width = [max(6, len(n)) for n in names]
    lines = [" | ".join(n.ljust(w) for n, w in zip(names, width, strict=True)).rstrip(), "-+-".join("-" * w for w in width)]
    lines += [" | ".join(shown(v).ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows[:most]]
    return "\n".join([*lines, f"({len(rows)} rows)" if len(rows) <= most else f"(the first {most} rows)"])


def run(engine: Engine, source: TextIO, out: TextIO, err: TextIO, prompt: str = "") -> None:
    """Read lines until the end or ``.quit``; an error is reported and the loop goes on."""
    while True:
        out.write(prompt)
        out.flush()
        line = source.readline()
        text = line.strip()
        if not line or text in (".quit", ".exit"):
            return
        if not text:
            continue
        if text == ".help":
            out.write(HELP)
        elif text == ".schema":
            for name in sorted(engine.tables):
                out.write(f"Table: {name}\n" + "".join(f"  {c:<12} {t}\n" for c, t in engine.schema(name)))
        elif text.startswith("."):
            err.write(f"unknown command {text}; try .help\n")
        else:
            try:
                parse(text)
                out.write(render(engine.sql(text)) + "\n")
            except QueryError as e:
                err.write(f"error: {e}\n")
            except Exception as e:  # what Spark raises while a query runs must not end the shell
                err.write(f"error: {str(e).splitlines()[0]}\n")


def main(args: list[str]) -> int:
    from quarrion.session import local

    engine = Engine(local())
    if args:
        engine.load_folder(args[0], *args[1:])
    else:
        engine.register("people", demo(engine.spark))
    run(engine, sys.stdin, sys.stdout, sys.stderr, "> ")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
