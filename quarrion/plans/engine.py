"""The engine: named tables, and queries over them in the strict dialect or in Spark's SQL."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from quarrion.errors import PlanError, QueryError
from quarrion.plans.dialect import parse
from quarrion.plans.planner import plan


_NUMERIC_ONLY = {"Sum": "SUM", "Average": "AVG", "Min": "MIN", "Max": "MAX"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_aggregates(spark: SparkSession, root) -> None:
    """Refuse aggregates of text and booleans anywhere in an analysed plan, subqueries included.

    Spark casts text to numbers here and fails at run time, on the first value that is none.
    """
    cast = spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast
    nodes, inputs, moved = [root], [], {}
    while nodes:
        plan = nodes.pop()
        nodes += _items(plan.children())
        found = _items(plan.expressions())
        while found:
            e = found.pop()
            name = e.getClass().getSimpleName()
            found += _items(e.children())
            if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                nodes.append(e.plan())
            if name == "Alias" and e.name().startswith("_w"):  # Spark moves a window function's input to a step below
                moved[e.exprId().id()] = e.child()
            if name in _NUMERIC_ONLY:
                inputs.append((_NUMERIC_ONLY[name], e.children().apply(0)))
    for name, of in inputs:
        if of.getClass().getSimpleName() == "AttributeReference":
            of = moved.get(of.exprId().id(), of)
        if of.getClass().getSimpleName() == "Cast" and of.getTagValue(cast.USER_SPECIFIED_CAST()).isEmpty():
            of = of.child()
        kind = of.dataType().typeName().split("(")[0].split(" ")[0]
        if kind in ("string", "char", "varchar", "boolean"):
            raise PlanError(f"{name} is not defined for the {kind} values of {of.sql()}")


class Engine:
    """Tables are frames by name; names keep their case and are looked up exactly.

    ``sql(query)`` runs the strict dialect, with its errors before anything runs.  ``sql(query, dialect="spark")`` runs any
    Spark SQL over the same tables; a statement of the small dialect's form keeps its semantics there (exact names, nulls
    last) without the limits on what WHERE, GROUP BY and ORDER BY take.  In both dialects SUM, AVG, MIN and MAX of text or
    booleans are errors before anything runs; an explicit cast says what is meant.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> Engine:
        self.tables[name] = df
        return self

    def load(self, name: str, path: str, format: str = "parquet", **options: str) -> Engine:
        return self.register(name, self.spark.read.format(format).options(**options).load(path))

    def load_folder(self, path: str, *names: str) -> Engine:
        """Register ``path/NAME.parquet`` for each name."""
        for name in names:
            self.load(name, str(PurePosixPath(path) / f"{name}.parquet") if "://" not in path else f"{path}/{name}.parquet")
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise PlanError(f"unknown table {name!r}; known are {', '.join(sorted(self.tables)) or 'none'}")
        return self.tables[name]

    def sql(self, query: str, dialect: str = "strict") -> DataFrame:
        if dialect == "strict":
            statement = parse(query)
            return plan(statement, self.table(statement.table))
        if dialect != "spark":
            raise QueryError(f"unknown dialect {dialect!r}; known are strict and spark")
        try:
            statement = parse(query)
        except QueryError:
            statement = None  # more than the small dialect: Spark's own parser decides
        if statement and statement.table in self.tables:
            return plan(statement, self.table(statement.table), strict=False)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        df = self.spark.sql(query)
        _check_aggregates(self.spark, df._jdf.queryExecution().analyzed())
        return df

    def schema(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.table(name).schema]
