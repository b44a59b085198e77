"""A statement of the small dialect as a continuous query: the same plan over a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quarrion.errors import PlanError
from quarrion.plans.dialect import parse
from quarrion.plans.planner import plan


def continuous(query: str, stream: DataFrame, checkpoint: str, strict: bool = True) -> DataStreamWriter:
    """A writer, ready for its sink and ``start()``: rows as they come, or all groups so far for an aggregate.

    State is one row for each group.  ORDER BY needs an aggregate, as a stream has no last row; LIMIT needs ORDER BY.
    """
    if not stream.isStreaming:
        raise PlanError("the table is not a stream")
    statement = parse(query)
    grouped = bool(statement.aggregated or statement.group)
    if statement.order and not grouped:
        raise PlanError("ORDER BY over a stream needs an aggregate")
    if statement.limit is not None and not statement.order:
        raise PlanError("LIMIT over a stream needs ORDER BY")
    rows = plan(statement, stream, strict)
    mode = "complete" if statement.aggregated else "update" if grouped else "append"
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
