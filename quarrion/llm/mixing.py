"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic.  A cell's weight starts as its share of all tokens and is
raked in turn to the target shares of sources, languages and topics, until every margin has its target.  A document is then kept with a probability
proportional to its cell's fitted weight over its share, scaled so that the most wanted cell is kept whole; the draw is a
hash of the id, so it is the same on every run and needs no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm.common import free_name, stored

KEYS = ("source", "lang", "topic")
#: Default targets: each margin's token shares to this power, normalised.
POWERS = {"source": 0.85, "lang": 0.85, "topic": 0.95}
#: A sweep rakes each margin once; so many make one plan.  Unless their number is given, sweeps end when no margin is off its
#: target by more than TOLERANCE, or when that no longer falls.
STEP, TOLERANCE, MOST_SWEEPS = 3, 1e-14, 99
#: Cells that are broadcast at most; more are joined by shuffle.
BROADCAST_CELLS = 100_000
MISSING = "(none)"


def n_tokens(text: Column) -> Column:
    """Words of the whole text and one for its end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("bigint") + 1


def topic(text: Column, tokens: Column) -> Column:
    """What kind of text it is, from counts over the whole text: table, marked, short or prose."""
    whole = F.coalesce(text, F.lit(""))
    count = lambda chars: F.length(whole) - F.length(F.translate(whole, chars, ""))
    return F.when(count("|") * 4 >= tokens, "table").when(count("!#$%&*") >= tokens, "marked").when(tokens <= 50, "short").otherwise("prose")


def draw(id_: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def cell_columns(df: DataFrame, text_col: str = "text", topic_col: str | None = None) -> dict[str, Column]:
    """The cell keys and tokens of a row; a null source, language or topic is a value of its own."""
    tokens = n_tokens(df[text_col])
    of = lambda c: F.coalesce(df[c].cast("string"), F.lit(MISSING))
    return {"source": of("source"), "lang": of("lang"), "topic": of(topic_col) if topic_col else topic(df[text_col], tokens), "n_tokens": tokens}


def fitted(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight, rate, margin_error) of cells with ``tokens``: weights raked to the targets.

    ``targets`` maps a key to a frame (key, share); a margin without one gets its token shares to the power POWERS names.
    ``margin_error`` is the largest difference of a margin from its target, the same in every row: it stays large if no weights
    can meet the targets, as when they name shares that do not sum to one or values without a document.
    """
    over = lambda k: Window.partitionBy(k)
    total = cells.agg(F.sum("tokens").alias("_total"))
    now = cells.crossJoin(F.broadcast(total)).withColumn("weight", F.col("tokens") / F.col("_total"))  # one row beside each cell
    for k in KEYS:
        if targets and k in targets:
            goal = targets[k].select(F.col(targets[k].columns[0]).alias(k), F.col(targets[k].columns[1]).cast("double").alias(f"_goal_{k}"))
        else:
            goal = cells.groupBy(k).agg(F.pow(F.sum("tokens").cast("double"), F.lit(POWERS[k])).alias(f"_goal_{k}"))
        goal = goal.crossJoin(F.broadcast(goal.agg(F.sum(f"_goal_{k}").alias("_all")))).select(k, (F.col(f"_goal_{k}") / F.col("_all")).alias(f"_goal_{k}"))
        now = now.join(goal, k, "left").withColumn(f"_goal_{k}", F.coalesce(f"_goal_{k}", F.lit(0.0)))
    now, error = stored(now, "cells"), None
    for sweep in range(1, (sweeps or MOST_SWEEPS) + 1):
        for k in KEYS:
            now = now.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_goal_{k}"), F.sum("weight").over(over(k))), F.lit(0.0)))
        if sweep % STEP and sweep != sweeps:
            continue
        now = stored(now, "cells")
        before, error = error, margin_error(now)
        if not sweeps and (error <= TOLERANCE or (before is not None and error >= before)):
            break
    now = now.withColumn("_ratio", F.col("weight") * F.col("_total") / F.col("tokens"))
    most = now.agg(F.max("_ratio").alias("_most"))
    rate = F.round(F.coalesce(F.try_divide(F.col("_ratio"), F.col("_most")), F.lit(0.0)), 9)
    return stored(now.crossJoin(F.broadcast(most)).select(*KEYS, "tokens", "weight", rate.alias("rate"), F.lit(error).cast("double").alias("margin_error")), "rates")


def margin_error(cells: DataFrame) -> float:
    """How far the margin that is farthest from its target is off, as a share of all weight."""
    apart = [cells.groupBy(F.col(k).alias("value")).agg((F.sum("weight") - F.first(f"_goal_{k}")).alias("off")) for k in KEYS]
    return apart[0].unionByName(apart[1]).unionByName(apart[2]).agg(F.max(F.abs("off"))).first()[0] or 0.0


def _keyed(df: DataFrame, columns: list[Column], text_col: str, topic_col: str | None) -> tuple[DataFrame, dict[str, str]]:
    """The columns beside each row's cell and tokens, stored, so that texts are gone over once."""
    names = {k: free_name(df.columns, f"_mix_{k}") for k in (*KEYS, "n_tokens", "rate")}
    return stored(df.select(*columns, *(c.alias(names[k]) for k, c in cell_columns(df, text_col, topic_col).items())), "keyed"), names


def _with_rate(rows: DataFrame, names: dict[str, str], targets: dict[str, DataFrame] | None, sweeps: int | None = None) -> DataFrame:
    cells = rows.groupBy(*(F.col(names[k]).alias(k) for k in KEYS)).agg(F.sum(names["n_tokens"]).alias("tokens"))
    cells = fitted(stored(cells, "tokens"), targets, sweeps).select(*(F.col(k).alias(names[k]) for k in (*KEYS, "rate")))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return rows.join(cells, [names[k] for k in KEYS], "left").withColumn(names["rate"], F.coalesce(names["rate"], F.lit(0.0)))


def rates(df: DataFrame, text_col: str = "text", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, sweeps: int | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight, rate, margin_error) of the cells of ``df``.

    A null text has one token, null sources, languages and topics are values of their own, repeated rows count each; no rows
    give no cells.
    """
    keyed = df.select(*(c.alias(k) for k, c in cell_columns(df, text_col, topic_col).items()))
    return fitted(stored(keyed.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens")), "tokens"), targets, sweeps)


def calibrated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 1, sweeps: int | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, rate, kept) for each row.

    ``rate`` is the probability with which the row's cell is kept, ``kept`` its draw.  Null texts have no words, null
    sources and languages are values of their own, a null id draws as an empty one, repeated rows draw alike; no rows give
    no rows.  ``df`` needs columns source and lang; others are not read.
    """
    rows, names = _keyed(df, [df[id_col].alias("_mix_id")], text_col, topic_col)
    rows = _with_rate(rows, names, targets, sweeps)
    return rows.select(F.col("_mix_id").cast("bigint").alias("doc_id"), *(F.col(names[k]).alias(k) for k in (*KEYS, "n_tokens", "rate")), (draw(F.col("_mix_id"), seed) < F.col(names["rate"])).alias("kept"))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 1) -> DataFrame:
    """The rows of ``df`` that their draw keeps, with all their columns; no text is shuffled.

    Nulls, repeated rows and empty tables are as for ``calibrated``.
    """
    rows, names = _keyed(df, [df[c] for c in df.columns], text_col, topic_col)
    rows = _with_rate(rows, names, targets)
    return rows.where(draw(F.col(id_col), seed) < F.col(names["rate"])).select(*df.columns)
