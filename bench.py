"""Warm medians of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores.  Each query is planned and drained anew on every run, over
tables cached in memory, as the published figures are for in-memory tables; ``scan_*`` reads the Parquet files.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quarrion import Engine
from quarrion.session import local

RUNS, WARM = 9, 6
#: Copies of lineitem for the throughput figures.
TIMES = 20
STRICT = {
    "filter_project": "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey > 30",
    "filter_count": "SELECT COUNT(*) FROM lineitem WHERE l_orderkey > 30",
    "filter_str": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "group_low": "SELECT l_returnflag, COUNT(*), AVG(l_quantity) FROM lineitem GROUP BY l_returnflag",
    "group_high": "SELECT l_partkey, COUNT(*), AVG(l_quantity) FROM lineitem GROUP BY l_partkey",
    "group_extra_high": "SELECT l_orderkey, COUNT(*), AVG(l_quantity) FROM lineitem GROUP BY l_orderkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10",
    "flagship": "SELECT l_returnflag, COUNT(*), AVG(l_quantity) FROM lineitem WHERE l_orderkey > 30 GROUP BY l_returnflag ORDER BY l_returnflag",
}
CHAINS = {
    "filter_2": [("o_custkey", ">", 30), ("o_custkey", "<", 6000)],
    "filter_3": [("o_custkey", ">", 30), ("o_custkey", "<", 6000), ("o_custkey", "!=", 45)],
    "filter_int_str": [("o_custkey", ">", 30), ("o_orderstatus", "=", "F")],
}


def main() -> None:
    from quarrion.operators import project, where

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    # static plans; one partition for each core
    spark = local(**{"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.aggregate.fastHashMap.capacityBit": "18"})
    spark.sparkContext.setLogLevel("ERROR")
    files = Engine(spark).load_folder(sf, "lineitem", "orders")
    memory = Engine(spark)
    sizes = {}
    for name in files.tables:
        memory.register(name, files.table(name).repartition(spark.sparkContext.defaultParallelism).cache())
        sizes[name] = memory.table(name).count()

    def chain(conditions):
        rows = memory.table("orders")
        for c in conditions:
            rows = where(rows, *c)
        return project(rows, ["o_orderkey", "o_custkey"])

    runs = {k: (lambda q=q: memory.sql(q)) for k, q in STRICT.items()} | {k: (lambda c=c: chain(c)) for k, c in CHAINS.items()}
    runs |= {f"scan_{k}": (lambda q=STRICT[k]: files.sql(q)) for k in ("filter_project", "group_high")}

    def timed(make) -> float:
        times = []
        for _ in range(RUNS + WARM):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return statistics.median(times[WARM:])

    took = {k: round(timed(make), 4) for k, make in runs.items()}
    # beside them the same statements as sessions run them by default, with adaptive execution
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    adaptive = {k: round(timed(runs[k]), 4) for k in STRICT}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    # the same rows many times over, to see throughput beyond the fixed cost of a query
    columns = memory.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    many = Engine(spark).register("lineitem", columns.crossJoin(spark.range(TIMES).select()).cache())
    rows = many.table("lineitem").count()
    rates = {k: round(rows / timed(lambda k=k: many.sql(STRICT[k])) / 1e6, 1) for k in ("filter_project", "group_low", "group_high", "group_extra_high")}
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "adaptive": adaptive, "sf": sf.rstrip("/").rsplit("/", 1)[-1], "rows": sizes, "million_rows_per_sec": {"rows": rows} | rates}))
    spark.stop()


if __name__ == "__main__":
    main()
