"""The engine's registered queries over the driver's tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions import aggregates as A
from quarrion.operators import encodings, statistics
from quarrion.operators import relational as R
from quarrion.plans.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strict(key: str, query: str, oracle: str, *names: str) -> None:
    """A statement of the strict dialect; ``names`` are its columns' names in the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = query.split(" FROM ")[1].split()[0]
        out = Engine(spark).load_folder(sf_dir, table).sql(query)
        return out.toDF(*names) if names else out

    QUERIES[key], ORACLE[key] = run, oracle


def functional(key: str, oracle: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[key] = f
        if oracle:
            ORACLE[key] = oracle
        return f

    return keep


# Scans and projections

strict("scan_star", "SELECT * FROM region", "SELECT * FROM region")
strict("scan_project", "SELECT p_name, p_partkey FROM part", "SELECT p_name, p_partkey FROM part")
strict("project_duplicate", "SELECT p_size, p_size FROM part", "SELECT p_size AS a, p_size AS b FROM part", "a", "b")

# Filters

for _word, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    strict(f"where_int_{_word}", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey {_op} 100", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey {_op} 100")
strict("where_str_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
strict("where_hidden_col", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")


@functional("where_null_ne", "SELECT o_orderkey, s FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) WHERE s <> 'O'")
def where_null_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return R.where(orders, "s", "!=", "O")


def _chain(*conditions: tuple[str, str, object]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = R.scan(read(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])
        for c in conditions:
            rows = R.where(rows, *c)
        return R.project(rows, ["o_orderkey", "o_custkey"])

    return run


_OVER, _UNDER = ("o_custkey", ">", 30), ("o_custkey", "<", 60)
functional("where_chain_2", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 30 AND o_custkey < 60")(_chain(_OVER, _UNDER))
functional("where_chain_3", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 30 AND o_custkey < 60 AND o_custkey <> 45")(_chain(_OVER, _UNDER, ("o_custkey", "!=", 45)))
functional("where_chain_int_str", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 30 AND o_orderstatus = 'F'")(_chain(_OVER, ("o_orderstatus", "=", "F")))

# Scalar aggregates

strict("agg_count_star", "SELECT COUNT(*) FROM events", "SELECT COUNT(*) AS n FROM events", "n")
strict("agg_count_col", "SELECT COUNT(user_id) FROM events", "SELECT COUNT(user_id) AS n FROM events", "n")
strict("agg_sum_int", "SELECT SUM(user_id) FROM events", "SELECT CAST(SUM(user_id) AS BIGINT) AS total FROM events", "total")
strict("agg_minmax_int", "SELECT MIN(user_id), MAX(user_id) FROM events", "SELECT MIN(user_id) AS low, MAX(user_id) AS high FROM events", "low", "high")
strict("agg_avg_int", "SELECT AVG(user_id) FROM events", "SELECT AVG(user_id) AS mean FROM events", "mean")
strict("agg_sum_float", "SELECT SUM(l_quantity) FROM lineitem", "SELECT SUM(l_quantity) AS total FROM lineitem", "total")
strict("agg_minmax_float", "SELECT MIN(l_extendedprice), MAX(l_extendedprice) FROM lineitem", "SELECT MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high FROM lineitem", "low", "high")
strict("agg_avg_float", "SELECT AVG(l_quantity) FROM lineitem", "SELECT AVG(l_quantity) AS mean FROM lineitem", "mean")
strict(
    "agg_filtered", "SELECT COUNT(*), SUM(l_quantity), AVG(l_quantity) FROM lineitem WHERE l_returnflag = 'R'",
    "SELECT COUNT(*) AS n, SUM(l_quantity) AS total, AVG(l_quantity) AS mean FROM lineitem WHERE l_returnflag = 'R'", "n", "total", "mean",
)
strict(
    "agg_empty", "SELECT COUNT(*), SUM(user_id), MIN(user_id), MAX(user_id), AVG(user_id) FROM events WHERE user_id < 0",
    "SELECT COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS total, MIN(user_id) AS low, MAX(user_id) AS high, AVG(user_id) AS mean FROM events WHERE user_id < 0",
    "n", "total", "low", "high", "mean",
)


@functional("agg_count_nulls", "SELECT COUNT(s) AS n, COUNT(*) AS rows_ FROM (SELECT NULLIF(o_orderstatus, 'F') AS s FROM orders)")
def agg_count_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return R.aggregate(orders, [A.count("s", "n"), A.count(name="rows_")])


@functional("agg_skip_nan", "SELECT MIN(x) AS low, MAX(x) AS high FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS x FROM orders)")
def agg_skip_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"))
    return R.aggregate(orders, [A.least("x", "low", skip_nan=True), A.greatest("x", "high", skip_nan=True)])


# Grouping

strict("group_str_key", "SELECT l_returnflag, COUNT(*), SUM(l_quantity), AVG(l_quantity) FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS total, AVG(l_quantity) AS mean FROM lineitem GROUP BY l_returnflag", "l_returnflag", "n", "total", "mean")
strict("group_int_key", "SELECT user_id, COUNT(*), MIN(event_id), MAX(event_id) FROM events GROUP BY user_id", "SELECT user_id, COUNT(*) AS n, MIN(event_id) AS low, MAX(event_id) AS high FROM events GROUP BY user_id", "user_id", "n", "low", "high")
strict("group_high_card", "SELECT l_orderkey, COUNT(*), AVG(l_quantity) FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, COUNT(*) AS n, AVG(l_quantity) AS mean FROM lineitem GROUP BY l_orderkey", "l_orderkey", "n", "mean")
strict("group_multi_key", "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity) FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag", "l_linestatus", "n", "total")
strict("group_reordered", "SELECT COUNT(*), l_returnflag FROM lineitem GROUP BY l_returnflag", "SELECT COUNT(*) AS n, l_returnflag FROM lineitem GROUP BY l_returnflag", "n", "l_returnflag")
strict("group_key_not_selected", "SELECT COUNT(*) FROM lineitem GROUP BY l_returnflag", "SELECT COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", "n")
strict("group_filtered", "SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_partkey > 100 GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_partkey > 100 GROUP BY l_returnflag", "l_returnflag", "n")
strict("group_empty", "SELECT l_returnflag, COUNT(*) FROM lineitem WHERE l_partkey < 0 GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_partkey < 0 GROUP BY l_returnflag", "l_returnflag", "n")
strict("group_no_agg", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag")


@functional("group_null_key", "SELECT NULLIF(o_orderstatus, 'F') AS k, COUNT(*) AS n FROM orders GROUP BY 1")
def group_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("k"))
    return R.group_by(orders, ["k"], [A.count(name="n")])


@functional("group_multi_null", "SELECT NULLIF(l_returnflag, 'R') AS a, NULLIF(l_linestatus, 'O') AS b, COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem GROUP BY 1, 2")
def group_multi_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("a"), F.nullif("l_linestatus", F.lit("O")).alias("b"), "l_quantity")
    return R.group_by(rows, ["a", "b"], [A.count(name="n"), A.total("l_quantity", "total")])


# Order and limit

strict("order_int_asc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey")
strict("order_int_desc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC")
strict("order_float", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal")
strict("order_str", "SELECT c_name, c_custkey FROM customer ORDER BY c_name", "SELECT c_name, c_custkey FROM customer ORDER BY c_name")
strict("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")
strict("limit_large", "SELECT n_nationkey, n_name FROM nation LIMIT 1000000", "SELECT n_nationkey, n_name FROM nation LIMIT 1000000")
strict("topk_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
strict("group_order_limit", "SELECT l_orderkey, COUNT(*) FROM lineitem GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 20", "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 20", "l_orderkey", "n")


@functional("limit_n", None)  # which rows come is not defined, only how many
def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limit(read(spark, sf_dir, "orders").select("o_orderkey"), 7)


@functional("limit_n_count", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 7)")
def limit_n_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aggregate(limit_n(spark, sf_dir), [A.count(name="n")])


@functional("order_nulls", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS k FROM orders ORDER BY k DESC NULLS LAST")
def order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("double")).alias("k"))
    return R.order_by(rows, "k", ascending=False)


@functional("order_bool", "SELECT o_orderkey, o_orderstatus = 'F' AS b FROM orders ORDER BY b")
def order_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.order_by(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("b")), "b")


# Statistics, encodings, files


@functional("zone_map_table", "SELECT MIN(o_custkey) AS min, MAX(o_custkey) AS max, COUNT(*) - COUNT(o_custkey) AS nulls, COUNT(*) AS rows FROM orders")
def zone_map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.zone_map(read(spark, sf_dir, "orders"), "o_custkey")


@functional(
    "zone_map_blocks",
    """SELECT CAST((rn - 1) // 8192 AS BIGINT) AS block, MIN(o_custkey) AS min, MAX(o_custkey) AS max, COUNT(*) - COUNT(o_custkey) AS nulls, COUNT(*) AS rows
       FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""",
)
def zone_map_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.block_zone_maps(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", rows=8192)


@functional("codec_delta", "SELECT o_orderkey AS pos, o_custkey AS value, o_custkey - coalesce(lag(o_custkey) OVER (ORDER BY o_orderkey), 0) AS delta FROM orders")
def codec_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.deltas(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@functional(
    "codec_rle",
    """WITH m AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events),
            r AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS run FROM m)
       SELECT run, event_type AS value, MIN(event_id) AS start, COUNT(*) AS length FROM r GROUP BY run, event_type""",
)
def codec_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.runs(read(spark, sf_dir, "events"), "event_id", "event_type")


@functional(
    "codec_dict",
    """SELECT event_type AS value, MIN(event_id) AS first, COUNT(*) AS uses, CAST(dense_rank() OVER (ORDER BY MIN(event_id)) AS BIGINT) - 1 AS code
       FROM events GROUP BY event_type""",
)
def codec_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.codes(read(spark, sf_dir, "events"), "event_id", "event_type")


@functional("file_roundtrip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile
    import uuid

    from quarrion.sources.datasource import register

    register(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quarrion-")
    path = f"{shared.removeprefix('file://').removeprefix('file:')}/nation-{uuid.uuid4().hex}"  # a lazy frame may still read an earlier one
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    read(spark, sf_dir, "nation").write.format("blockfile").option("rowgroup", "10").mode("overwrite").save(path)
    return spark.read.format("blockfile").load(path)


strict(
    "flagship", "SELECT l_returnflag, COUNT(*), AVG(l_quantity) FROM lineitem WHERE l_orderkey > 30 GROUP BY l_returnflag ORDER BY l_returnflag",
    "SELECT l_returnflag, COUNT(*) AS n, AVG(l_quantity) AS mean FROM lineitem WHERE l_orderkey > 30 GROUP BY l_returnflag ORDER BY l_returnflag", "l_returnflag", "n", "mean",
)
