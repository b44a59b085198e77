"""Session plumbing shared by the corpus operators: shared storage, Arrow batches, hot-key joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.session import share_package

#: Rows of an Arrow batch that goes to a Python worker; texts vary from one word to megabytes.
ARROW_ROWS = 512
#: Text bytes that a worker hashes at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Whether Spark deletes the shuffle files of a write when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a worker's memory does not depend on text lengths."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; a local one only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.conf.get("spark.master", "local") or "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quarrion-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarrion-{spark.sparkContext.applicationId}"


def _own_folder(spark: SparkSession):
    """The file system and path of this application's folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames that still read them can no longer run."""
    files, path = _own_folder(spark)
    files.delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing.

    The schema is passed to the reader, so an empty frame comes back empty and no inference job runs.  These tables go when
    the application's JVM ends, or by ``clear`` when their readers are done.  The shuffle files of the write go when it ends,
    so that those of an operator's steps do not add up on disk.
    """
    spark = df.sparkSession
    files, folder = _own_folder(spark)
    files.deleteOnExit(folder)
    path = f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    release_jvm_memory(spark)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, what: str) -> Iterator[Row]:
    """The rows of a frame whose size has a bound, on the driver: computed by all tasks, then read in one job.

    Reading a frame straight from its last shuffle would take a job for each of its partitions.
    """
    return stored(df, what).coalesce(1).toLocalIterator()


def release_memory() -> None:
    """Give memory that a model's fit has freed back to the system, where the C library can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_jvm_memory(spark: SparkSession) -> str:
    """Give native memory that the driver's JVM has freed back to the system; what the JVM says, or nothing where it cannot.

    Compiling the code of many plans takes and frees native memory, which the C library would keep.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with suppress(Py4JError, PySparkException):
        of = jvm.java.lang.Class
        kinds, given = new(of, 4), new(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()  # its class is not public, the interface is
        return of.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)
    return ""


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n: the split that decides which rows a model may learn from."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def _drawn(hashed: Column, rows: Column, n: int) -> Column:
    """Whether a hash belongs to the n of so many rows; the product may be beyond a long, so it is a double."""
    return F.pmod(hashed, F.lit(1 << 30)).cast("double") * rows < float(n) * (1 << 30)


def bounded_sample(df: DataFrame, key: str, n: int, per: str | None = None) -> DataFrame:
    """At most n rows (of each value of ``per``), chosen by a hash of the key; ``df`` should hold no texts.

    Groups are counted first and thinned by the hash to about 4 n rows, so that the ranking sees a bounded number.
    The counts are broadcast if there are 10 000 groups (labels, languages) at most, and joined by shuffle beyond.
    """
    from pyspark.sql import Window

    group = F.col(per) if per else F.lit(0)
    counts = df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    counts = F.broadcast(counts) if not per or counts.count() <= 10_000 else counts
    thinned = df.join(counts, group == F.col("_g")).where(_drawn(F.xxhash64(F.col(key)), F.col("_n"), 4 * n))
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key)), F.col(key))
    return thinned.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(*df.columns)


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Arrow batches cut so that each holds CHUNK_BYTES of text at most, or one longer text; nulls become empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = memoryview(texts.buffers()[1]).cast("q")[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = at + 1
            while to < len(texts) and ends[to + 1] - ends[at] <= CHUNK_BYTES:
                to += 1
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, f: Callable[[Iterator[tuple[pa.RecordBatch, pa.Array]]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over bounded text chunks; ``f`` yields column dicts for ``schema``."""
    small_batches(df.sparkSession)
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(text_batches(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) if not isinstance(columns[x.name], pa.Array) else columns[x.name].cast(x.type) for x in to], schema=to)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in schema.split(","))])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of many rows to one row for each group, whatever the share of the largest group.

    ``groups`` has ``size``, its number of rows.  Groups of over max(10 000, total / 500) rows number 500 at most, a
    bound that does not grow with the data, so they are broadcast; each of the rest is a small key of a shuffled join.
    """
    hot = max(10_000, total // 500)
    extra = [c for c in groups.columns if c not in keys]
    large = F.broadcast(groups.where(F.col(size) > hot).select(*keys, F.struct(*extra).alias("_hot")))
    small = groups.where(F.col(size) <= hot).select(*keys, F.struct(*extra).alias("_cold"))
    marked = rows.join(large, keys, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(small, keys, "left").withColumnRenamed("_cold", "_found")
    found = marked.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "_found")
    return found.unionByName(cold).select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in extra))


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores appended until it clashes with no column (Spark compares names without case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: extra columns cannot clash with an operator's own."""
    return df.select(df[id_col].cast(T.LongType()).alias("doc_id"), df[text_col].cast("string").alias("text"))
