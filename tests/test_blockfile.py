import io
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.errors import FormatError
from quarrion.sources import blockfile as bf
from quarrion.sources.datasource import may_match, register

SAMPLE = pa.table({"id": pa.array([1, 2, 3], pa.int64()), "name": pa.array(["alice", None, "charlie"], pa.string())})


def write(*tables, schema=None):
    out = io.BytesIO()
    w = bf.Writer(out, schema or tables[0].schema)
    for t in tables:
        w.write(t)
    w.close()
    return out.getvalue()


def read(b):
    f = io.BytesIO(b)
    footer = bf.read_footer(f, len(b))
    return footer, [bf.read_group(f, footer, i) for i in range(len(footer.groups))]


def test_sample_layout():
    b = write(SAMPLE)
    assert len(b) == 164 and b[:6] == b"CLDB\x01\x00" and b[156:] == struct.pack("<I", 92) + b"CLDB"
    assert b[6:31] == struct.pack("<qqq", 1, 2, 3) + b"\0"
    assert b[31:64] == struct.pack("<IIIII", 4, 0, 5, 5, 12) + b"alicecharlie" + b"\2"
    assert b[64:82] == struct.pack("<HH", 2, 2) + b"id\0" + struct.pack("<H", 4) + b"name\2" + struct.pack("<I", 1)
    assert b[82:119] == struct.pack("<IQIIBqq", 3, 6, 25, 0, 1, 1, 3)
    assert b[119:156] == struct.pack("<QIIBI", 31, 33, 1, 1, 5) + b"alice" + struct.pack("<I", 7) + b"charlie"


def test_groups_and_types():
    kinds = {"i": pa.int64(), "f": pa.float64(), "s": pa.string(), "b": pa.bool_()}
    one = pa.table({"i": [10, -20, None], "f": [1.1, None, float("nan")], "s": ["hello", "", None], "b": [True, False, None]}, schema=pa.schema(list(kinds.items())))
    none = pa.table({n: pa.array([None, None], t) for n, t in kinds.items()})
    footer, groups = read(write(one, none, one.slice(0, 0)))
    assert footer.total_rows == 5 and [g.num_rows for g in groups] == [3, 2, 0]
    assert groups[1].equals(none) and str(groups[0].to_pylist()) == str(one.to_pylist())
    assert footer.groups[0].chunks[3].low is False and footer.groups[0].chunks[3].high is True
    assert (footer.groups[0].chunks[1].low, footer.groups[0].chunks[1].high) == (1.1, 1.1)
    assert footer.groups[1].chunks[0].low is None and footer.groups[1].chunks[0].nulls == 2
    assert bf.read_group(io.BytesIO(write(one)), read(write(one))[0], 0, ["s", "i"]).column_names == ["s", "i"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.none() | st.floats(allow_nan=False), st.none() | st.text(max_size=9), st.none() | st.booleans()), max_size=30))
def test_round_trip(rows):
    t = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("i", pa.int64()), ("f", pa.float64()), ("s", pa.string()), ("b", pa.bool_())))})
    assert read(write(t))[1][0].equals(t)


def test_writer_checks():
    out = io.BytesIO()
    w = bf.Writer(out, SAMPLE.schema)
    with pytest.raises(FormatError):
        w.write(SAMPLE.select(["id"]))
    with pytest.raises(FormatError):
        w.write(SAMPLE.rename_columns(["id", "other"]))
    with pytest.raises(FormatError):
        bf.storable(pa.schema([("x", pa.date32())]))
    with pytest.raises(FormatError):
        bf.storable(pa.schema([]))
    assert bf.storable(pa.schema([("x", pa.int16()), ("y", pa.float32())])).types == [pa.int64(), pa.float64()]


@pytest.mark.parametrize(
    "damage",
    [
        lambda b: b[:10], lambda b: b"", lambda b: b"XXXX" + b[4:], lambda b: b[:4] + b"\2\0" + b[6:], lambda b: b[:-4] + b"XXXX", lambda b: b[:-8] + struct.pack("<I", 10_000) + b[-4:], lambda b: b[:-8] + struct.pack("<I", 3) + b[-4:],
        lambda b: b[:70] + b"\x09" + b[71:], lambda b: b[:86] + struct.pack("<Q", 1 << 40) + b[94:], lambda b: b[:31] + struct.pack("<I", 9) + b[35:], lambda b: b[:39] + struct.pack("<I", 99) + b[43:], lambda b: b[:52] + b"\xff" + b[53:], lambda b: b[:94] + struct.pack("<I", 17) + b[98:],
    ],
)
def test_damage_is_found(damage):
    with pytest.raises(FormatError):
        read(damage(write(SAMPLE)))


def test_group_number():
    footer, _ = read(write(SAMPLE))
    for n in (-1, 1):
        with pytest.raises(FormatError):
            bf.read_group(io.BytesIO(write(SAMPLE)), footer, n)


def test_regrouping():
    batches = [pa.record_batch({"x": list(range(i, i + n))}) for i, n in ((0, 5), (5, 0), (5, 9), (14, 3))]
    assert [t.num_rows for t in bf.groups_of(iter(batches), 4)] == [4, 4, 4, 4, 1]


def test_data_source(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    df = spark.range(1000).selectExpr("id", "id * 0.5D AS half", "IF(id % 7 = 0, NULL, concat('n', id)) AS name", "id % 3 = 0 AS third").repartition(3)
    df.write.format("blockfile").option("rowgroup", "100").mode("append").save(path)
    back = spark.read.format("blockfile").load(path)
    assert back.schema.simpleString() == "struct<id:bigint,half:double,name:string,third:boolean>"
    assert back.rdd.getNumPartitions() >= 10 and sorted(back.collect()) == sorted(df.collect())
    assert back.where("id < 10").count() == 10
    spark.range(5).write.format("blockfile").mode("overwrite").save(path)
    assert spark.read.format("blockfile").load(path).count() == 5
    spark.range(0).write.format("blockfile").mode("overwrite").save(path)
    assert spark.read.format("blockfile").load(path).collect() == []


def test_columns_option_and_append_guard(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    df = spark.range(50).selectExpr("id", "concat('n', id) AS name", "id * 0.5D AS half")
    df.write.format("blockfile").mode("append").save(path)
    some = spark.read.format("blockfile").option("columns", "half, id").option("where", "id >= 0").load(path)
    assert some.columns == ["half", "id"] and sorted(r.id for r in some.collect()) == list(range(50))
    df.write.format("blockfile").mode("append").save(path)
    assert spark.read.format("blockfile").load(path).count() == 100
    for wrong in (spark.range(3), df.selectExpr("name", "id", "half")):
        with pytest.raises(Exception, match="columns to append"):
            wrong.write.format("blockfile").mode("append").save(path)
    assert spark.read.format("blockfile").load(path).count() == 100
    with pytest.raises(Exception, match="unknown column"):
        spark.read.format("blockfile").option("columns", "other").load(path).count()


def test_files_that_differ_are_refused(spark, tmp_path):
    register(spark)
    for n, df in (("a", spark.range(3)), ("b", spark.range(3).selectExpr("id AS other"))):
        df.coalesce(1).write.format("blockfile").mode("append").save(str(tmp_path / n))
    (tmp_path / "both").mkdir()
    for n in "ab":
        next((tmp_path / n).glob("*.block")).rename(tmp_path / "both" / f"{n}.block")
    with pytest.raises(Exception, match="first file"):
        spark.read.format("blockfile").load(str(tmp_path / "both")).collect()


def test_where_option_skips_groups(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.format("blockfile").option("rowgroup", "100").mode("append").save(path)
    some = spark.read.format("blockfile").option("where", "id >= 850").load(path)
    assert some.count() == 200 and some.where("id >= 850").count() == 150


def test_one_frame_with_many_filters_loses_nothing(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "t")
    df = spark.range(1000).coalesce(1).selectExpr("id", "concat('n', lpad(id, 4, '0')) AS name", "IF(id % 300 = 7, double('NaN'), double(id)) AS x", "IF(id > 200, NULL, id) AS some")
    df.write.format("blockfile").option("rowgroup", "250").mode("append").save(path)
    back = spark.read.format("blockfile").load(path)
    for f in ("id >= 850", "true", "id IN (5, 905)", "name = 'n0333'", "x > 990", "NOT x < 990", "some IS NULL", "id < 50 OR x > 980"):
        assert sorted(r.id for r in back.where(f).select("id").collect()) == sorted(r.id for r in df.where(f).select("id").collect()), f


@pytest.mark.parametrize(("op", "value", "ok"), [("=", 5, True), ("=", 11, False), ("<", 1, False), ("<=", 1, True), (">", 10, False), (">=", 10, True), ("!=", 5, True), ("=", "x", True)])
def test_zone_map_decisions(op, value, ok):
    assert may_match(bf.Chunk(0, 0, 0, 1, 10), pa.int64(), op, value) is ok
    assert may_match(bf.Chunk(0, 0, 0, True, False), pa.bool_(), op, value)
