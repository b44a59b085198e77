"""The block file: a self-describing columnar file of four column types, as bytes.

Header, row groups (for each column its values and a null bitmap), a footer with the schema and every chunk's place and
statistics, the footer's length, and the magic again.  Numbers are little-endian.  Arrow tables go in and come out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarrion.errors import FormatError

# Fixed values of the format: magic, version, rows of a group by default, type tags.
MAGIC, VERSION, GROUP_ROWS = b"CLDB", 1, 65536
TAGS = {0: pa.int64(), 1: pa.float64(), 2: pa.string(), 3: pa.bool_()}
HEADER, TRAILER = 6, 8

_TAG_OF = {t: n for n, t in TAGS.items()}


@dataclass(frozen=True)
class Chunk:
    """Where a column of a row group lies, and its statistics (None: no value, or none recorded)."""

    offset: int
    size: int
    nulls: int
    low: object = None
    high: object = None


@dataclass(frozen=True)
class Group:
    rows: int
    chunks: tuple[Chunk, ...]


@dataclass
class Footer:
    schema: pa.Schema
    groups: list[Group] = field(default_factory=list)

    @property
    def total_rows(self) -> int:
        return sum(g.rows for g in self.groups)


def storable(schema: pa.Schema) -> pa.Schema:
    """The schema that a file gives back, or a FormatError: narrower integers and floats widen."""
    out = []
    for f in schema:
        t = f.type
        if pa.types.is_integer(t) and t != pa.uint64():
            t = pa.int64()
        elif pa.types.is_floating(t):
            t = pa.float64()
        elif pa.types.is_large_string(t) or pa.types.is_string_view(t):
            t = pa.string()
        if t not in _TAG_OF:
            raise FormatError(f"column {f.name!r} has type {f.type}, which a block file cannot hold")
        out.append(pa.field(f.name, t))
    if not out:
        raise FormatError("a block file needs at least one column")
    return pa.schema(out)


# Writing


def _bitmap(nulls: np.ndarray) -> bytes:
    return np.packbits(nulls, bitorder="little").tobytes()


def encode_chunk(column: pa.Array) -> bytes:
    """Values with placeholders for nulls (zero, false, no bytes), and the null bitmap."""
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_string(column.type):
        filled = column.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        if len(ends) and ends[-1] - ends[0] >= 1 << 32:
            raise FormatError("a row group's strings are too long for 32-bit offsets; write smaller groups")
        text = filled.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if filled.buffers()[2] is not None else b""
        offsets = (ends - ends[0]).astype("<u4") if len(ends) else np.zeros(1, "<u4")
        body = struct.pack("<I", len(offsets)) + offsets.tobytes() + text
    elif pa.types.is_boolean(column.type):
        body = column.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
    else:
        body = column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8" if pa.types.is_integer(column.type) else "<f8").tobytes()
    return body + _bitmap(nulls)


def bounds(column: pa.Array) -> tuple[object, object]:
    """Least and largest value; NaNs do not count unless there is nothing else, strings go by their bytes."""
    values = column.drop_null()
    if pa.types.is_floating(values.type):
        real = values.filter(pc.invert(pc.is_nan(values)))
        values = real if len(real) else values
    if not len(values):
        return None, None
    found = pc.min_max(values)
    return found["min"].as_py(), found["max"].as_py()


def _pack_value(kind: pa.DataType, value: object) -> bytes:
    if kind == pa.string():
        b = value.encode()
        return struct.pack("<I", len(b)) + b
    return struct.pack("<d" if kind == pa.float64() else "<q", value)


class Writer:
    """Row groups one after another, then ``close``; a file is not valid before that."""

    def __init__(self, out: BinaryIO, schema: pa.Schema):
        self.out, self.footer, self.at = out, Footer(storable(schema)), HEADER
        out.write(MAGIC + struct.pack("<H", VERSION))

    def write(self, table: pa.Table | pa.RecordBatch) -> None:
        """Append a row group; its columns must have the file's names and types."""
        if storable(table.schema) != self.footer.schema:
            raise FormatError(f"the row group's columns {table.schema.names} do not match the file's {self.footer.schema.names}")
        table = (table if isinstance(table, pa.Table) else pa.Table.from_batches([table])).cast(self.footer.schema).combine_chunks()
        chunks = []
        for column in table.columns:
            array = column.chunk(0) if column.num_chunks else pa.array([], column.type)
            b = encode_chunk(array)
            self.out.write(b)
            chunks.append(Chunk(self.at, len(b), array.null_count, *bounds(array)))
            self.at += len(b)
        self.footer.groups.append(Group(table.num_rows, tuple(chunks)))

    def close(self) -> None:
        b = pack_footer(self.footer)
        self.out.write(b + struct.pack("<I", len(b)) + MAGIC)


def pack_footer(footer: Footer) -> bytes:
    out = [struct.pack("<H", len(footer.schema))]
    for f in footer.schema:
        name = f.name.encode()
        out.append(struct.pack("<H", len(name)) + name + bytes([_TAG_OF[f.type]]))
    out.append(struct.pack("<I", len(footer.groups)))
    for g in footer.groups:
        out.append(struct.pack("<I", g.rows))
        for f, c in zip(footer.schema, g.chunks, strict=True):
            out.append(struct.pack("<QIIB", c.offset, c.size, c.nulls, c.low is not None))
            if c.low is not None:
                out += [_pack_value(f.type, c.low), _pack_value(f.type, c.high)]
    return b"".join(out)


# Reading


class _Cursor:
    def __init__(self, b: bytes):
        self.b, self.at = b, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.b):
            raise FormatError(f"the footer ends at byte {len(self.b)}, {n} bytes are wanted from {self.at}")
        self.at += n
        return self.b[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def value(self, kind: pa.DataType) -> object:
        if kind == pa.string():
            return self.take(self.number("I")).decode()
        x = self.number("d" if kind == pa.float64() else "q")
        return bool(x) if kind == pa.bool_() else x


def read_footer(f: BinaryIO, size: int) -> Footer:
    """The footer of a file of ``size`` bytes, with every place in it checked."""
    if size < HEADER + TRAILER:
        raise FormatError(f"a file of {size} bytes is too short")
    f.seek(0)
    magic, version = f.read(4), struct.unpack("<H", f.read(2))[0]
    if magic != MAGIC:
        raise FormatError(f"the file begins with {magic!r}")
    if version != VERSION:
        raise FormatError(f"version {version} is not supported")
    f.seek(size - TRAILER)
    length, magic = struct.unpack("<I4s", f.read(TRAILER))
    if magic != MAGIC:
        raise FormatError(f"the file ends with {magic!r}")
    if length > size - HEADER - TRAILER:
        raise FormatError(f"a footer of {length} bytes does not fit a file of {size}")
    end = size - TRAILER - length
    f.seek(end)
    c = _Cursor(f.read(length))
    fields = []
    for _ in range(c.number("H")):
        name, tag = c.take(c.number("H")).decode(), c.number("B")
        if tag not in TAGS:
            raise FormatError(f"column {name!r} has the unknown type {tag}")
        fields.append(pa.field(name, TAGS[tag]))
    footer = Footer(pa.schema(fields))
    for _ in range(c.number("I")):
        rows, chunks = c.number("I"), []
        for field_ in fields:
            offset, length_, nulls, has = c.number("Q"), c.number("I"), c.number("I"), c.number("B")
            if offset < HEADER or offset + length_ > end:
                raise FormatError(f"a chunk of column {field_.name!r} lies outside the file's data")
            low, high = (c.value(field_.type), c.value(field_.type)) if has == 1 else (None, None)
            chunks.append(Chunk(offset, length_, nulls, low, high))
        footer.groups.append(Group(rows, tuple(chunks)))
    if c.at != len(c.b):
        raise FormatError(f"{len(c.b) - c.at} bytes of the footer are left over")
    return footer


def decode_chunk(b: bytes, kind: pa.DataType, rows: int) -> pa.Array:
    """Back to an Arrow array."""
    tail = -(-rows // 8)
    if len(b) < tail:
        raise FormatError("a chunk is shorter than its null bitmap")
    body, bits = b[: len(b) - tail], np.frombuffer(b[len(b) - tail :], np.uint8)
    nulls = np.unpackbits(bits, count=rows, bitorder="little").astype(bool)
    if kind == pa.string():
        if len(body) < 4 or struct.unpack("<I", body[:4])[0] != rows + 1 or len(body) < 4 * (rows + 2):
            raise FormatError("a string chunk's offsets do not match its rows")
        offsets = np.frombuffer(body[4 : 4 * (rows + 2)], "<u4").astype(np.int64)
        text = body[4 * (rows + 2) :]
        if offsets[0] or (np.diff(offsets) < 0).any() or offsets[-1] != len(text):
            raise FormatError("a string chunk's offsets are out of order or out of range")
        valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
        array = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text), valid)
        try:
            array.validate(full=True)
        except pa.ArrowInvalid as e:
            raise FormatError(f"a string chunk is not UTF-8: {e}") from None
        return array.cast(pa.string())
    width = 1 if kind == pa.bool_() else 8
    if len(body) != rows * width:
        raise FormatError(f"a chunk holds {len(body)} bytes for {rows} values of {width}")
    values = np.frombuffer(body, np.uint8 if kind == pa.bool_() else "<i8" if kind == pa.int64() else "<f8")
    return pa.array(values.astype(bool) if kind == pa.bool_() else values, kind, mask=nulls)


def read_group(f: BinaryIO, footer: Footer, number: int, columns: list[str] | None = None) -> pa.Table:
    """Some or all columns of a row group."""
    if not 0 <= number < len(footer.groups):
        raise FormatError(f"row group {number} of {len(footer.groups)}")
    group, wanted = footer.groups[number], footer.schema.names if columns is None else columns
    out = []
    for name in wanted:
        i = footer.schema.names.index(name)
        f.seek(group.chunks[i].offset)
        out.append(decode_chunk(f.read(group.chunks[i].size), footer.schema.types[i], group.rows))
    return pa.Table.from_arrays(out, list(wanted))


def groups_of(tables: Iterator[pa.RecordBatch], rows: int = GROUP_ROWS) -> Iterator[pa.Table]:
    """Batches regrouped into tables of so many rows; the last may be shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in tables:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
