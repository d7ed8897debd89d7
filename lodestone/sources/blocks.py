"""Block files: a compact columnar interchange format of row groups.

Little-endian. Header: magic, u16 version, u16 columns; per column u16 length
and name, u8 type, from version 2 u16 length and annotation; u32 row groups.
Row group: u64 rows; from version 3 per column a flag, a least and a greatest
value (8 bytes each); then per column a validity bitmap and the values: int64
and double 8 bytes, bool 1 byte, string rows+1 int64 offsets, u64 length, bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import islice
from typing import Any, BinaryIO

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.plans.frame import Frame
from lodestone.types import kind_of

# Fixed values of the format.
MAGIC = b"VTR1"
VERSION = 3
TYPES = ["int64", "double", "bool", "string"]

_SPARK = {"int64": "bigint", "double": "double", "bool": "boolean", "string": "string"}
GROUP_ROWS = 65_536


def _exact(f: BinaryIO, n: int) -> bytes:
    got = f.read(n)
    if len(got) < n:
        raise ValueError("truncated block file")
    return got


def _number(f: BinaryIO, form: str) -> int:
    return struct.unpack("<" + form, _exact(f, struct.calcsize("<" + form)))[0]


def _header(f: BinaryIO) -> tuple[int, list[tuple[str, str, str]], int]:
    if f.read(4) != MAGIC:
        raise ValueError("not a block file")
    version, columns = _number(f, "H"), []
    if not 1 <= version <= VERSION:
        raise ValueError(f"unknown block file version {version}")
    for _ in range(_number(f, "H")):
        name = _exact(f, _number(f, "H")).decode()
        kind = TYPES[_number(f, "B")]
        note = _exact(f, _number(f, "H")).decode() if version >= 2 else ""
        columns.append((name, kind, note))
    return version, columns, _number(f, "I")


def _values(f: BinaryIO, kind: str, n: int) -> list[Any]:
    bits = np.unpackbits(np.frombuffer(_exact(f, (n + 7) // 8), np.uint8), bitorder="little")[:n].astype(bool)
    if kind == "string":
        offsets = np.frombuffer(_exact(f, 8 * (n + 1)), "<i8")
        data = _exact(f, _number(f, "Q"))
        return [data[a:b].decode() if ok else None for ok, a, b in zip(bits, offsets, offsets[1:], strict=False)]
    form = {"int64": "<i8", "double": "<f8", "bool": "u1"}[kind]
    raw = np.frombuffer(_exact(f, n * np.dtype(form).itemsize), form)
    raw = raw.astype(bool) if kind == "bool" else raw
    return [v if ok else None for v, ok in zip(raw.tolist(), bits, strict=True)]


def _skip(f: BinaryIO, version: int, columns: list) -> None:
    n = _number(f, "Q")
    f.seek(17 * len(columns) * (version >= 3), 1)
    for _, kind, _ in columns:
        f.seek((n + 7) // 8, 1)
        if kind == "string":
            f.seek(8 * (n + 1), 1)
            f.seek(_number(f, "Q"), 1)
        else:
            f.seek(n * (1 if kind == "bool" else 8), 1)


class _Group(InputPartition):
    def __init__(self, at: int):
        self.at = at


class _Reader(DataSourceReader):
    """One partition for each row group; the driver walks the file by seeking only."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Group]:
        with open(self.path, "rb") as f:
            version, columns, groups = _header(f)
            found = []
            for _ in range(groups):
                found.append(_Group(f.tell()))
                _skip(f, version, columns)
        return found or [_Group(-1)]

    def read(self, partition: _Group) -> Iterator[tuple]:
        if partition.at < 0:
            return
        with open(self.path, "rb") as f:
            version, columns, _ = _header(f)
            f.seek(partition.at)
            n = _number(f, "Q")
            f.seek(17 * len(columns) * (version >= 3), 1)
            yield from zip(*(_values(f, kind, n) for _, kind, _ in columns), strict=True)


class BlockSource(DataSource):
    """option: path."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_blocks"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as f:
            return ", ".join(f"`{n}` {_SPARK[k]}" for n, k, _ in _header(f)[1])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_blocks(spark: SparkSession, path: str) -> Frame:
    """A block file that driver and executors can open, as a frame in file order."""
    with open(path, "rb") as f:
        notes = {n: note for n, _, note in _header(f)[1] if note}
    spark.dataSource.register(BlockSource)
    df = spark.read.format(BlockSource.name()).option("path", path).load()
    return Frame.of(df, meta={"annotations": notes} if notes else None)


def _stats(kind: str, known: list[Any]) -> bytes:
    if kind == "string" or not known:
        return bytes(17)
    if kind == "bool":
        return struct.pack("<BQQ", 1, int(False in known), int(True in known))
    form = "q" if kind == "int64" else "d"
    return struct.pack("<B" + form * 2, 1, min(known), max(known))


def _encode(kind: str, values: list[Any]) -> bytes:
    ok = np.array([v is not None for v in values], bool)
    bits = np.packbits(ok, bitorder="little").tobytes()
    if kind == "string":
        data = [b"" if v is None else str(v).encode() for v in values]
        offsets = np.cumsum([0, *map(len, data)]).astype("<i8").tobytes()
        body = b"".join(data)
        return bits + offsets + struct.pack("<Q", len(body)) + body
    form = {"int64": "<i8", "double": "<f8", "bool": "u1"}[kind]
    return bits + np.array([0 if v is None else v for v in values], form).tobytes()


def write_blocks(frame: Frame, path: str, batch_size: int = GROUP_ROWS) -> None:
    """One row group for each batch of rows, streamed through the driver; the file appears when complete."""
    df = frame.to_df()
    fields = [(f.name, kind_of(f.dataType)) for f in df.schema.fields]
    for name, kind in fields:
        if kind not in TYPES:
            raise TypeError(f"unsupported column type: {name} is {kind}")
    rows, groups, temp = df.toLocalIterator(True), 0, f"{path}.writing"
    with open(temp, "wb") as f:
        f.write(MAGIC + struct.pack("<HH", VERSION, len(fields)))
        for name, kind in fields:
            f.write(struct.pack("<H", len(name.encode())) + name.encode() + struct.pack("<BH", TYPES.index(kind), 0))
        at = f.tell()
        f.write(struct.pack("<I", 0))
        while batch := list(islice(rows, batch_size)):
            groups += 1
            columns = list(zip(*batch, strict=True))
            f.write(struct.pack("<Q", len(batch)))
            for (_, kind), values in zip(fields, columns, strict=True):
                f.write(_stats(kind, [v for v in values if v is not None and v == v]))
            for (_, kind), values in zip(fields, columns, strict=True):
                f.write(_encode(kind, list(values)))
        f.seek(at)
        f.write(struct.pack("<I", groups))
    os.replace(temp, path)
