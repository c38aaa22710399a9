"""OpenStreetMap PBF as tables: a Spark data source that reads blobs in parallel.

A file is a list of blobs. The driver lists where they begin (headers only); each task decompresses and decodes its own, so
the three tables come from one kind of scan. Options: path, and kind (node, way or relation). Register with
spark.dataSource.register(OsmPbf), then spark.read.format("osm_pbf").option("kind", "way").load(path)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TAGS = "tags map<string,string>"
SCHEMAS = {
    "node": f"node bigint, lat double, lng double, {_TAGS}",
    "way": f"way bigint, refs array<bigint>, {_TAGS}",
    "relation": f"relation bigint, members array<struct<type:string,ref:bigint,role:string>>, {_TAGS}",
}
_KINDS = ("node", "way", "relation")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        yield number, value


def packed(data: bytes, signed: bool = False) -> list[int]:
    """All numbers of a packed list at once: bytes below 128 end a number, and each byte adds seven bits."""
    found = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(found < 128)
    if not len(ends):
        return []
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((found[: ends[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)
    return ((values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)).tolist() if signed else values.tolist()


def summed(steps: list[int]) -> list[int]:
    return np.cumsum(np.array(steps, np.int64)).tolist()


def opened(path: str):
    """A file of any file system that a path may name, to be read at places; tasks open it wherever they run."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def blob_bytes(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    return parts[1] if 1 in parts else zlib.decompress(parts[3])


def block_rows(block: bytes, kind: str) -> Iterator[tuple]:
    parts = [*fields(block)]
    strings = [s.decode("utf-8", "replace") for n, s in fields(next(v for k, v in parts if k == 1)) if n == 1]
    one = dict(parts)
    grain, lat0, lng0 = one.get(17, 100), zigzag_free(one.get(19, 0)), zigzag_free(one.get(20, 0))
    place = lambda v, zero: 1e-9 * (zero + grain * v)
    tags = lambda keys, values: {strings[k]: strings[v] for k, v in zip(keys, values, strict=True)}
    for number, group in parts:
        if number != 2:
            continue
        for what, item in fields(group):
            if what == 1 and kind == "node":
                f = dict(fields(item))
                yield zigzag(f[1]), place(zigzag(f[8]), lat0), place(zigzag(f[9]), lng0), tags(packed(f.get(2, b"")), packed(f.get(3, b"")))
            elif what == 2 and kind == "node":
                f = dict(fields(item))
                mixed, at = packed(f.get(10, b"")), 0
                for i, y, x in zip(summed(packed(f[1], True)), summed(packed(f[8], True)), summed(packed(f[9], True)), strict=True):
                    own = {}
                    while at < len(mixed) and mixed[at]:
                        own[strings[mixed[at]]] = strings[mixed[at + 1]]
                        at += 2
                    at += 1
                    yield i, place(y, lat0), place(x, lng0), own
            elif what == 3 and kind == "way":
                f = dict(fields(item))
                yield signed(f[1]), summed(packed(f.get(8, b""), True)), tags(packed(f.get(2, b"")), packed(f.get(3, b"")))
            elif what == 4 and kind == "relation":
                f = dict(fields(item))
                members = zip(packed(f.get(10, b"")), summed(packed(f.get(9, b""), True)), packed(f.get(8, b"")), strict=True)
                yield signed(f[1]), [(_KINDS[t], ref, strings[role]) for t, ref, role in members], tags(packed(f.get(2, b"")), packed(f.get(3, b"")))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


zigzag_free = signed


def blob_places(path: str) -> list[tuple[int, int]]:
    """Offset and size of each data blob."""
    out = []
    with opened(path) as file:
        while head := file.read(4):
            header = dict(fields(file.read(struct.unpack(">I", head)[0])))
            if header[1] == b"OSMData":
                out.append((file.tell(), header[3]))
            file.seek(header[3], 1)
    return out


class Blobs(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        places = blob_places(self.path)
        return [Blobs(self.path, places[k : k + 8]) for k in range(0, len(places), 8)] or [Blobs(self.path, [])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with opened(partition.path) as file:
            for offset, size in partition.places:
                file.seek(offset)
                yield from block_rows(blob_bytes(file.read(size)), self.kind)


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "node")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("kind", "node"))
