"""OSM PBF as a splittable, pruned Spark data source.

``spark.read.format("osm_pbf").load(path)`` (after ``spark.dataSource.register(OsmPbf)``; ``entities_of`` does both) gives rows
(kind, id, lon, lat, refs, members, tags) of one file, a glob or a list of either.  Planning asks for file sizes only: a partition
is a byte range.  Its task looks for the first blob header in the range, which must lead to another header or to the end of the file,
and goes from blob to blob until one begins past the range, so every blob is read by one task.

A predicate on ``kind`` is pushed down (or the option ``kinds`` set): a block is inflated, but a group of other entities is passed
over without decoding it.  Blocks become Arrow batches: packed numbers of all entities of a group are decoded at once in numpy.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = ("kind string, id long, lon double, lat double, refs array<long>, "
          "members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
KINDS = ("node", "way", "relation")
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())),
                   ("members", pa.list_(_MEMBER)), ("tags", pa.map_(pa.string(), pa.string()))])
#: Bytes of a partition.
SPLIT = 32 << 20
_HEADER = b"\x0a\x07OSMData"
_LONGEST = 64 << 10  # of a blob's header


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or bytes of length-delimited fields."""
    at, end = 0, len(raw)
    while at < end:
        key, at = varint(raw, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(raw, at)
        elif wire == 2:
            size, at = varint(raw, at)
            value, at = raw[at:at + size], at + size
        else:
            size = 8 if wire == 1 else 4
            value, at = raw[at:at + size], at + size
        yield key >> 3, value


def varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def numbers(raw: bytes) -> np.ndarray:
    """All base-128 numbers of a packed field, as 64 bits."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    start = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    size = np.diff(np.append(start, len(b)))
    shift = (np.arange(len(b)) - np.repeat(start, size)).astype(np.uint64) * np.uint64(7)
    return np.add.reduceat((b & 127).astype(np.uint64) << shift, start)


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def packed_rows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the packed fields of all rows, offset of each row's)."""
    raw = b"".join(rows)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) < 128)))
    return numbers(raw), ends[np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))]


def running_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of zigzag differences that begin anew with every row."""
    total = np.cumsum(zigzag(values))
    base = np.concatenate(([0], total))[offsets[:-1]]
    return total - np.repeat(base, np.diff(offsets))


def inflate(blob: bytes) -> bytes:
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
    raise ValueError("unsupported blob compression")


def header_box(block: bytes) -> tuple[float, float, float, float] | None:
    """(minx, miny, maxx, maxy) of a header block, if it has one."""
    for number, value in fields(block):
        if number == 1:
            box = {n: signed(v) * 1e-9 for n, v in fields(value)}
            return box[1], box[4], box[2], box[3]
    return None


def _tag_maps(strings: pa.Array, keys: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(keys.astype(np.int64))), strings.take(pa.array(values.astype(np.int64))))


def _batch(kind: str, ids: np.ndarray, tags: pa.Array, **more) -> pa.RecordBatch:
    columns = {"kind": pa.array([kind] * len(ids)), "id": pa.array(ids, pa.int64()), "tags": tags, **more}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(ids), f.type)) for f in ARROW], schema=ARROW)


def _dense_nodes(value: bytes, strings: pa.Array, degrees) -> pa.RecordBatch:
    got = dict(fields(value))
    ids, lats, lons = (np.cumsum(zigzag(numbers(got.get(k, b"")))) for k in (1, 8, 9))
    kv = numbers(got.get(10, b"")).astype(np.int64)
    ends = np.flatnonzero(kv == 0) if len(kv) else np.zeros(0, np.int64)
    if len(ids) and not len(ends):  # no node has tags
        return _batch("node", ids, _tag_maps(strings, kv, kv, np.zeros(len(ids) + 1)), lon=pa.array(degrees(lons, 1)), lat=pa.array(degrees(lats, 0)))
    pairs = kv[kv > 0] if len(kv) else kv
    # a pair's key and value are two numbers, and each node ends with a zero
    offsets = np.concatenate(([0], (ends - np.arange(len(ends))) // 2))
    return _batch("node", ids, _tag_maps(strings, pairs[::2], pairs[1::2], offsets), lon=pa.array(degrees(lons, 1)), lat=pa.array(degrees(lats, 0)))


def _group(found: list[tuple[int, dict]], strings: pa.Array, degrees) -> Iterator[pa.RecordBatch]:
    """Batches of the plain nodes, ways and relations of a group: (field number, fields)."""
    for number, kind in ((1, "node"), (3, "way"), (4, "relation")):
        rows = [got for n, got in found if n == number]
        if not rows:
            continue
        keys, offsets = packed_rows([r.get(2, b"") for r in rows])
        values, _ = packed_rows([r.get(3, b"") for r in rows])
        tags, ids = _tag_maps(strings, keys, values, offsets), np.array([r[1] for r in rows], np.uint64).view(np.int64)
        if number == 1:
            lat, lon = (zigzag(np.array([r[k] for r in rows], np.uint64)) for k in (8, 9))
            yield _batch(kind, zigzag(ids.view(np.uint64)), tags, lon=pa.array(degrees(lon, 1)), lat=pa.array(degrees(lat, 0)))
        elif number == 3:
            deltas, at = packed_rows([r.get(8, b"") for r in rows])
            yield _batch(kind, ids, tags, refs=pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(running_rows(deltas, at))))
        else:
            roles, _ = packed_rows([r.get(8, b"") for r in rows])
            deltas, at = packed_rows([r.get(9, b"") for r in rows])
            types, _ = packed_rows([r.get(10, b"") for r in rows])
            members = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(types.astype(np.int64))), pa.array(running_rows(deltas, at)),
                                                  strings.take(pa.array(roles.astype(np.int64)))], fields=list(_MEMBER))
            yield _batch(kind, ids, tags, members=pa.ListArray.from_arrays(pa.array(at, pa.int32()), members))


#: What the fields of a group hold.
_HELD = {1: "node", 2: "node", 3: "way", 4: "relation"}


def entities(block: bytes, kinds: frozenset[str] = frozenset(KINDS)) -> Iterator[pa.RecordBatch]:
    """Batches of a data block's entities of some kinds; a group of others is not decoded."""
    strings, groups, grain, base = [], [], 100, [0, 0]
    for number, value in fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in fields(value) if n == 1]
        elif number == 2 and value and _HELD.get(value[0] >> 3) in kinds:  # a group holds entities of one kind
            groups.append(value)
        elif number == 17:
            grain = value
        elif number in (19, 20):
            base[number - 19] = value - (1 << 64) if value >> 63 else value
    if not groups:
        return
    texts = pa.array(strings, pa.string())
    degrees = lambda v, axis: (base[axis] + grain * v) * 1e-9
    for group in groups:
        found = []
        for number, value in fields(group):
            if number == 2:
                yield _dense_nodes(value, texts, degrees)
            elif number in _HELD:
                found.append((number, dict(fields(value))))
        yield from _group(found, texts, degrees)


class Stretch(InputPartition):
    """Bytes [start, end) of a file: the blobs whose header begins there."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


def _inner(path: str):
    """(file system, path) of a URI that Arrow knows (hdfs, s3, gs, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A readable file of a local path or of any file system that Arrow knows by its URI."""
    if "://" not in path:
        return open(path, "rb")
    where, inner = _inner(path)
    return where.open_input_file(inner)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, size) of a path or glob, in order of names; nothing is opened."""
    path = path.removeprefix("file://")
    if "://" not in path:
        found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
        return [(p, os.path.getsize(p)) for p in found]
    from fnmatch import fnmatch

    from pyarrow import fs

    where, inner = _inner(path)
    scheme = path[:path.index("://") + 3]
    if not glob.has_magic(inner):
        return [(path, where.get_file_info(inner).size)]
    top = inner[:inner.rindex("/", 0, min(inner.index(c) for c in "*?[" if c in inner)) + 1]
    rows = where.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((scheme + r.path, r.size) for r in rows if r.is_file and fnmatch(r.path, inner))


def _header(f, at: int) -> tuple[str, int, int] | None:
    """(type, start of the blob, its size) of the header at a place; None if there is none."""
    f.seek(at)
    raw = f.read(4)
    size = struct.unpack(">I", raw)[0] if len(raw) == 4 else 0
    if not 0 < size <= _LONGEST:
        return None
    raw = f.read(size)
    try:
        got = dict(fields(raw)) if len(raw) == size else {}
        return got[1].decode("ascii"), at + 4 + size, int(got[3])
    except (KeyError, IndexError, ValueError, AttributeError, TypeError):
        return None


def _first(f, start: int, end: int, size: int) -> int:
    """Place of the first header in [start, end), or ``end``; what looks like one must lead to another or to the end of the file."""
    if start == 0:
        return 0
    at = start
    tail = b""
    while at - len(tail) < end:
        f.seek(at)
        chunk = f.read(1 << 20)
        if not chunk and not tail:
            return end
        window, base, seen = tail + chunk, at - len(tail), 0
        while (k := window.find(_HEADER, seen)) >= 0:
            place, seen = base + k - 4, k + 1
            if start <= place < end and (head := _header(f, place)):
                after = head[1] + head[2]
                if after == size or after < size and _header(f, after):
                    return place
            if place >= end:
                return end
        tail, at = window[-(len(_HEADER) + 4):], at + len(chunk)
        if not chunk:
            return end
    return end


def blobs(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(type, start, size) of the blobs whose header begins in [start, end), reading headers only."""
    (_, size), = listed(path)
    end = size if end is None else end
    with opened(path) as f:
        at = _first(f, start, end, size)
        while at < end and (head := _header(f, at)):
            yield head
            at = head[1] + head[2]
        if at < end:
            raise ValueError(f"{path}: no blob at {at}")


def read_header(path: str) -> tuple[float, float, float, float] | None:
    """The box that a file's header states, for ``infer_extent``."""
    for kind, start, size in blobs(path):
        if kind == "OSMHeader":
            with opened(path) as f:
                f.seek(start)
                return header_box(inflate(f.read(size)))
        break
    return None


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = self.options
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        kinds = frozenset(k.strip() for k in options.get("kinds", ",".join(KINDS)).split(","))
        made = _PushingReader if options.get("pushdown") == "true" else _Reader
        return made(paths, kinds, int(options.get("splitBytes", SPLIT)))


class _Reader(DataSourceReader):
    """Paths must be ones that driver and executors can open: a shared mount or URIs of a cluster file system."""

    def __init__(self, paths: list[str], kinds: frozenset[str], split: int = SPLIT):
        self.paths, self.kinds, self.split = paths, kinds, split

    def partitions(self) -> list[Stretch]:
        files = [x for p in self.paths for x in listed(p)]
        return [Stretch(p, a, min(size, a + self.split)) for p, size in files for a in range(0, size, self.split)] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        if start == end or not self.kinds:
            return
        with opened(path) as f:
            for kind, at, size in blobs(path, start, end):
                if kind == "OSMData":
                    f.seek(at)
                    yield from entities(inflate(f.read(size)), self.kinds)


class _PushingReader(_Reader):
    """Takes predicates on ``kind`` from the plan; Spark refuses such a reader where pushdown into Python sources is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                self.kinds &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            else:
                yield f


def entities_of(spark, *paths: str, kinds: Iterable[str] = KINDS):
    """Rows of SCHEMA of files and globs, with pushdown of predicates on ``kind``."""
    spark.dataSource.register(OsmPbf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("osm_pbf").option("kinds", ",".join(kinds)).option("pushdown", "true").option("paths", json.dumps(list(paths))).load()


def read_entities(df):
    """(nodes, ways, relations) of rows of SCHEMA; nodes with non-finite coordinates drop."""
    from pyspark.sql import functions as F

    from ..operators.assemble import finite

    nodes = df.where((F.col("kind") == "node") & finite("lon", "lat")).select("id", "lon", "lat", "tags")
    ways = df.where(F.col("kind") == "way").select("id", "refs", "tags")
    return nodes, ways, df.where(F.col("kind") == "relation").select("id", "members", "tags")
