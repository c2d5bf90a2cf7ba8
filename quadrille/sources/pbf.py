"""Protobuf block files of elements, of any size.

A file is a row of blobs that can be decoded apart. Spark's text source cuts
files into splits, and each split into pieces, at a separator: here the bytes
that begin the header of a data blob. So many tasks read one file, in any file
system that Spark reads, without an index and without the driver. What stands
between two separators is checked against the lengths that the headers give:
where the separator happens to occur inside of a blob, pieces are joined again.

Columns are built as Arrow arrays; only ways and relations, which are messages
of their own, are gone through one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the format, the features that are understood or wanted, member types, and what a data blob's header begins with.
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
SORTED, LOCATED = "Sort.Type_then_ID", "LocationsOnWays"
MEMBER_TYPES = ("node", "way", "relation")
SEPARATOR = "\n\x07OSMData"

SCHEMA = "type string, id long, lat7 long, lon7 long, version int, ts timestamp, tags array<struct<k:string,v:string>>, refs array<long>, lats7 array<long>, lons7 array<long>, members array<struct<type:string,ref:long,role:string>>"
HEADER_SCHEMA = "path string, required array<string>, optional array<string>, replication_timestamp timestamp, replication_sequence long, replication_url string"


# Messages ---------------------------------------------------------------------


class BrokenOff(ValueError):
    """A message or a row of blobs ends before its length."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place behind it."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise BrokenOff("the message is broken off")
        if shift > 63:
            raise ValueError("a number is too long")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields_at(data: bytes, at: int = 0) -> Iterator[tuple[int, int | bytes, int]]:
    """(number, value, place behind it) of a protobuf message: varints as numbers, all else as bytes."""
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, value, at
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"no such wire type: {kind}")
        n, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
        if at + n > len(data):
            raise BrokenOff("the message is broken off")
        yield key >> 3, data[at : at + n], at + n
        at += n


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    for number, value, _ in fields_at(data):
        yield number, value


def varints(data: bytes) -> np.ndarray:
    """All varints of packed data at once, as signed 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise ValueError("the numbers are broken off")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(x & 1)


def numbers(values: list[int | bytes]) -> np.ndarray:
    """A repeated number field, packed or not."""
    parts = [varints(v) if isinstance(v, bytes) else np.array([v], np.uint64).view(np.int64) for v in values]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def gather(data: bytes) -> dict[int, list[int | bytes]]:
    out: dict[int, list[int | bytes]] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


# Blobs ------------------------------------------------------------------------


def unpacked(blob: bytes) -> bytes:
    message = dict(fields(blob))
    if 1 in message:
        return message[1]
    if 3 not in message:
        raise ValueError("the block's compression is not supported" if message.keys() & {4, 5, 6, 7} else "the block has no data")
    out = zlib.decompress(message[3])
    if len(out) != message.get(2, len(out)):
        raise ValueError("the block has another length than it says")
    return out


def _size(header: dict) -> int:
    if not 0 <= header.get(3, -1) <= MOST_BLOB:
        raise ValueError("a block is too large")
    return header[3]


def whole_blobs(data: bytes, at: int = 0) -> Iterator[tuple[str, bytes]]:
    """(kind, blob) of a row of blobs; four bytes may be left, the length of the next header."""
    while len(data) - at not in (0, 4):
        if len(data) - at < 4:
            raise BrokenOff("the file is broken off")
        (n,) = struct.unpack_from(">I", data, at)
        if not 0 < n <= MOST_HEADER:
            raise ValueError("a block's header is too large")
        if at + 4 + n > len(data):
            raise BrokenOff("the file is broken off")
        header = dict(fields(data[at + 4 : at + 4 + n]))
        at += 4 + n
        size = _size(header)
        if at + size > len(data):
            raise BrokenOff("the file is broken off")
        yield header[1].decode(), data[at : at + size]
        at += size


def piece_blobs(piece: bytes) -> list[tuple[str, bytes]]:
    """(kind, blob) of what follows a separator: the rest of its header, the blob, and other blobs."""
    for number, value, at in fields_at(piece):
        if number == 3:
            size = _size({3: value})
            if at + size > len(piece):
                raise BrokenOff("the file is broken off")
            return [("OSMData", piece[at : at + size]), *whole_blobs(piece, at + size)]
        if number != 2:
            raise ValueError("a block's header has an unknown form")
    raise BrokenOff("the file is broken off")


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    """(path, kind, blob) of pieces (path, start, value) as Spark reads them: a split's stand in a row."""
    split, held = None, b""
    for batch in batches:
        for path, start, value in zip(*(batch.column(i) for i in range(3))):
            path, start, value = path.as_py(), start.as_py(), value.as_py() or b""
            first = (path, start) != split
            if first and held:
                raise ValueError(f"{split[0]}: a blob is broken off")
            split = (path, start)
            at_head = start == 0 and (first or in_head)
            piece = held + SEPARATOR.encode() + value if held else value
            if len(piece) > 3 * MOST_BLOB + MOST_HEADER:
                raise ValueError(f"{path}: a blob is broken off")
            try:
                found = list(whole_blobs(piece)) if at_head else piece_blobs(piece)
            except BrokenOff:
                held, in_head = piece, at_head
                continue
            held, in_head = b"", False
            if at_head and (not found or found[0][0] != "OSMHeader"):
                raise ValueError(f"{path}: the file has no header")
            yield from ((path, *x) for x in found)
    if held:
        raise ValueError(f"{split[0]}: a blob is broken off")


# Headers ----------------------------------------------------------------------


def header(blob: bytes) -> dict:
    """A file's features and state, as in HEADER_SCHEMA."""
    found = gather(unpacked(blob))
    texts = lambda n: [x.decode() for x in found.get(n, [])]
    seconds = found.get(32, [0])[-1]
    return {"required": texts(4), "optional": texts(5), "replication_timestamp": seconds * 1_000_000 if seconds > 0 else None, "replication_sequence": found.get(33, [None])[-1], "replication_url": (texts(34) or [None])[-1]}


def check_header(blob: bytes, strict: bool = False) -> None:
    """Refuse features that aren't understood; ``strict`` asks for order by type and id and for the ways' own coordinates."""
    found = header(blob)
    if unknown := set(found["required"]) - FEATURES:
        raise ValueError(f"the file needs {sorted(unknown)}")
    if strict and (missing := {SORTED, LOCATED} - set(found["optional"])):
        raise ValueError(f"the file lacks {sorted(missing)}")


# Blocks -----------------------------------------------------------------------

TAG = pa.struct([("k", pa.string()), ("v", pa.string())])
MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
LONGS = pa.list_(pa.int64())
ARROW = pa.schema(
    [("type", pa.string()), ("id", pa.int64()), ("lat7", pa.int64()), ("lon7", pa.int64()), ("version", pa.int32()), ("ts", pa.timestamp("us", "UTC"))]
    + [("tags", pa.list_(TAG)), ("refs", LONGS), ("lats7", LONGS), ("lons7", LONGS), ("members", pa.list_(MEMBER))]
)
_NONE = np.zeros(0, np.int64)


def _lists(parts: list[np.ndarray] | None, values: pa.Array | None = None, sizes=None) -> pa.ListArray:
    """Lists of numbers, or of ``values`` of the given sizes."""
    sizes = list(map(len, parts)) if sizes is None else sizes
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_NONE, *parts])) if values is None else values)


def dense_tags(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tags of each node, keys, values) of a list in which each node's keys and values are followed by a zero."""
    sizes, keys = np.zeros(n, np.int64), []
    if not len(words):
        return sizes, _NONE, _NONE
    at = node = 0
    row = words.tolist()
    while at < len(row):
        if row[at] == 0:
            node += 1
            at += 1
        elif at + 1 == len(row):
            raise ValueError("a key of the dense nodes has no value")
        elif node >= n:
            raise ValueError("there are tags of more dense nodes than ids")
        else:
            keys.append(at)
            sizes[node] += 1
            at += 2
    keys = np.array(keys, np.int64)
    return sizes, words[keys], words[keys + 1]


def block_batches(blob: bytes) -> Iterator[pa.RecordBatch]:
    """Batches (ARROW) of one block."""
    block = gather(unpacked(blob))
    table = [s.decode("utf-8", "replace") for s in gather(block[1][0]).get(1, [])]
    strings = pa.array([*table, ""], pa.string())  # the last one stands for places that the table lacks
    granularity, dates = block.get(17, [100])[0], block.get(18, [1000])[0]
    lat0, lon0 = (int(np.array([block.get(n, [0])[0]], np.uint64).view(np.int64)[0]) for n in (19, 20))
    text = lambda i: strings.take(pa.array(np.where((i >= 0) & (i < len(table)), i, len(table))))
    e7 = lambda x, offset: (offset + granularity * x) // 100

    def batch(kind: str, n: int, **columns) -> pa.RecordBatch:
        columns["type"] = pa.array([kind] * n, pa.string())
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in ARROW], schema=ARROW)

    def instants(values: np.ndarray) -> pa.Array:
        return pa.array(values * (dates * 1000), mask=values == 0).cast(pa.int64()).cast(ARROW.field("ts").type)

    def tags(sizes, keys: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return _lists(None, pa.StructArray.from_arrays([text(keys), text(values)], fields=list(TAG)), sizes)

    def plain(messages: list[dict]) -> dict[str, pa.Array]:
        """Tags, version and time of messages that stand alone."""
        keys, values = ([numbers(m.get(n, [])) for m in messages] for n in (2, 3))
        if any(len(k) != len(v) for k, v in zip(keys, values)):
            raise ValueError("keys and values differ in number")
        info = [dict(fields(m[4][0])) if 4 in m else {} for m in messages]
        times = np.array([i.get(2, 0) for i in info], np.int64)
        return {"tags": tags(list(map(len, keys)), np.concatenate([_NONE, *keys]), np.concatenate([_NONE, *values])), "version": pa.array([i.get(1) for i in info], pa.int32()), "ts": instants(times)}

    for group in map(gather, block.get(2, [])):
        if nodes := [gather(m) for m in group.get(1, [])]:
            ids, lat, lon = (zigzag(np.concatenate([numbers(m[n]) for m in nodes])) for n in (1, 8, 9))
            yield batch("node", len(ids), id=pa.array(ids), lat7=pa.array(e7(lat, lat0)), lon7=pa.array(e7(lon, lon0)), **plain(nodes))
        for m in map(gather, group.get(2, [])):
            ids, lat, lon = (np.cumsum(zigzag(numbers(m.get(n, [])))) for n in (1, 8, 9))
            if not len(ids) == len(lat) == len(lon):
                raise ValueError("the columns of the dense nodes differ in length")
            columns = {"id": pa.array(ids), "lat7": pa.array(e7(lat, lat0)), "lon7": pa.array(e7(lon, lon0)), "tags": tags(*dense_tags(numbers(m.get(10, [])), len(ids)))}
            more = gather(m[5][0]) if 5 in m else {}
            version, times = numbers(more.get(1, [])), np.cumsum(zigzag(numbers(more.get(2, []))))
            if len(version) == len(ids) == len(times):
                columns |= {"version": pa.array(version.astype(np.int32)), "ts": instants(times)}
            yield batch("node", len(ids), **columns)
        if ways := [gather(m) for m in group.get(3, [])]:
            row = lambda n: [np.cumsum(zigzag(numbers(m.get(n, [])))) for m in ways]  # noqa: E731,B023
            lats, lons = [e7(x, lat0) for x in row(9)], [e7(x, lon0) for x in row(10)]
            yield batch("way", len(ways), id=pa.array([m[1][0] for m in ways]), refs=_lists(row(8)), lats7=_lists(lats), lons7=_lists(lons), **plain(ways))
        if relations := [gather(m) for m in group.get(4, [])]:
            roles, kinds = ([numbers(m.get(n, [])) for m in relations] for n in (8, 10))
            refs = [np.cumsum(zigzag(numbers(m.get(9, [])))) for m in relations]
            if any(not len(a) == len(b) == len(c) for a, b, c in zip(roles, refs, kinds)):
                raise ValueError("the members' columns differ in length")
            kind = np.concatenate([_NONE, *kinds])
            if len(kind) and not 0 <= kind.min() <= kind.max() < len(MEMBER_TYPES):
                raise ValueError("a member has an unknown type")
            members = [pa.array(MEMBER_TYPES, pa.string()).take(pa.array(kind)), pa.array(np.concatenate([_NONE, *refs])), text(np.concatenate([_NONE, *roles]))]
            lists = _lists(None, pa.StructArray.from_arrays(members, fields=list(MEMBER)), list(map(len, refs)))
            yield batch("relation", len(relations), id=pa.array([m[1][0] for m in relations]), members=lists, **plain(relations))


# Tables -----------------------------------------------------------------------


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): what stands between the separators of all files at ``path``, and where its split begins."""
    read = spark.read.option("lineSep", SEPARATOR).text(path)
    return read.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Elements (SCHEMA) of all block files at ``path``, in their files' order within a partition.

    A way has the coordinates that stand in the file itself, where it has some. A file that isn't understood ends the job.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kind, blob in blobs(batches):
            if kind == "OSMHeader":
                check_header(blob, strict)
            elif kind == "OSMData":  # other kinds are left out, as the format says
                yield from block_batches(blob)

    return pieces(spark, path).mapInArrow(decode, SCHEMA)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADER_SCHEMA of all block files at ``path``: a row for each header."""
    types = pa.schema([("path", pa.string()), ("required", pa.list_(pa.string())), ("optional", pa.list_(pa.string())), ("replication_timestamp", pa.timestamp("us", "UTC")), ("replication_sequence", pa.int64()), ("replication_url", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kind, blob in blobs(batches):
            if kind == "OSMHeader":
                yield pa.RecordBatch.from_pylist([{"path": name, **header(blob)}], schema=types)

    return pieces(spark, path).mapInArrow(decode, HEADER_SCHEMA)


def has_locations(refs: Column | str = "refs", lats: Column | str = "lats7", lons: Column | str = "lons7") -> Column:
    """Whether a way has a valid coordinate for each of its nodes."""
    fine = lambda c, most: F.forall(c, lambda x: x.between(-most, most))
    return F.coalesce((F.size(refs) > 0) & (F.size(refs) == F.size(lats)) & (F.size(refs) == F.size(lons)) & fine(lats, 900_000_000) & fine(lons, 1_800_000_000), F.lit(False))
