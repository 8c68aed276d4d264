"""TFRecord files of examples: framing with masked CRC-32C, and the protocol-buffer wire format."""

from __future__ import annotations

import gzip
import io
import struct
import uuid
from collections.abc import Iterator
from string import Formatter
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.operators.rank import ranked


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


TABLE = _table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ TABLE[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


#: Fewer records of one length than this are summed one by one.
TOGETHER = 16
CRC_TABLE = np.array(TABLE, np.uint32)
#: Records that are read, checked and decoded together.
TOGETHER_READ = 4096


def crc32c_many(data: list[bytes]) -> np.ndarray:
    """The checksums of many records: those of one length are columns of a matrix, a byte of all of them at a time."""
    out = np.empty(len(data), np.uint32)
    length = np.array([len(x) for x in data], np.int64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        if len(at) < TOGETHER:
            out[at] = [crc32c(data[k]) for k in at]
            continue
        m = np.frombuffer(b"".join(data[k] for k in at), np.uint8).reshape(len(at), n).T.copy()
        c = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for row in m:
            c = c >> np.uint32(8) ^ CRC_TABLE[(c ^ row) & np.uint32(255)]
        out[at] = c ^ np.uint32(0xFFFFFFFF)
    return out


def masked_many(data: list[bytes]) -> np.ndarray:
    c = crc32c_many(data)
    return (c >> np.uint32(15) | c << np.uint32(17)) + np.uint32(0xA282EAD8)


def frames(data: list[bytes]) -> bytes:
    """Records with their lengths and checksums, one after another."""
    heads = [struct.pack("<Q", len(x)) for x in data]
    sums = zip(masked_many(heads).tolist(), masked_many(data).tolist(), strict=True)
    return b"".join(h + struct.pack("<I", a) + x + struct.pack("<I", b) for h, x, (a, b) in zip(heads, data, sums, strict=True))


def batches_of(f: BinaryIO, many: int = 1024, large: int = 64 << 20) -> Iterator[list[bytes]]:
    """The records of an open file, checked, so many or so large at a time."""
    heads, lengths, data, sums, held = [], [], [], [], 0

    def checked() -> list[bytes]:
        if (masked_many(heads) != np.array(lengths, np.uint32)).any() or (masked_many(data) != np.array(sums, np.uint32)).any():
            raise ValueError("a record is damaged")
        return list(data)

    while head := f.read(12):
        if len(head) < 12:
            raise ValueError("the file ends within a record")
        n, crc = struct.unpack("<QI", head)
        if n > 1 << 20 and int(masked_many([head[:8]])[0]) != crc:
            raise ValueError("a record is damaged")  # before so much is read
        body = f.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("the file ends within a record")
        for to, x in ((heads, head[:8]), (lengths, crc), (data, body[:n]), (sums, struct.unpack("<I", body[n:])[0])):
            to.append(x)
        held += n
        if len(data) >= many or held >= large:
            yield checked()
            heads, lengths, data, sums, held = [], [], [], [], 0
    if data:
        yield checked()


def records(raw: bytes) -> Iterator[bytes]:
    for found in batches_of(io.BytesIO(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)):
        yield from found


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            yield key >> 3, number()


def encode_example(values: dict[str, np.ndarray]) -> bytes:
    """Each array as <name>/value (bytes), /dtype, /ndim and /shape/<i>."""
    out = {}
    for name, a in values.items():
        whole = lambda n: field(3, field(1, varint(int(n))))
        out[f"{name}/value"] = field(1, field(1, np.ascontiguousarray(a).tobytes()))
        out[f"{name}/dtype"] = field(1, field(1, a.dtype.name.encode()))
        out[f"{name}/ndim"] = whole(a.ndim)
        for i, n in enumerate(a.shape):
            out[f"{name}/shape/{i}"] = whole(n)
    return field(1, b"".join(field(1, field(1, k.encode()) + field(2, v)) for k, v in out.items()))


def encode_examples(values: dict[str, np.ndarray]) -> list[bytes]:
    """encode_example of each row of arrays (n, ..) of one shape: all but the values is written once."""
    n = len(next(iter(values.values())))
    if not n:
        return []
    first = encode_example({k: a[0] for k, a in values.items()})
    m = np.tile(np.frombuffer(first, np.uint8), (n, 1))
    for name, at, size in value_places(first):
        if size:
            m[:, at : at + size] = np.ascontiguousarray(values[name]).reshape(n, -1).view(np.uint8).reshape(n, size)
    return [r.tobytes() for r in m]


def encode_rows(feature: list[np.ndarray], label: list[np.ndarray], feature_dtype: str, label_dtype: str) -> list[bytes]:
    """Examples of many rows, those of one shape together."""
    feature, label = ([np.asarray(v).astype(kind) for v in values] for values, kind in ((feature, feature_dtype), (label, label_dtype)))
    shapes: dict[tuple, list[int]] = {}
    for k, (x, y) in enumerate(zip(feature, label, strict=True)):
        shapes.setdefault((x.shape, y.shape), []).append(k)
    out = [b""] * len(feature)
    for at in shapes.values():
        for k, data in zip(at, encode_examples({"feature": np.stack([feature[k] for k in at]), "label": np.stack([label[k] for k in at])}), strict=True):
            out[k] = data
    return out


def value_places(record: bytes) -> list[tuple[str, int, int]]:
    """name, offset and size of the bytes of each <name>/value in a record."""
    out = []
    for _, at, size in places(record, 0, len(record)):
        for _, a, n in places(record, at, at + size):
            parts = {p[0]: p for p in places(record, a, a + n)}
            key, value = parts[1], parts[2]
            name = record[key[1] : key[1] + key[2]].decode()
            if name.endswith("/value"):
                for _ in range(2):
                    value = next(places(record, value[1], value[1] + value[2]))
                out.append((name[: -len("/value")], *value[1:]))
    return out


def places(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """number, offset and size of the fields with a length between at and end; others are passed over."""

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < end:
        key = number()
        if key & 7 == 2:
            n = number()
            yield key >> 3, at, n
            at += n
        else:
            number()


def decode_example(data: bytes) -> dict[str, bytes | int]:
    out: dict[str, bytes | int] = {}
    for _, features in fields(data):
        for _, entry in fields(features):
            parts = dict(fields(entry))
            kind, value = next(iter(fields(parts[2])))
            inner = next(iter(fields(value)))[1]
            out[parts[1].decode()] = next(iter(fields(inner if isinstance(inner, bytes) and kind != 1 else value)))[1] if kind == 1 else (inner if isinstance(inner, int) else _varint(inner))
    return out


def _varint(data: bytes) -> int:
    n = 0
    for k, b in enumerate(data):
        n |= (b & 127) << 7 * k
    return n


def opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def template_keys(template: str) -> list[str]:
    return [k for _, k, _, _ in Formatter().parse(template) if k]


def write_tfrecords(df: DataFrame, template: str, order: str, feature: Column | str, label: Column | str, feature_dtype: str = "float32", label_dtype: str = "float32", chunk: int = 10_000, first_shard: int = 0, compress: bool = True) -> DataFrame:
    """Write rows as examples, `chunk` a file; template has {shard}. Returns shard, path, n (run by an action).

    Files go to a store that all executors reach: a mounted folder, or a URI of a kind that pyarrow knows. A
    file appears whole under its name, so tasks can be run again. One shard's rows meet in a task; rows are
    numbered along `order`, which should tell them apart, first within ranges and then by the ranges before. feature and
    label as expressions are made where a shard is written, so that df's rows are dealt out as they are.
    """
    if "shard" not in template_keys(template):
        raise ValueError("the path needs {shard}")
    if isinstance(feature, str) and isinstance(label, str):
        df = df.select(order, feature, label)
    d = ranked(df, [order], "_row")
    d = d.withColumn("_shard", (F.floor(F.col("_row") / chunk) + first_shard).cast("int")).repartition("_shard")
    feature, label = (F.col(c) if isinstance(c, str) else c for c in (feature, label))

    def write(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_row")
        shard = int(p["_shard"].iloc[0])
        path = template.format(shard=shard)
        data = frames(encode_rows([np.asarray(x) if not len(x) or not isinstance(x[0], np.ndarray) else np.stack(x) for x in p["_feature"]], list(p["_label"]), feature_dtype, label_dtype))
        store, at = opened(path)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as f:
            f.write(gzip.compress(data, 6, mtime=0) if compress else data)
        store.move(part, at)
        return pd.DataFrame({"shard": [shard], "path": [path], "n": [len(p)]})

    return d.select("_row", "_shard", feature.alias("_feature"), label.alias("_label")).groupBy("_shard").applyInPandas(write, "shard int, path string, n long")


def example_row(record: bytes, feature_dtype: str, label_dtype: str) -> list:
    """feature, feature_shape, label, label_shape."""
    e = decode_example(record)
    row: list = []
    for name, kind in (("feature", feature_dtype), ("label", label_dtype)):
        row += [np.frombuffer(e[f"{name}/value"], kind).astype(float).tolist(), [e[f"{name}/shape/{i}"] for i in range(e[f"{name}/ndim"])]]
    return row


#: Fewer records that differ in nothing but values are decoded one by one.
ALIKE = 16
NAMES = ["feature", "feature_shape", "label", "label_shape"]


def example_columns(found: list[bytes], feature_dtype: str, label_dtype: str) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Places in found, and their columns NAMES: records that differ in nothing but values are decoded together."""
    length = np.array([len(x) for x in found], np.int64)
    for n in np.unique(length):
        left = np.flatnonzero(length == n)
        m = np.frombuffer(b"".join(found[k] for k in left), np.uint8).reshape(len(left), n)
        while len(left):
            first = found[left[0]]
            held, same = dict((name, (at, size)) for name, at, size in value_places(first)), np.ones(n, bool)
            for at, size in held.values():
                same[at : at + size] = False
            alike = (m[:, same] == m[0, same]).all(1)
            if len(left) >= ALIKE > alike.sum():  # of another writer, with values of their own beside these
                rows = list(zip(*(example_row(found[k], feature_dtype, label_dtype) for k in left), strict=True))
                yield left, [pa.array(c, pa.list_(kind)) for c, kind in zip(rows, (pa.float64(), pa.int64()) * 2, strict=True)]
                break
            columns: list[pa.Array] = []
            row = example_row(first, feature_dtype, label_dtype)
            for k, (name, kind) in enumerate((("feature", feature_dtype), ("label", label_dtype))):
                at, size = held[name]
                v = np.ascontiguousarray(m[alike, at : at + size]).view(kind).astype(float) if size else np.empty((int(alike.sum()), 0))
                for a in (v, np.tile(np.array(row[2 * k + 1], np.int64), (len(v), 1))):
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.int32()), pa.array(a.ravel())))
            yield left[alike], columns
            left, m = left[~alike], m[~alike]


def example_batches(path: str, f: BinaryIO, feature_dtype: str, label_dtype: str) -> Iterator[pa.RecordBatch]:
    """path, rec_no and the columns NAMES of an open file."""
    rec_no = 0
    for found in batches_of(f, TOGETHER_READ):
        for at, columns in example_columns(found, feature_dtype, label_dtype):
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(rec_no + at), *columns], ["path", "rec_no", *NAMES])
        rec_no += len(found)


def read_tfrecords(spark: SparkSession, path: str, feature_dtype: str = "float32", label_dtype: str = "float32", files: str | None = None) -> DataFrame:
    """path, rec_no, feature, label (flat arrays of double) and their shapes.

    files: a pattern of the names in the folder `path`, which is listed at once; files of a pattern in the path are looked up one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = raw.as_py()
                with gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw) as f:
                    yield from example_batches(path, f, feature_dtype, label_dtype)

    d = spark.read.format("binaryFile").options(**({"pathGlobFilter": files} if files else {})).load(path)
    return d.select("path", "content").mapInArrow(run, "path string, rec_no long, feature array<double>, feature_shape array<long>, label array<double>, label_shape array<long>")
