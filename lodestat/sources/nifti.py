"""NIfTI-1 volumes as (path, x, y, z, t, value) rows, masks by semi-join, and volumes back from rows."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NIfTI-1 data type codes.  Fixed values.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse(raw: bytes) -> np.ndarray:
    """The scaled data array, four-dimensional, of a single-file volume."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{end}8h", raw[40:56])
    kind, offset = struct.unpack(f"{end}h", raw[70:72])[0], int(struct.unpack(f"{end}f", raw[108:112])[0])
    slope, inter = struct.unpack(f"{end}2f", raw[112:120])
    shape = [max(1, d) for d in dims[1:5]]
    data = np.frombuffer(raw, dtype=np.dtype(KINDS[kind]).newbyteorder(end), count=int(np.prod(shape)), offset=offset).reshape(shape, order="F")
    return data * slope + inter if slope not in (0.0,) and np.isfinite(slope) else data.astype(float)


def volume(data: np.ndarray) -> bytes:
    """A single-file float64 volume."""
    data = data.reshape(data.shape + (1,) * (4 - data.ndim))
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, *data.shape, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<2f", head, 112, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asfortranarray(data, dtype="<f8").tobytes(order="F")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, t, value) of all volumes under a path, one file a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data = parse(bytes(raw))
                for t in range(data.shape[3]):
                    x, y, z = np.indices(data.shape[:3]).reshape(3, -1)
                    yield pd.DataFrame({"path": name, "x": x.astype("int32"), "y": y.astype("int32"), "z": z.astype("int32"), "t": np.int32(t), "value": data[..., t].astype(float).ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x int, y int, z int, t int, value double")


def header(spark: SparkSession, path: str) -> bytes:
    """The first 352 bytes of a volume: geometry, affine and history."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"head": [(gzip.decompress(bytes(c)) if bytes(c[:2]) == b"\x1f\x8b" else bytes(c))[:352] for c in pdf["content"]]})

    return bytes(raw.mapInPandas(run, "head binary").first().head)


def like(head: bytes, data: np.ndarray) -> bytes:
    """A float64 volume with the geometry of another's header and the extent of ``data``; scaling and extensions are not taken over."""
    end = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
    out = bytearray(head[:352])
    data = data.reshape(data.shape + (1,) * (4 - data.ndim))
    struct.pack_into(f"{end}8h", out, 40, 3 if data.shape[3] == 1 else 4, *data.shape, 1, 1, 1)
    struct.pack_into(f"{end}2h", out, 70, 64, 64)
    struct.pack_into(f"{end}f", out, 108, 352.0)
    struct.pack_into(f"{end}2f", out, 112, 1.0, 0.0)
    out[344:352] = b"n+1\0\0\0\0\0"
    return bytes(out) + np.asfortranarray(data, dtype=f"{end}f8").tobytes(order="F")


def volume_content(values: DataFrame, head: bytes) -> DataFrame:
    """(content): the volume of rows (x, y, z, value) in the geometry of ``head``, made in a task; voxels without a row are 0."""
    end = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
    shape = tuple(max(1, d) for d in struct.unpack(f"{end}8h", head[40:56])[1:4])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.zeros(shape)
        for pdf in batches:
            data[pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["z"].to_numpy()] = pdf["value"].fillna(0.0).to_numpy()
        yield pd.DataFrame({"content": [like(head, data)]})

    return values.select("x", "y", "z", "value").coalesce(1).mapInPandas(run, "content binary")  # one volume is one file


def write_volume(values: DataFrame, head: bytes, path: str) -> None:
    """The rows (x, y, z, value) as a volume at ``path``, on any file system that Spark reaches."""
    spark = values.sparkSession
    content = bytes(volume_content(values.repartition(1), head).first().content)  # the file itself
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def masked(volumes: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels where the mask is not zero."""
    return volumes.join(mask.filter("value <> 0").select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi")
