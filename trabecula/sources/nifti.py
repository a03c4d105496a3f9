"""NIfTI-1 volumes as Spark tables: the format's header and voxels read with struct, gzip and numpy, no imaging library.

Files are listed and read by Spark's binaryFile source, so that any store Spark can read will do; each file is decoded where its
bytes are. Axes are the file's own: i, j, k are array axes 0, 1, 2. Zeros are not stored.
"""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: numpy types by datatype code, names of spatial units by code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
UNITS = {0: "unknown", 1: "meter", 2: "mm", 3: "micron"}
HEADER, OFFSET = 348, 352

VOLUMES = "volume_id string, path string, ni int, nj int, nk int, si double, sj double, sk double, spatial_unit string, affine array<double>, datatype int, integral boolean"


@dataclass
class Nifti:
    data: np.ndarray
    spacing: tuple[float, float, float]
    unit: str
    affine: np.ndarray
    datatype: int


def _affine(raw: bytes, e: str, pixdim: tuple[float, ...], shape) -> np.ndarray:
    qform, sform = struct.unpack_from(e + "2h", raw, 252)
    out = np.eye(4)
    if sform > 0:
        out[:3] = np.array(struct.unpack_from(e + "12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack_from(e + "6f", raw, 256)
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        out[:3, :3] = turn * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
        out[:3, 3] = x, y, z
    else:
        out[:3, :3] = np.diag(pixdim[1:4])
        out[:3, 3] = -(np.array(shape) - 1) / 2 * np.array(pixdim[1:4])
    return out


def decode(raw: bytes) -> Nifti:
    """The first three-dimensional frame of a .nii or .nii.gz file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < HEADER:
        raise ValueError("not a NIfTI-1 file: too short")
    e = "<" if struct.unpack_from("<i", raw)[0] == HEADER else ">"
    if struct.unpack_from(e + "i", raw)[0] != HEADER or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(e + "8h", raw, 40)
    if dim[0] < 3 or dim[0] > 4:
        raise ValueError(f"expected a volume of three dimensions, or four of which the first frame counts, got {dim[0]}")
    datatype = struct.unpack_from(e + "h", raw, 70)[0]
    if datatype not in TYPES:
        raise ValueError(f"datatype {datatype} is not supported")
    pixdim = struct.unpack_from(e + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(e + "3f", raw, 108)
    shape = tuple(int(x) for x in dim[1:4])
    data = np.frombuffer(raw, np.dtype(TYPES[datatype]).newbyteorder(e), int(np.prod(shape)), int(offset) or OFFSET).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or slope and inter:
        data = data * np.float64(slope) + inter
    unit = UNITS.get(raw[123] & 7, "unknown")
    return Nifti(data, tuple(float(abs(x)) for x in pixdim[1:4]), unit, _affine(raw, e, pixdim, shape), datatype)


def encode(data: np.ndarray, affine: np.ndarray, spacing=(1.0, 1.0, 1.0), unit: str = "unknown", compressed: bool = True) -> bytes:
    code = next(c for c, t in TYPES.items() if np.dtype(t) == data.dtype)
    head = bytearray(OFFSET)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, float(OFFSET), 1.0, 0.0)
    head[123] = next((c for c, u in UNITS.items() if u == unit), 0)
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float).reshape(4, 4)[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.astype(data.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(raw, mtime=0) if compressed else raw


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the store names it, which is how paths of files begin."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{nii,nii.gz}")
    return reader.load(path)


def read_volumes(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row for each file under the path: its name as volume_id, shape, spacing, unit and affine."""

    def run(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                n = decode(raw)
                rows.append({"volume_id": p, "path": p, **dict(zip(("ni", "nj", "nk"), n.data.shape)), **dict(zip(("si", "sj", "sk"), n.spacing)), "spatial_unit": n.unit, "affine": n.affine.ravel().tolist(), "datatype": n.datatype, "integral": bool(np.issubdtype(n.data.dtype, np.integer))})
            kinds = [("volume_id", pa.string()), ("path", pa.string()), *((c, pa.int32()) for c in ("ni", "nj", "nk")), *((c, pa.float64()) for c in ("si", "sj", "sk")), ("spatial_unit", pa.string()), ("affine", pa.list_(pa.float64())), ("datatype", pa.int32()), ("integral", pa.bool_())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return _files(spark, path, recursive).select("path", "content").mapInArrow(run, VOLUMES)


def read_voxels(spark: SparkSession, path: str, normalize: bool = True, recursive: bool = True) -> DataFrame:
    """volume_id, i, j, k, value of the voxels that aren't zero. normalize: integers of zeros and ones stay, other values beyond
    0..1 are stretched from least to most (a constant volume becomes zeros), the rest is clipped; otherwise as stored."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                x = decode(raw).data.astype(np.float32)
                if normalize and x.size:
                    low, high = float(x.min()), float(x.max())
                    if low < 0 or high > 1:
                        x = (x - np.float32(low)) / np.float32(high - low) if high > low else np.zeros_like(x)
                    x = np.clip(x, 0, 1)
                at = np.argwhere(x)
                for s in range(0, len(at), 1 << 20):
                    part = at[s : s + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), pa.string()), *(pa.array(part[:, a].astype(np.int32)) for a in range(3)), pa.array(x[tuple(part.T)], pa.float32())], ["volume_id", "i", "j", "k", "value"])

    return _files(spark, path, recursive).select("path", "content").mapInArrow(run, "volume_id string, i int, j int, k int, value float")
