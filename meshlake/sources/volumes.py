"""Volume files as tables: NIfTI-1 and text JNIfTI, turned to RAS.

Files are read by Spark's own binary reader, so any store that it opens will do; each file
is decoded by one task into batches of voxels.
"""

from __future__ import annotations

import base64
import gzip
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: NIfTI-1 data type codes, and element names of JData arrays.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
JDATA_TYPES = {"uint8": "u1", "int8": "i1", "uint16": "u2", "int16": "i2", "uint32": "u4", "int32": "i4", "uint64": "u8", "int64": "i8", "single": "f4", "double": "f8", "logical": "u1"}
VOXELS_A_BATCH = 1 << 17
LABEL_MOST = 65534


def quaternion_affine(b: float, c: float, d: float, offset, size, handed: float) -> np.ndarray:
    """The affine of a rotation given by the last three parts of a unit quaternion."""
    a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    out = np.eye(4)
    out[:3, :3] = r * np.array([size[0], size[1], size[2] * (-1.0 if handed < 0 else 1.0)])
    out[:3, 3] = offset
    return out


def decode_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values indexed x, y, z[, channel], affine) of a NIfTI-1 file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    read = lambda kind, at: struct.unpack_from(order + kind, data, at)
    dim = read("8h", 40)
    shape = [max(1, n) for n in dim[1 : 1 + dim[0]]]
    code, pixdim = read("h", 70)[0], read("8f", 76)
    if code not in NIFTI_TYPES:
        raise ValueError(f"data type {code} is not supported")
    offset, slope, inter = int(read("f", 108)[0]), *read("2f", 112)
    qform, sform = read("2h", 252)
    if sform > 0:
        affine = np.vstack([np.array(read("12f", 280)).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        affine = quaternion_affine(*read("3f", 256), read("3f", 268), pixdim[1:4], pixdim[0])
    else:
        affine = np.diag([*pixdim[1:4], 1.0])
    values = np.frombuffer(data, order + NIFTI_TYPES[code], int(np.prod(shape)), offset).reshape(shape, order="F").astype(np.float64)
    if slope not in (0.0, 1.0) or (inter != 0.0 and slope != 0.0):
        values = values * slope + inter
    return values.reshape(values.shape + (1,) * (3 - values.ndim)), affine


def jdata_array(node: dict) -> np.ndarray:
    """An annotated array: type, size and values, or zlib data in base 64."""
    kind = np.dtype("<" + JDATA_TYPES[node["_ArrayType_"]])
    size = np.atleast_1d(node["_ArraySize_"]).tolist()
    if "_ArrayZipData_" in node:
        if node.get("_ArrayZipType_", "zlib") not in ("zlib", "gzip"):
            raise ValueError("only zlib and gzip arrays are supported")
        raw = base64.b64decode(node["_ArrayZipData_"])
        values = np.frombuffer(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else zlib.decompress(raw), kind)
    else:
        values = np.array(node["_ArrayData_"], kind).ravel()
    return values.reshape(size, order="F" if node.get("_ArrayOrder_", "r") in ("c", "col", "F") else "C")


def jnifti_affine(header: dict) -> np.ndarray:
    """Affine, else quaternion, else orientation letters with voxel size, else voxel size."""
    size = (list(header.get("VoxelSize", [1, 1, 1])) + [1, 1, 1])[:3]
    given = np.array(header.get("Affine", []), float)
    if given.size >= 12 and np.any(given.ravel()[:12]):
        return np.vstack([given.reshape(-1, 4)[:3], [0, 0, 0, 1]])
    if header.get("QForm") and header.get("Quatern"):
        q = header["Quatern"]
        offset = header.get("QuaternOffset", {"x": 0, "y": 0, "z": 0})
        return quaternion_affine(q["b"], q["c"], q["d"], [offset[k] for k in "xyz"], size, 1.0)
    out = np.diag([*size, 1.0]).astype(float)
    letters = [str(header.get("Orientation", {}).get(a, "")).lower() for a in "xyz"]
    places = {"r": (0, 1), "l": (0, -1), "a": (1, 1), "p": (1, -1), "s": (2, 1), "i": (2, -1)}
    if all(x in places for x in letters):
        out[:3, :3] = 0
        for column, letter in enumerate(letters):
            row, sign = places[letter]
            out[row, column] = sign * size[column]
    return out


def decode_jnifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    root = json.loads(data)
    values = root["NIFTIData"]
    array = jdata_array(values) if isinstance(values, dict) and "_ArrayType_" in values else np.array(values)
    return array.astype(np.float64), jnifti_affine(root.get("NIFTIHeader", {}))


def to_ras(values: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes permuted and flipped so that they run right, anterior and superior."""
    column = affine[:3, :3] / np.maximum(np.linalg.norm(affine[:3, :3], axis=0), 1e-30)
    best, order = None, None
    for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        score = sum(abs(column[r, c]) for r, c in enumerate(p))
        if best is None or score > best + 1e-12:
            best, order = score, p
    values = values.transpose(*order, *range(3, values.ndim))
    turned = affine.copy()
    turned[:, :3] = affine[:, list(order)]
    for axis in range(3):
        if turned[axis, axis] < 0:
            values = np.flip(values, axis)
            turned[:3, 3] += turned[:3, axis] * (values.shape[axis] - 1)
            turned[:3, axis] *= -1
    return values, turned


def _decoded(path: str, content: bytes) -> tuple[np.ndarray, np.ndarray]:
    if path.endswith((".jnii", ".json")):
        return to_ras(*decode_jnifti(content))
    if path.endswith((".nii", ".nii.gz")):
        return to_ras(*decode_nifti(content))
    raise ValueError(f"unknown kind of volume: {path}")


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """(path, vid, x, y, z, value) of the 3-D volumes at a path, in RAS order, zeros included."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                values, _ = _decoded(name, content)
                if values.ndim != 3:
                    raise ValueError(f"{name} has {values.ndim} dimensions; read_probabilities takes four")
                nx, ny, _ = values.shape
                flat = values.ravel(order="F")
                for k in range(0, len(flat), VOXELS_A_BATCH):
                    vid = np.arange(k, min(k + VOXELS_A_BATCH, len(flat)))
                    yield pd.DataFrame({"path": name, "vid": vid, "x": (vid % nx).astype(np.int32), "y": (vid // nx % ny).astype(np.int32), "z": (vid // (nx * ny)).astype(np.int32), "value": flat[vid]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "path string, vid long, x int, y int, z int, value double")


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(path, vid, x, y, z, p array<double>) of 4-D volumes, one entry a channel."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                values, _ = _decoded(name, content)
                if values.ndim != 4:
                    raise ValueError(f"{name} has {values.ndim} dimensions")
                nx, ny, nz, n = values.shape
                flat = values.reshape(nx * ny * nz, n, order="F")
                for k in range(0, len(flat), VOXELS_A_BATCH // n + 1):
                    vid = np.arange(k, min(k + VOXELS_A_BATCH // n + 1, len(flat)))
                    yield pd.DataFrame({"path": name, "vid": vid, "x": (vid % nx).astype(np.int32), "y": (vid // nx % ny).astype(np.int32), "z": (vid // (nx * ny)).astype(np.int32), "p": list(flat[vid])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "path string, vid long, x int, y int, z int, p array<double>")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, nx, ny, nz, affine): one row a file."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                values, affine = _decoded(name, content)
                yield pd.DataFrame({"path": [name], "nx": [values.shape[0]], "ny": [values.shape[1]], "nz": [values.shape[2]], "affine": [affine.ravel()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, "path string, nx int, ny int, nz int, affine array<double>")


def as_label(value: Column) -> Column:
    """Rounded half away from zero and clamped to the range of labels."""
    half_away = F.when(value < 0, F.ceil(value - 0.5)).otherwise(F.floor(value + 0.5))
    return F.least(F.greatest(half_away, F.lit(0)), F.lit(LABEL_MOST)).cast("int")


def nifti_bytes(values: np.ndarray, affine: np.ndarray) -> bytes:
    """A NIfTI-1 file of doubles: what the volume sink writes."""
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", header, 70, 64, 64)
    size = np.linalg.norm(affine[:3, :3], axis=0)
    struct.pack_into("<8f", header, 76, 1.0, *size, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", header, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", header, 252, 0, 1)
    struct.pack_into("<12f", header, 280, *affine[:3].ravel())
    header[344:348] = b"n+1\0"
    return bytes(header) + values.astype("<f8").tobytes(order="F")
