"""Mesh and point files as tables, and the JMesh sink.

Readers take any path that Spark's binary reader opens and give one row a record:
(path, kind, seq, x, y, z, v, label) with kind node, tri, tet, seed or hole. Indices are
0-based in tables and 1-based in JMesh files. Indices out of range are errors.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, seq long, x double, y double, z double, v array<long>, label int, outer int"
#: The keys under which JMesh files hold each kind.
JMESH_NODES = ("MeshNode", "MeshVertex3", "MeshVertex")
JMESH_TETS = ("MeshElem", "MeshTet4", "MeshTet")
JMESH_TRIS = ("MeshTri", "MeshTri3", "MeshSurf", "MeshFace")

Record = tuple[str, tuple[float, float, float] | None, list[int] | None, int | None, int | None]


def _node(p) -> Record:
    return "node", (float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0), None, None, None


def parse_off(data: bytes) -> list[Record]:
    """Polygons are fanned from their first corner."""
    lines = [x.split("#")[0].split() for x in data.decode().splitlines()]
    tokens = [t for x in lines for t in x]
    if not tokens or not tokens[0].upper().endswith("OFF"):
        raise ValueError("not an OFF file")
    n, m = int(tokens[1]), int(tokens[2])
    at = 4
    out = [_node(tokens[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
    at += 3 * n
    rows = [x for x in lines if x]
    faces = rows[-m:] if m and len(rows) >= m else []
    for f in faces:
        k = int(f[0])
        corners = [int(x) for x in f[1 : 1 + k]]
        out.extend(("tri", None, [corners[0], corners[i], corners[i + 1]], None, None) for i in range(1, k - 1))
    return out


def parse_stl(data: bytes) -> list[Record]:
    """Text or binary, told apart by the size that a binary file must have; equal corners are welded."""
    n = struct.unpack("<I", data[80:84])[0] if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        raw = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)["v"].reshape(-1, 3)
        points = [tuple(map(float, p)) for p in raw]
    else:
        points = [tuple(map(float, x.split()[1:4])) for x in data.decode().splitlines() if x.strip().startswith("vertex")]
    ids: dict[tuple, int] = {}
    corners = [ids.setdefault(p, len(ids)) for p in points]
    return [_node(p) for p in ids] + [("tri", None, corners[i : i + 3], None, None) for i in range(0, len(corners), 3)]


def parse_xyz(data: bytes) -> list[Record]:
    """x y z and perhaps a label on each line, by commas or blanks; lines that are not numbers are skipped."""
    out = []
    for line in data.decode().splitlines():
        parts = line.replace(",", " ").split()
        try:
            values = [float(p) for p in parts]
        except ValueError:
            continue
        if len(values) >= 3:
            kind, at, *_ = _node(values)
            out.append((kind, at, None, int(values[3]) if len(values) > 3 else None, None))
    return out


def _rows(node) -> np.ndarray:
    if isinstance(node, dict):
        if "_ArrayType_" in node:
            from meshlake.sources.volumes import jdata_array

            return np.atleast_2d(jdata_array(node))
        return _rows(node.get("Data", node.get("_Data_", [])))
    return np.atleast_2d(np.array(node, float)) if len(node) else np.zeros((0, 4))


def parse_jmesh(data: bytes) -> list[Record]:
    """Text JMesh: nodes; elements of 4 corners and perhaps a label; triangles of 3 and perhaps one or two labels."""
    root = json.loads(data)
    out: list[Record] = []
    for key in JMESH_NODES:
        if key in root:
            out.extend(_node(p) for p in _rows(root[key]))
            break
    for key in JMESH_TETS:
        if key in root:
            out.extend(("tet", None, [int(x) - 1 for x in r[:4]], int(r[4]) if len(r) > 4 else 1, None) for r in _rows(root[key]))
            break
    for key in JMESH_TRIS:
        if key in root:
            out.extend(("tri", None, [int(x) - 1 for x in r[:3]], int(r[3]) if len(r) > 3 else None, int(r[4]) if len(r) > 4 else None) for r in _rows(root[key]))
            break
    return out


def parse_poly(data: bytes) -> list[Record]:
    """TetGen .poly or .smesh with its own nodes: convex facets are fanned; holes and region seeds are kept."""
    lines = [x for x in (line.split("#")[0].split() for line in data.decode().splitlines()) if x]
    at = 0

    def following() -> list[str]:
        nonlocal at
        at += 1
        return lines[at - 1]

    n = int(following()[0])
    nodes = [following() for _ in range(n)]
    base = int(nodes[0][0]) if nodes else 0
    out: list[Record] = [_node(p[1:4]) for p in nodes]
    for _ in range(int(following()[0])):
        head = following()
        polygons, holes = int(head[0]), int(head[1]) if len(head) > 1 else 0
        for _ in range(polygons):
            p = following()
            corners = [int(x) - base for x in p[1 : 1 + int(p[0])]]
            out.extend(("tri", None, [corners[0], corners[i], corners[i + 1]], None, None) for i in range(1, len(corners) - 1))
        if holes:
            raise ValueError("facets with holes are not supported")
    if at < len(lines):
        for _ in range(int(following()[0])):
            out.append(("hole", tuple(map(float, following()[1:4])), None, None, None))
    if at < len(lines):
        for _ in range(int(following()[0])):
            r = following()
            out.append(("seed", tuple(map(float, r[1:4])), None, int(float(r[4])) if len(r) > 4 else None, None))
    return out


PARSERS = {".off": parse_off, ".stl": parse_stl, ".xyz": parse_xyz, ".txt": parse_xyz, ".csv": parse_xyz, ".pts": parse_xyz, ".jmsh": parse_jmesh, ".json": parse_jmesh, ".poly": parse_poly, ".smesh": parse_poly}


def parse(path: str, data: bytes) -> list[Record]:
    """By the extension; an unknown one, or a corner that is no node, is an error."""
    parser = next((p for ext, p in PARSERS.items() if path.lower().endswith(ext)), None)
    if parser is None:
        raise ValueError(f"unknown kind of mesh: {path}")
    records = parser(data)
    n = sum(r[0] == "node" for r in records)
    if any(not 0 <= i < n for r in records if r[2] for i in r[2]):
        raise ValueError(f"{path}: a corner is out of range")
    return records


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                seq: dict[str, int] = {}
                rows = []
                for kind, at, v, label, outer in parse(name, content):
                    k = seq[kind] = seq.get(kind, -1) + 1
                    x, y, z = at or (None, None, None)
                    rows.append((name, kind, k, x, y, z, v, label, outer))
                out = pd.DataFrame(rows, columns=["path", "kind", "seq", "x", "y", "z", "v", "label", "outer"])
                yield out.astype({"label": "Int32", "outer": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, SCHEMA)


def nodes_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'node'").select(F.col("seq").alias("nid"), "x", "y", "z", "label")


def tris_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'tri'").select(F.col("seq").alias("fid"), *[F.col("v")[k].alias(f"v{k}") for k in range(3)], F.coalesce("label", F.lit(1)).alias("inner"), F.coalesce("outer", F.lit(0)).alias("outer"))


def tets_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'tet'").select(F.col("seq").alias("tid"), *[F.col("v")[k].alias(f"v{k}") for k in range(4)], "label")


def jmesh_text(nodes: DataFrame, tets: DataFrame, faces: DataFrame) -> DataFrame:
    """The lines of a JMesh text file, in order by line: a mesh of any size, one record a line, 1-based.

    Write them with one task (coalesce(1) after the sort) where a single file is wanted;
    Parquet is the sink for large meshes.
    """
    numbers = lambda *c: F.concat(F.lit("["), F.concat_ws(",", *c), F.lit("]"))
    one = lambda c: (F.col(c) + 1).cast("string")
    part = [
        nodes.select(F.lit(1).alias("part"), F.col("nid").alias("at"), numbers(*[F.col(a).cast("string") for a in "xyz"]).alias("row")),
        tets.select(F.lit(2).alias("part"), F.col("tid").alias("at"), numbers(*[one(f"v{k}") for k in range(4)], F.col("label").cast("string")).alias("row")),
        faces.select(F.lit(3).alias("part"), F.xxhash64("v0", "v1", "v2").alias("at"), numbers(*[one(f"v{k}") for k in range(3)], F.col("inner").cast("string"), F.col("outer").cast("string")).alias("row")),
    ]
    keys = {1: "MeshNode", 2: "MeshElem", 3: "MeshFace"}
    rows = part[0].unionByName(part[1]).unionByName(part[2])
    first = rows.groupBy("part").agg(F.min("at").alias("first"))
    rows = rows.join(F.broadcast(first), "part")
    key = F.element_at(F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.lit(v))]), F.col("part"))
    opening = F.when(F.col("at") == F.col("first"), F.concat(F.when(F.col("part") == 1, F.lit("{")).otherwise(F.lit("],")), F.lit('"'), key, F.lit('":['))).otherwise(F.lit(","))
    lines = rows.select("part", "at", F.concat(opening, F.col("row")).alias("value"))
    spark = nodes.sparkSession
    end = spark.range(1).select(F.lit(9).alias("part"), F.col("id").alias("at"), F.lit("]}").alias("value"))
    return lines.unionByName(end).orderBy("part", "at").select("value")
