import base64
import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from meshlake.sources import meshes, volumes


def test_nifti_is_turned_to_ras(spark, tmp_path):
    values = np.arange(24, dtype=float).reshape(2, 3, 4)
    affine = np.array([[-2.0, 0, 0, 5], [0, 0, 1.5, 0], [0, 1.0, 0, 0], [0, 0, 0, 1]])
    (tmp_path / "a.nii.gz").write_bytes(gzip.compress(volumes.nifti_bytes(values, affine)))
    rows = volumes.read_volume(spark, str(tmp_path / "a.nii.gz")).collect()
    grid = volumes.read_grid(spark, str(tmp_path / "a.nii.gz")).first()
    assert (grid.nx, grid.ny, grid.nz) == (2, 4, 3)
    turned = np.array(grid.affine).reshape(4, 4)
    assert np.allclose(np.diag(turned)[:3], [2, 1.5, 1])
    for r in rows:
        world = turned @ [r.x, r.y, r.z, 1]
        i, j, k, _ = np.rint(np.linalg.inv(affine) @ world).astype(int)
        assert r.value == values[i, j, k]
    assert [r.vid for r in rows] == list(range(24))


@pytest.mark.parametrize("packed", [False, True])
def test_jnifti(spark, tmp_path, packed):
    values = np.arange(12, dtype="<u2").reshape(2, 3, 2)
    data = {"_ArrayType_": "uint16", "_ArraySize_": [2, 3, 2]}
    if packed:
        data |= {"_ArrayZipType_": "zlib", "_ArrayZipData_": base64.b64encode(zlib.compress(values.tobytes())).decode()}
    else:
        data["_ArrayData_"] = values.ravel().tolist()
    (tmp_path / "a.jnii").write_text(json.dumps({"NIFTIHeader": {"Dim": [2, 3, 2], "VoxelSize": [1, 1, 1.5]}, "NIFTIData": data}))
    rows = volumes.read_volume(spark, str(tmp_path / "a.jnii")).collect()
    assert all(r.value == values[r.x, r.y, r.z] for r in rows) and len(rows) == 12


def test_affine_fallbacks():
    zero = {"VoxelSize": [1, 1, 1.5], "Affine": [[0] * 4] * 3, "Orientation": {"x": "r", "y": "a", "z": "s"}}
    assert np.allclose(np.diag(volumes.jnifti_affine(zero))[:3], [1, 1, 1.5])
    turned = volumes.to_ras(np.zeros((2, 3, 4)), volumes.jnifti_affine({"VoxelSize": [1, 1, 1.5], "Orientation": {"x": "p", "y": "s", "z": "l"}}))
    assert np.allclose(np.linalg.norm(turned[1][:3, :3], axis=0), [1.5, 1, 1]) and turned[0].shape == (4, 2, 3)


def test_probabilities(spark, tmp_path):
    values = np.random.default_rng(1).random((2, 2, 2, 3))
    (tmp_path / "p.nii").write_bytes(volumes.nifti_bytes(values, np.eye(4)))
    rows = volumes.read_probabilities(spark, str(tmp_path / "p.nii")).collect()
    assert len(rows) == 8 and all(np.allclose(r.p, values[r.x, r.y, r.z]) for r in rows)
    with pytest.raises(Exception, match="dimensions"):
        volumes.read_volume(spark, str(tmp_path / "p.nii")).collect()


def test_labels_are_rounded_and_clamped(spark):
    df = spark.createDataFrame([(-3.0,), (0.5,), (2.49,), (70000.0,)], "v double")
    assert [r[0] for r in df.select(volumes.as_label(df.v)).collect()] == [0, 1, 2, 65534]


OFF = b"OFF\n# corners\n4 1 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
POLY = b"8 3 0 0\n" + b"".join(b"%d %d %d %d\n" % (n, n & 1, n >> 1 & 1, n >> 2) for n in range(8)) + b"1\n1 0\n4 0 1 3 2\n1\n1 0.5 0.5 0.5\n1\n1 0.1 0.1 0.1 7 -1\n"


def test_mesh_files(spark, tmp_path):
    (tmp_path / "a.off").write_bytes(OFF)
    (tmp_path / "b.xyz").write_text("x,y,z\n1 2 3 4\n5,6,7\n")
    tri = np.zeros(1, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    tri["v"] = [[[0, 0, 0], [1, 0, 0], [0, 1, 0]]]
    (tmp_path / "c.stl").write_bytes(b"solid".ljust(80) + struct.pack("<I", 1) + tri.tobytes())
    (tmp_path / "d.stl").write_text("solid\n" + "vertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\n" * 2 + "endsolid\n")
    (tmp_path / "e.poly").write_bytes(POLY)
    (tmp_path / "f.jmsh").write_text(json.dumps({"MeshVertex3": [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], "MeshTet4": [[1, 2, 3, 4, 5]], "MeshFace": [[1, 2, 3, 5, 0]]}))
    count = {(r.path[-5:], r.kind): r["count"] for r in meshes.read_mesh(spark, str(tmp_path)).groupBy("path", "kind").count().collect()}
    assert count == {("a.off", "node"): 4, ("a.off", "tri"): 2, ("b.xyz", "node"): 2, ("c.stl", "node"): 3, ("c.stl", "tri"): 1, ("d.stl", "node"): 3, ("d.stl", "tri"): 2, (".poly"[-5:], "node"): 8, (".poly", "tri"): 2, (".poly", "hole"): 1, (".poly", "seed"): 1, (".jmsh", "node"): 4, (".jmsh", "tet"): 1, (".jmsh", "tri"): 1}


def test_mesh_errors():
    with pytest.raises(ValueError, match="out of range"):
        meshes.parse("a.off", OFF.replace(b"4 0 1 2 3", b"3 0 1 9"))
    with pytest.raises(ValueError, match="unknown"):
        meshes.parse("a.vtk", b"")


def test_jmesh_round_trip(spark, tmp_path):
    (tmp_path / "a.jmsh").write_text(json.dumps({"MeshNode": [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], "MeshElem": [[1, 2, 3, 4, 5]], "MeshFace": [[1, 2, 3, 5, 0]]}))
    records = meshes.read_mesh(spark, str(tmp_path / "a.jmsh"))
    lines = meshes.jmesh_text(meshes.nodes_of(records), meshes.tets_of(records), meshes.tris_of(records)).collect()
    assert meshes.parse("b.jmsh", "".join(r.value for r in lines).encode()) == meshes.parse("a.jmsh", (tmp_path / "a.jmsh").read_bytes())
