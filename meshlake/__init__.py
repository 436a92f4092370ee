"""Mesh and voxel analytics as DataFrame operators on PySpark."""

__version__ = "0.1.0"
