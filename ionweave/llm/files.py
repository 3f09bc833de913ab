"""Files that tasks write and read beside Spark's own formats, on any file system that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute local path."""
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def local_path(uri: str) -> str | None:
    """The path if it is a local one that can be mapped into memory."""
    system, path = opened(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None
