"""Files on any storage: local paths, `file://`, and what pyarrow reads by scheme (s3, gs, hdfs, abfss).

Works on the driver and in tasks alike, without a JVM. A scheme that pyarrow lacks is an error.
"""

from __future__ import annotations

import os

from pyarrow import fs as pafs

# Names that Hadoop has for schemes which pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def scheme(path: str) -> str:
    """The scheme of a path, empty for local ones (with or without `file:`)."""
    head, sep, _ = path.partition("://")
    return head if sep and head != "file" else ""


def plain(path: str) -> str:
    """A local path without `file:`, absolute; others as they are."""
    if scheme(path):
        return path
    return os.path.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


def uri(path: str) -> str:
    """A path as Spark's readers and writers are given it: local ones with `file://`, whatever the cluster's default storage is."""
    return path if scheme(path) else "file://" + plain(path)


def _open(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what has to be put before such paths to name them outside."""
    kind = scheme(path)
    if not kind:
        return pafs.LocalFileSystem(), plain(path), ""
    try:
        system, inner = pafs.FileSystem.from_uri(SCHEMES.get(kind, kind) + path[len(kind) :])
    except Exception as e:
        raise ValueError(f"cannot reach {path!r}: {e}") from e
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{kind}://"


def info(path: str) -> pafs.FileInfo:
    """Type, size and time of change."""
    system, inner, _ = _open(path)
    return system.get_file_info(inner)


def exists(path: str) -> bool:
    return info(path).type != pafs.FileType.NotFound


def is_dir(path: str) -> bool:
    return info(path).type == pafs.FileType.Directory


def files_under(path: str) -> list[str]:
    """All files below a folder, sorted by name."""
    system, inner, before = _open(path)
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(before + f.path for f in found if f.type == pafs.FileType.File)


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def make_dir(path: str) -> None:
    system, inner, _ = _open(path)
    system.create_dir(inner, recursive=True)


def read_bytes(path: str, offset: int = 0, length: int | None = None) -> bytes:
    system, inner, _ = _open(path)
    with system.open_input_file(inner) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def writer(path: str):
    """An output stream; the file appears as a whole when it is closed (object stores) or grows (others)."""
    system, inner, _ = _open(path)
    return system.open_output_stream(inner, compression=None)


def write_bytes(path: str, data: bytes) -> None:
    with writer(path) as f:
        f.write(data)
