"""File access from tasks, on local disks, HDFS and object stores alike."""

from __future__ import annotations

import glob
import itertools
import os
import re
from collections.abc import Iterator

from pyarrow import fs

# The Hadoop names of an object store scheme that Arrow knows under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs"}


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a plain path or URI (``file:/x`` as Spark writes it included)."""
    match = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(/.*)$", path)
    if not match:
        return fs.LocalFileSystem(), os.path.realpath(os.path.expanduser(path))
    scheme, rest = match.groups()
    if scheme == "file":
        return fs.LocalFileSystem(), os.path.realpath("/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def absolute(path: str) -> str:
    """A relative local path as seen from the driver; URIs stay as they are."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return path
    return os.path.abspath(os.path.expanduser(path))


def canonical(path: str) -> str:
    """One spelling per file: links of local files are followed."""
    return prefix_of(path) + resolve(path)[1]


def prefix_of(path: str) -> str:
    """What turns an inner path back into a full one: empty for local files."""
    match = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)", path)
    if not match or match.group(1) == "file":
        return ""
    scheme, authority = match.groups()
    return f"{scheme}://" if SCHEMES.get(scheme) else f"{scheme}:{authority}"


def list_dir(path: str, recursive: bool = False) -> Iterator[str]:
    """Full paths of the files in a folder; an absent folder is empty."""
    system, inner = resolve(path)
    selector = fs.FileSelector(inner, allow_not_found=True, recursive=recursive)
    prefix = prefix_of(path)
    for info in system.get_file_info(selector):
        if info.type == fs.FileType.File:
            yield prefix + info.path


def entries(path: str) -> Iterator[tuple[str, bool]]:
    """Full path of each file and folder right below a folder, and whether it is a folder; an absent one has none.

    A local folder is gone through as a stream; of a store the client's own list is.
    """
    system, inner = resolve(path)
    prefix = prefix_of(path)
    if isinstance(system, fs.LocalFileSystem):
        if os.path.isdir(inner):
            with os.scandir(inner) as found:
                for entry in found:
                    folder = entry.is_dir()
                    if folder or entry.is_file():
                        yield f"{prefix}{inner.rstrip('/')}/{entry.name}", folder
        return
    for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            yield prefix + info.path, info.type == fs.FileType.Directory


def names_below(path: str, size: int = 10_000) -> Iterator[list[str]]:
    """The names right below a folder, so many at a time."""
    found = (name.rstrip("/").rsplit("/", 1)[1] for name, _ in entries(path))
    while names := list(itertools.islice(found, size)):
        yield names


def list_both(path: str) -> tuple[list[str], list[str]]:
    """Full paths of the files and of the folders right below a folder; an absent one has none."""
    found = list(entries(path))
    return [name for name, folder in found if not folder], [name for name, folder in found if folder]


def glob_root(pattern: str) -> tuple[str, str, bool]:
    """The folder that a shell pattern starts from, a regular expression for paths relative to it, and whether it goes deeper."""
    parts = pattern.split("/")
    fixed = 0
    while fixed < len(parts) - 1 and not glob.has_magic(parts[fixed]):
        fixed += 1
    root = "/".join(parts[:fixed]) or ("/" if pattern.startswith("/") else ".")
    tail = "/".join(parts[fixed:])
    return root, glob.translate(tail, recursive=True, include_hidden=False), "/" in tail


def base_of(root: str) -> str:
    """What the full paths below a folder start with."""
    return prefix_of(root) + resolve(root)[1].rstrip("/") + "/"


def exists(path: str) -> bool:
    system, inner = resolve(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound
