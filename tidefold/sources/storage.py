"""Folders and files as tasks see them: mounted paths, and any file system of pyarrow by URI.

Used inside tasks only. A path without a scheme, or of ``file:``, is opened by the operating
system; any other (``s3://``, ``gs://``, ``hdfs://``, ...) by the file system that its scheme
names. Paths are returned in the form in which they were asked for.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

Entry = tuple[str, str, int | None, int | None, str | None]

NOT_UTF8 = "name is not UTF-8"


def mounted(path: str) -> str | None:
    """The path for the operating system, or None for a place on another file system."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


@lru_cache(maxsize=64)
def _system(place: str):
    """File system of ``scheme://host``, and the path that the host stands for in it (a bucket)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(place + "/")
    return system, path.strip("/")


def _opened(uri: str):
    """File system, path in it, and what stands before such paths in URIs."""
    scheme, _, rest = uri.partition("://")
    host, _, inside = rest.partition("/")
    place = f"{scheme}://{host}"
    system, base = _system(place)
    if base:
        return system, f"{base}/{inside}".rstrip("/"), place.removesuffix(base)
    return system, "/" + inside, place


def reason(problem: OSError) -> str:
    return problem.strerror or str(problem)


def list_folder(folder: str) -> Iterator[Entry]:
    """``kind, path, mtime_us, size, message`` of what lies in a folder.

    Of mounted files only the names are read here, in one pass however many there are;
    ``file_facts`` tells the rest. Links are not followed. What cannot be read is an
    entry of kind ``error``.
    """
    local = mounted(folder)
    try:
        yield from _scan(local) if local is not None else _select(folder)
    except OSError as problem:
        yield "error", folder, None, None, reason(problem)


def _scan(folder: str) -> Iterator[Entry]:
    with os.scandir(folder) as listing:
        for entry in listing:
            # A name that is not UTF-8 cannot be a text: it is recorded.
            shown = os.fsencode(entry.path).decode("utf-8", "backslashreplace")
            if shown != entry.path:
                yield "error", shown, None, None, NOT_UTF8
                continue
            try:
                kind = "folder" if entry.is_dir(follow_symlinks=False) else "file"
                yield kind, entry.path, None, None, None
            except OSError as problem:
                yield "error", entry.path, None, None, reason(problem)


def _select(folder: str) -> Iterator[Entry]:
    from pyarrow import fs

    system, path, before = _opened(folder)
    for info in system.get_file_info(fs.FileSelector(path, recursive=False)):
        if info.type == fs.FileType.Directory:
            yield "folder", before + info.path, None, None, None
        else:
            yield "file", before + info.path, info.mtime_ns and info.mtime_ns // 1000, info.size, None


def file_facts(path: str) -> Entry:
    """Time and size of a mounted file, or why they cannot be told."""
    try:
        info = os.lstat(mounted(path) or path)
        return "file", path, info.st_mtime_ns // 1000, info.st_size, None
    except OSError as problem:
        return "error", path, None, None, reason(problem)


def open_content(path: str):
    """The content of a file, to be read in pieces."""
    local = mounted(path)
    if local is not None:
        return open(local, "rb")
    system, inside, _ = _opened(path)
    return system.open_input_stream(inside, compression=None)


def open_at(path: str, offset: int):
    """The content of a file from ``offset`` on."""
    local = mounted(path)
    if local is not None:
        content = open(local, "rb")
    else:
        system, inside, _ = _opened(path)
        content = system.open_input_file(inside)
    content.seek(offset)
    return content
