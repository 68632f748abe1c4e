"""Paths: names, extensions, walk order, destinations, display form."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions a run accepts.
ALLOWED_EXTENSIONS = (
    ".jpg", ".jpeg", ".heic", ".png", ".mp4", ".mov", ".mkv", ".webm", ".avi",
)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix from the last dot of the name, or an empty text."""
    name = basename(path)
    suffix = F.lower(F.substring_index(name, ".", -1))
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), suffix)).otherwise("")


def walk_key(path: Column) -> Column:
    """Sort key of a directory walk: names compared level by level.

    With the separator turned into the lowest byte, one string comparison gives
    the order that comparing arrays of names would, and no array is built.
    """
    return F.replace(path, F.lit("/"), F.lit("\0"))


def destination(folder: str, month: Column, path: Column) -> Column:
    """``folder/YYYY-MM/name``; null when the month is."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), month, F.lit("/"), basename(path))


def clean_path(path: Column) -> Column:
    """Drop doubled and trailing separators and ``.`` elements.

    ``..`` is left alone: paths made by a listing never hold it.
    """
    return F.regexp_replace(path, r"(?:/\.?)+(?=/|\z)", "")


def relative_path(path: Column, root: str) -> Column:
    """A path as shown in reports: relative to the root, led by the root's name.

    Paths outside the root are shown relative to the closest common folder; if
    only one of the two is absolute the path is left as it is.
    """
    if not root:
        return path
    root = posixpath.normpath(root)
    absolute = root.startswith("/")
    lead = "/" if absolute else ""
    names = [name for name in root.split("/") if name not in ("", ".")]
    whole = clean_path(path)
    if not names:
        shown = F.when(whole == "", root).otherwise(whole)
    else:
        # The longest shared run of folders decides; fewer shared folders mean
        # more steps up, the first of which cancels the root's own name.
        shown = None
        for shared in range(len(names), -1, -1):
            folder = lead + "/".join(names[:shared])
            steps_up = len(names) - shared
            start = "../" * (steps_up - 1) if steps_up else names[-1] + "/"
            skip = len(folder.rstrip("/")) + 1 if folder else 0
            rest = F.concat(F.lit(start), F.substr(whole, F.lit(skip + 1)))
            inside = whole.startswith(folder.rstrip("/") + "/") if folder else F.lit(True)
            if shared == len(names):
                shown = F.when(whole == folder, names[-1])
            elif folder:
                bare = "../" * (steps_up - 1)
                shown = shown.when(whole == folder, bare.rstrip("/") or ".")
            shown = shown.when(inside, rest)
        shown = shown.otherwise(path)
    same_kind = path.startswith("/") if absolute else ~path.startswith("/")
    return F.when((path != "") & same_kind, shown).otherwise(path)
