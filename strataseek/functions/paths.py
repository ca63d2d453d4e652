"""Parts of paths as columns. Separators are ``/``; a name's extension follows its last dot, unless that is its first character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent(path: Column) -> Column:
    """What stands before the last component; ``/`` for a child of the root, empty for a bare name."""
    return F.when(path.rlike(r"^/[^/]*/*$"), F.when(path.rlike(r"^/+$"), "").otherwise("/")).otherwise(F.regexp_extract(path, r"^(.*?)/+[^/]*/*$", 1))


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+\.([^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def depth(path: Column) -> Column:
    """Number of components, the root directory included."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.size(parts) + F.startswith(path, F.lit("/")).cast("int")


def components(path: Column) -> Column:
    """The components as an array; arrays sort as paths do, component by component."""
    return F.split(path, "/")


def display_parent(full_path: Column, parent_path: Column) -> Column:
    """The folder shown for a row: its parent, else what the full path says, else the drive."""
    own = parent(full_path)
    return F.when((parent_path != "") & (parent_path != "/"), parent_path).when(own != "", own).otherwise(F.substring(full_path, 1, 3))


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; paths elsewhere stay whole."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
