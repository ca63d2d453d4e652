"""Directory trees as a data source (``fsindex``) and their changes as a stream (``fswatch``).

A partition is a root's direct subfolder (and one for the root's own entries), so a
tree is walked in parallel. ``file_ord`` numbers rows in the order of the walk.
Options: ``path`` (several separated by ``;``), ``hidden`` (walk hidden subtrees),
``fast`` (leave creation and access times null), ``depth`` (levels below the root).
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from strataseek.operators.listing import numbered
from strataseek.schema import ATTRIBUTE_BITS, ATTRIBUTES, FILE_ENTRY, WATCH_EVENT
from strataseek.sources.scratch import written

#: Rows that one partition may number.
PLACES = 1 << 40


@dataclass
class Branch(InputPartition):
    """A subtree to walk; ``levels`` below it (-1: all), or the root alone with its files."""

    root: str
    number: int
    levels: int
    only_files: bool = False


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def entry(path: str, place: int, fast: bool = False) -> tuple | None:
    """The row of a path, symlinks not followed; None if it can't be read."""
    try:
        s = os.lstat(path)
    except OSError:
        return None
    name = os.path.basename(path.rstrip("/")) or path
    dot = name.rfind(".")
    folder = stat.S_ISDIR(s.st_mode)
    bits = getattr(s, "st_file_attributes", None)
    if bits is None:
        flags = [n == "read_only" and not s.st_mode & 0o222 or n == "directory" and folder for n in ATTRIBUTE_BITS]
    else:
        flags = [bool(bits & (1 << k)) for k in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)]
    born = getattr(s, "st_birthtime", s.st_ctime)
    return (
        place,
        path,
        name,
        "" if folder or dot <= 0 else name[dot + 1 :],
        os.path.dirname(path.rstrip("/")) if path != "/" else "",
        s.st_size,
        None if fast else _time(born),
        _time(s.st_mtime),
        None if fast else _time(s.st_atime),
        None,
        tuple(flags),
        folder,
        None,
        0,
        None,
    )


def walk(root: str, levels: int, hidden: bool) -> Iterator[str]:
    """Paths below ``root`` in name order, parents first; the root itself comes first."""
    yield root
    if levels == 0:
        return
    try:
        with os.scandir(root) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if not hidden and e.name.startswith("."):
            continue
        if e.is_dir(follow_symlinks=False):
            yield from walk(e.path, levels - 1, hidden)
        else:
            yield e.path


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(p) for p in options["path"].split(";") if p]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.fast = options.get("fast", "false").lower() == "true"
        self.levels = int(options.get("depth", "-1"))

    def partitions(self) -> list[Branch]:
        out: list[Branch] = []
        for root in self.roots:
            out.append(Branch(root, len(out), 1 if self.levels else 0, only_files=True))
            if self.levels == 0 or self.levels == 1:
                continue
            try:
                with os.scandir(root) as found:
                    below = sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and (self.hidden or not e.name.startswith(".")))
            except OSError:
                continue
            for path in below:
                out.append(Branch(path, len(out), self.levels - 1 if self.levels > 0 else -1))
        return out

    def read(self, branch: Branch) -> Iterator[tuple]:
        place = branch.number * PLACES
        for path in walk(branch.root, branch.levels, self.hidden):
            if branch.only_files and path != branch.root and os.path.isdir(path) and not os.path.islink(path) and self.levels != 1:
                continue  # a partition of its own
            row = entry(path, place, self.fast)
            if row:
                yield row
                place += 1


class WatchReader(SimpleDataSourceStreamReader):
    """Differences between successive looks at the trees; what was seen is kept in the folder ``state``."""

    def __init__(self, options: dict):
        self.tree = TreeReader(options)
        self.state = options["state"]

    def _seen(self, number: int) -> dict:
        try:
            with open(os.path.join(self.state, f"{number}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def initialOffset(self) -> dict:
        return {"look": 0, "seq": 0}

    def _look(self) -> dict[str, list]:
        out = {}
        for branch in self.tree.partitions():
            for row in self.tree.read(branch):
                out[row[1]] = [row[7].timestamp(), row[5]]
        return out

    def _events(self, before: dict, after: dict, seq: int) -> list[tuple]:
        kinds = [(p, "removed") for p in sorted(before.keys() - after.keys())] + [(p, "added") for p in sorted(after.keys() - before.keys())]
        kinds += [(p, "modified") for p in sorted(before.keys() & after.keys()) if before[p] != after[p]]
        stamp = datetime.now(timezone.utc)
        return [(seq + i, stamp, p, kind) for i, (p, kind) in enumerate(kinds)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, after = self._seen(start["look"]), self._look()
        events = self._events(before, after, start["seq"])
        if not events:
            return iter([]), start
        os.makedirs(self.state, exist_ok=True)
        with open(os.path.join(self.state, f"{start['look'] + 1}.json"), "w") as f:
            json.dump(after, f)
        return iter(events), {"look": start["look"] + 1, "seq": start["seq"] + len(events)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before = self._seen(start["look"])
        return iter(self._events(before, self._seen(end["look"]), start["seq"]))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state) if os.path.isdir(self.state) else []:
            if name.removesuffix(".json").isdigit() and int(name.removesuffix(".json")) < end["look"]:
                os.remove(os.path.join(self.state, name))


class FileIndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fsindex"

    def schema(self):
        return FILE_ENTRY

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


class FileWatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fswatch"

    def schema(self):
        return WATCH_EVENT

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return WatchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileIndexSource)
    spark.dataSource.register(FileWatchSource)


def index_folder(spark: SparkSession, path: str, include_hidden: bool = False, fast: bool = False, depth: int = -1) -> DataFrame:
    """Files and folders below a root, the root included; hidden subtrees only if asked for."""
    register(spark)
    return spark.read.format("fsindex").options(path=path, hidden=str(include_hidden), fast=str(fast), depth=str(depth)).load()


#: Folders that a task lists in a round of a walk by levels, about.
FOLDERS = 200
_LISTED = T.StructType([T.StructField("_key", T.ArrayType(T.StringType())), *FILE_ENTRY.fields])


def _listing(hidden: bool, fast: bool):
    """Folders (full_path, _key) -> the rows of what lies directly in them; a key is the names from the root on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for folder, key in zip(frame["full_path"], frame["_key"], strict=True):
                try:
                    with os.scandir(folder) as found:
                        inside = [e.path for e in found if hidden or not e.name.startswith(".")]
                except OSError:
                    continue
                rows += [([*key, r[2]], *r) for r in (entry(p, 0, fast) for p in inside) if r]
            out = pd.DataFrame(rows, columns=_LISTED.names)
            out["attributes"] = [dict(zip(ATTRIBUTES.names, a, strict=True)) for a in out["attributes"]]
            yield out

    return run


def index_by_levels(spark: SparkSession, path: str, include_hidden: bool = False, fast: bool = False, depth: int = -1) -> DataFrame:
    """As ``index_folder``, for trees of any shape: the folders of each level are dealt out anew, so no task walks a subtree alone.

    A level is written when it has been listed; the rows are numbered in the order of the walk in the end, by ranges.
    """
    level = spark.createDataFrame([([str(i).zfill(6)], *entry(os.path.abspath(p), 0, fast)) for i, p in enumerate(x for x in path.split(";") if x) if os.path.lexists(p)], _LISTED)
    levels = [written(level, "tree-level")]
    while depth != len(levels) - 1:
        folders = levels[-1].where("is_directory").select("full_path", "_key")
        n = folders.count()
        if not n:
            break
        dealt = folders.repartition(max(1, min(n, spark.sparkContext.defaultParallelism), n // FOLDERS))
        levels.append(written(dealt.mapInPandas(_listing(include_hidden, fast), _LISTED), "tree-level"))
    rows = reduce(DataFrame.unionByName, levels)
    # a root's own files come before its subfolders
    deep = (F.size("_key") > 2) | ((F.size("_key") == 2) & F.col("is_directory"))
    # names joined by a sign that sorts before all others keep the order of the lists
    order = [F.col("_key")[0], deep, F.array_join("_key", "\0")]
    keyed = rows.withColumns({f"_order{i}": c for i, c in enumerate(order)}).drop("file_ord", "_key")
    out = numbered(keyed, [F.col(f"_order{i}") for i in range(len(order))], "file_ord", first=0)
    return out.select(*FILE_ENTRY.names)
