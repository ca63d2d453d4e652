"""The engine as an object: sources in, one table of files, searches out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions import formatting, tokens
from strataseek.operators import fulltext, history, search
from strataseek.operators.text_index import TextIndex
from strataseek.plans.options import SearchOptions, SortSpec, parse_dir_sort, parse_sort_name
from strataseek.schema import FILE_ENTRY
from strataseek.sources import file_list, fsindex, sinks
from strataseek.sources.scratch import files_of
from strataseek.sources.versions import Versions


@dataclass(frozen=True)
class Source:
    """A folder or a file list to index; sources that aren't enabled are left out."""

    kind: str
    path: str
    enabled: bool = True
    label: str = ""


class Engine:
    """Files of several sources, their run history, and searches over them."""

    def __init__(self, spark: SparkSession, sources: Iterable[Source] = ()):
        self.spark = spark
        self.sources = list(sources)
        self.files = spark.createDataFrame([], FILE_ENTRY)
        self.runs = spark.createDataFrame([], "path string, run_count long, last_run timestamp")

    def build(self, include_hidden: bool = False) -> DataFrame:
        """Scan all enabled sources; overlapping ones give their rows twice. Order: source by source."""
        parts = []
        for n, s in enumerate(x for x in self.sources if x.enabled):
            if s.kind == "folder":
                part = fsindex.index_folder(self.spark, s.path, include_hidden)
            elif s.kind == "file_list":
                part = file_list.to_entries(file_list.load(self.spark, s.path, broken_is_empty=True), s.path)
            else:
                continue
            parts.append(part.withColumn("file_ord", F.col("file_ord") + F.lit(n) * F.lit(1 << 52)))
        self.files = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], FILE_ENTRY)
        return self.files

    def use(self, sources: Iterable[Source]) -> DataFrame:
        """Other sources; the table is built anew if they differ from those before."""
        before, self.sources = self.sources, list(sources)
        return self.files if before == self.sources else self.build()

    def load(self, files: DataFrame) -> Engine:
        self.files = files
        return self

    def search(self, query: str, options: SearchOptions | None = None, now: datetime | None = None, compat: bool = False) -> DataFrame:
        return search.search(search.with_run_history(self.files, self.runs), query, options, now, compat)

    def quick_search(self, query: str, max_scan: int, options: SearchOptions | None = None) -> DataFrame:
        return search.quick_search(self.files, query, max_scan, options)

    def totals(self) -> tuple[int, int, int]:
        """Rows, files and folders of the index."""
        return tuple(search.counts(self.files).first())

    def run_count(self, path: str) -> int:
        row = self.runs.where(F.col("path") == path).select("run_count").first()
        return row[0] if row else 0

    def set_run_count(self, path: str, count: int) -> None:
        row = self.spark.createDataFrame([(path, count, None)], self.runs.schema)
        self.runs = self.runs.where(F.col("path") != path).unionByName(row)

    def increment_run_count(self, path: str, at: datetime | None = None) -> None:
        event = self.spark.createDataFrame([(0, at or datetime.now(), path, "opened")], "seq long, ts timestamp, path string, kind string")
        self.runs = history.increment(self.runs, event)


def file_parts(files: DataFrame) -> DataFrame:
    """The fields that programs ask of a result: names, path, size, dates, attributes, kind."""
    return files.select(
        "file_name",
        "parent_path",
        "full_path",
        "extension",
        "size",
        "date_created",
        "date_modified",
        "date_accessed",
        "attributes",
        (~F.col("is_directory")).alias("is_file_result"),
        F.col("is_directory").alias("is_folder_result"),
    )


#: Switches without a value, and what they set. Fixed values.
FLAGS = {
    "regex": ("-r", "-regex"),
    "match_case": ("-i", "-case"),
    "match_whole_word": ("-w", "-ww", "-whole-word"),
    "match_path": ("-p", "-match-path", "-s"),
    "match_diacritics": ("-a", "-diacritics"),
    "help": ("-h", "-help", "-empty-search-help"),
    "hide_empty": ("-hide-empty-search-results",),
    "highlight": ("-highlight",),
    "count_only": ("-get-result-count",),
    "ascending": ("-sort-ascending",),
    "descending": ("-sort-descending",),
    "idle": ("-pause", "-more", "-save-settings", "-clear-settings"),
}

#: Switches followed by a value. Fixed values.
VALUES = {
    "max_results": ("-n", "-max-results"),
    "offset": ("-o", "-offset"),
    "sort": ("-sort",),
    "increment": ("-inc-run-count",),
    "get_run_count": ("-get-run-count",),
    "csv": ("-csv",),
    "efu": ("-efu",),
    "txt": ("-txt",),
    "m3u": ("-m3u",),
    "m3u8": ("-m3u8",),
    "idle": ("-instance", "-timeout", "-highlight-color", "-filename-color", "-name-color", "-path-color"),
}

#: Switches that choose columns. Fixed values.
COLUMNS = {
    "file_name": ("-name",),
    "full_path": ("-path-column",),
    "size": ("-size",),
    "extension": ("-extension", "-ext"),
    "date_created": ("-date-created", "-dc"),
    "date_modified": ("-date-modified", "-dm"),
    "date_accessed": ("-date-accessed", "-da"),
    "attributes": ("-attributes", "-attribs", "-attrib"),
    "file_list_filename": ("-file-list-file-name",),
    "run_count": ("-run-count",),
    "date_run": ("-date-run",),
    "date_recently_changed": ("-date-recently-changed", "-rc"),
}

EXPORTS = ("csv", "efu", "txt", "m3u", "m3u8")


def _by_switch(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {s: name for name, switches in table.items() for s in switches}


@dataclass
class Command:
    """A command line, read."""

    query: str = ""
    options: SearchOptions = field(default_factory=lambda: SearchOptions(max_results=0))
    export: tuple[str, str] | None = None
    set_run_count: tuple[str, int] | None = None
    increment: str | None = None
    get_run_count: str | None = None
    count_only: bool = False
    help: bool = False
    hide_empty: bool = False
    highlight: bool = False
    columns: tuple[str, ...] = ()


def parse_command(args: list[str]) -> Command:
    """Switches of the command line; what isn't one is the query. Those of terminals, settings and other programs are read and idle."""
    flags, values, columns = _by_switch(FLAGS), _by_switch(VALUES), _by_switch(COLUMNS)
    given: dict[str, str | bool] = {}
    words, shown, runs = [], [], None
    rest = iter(args)
    for x in rest:
        if x in flags:
            given[flags[x]] = True
        elif x in columns:
            shown.append(columns[x])
        elif x in values:
            given[values[x]] = next(rest, "")
        elif x == "-set-run-count":
            runs = (next(rest, ""), _whole(next(rest, "")))
        else:
            words.append(x)
    sort = str(given.get("sort", "name"))
    spec = parse_sort_name(sort) or parse_dir_sort(sort) or SortSpec()
    if "ascending" in given or "descending" in given:
        spec = replace(spec, descending="descending" in given)
    switches = {n: n in given for n in ("regex", "match_case", "match_whole_word", "match_path", "match_diacritics")}
    options = SearchOptions(sort=spec, max_results=_whole(given.get("max_results", "")), offset=_whole(given.get("offset", "")), **switches)
    export = next(((k, given[k]) for k in EXPORTS if given.get(k)), None)
    own = {n: n in given for n in ("count_only", "help", "hide_empty", "highlight")}
    return Command(" ".join(words), options, export, runs, given.get("increment"), given.get("get_run_count"), columns=tuple(dict.fromkeys(shown)), **own)


def _whole(text: str) -> int:
    return int(text) if text.isdecimal() else 0


def run_command(engine: Engine, args: list[str]) -> DataFrame | int | str | None:
    """Carry out a command line: results, a count, the list of switches, or None for a change of the history."""
    c = parse_command(args)
    if c.help:
        return "\n".join(" ".join(s) for table in (FLAGS, VALUES, COLUMNS) for s in table.values()) + "\n-set-run-count"
    if c.set_run_count:
        return engine.set_run_count(*c.set_run_count)
    if c.increment:
        return engine.increment_run_count(c.increment)
    if c.get_run_count:
        return engine.run_count(c.get_run_count)
    found = engine.search(c.query, c.options)
    if c.hide_empty and not c.query:
        found = found.where(F.lit(False))
    if c.count_only:
        return found.count()
    if c.export:
        kind, path = c.export
        if kind == "efu":
            sinks.write_file_list(found, path)
        elif kind == "csv":
            found.select("file_name", "full_path", "size", "date_modified").write.mode("overwrite").csv(path, header=True, escape='"')
        else:
            sinks.write_paths(found, path, kind)
    if c.highlight:
        found = found.withColumn("highlighted", formatting.highlight(F.col("full_path"), c.query.split()))
    return found.select(*c.columns, *(["highlighted"] if c.highlight else [])) if c.columns else found


class Catalog:
    """Document databases below a base folder: a small state of numbered versions, one writer at a time."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.versions = Versions(spark, f"{self.base}/catalog")

    def databases(self) -> list[dict]:
        _, state = self.versions.last()
        rows = [{**r, "created_at": datetime.fromisoformat(r["created_at"])} for r in state["databases"]] if state else []
        return sorted(rows, key=lambda r: (r["created_at"], r["id"]))

    def _change(self, change: Callable[[list[dict]], list[dict]]) -> None:
        """Write the state that follows from the last; ``Raced`` if another writer was first."""
        number, _ = self.versions.last()
        rows = change(self.databases())
        self.versions.commit(number + 1, {"databases": [{**r, "created_at": r["created_at"].isoformat()} for r in rows]})

    def create(self, name: str, root_dir: str, description: str = "") -> str:
        ident = f"db_{uuid.uuid4().hex}"
        new = {"id": ident, "name": name, "description": description, "root_dir": root_dir, "created_at": datetime.now(), "active": False}
        self._change(lambda rows: [*rows, new])
        return ident

    def activate(self, ident: str) -> str:
        """Make a database the active one; its folder."""
        self._change(lambda rows: [{**r, "active": r["id"] == ident} for r in rows])
        return self.folder(ident)

    def active(self) -> dict | None:
        return next((r for r in self.databases() if r["active"]), None)

    def delete(self, ident: str) -> None:
        """Forget a database and remove its folder."""
        self._change(lambda rows: [r for r in rows if r["id"] != ident])
        system, target = files_of(self.spark, self.folder(ident))
        system.delete(target, True)

    def folder(self, ident: str) -> str:
        return f"{self.base}/{ident}"

    def index(self, ident: str, tokenizer: Callable = tokens.words) -> TextIndex:
        """The full-text index of a database, empty at first."""
        return TextIndex(self.spark, f"{self.folder(ident)}/index", tokenizer)

    def documents(self, ident: str, tokenizer: Callable = tokens.words) -> int:
        """The number of documents that a database has pages of."""
        return fulltext.file_count(self.index(ident, tokenizer).pages()).first()[0]
