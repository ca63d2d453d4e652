"""File inventories, ordered source merging and rename previews."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions import formatting, paths

NO_EXTENSION = "(无扩展名)"

#: Extensions whose files count as source text. Fixed values.
CODE_EXTENSIONS = (
    "rs c cpp h hpp cxx cc hh py java go js ts rb php swift kt cs fs lua r m mm pl pm sh bash zsh ps1 bat cmd toml env ini cfg conf "
    "yaml yml json xml properties lock txt md requirements req in"
).split()


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1, ranges: int | None = None) -> DataFrame:
    """Append a gapless running number in the given (ascending) order, without one task that holds all rows.

    Rows fall into ranges of the order, whose bounds come from a fixed-size sample of the keys; each range
    numbers its own rows and starts after the counts of the ranges before it. A row's range depends
    on its key alone, so counts and ranks agree however often they are computed.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns(keys)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted((tuple(r) for r in keyed.select(*keys).orderBy(F.xxhash64(*keys)).limit(100 * n).collect()), key=lambda t: [(x is not None, x) for x in t])
    bounds = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    key = F.struct(*keys)
    edges = [F.struct(*(F.lit(x).cast(keyed.schema[k].dataType).alias(k) for k, x in zip(keys, b, strict=True))) for b in dict.fromkeys(bounds)]

    def place(low: int, high: int) -> Column:  # a search by halves: a row is compared with as many bounds as their number has bits
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key >= edges[middle], place(middle + 1, high)).otherwise(place(low, middle))

    dealt = keyed.withColumn("_range", place(0, len(edges)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = dealt.withColumn("_rank", rank).join(F.broadcast(offsets), "_range")  # at most n rows
    return out.select(*df.columns, (F.col("_before") + F.col("_rank") + (first - 1)).cast("long").alias(name))


def with_extension(files: DataFrame) -> DataFrame:
    """Plain files, their extension in lower case or a stand-in for none."""
    lowered = F.lower("extension")
    return files.where(~F.col("is_directory")).withColumn("extension", F.when(lowered == "", NO_EXTENSION).otherwise(F.coalesce(lowered, F.lit(NO_EXTENSION))))


def extensions(files: DataFrame) -> DataFrame:
    """The distinct extensions, sorted."""
    return with_extension(files).select("extension").distinct().orderBy("extension")


def inventory(files: DataFrame, chosen: Iterable[str] | None = None, zone: str = "UTC") -> DataFrame:
    """Index, name, extension, path, created, modified and size of the files with the chosen extensions, in the order of the scan."""
    listed = with_extension(files)
    if chosen is not None:
        listed = listed.where(F.col("extension").isin(list(chosen)))
    shown = numbered(listed, [F.col("file_ord")], "index")
    pattern = "yyyy-MM-dd HH:mm:ss"
    return shown.select(
        "index",
        F.col("file_name").alias("name"),
        "extension",
        F.col("full_path").alias("path"),
        formatting.format_date(F.col("date_created"), pattern, zone).alias("created"),
        formatting.format_date(F.col("date_modified"), pattern, zone).alias("modified"),
        "size",
    )


def totals(files: DataFrame) -> DataFrame:
    """Number and total size of plain files, also in megabytes as text."""
    out = files.where(~F.col("is_directory")).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return out.withColumn("total_mb", formatting.megabytes(F.col("total_size")))


def sources(files: DataFrame, root: str, contains: str = "") -> DataFrame:
    """Source files below ``root`` by relative path; ``contains`` filters the paths, folded."""
    found = files.where(~F.col("is_directory") & F.lower("extension").isin(CODE_EXTENSIONS))
    found = found.withColumn("relative_path", paths.relative(F.col("full_path"), root))
    if contains:
        found = found.where(F.contains(F.lower("relative_path"), F.lit(contains.lower())))
    return found.orderBy("relative_path")


def merged_text(files: DataFrame, content: Column | None = None, error: Column | None = None) -> DataFrame:
    """One text block for each source file (relative_path, full_path, file_name, content, error), in order of path."""
    content = F.col("content") if content is None else content
    error = F.lit(None).cast("string") if error is None else error
    body = F.coalesce(content, F.concat(F.lit("[读取失败: "), F.coalesce(error, F.lit("")), F.lit("]")))
    block = F.concat(
        F.lit("===== 文件: "), F.col("relative_path"), F.lit(" =====\n路径: "), F.col("full_path"), F.lit("\n文件名: "), F.col("file_name"), F.lit("\n--- 代码 ---\n"), body, F.lit("\n--- 结束 ---\n\n")
    )
    return files.select("relative_path", block.alias("block")).orderBy("relative_path")


@dataclass(frozen=True)
class RenameRule:
    """One step of a renaming; the counter stands for ``{n}`` and ``{N}`` (three digits)."""

    find: str = ""
    replace: str = ""
    prefix: str = ""
    suffix: str = ""
    counter_format: str = ""
    counter_start: int = 1
    new_extension: str | None = None


def renamed(name: Column, number: Column, rules: list[RenameRule]) -> Column:
    """The new name of the file with the given running number (from 1)."""
    stem, old = paths.stem(name), paths.extension(name)
    for r in rules:
        if r.find:
            stem = F.replace(stem, F.lit(r.find), F.lit(r.replace))
        stem = F.concat(F.lit(r.prefix), stem, F.lit(r.suffix))
        if r.counter_format:
            value = number + (r.counter_start - 1)
            text = F.replace(F.lit(r.counter_format), F.lit("{n}"), value.cast("string"))
            text = F.replace(text, F.lit("{N}"), F.format_string("%03d", value))
            stem = F.concat(stem, F.when(F.contains(text, F.lit("{")), F.lit("")).otherwise(text))
    ends = [r.new_extension for r in rules if r.new_extension is not None]
    ending = F.lit(ends[0]) if ends else old
    return F.when(ending == "", stem).otherwise(F.concat(stem, F.lit("."), ending))


def rename_preview(files: DataFrame, rules: list[RenameRule], folder: str | None = None) -> DataFrame:
    """Old and new path of every file, numbered in the order of the scan; new ones are in ``folder`` if named, else beside the old."""
    shown = numbered(files, [F.col("file_ord")], "number")
    new = renamed(F.col("file_name"), F.col("number"), rules)
    where = F.col("parent_path") if folder is None else F.lit(folder.rstrip("/"))
    return shown.select("number", F.col("full_path").alias("old_path"), F.concat_ws("/", where, new).alias("new_path"))


def rename(preview: DataFrame, copy: bool = False) -> list[tuple[str, str]]:
    """Carry a preview out on the driver's file system, in its order: move, or copy files and whole folders.

    Stops at the first error, which names the file; what was done until then stays done.
    """
    done = []
    for r in preview.orderBy("number").select("old_path", "new_path").toLocalIterator():
        try:
            if not copy:
                os.rename(r["old_path"], r["new_path"])
            elif os.path.isdir(r["old_path"]):
                shutil.copytree(r["old_path"], r["new_path"], dirs_exist_ok=True)
            else:
                shutil.copyfile(r["old_path"], r["new_path"])
        except OSError as e:
            raise OSError(f"{len(done)} files done, then {r['old_path']}: {e}") from e
        done.append((r["old_path"], r["new_path"]))
    return done


def clipboard(files: DataFrame, most: int = 50) -> DataFrame:
    """The first full paths of the scan, a line each, as one text."""
    top = files.orderBy("file_ord").limit(most)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "full_path"))), lambda x: x["full_path"]), "\n").alias("text"))
