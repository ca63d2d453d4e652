"""An index of the trigrams of file names, so that a search reads the names that can match, and not all.

A name's folded letters in threes (with the name's rows in blocks of ``BLOCK`` ids) are written where the names are read, in
portions (``inverted.PORTION``) sorted by trigram, a row for each trigram and block with the rows of the block that have it; a block whose names are not
read together comes in pieces. A query is read into a condition of trigrams: a term must
have all of its own, a group all terms, one of the groups must hold. Pieces of blocks are intersected each by itself; the rows that
are left are read from the table of files, which is sorted by block, and the query's own condition decides. A group without a
term of three letters, or a search of paths or by regular expression, reads everything.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.operators import inverted, search
from strataseek.plans import relational
from strataseek.plans.options import SearchOptions
from strataseek.plans.query import Term, parse

#: Ids of a block; trigrams of a query that are looked up (more would only save verification); blocks that go into the filter as literals.
BLOCK, MOST, LITERALS = 4096, 64, 1000
#: Rows that one file of ``files`` is to have, so that a task's memory doesn't grow with the table.
SHARE = 250_000
GRAMS = "gram string, block bigint, piece bigint, rows array<bigint>"


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def required(term: Term, options: SearchOptions) -> set[str] | None:
    """Trigrams that the folded name must have for a term to match it; None if nothing can be said.

    Folding depends on what stands around a letter beyond ASCII, so where case matters only ASCII runs count.
    """
    text, wild = term.text, not term.phrase and ("*" in term.text or "?" in term.text)
    if (not term.phrase and text.startswith("!")) or (options.match_whole_word and not wild):
        return None
    parts = re.split(r"[*?]", text) if wild else [text]
    if options.match_case:
        parts = [run for p in parts for run in re.findall(r"[\x00-\x7f]+", p)]
    elif wild:
        parts = re.split(r"[*?]", text.lower())  # folded whole, as the pattern is
    return set().union(*(trigrams(p.lower()) for p in parts)) or None


class NameIndex:
    """An index below ``path``: ``files`` and ``grams``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = spark.read.parquet(f"{path}/files")
        self.grams = spark.read.schema(GRAMS).parquet(f"{path}/grams")

    @staticmethod
    def build(files: DataFrame, path: str) -> None:
        """Write the index of files (with ``file_ord``, different for each row)."""
        block = F.expr(f"file_ord - pmod(file_ord, {BLOCK})").alias("block")
        own = files.select("*", block)
        shares = files.count() // SHARE
        # a few are left to Spark
        dealt = own.repartitionByRange(shares, "block") if shares > 1 else own.repartitionByRange("block")
        dealt.sortWithinPartitions("block", "file_ord").write.parquet(f"{path}/files")
        name = F.lower("file_name")
        long = F.char_length(name) >= 3
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(name) - 2), lambda i: F.substring(name, i, F.lit(3))))
        each = files.sparkSession.read.parquet(f"{path}/files").where(long).select(F.col("file_ord").cast("long").alias("file_ord"), F.col("block").cast("long").alias("block"), grams.alias("grams"))
        each.mapInArrow(inverted.names, GRAMS).write.options(**inverted.WRITTEN).parquet(f"{path}/grams")

    def _rows(self, asked: list[list[str]]) -> DataFrame:
        """``block, rows``: the rows of each piece of a block that have all trigrams of one of the lists."""
        all_ = sorted({g for x in asked for g in x})
        held = self.grams.where(F.col("gram").isin(all_)).groupBy("block", "piece").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("of"))

        def having(grams: list[str]) -> Column:
            # a trigram that the piece hasn't got leaves no row
            each = [F.coalesce(F.try_element_at("of", F.lit(g)), F.array()) for g in grams]
            return reduce(F.array_intersect, each)

        return held.select("block", reduce(F.array_union, map(having, asked)).alias("rows")).where(F.size("rows") > 0)

    def candidates(self, text: str, options: SearchOptions | None = None) -> DataFrame | None:
        """``block, rows`` that can match; None if any row can."""
        options = options or SearchOptions()
        if not text or options.regex:
            return None
        query = parse(text, options)
        groups = [g for g in query.groups if g]
        if query.options.match_path or not groups:
            return None
        asked = []
        for group in groups:
            grams = set().union(*(required(t, query.options) or () for t in group))
            if not grams:
                return None
            asked.append(sorted(grams)[:MOST])  # fewer say less, and the condition decides in the end
        return self._rows(asked)

    def matching(self, text: str, options: SearchOptions | None = None, now: datetime | None = None) -> DataFrame:
        """The rows that a query matches, as ``search.matching`` over all files."""
        rows = self.candidates(text, options)
        if rows is None:
            return search.matching(self.files, text, options, now).drop("block")
        blocks = [r[0] for r in rows.select("block").distinct().limit(LITERALS + 1).collect()]
        few = len(blocks) <= LITERALS
        files = self.files.where(F.col("block").isin(blocks)) if few else self.files
        ids = rows.select(F.explode("rows").alias("file_ord"))
        # what other rows say is asked of all files, not of the candidates
        return relational.matching(self.files, text, options, now, among=files.join(ids, "file_ord", "left_semi")).drop("block")
