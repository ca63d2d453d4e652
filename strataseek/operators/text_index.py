"""A saved full-text index of segments: upserts write what changed, reads merge.

A segment is a folder of Parquet tables, never changed once written:

* ``pages``: file_id, location, body, bucket (a range of ``BUCKET`` file ids)
* ``postings``: a row for each term and bucket (of ``State.bucket`` file ids, which follows the number of pages), several where a bucket's pages were not inverted together: ``n`` pages, the
  largest frequency and the least length in it (what a score in it can't exceed follows from these), the occurrences, and the
  entries: file_id, location, dl (tokens of the page), positions. A file has the postings of a share of the pages, in portions
  (``inverted.PORTION``) sorted by term and bucket; none are shuffled or sorted by Spark, and a lookup reads a term's place in each portion
* ``terms`` and ``endings``: the dictionary with page counts, sorted by term, and by the term read backwards

A commit adds a segment of the changed pages, a list of the files whose older pages no longer count (``gone``), and the
page counts that the terms lose with those pages (``lost``), so that corpus statistics stay exact without reading postings.
The state is one small numbered file; a commit writes the next number, and fails if another writer was first.
``compact`` merges segments of like size and takes the deletions into them.

Lookups of terms are equality filters that the scan uses; patterns are turned into terms by ranges of the dictionary.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions import tokens
from strataseek.operators import fulltext, incremental, inverted
from strataseek.plans.text_query import TextQuery
from strataseek.sources import pages as page_sources
from strataseek.sources.versions import Versions

#: File ids that share a bucket of pages, and a bucket of postings at least: the unit that a search for the best pages skips or reads.
BUCKET = 256
#: Buckets of postings that an index keeps as it grows, and the file ids of one at most: larger buckets mean fewer rows to write and to count.
SKIPPED, WIDEST = 64, 4096
#: Terms of a pattern that go into the filter as literals; more are joined. Deleted files and matched terms that may be sent to every task.
LITERALS, SENT = 1000, 1_000_000
#: Buckets that the first rounds of a search for the best pages read.
ROUNDS = (16, 256)
#: A tier of compaction: segments whose sizes differ by no more than this factor, merged when there are as many.
TIER = 4
ENTRY = "array<struct<file_id: bigint, location: bigint, dl: bigint, positions: array<int>>>"
POSTINGS = f"term string, bucket bigint, n bigint, most int, shortest bigint, occurrences bigint, entries {ENTRY}"


@dataclass
class State:
    """Version, the tokenizer's name, file ids of a bucket of postings, segments {id: {seq, pages, tokens}}, deletions {id: {seq, files}}, losses {id: {segment: [pages, tokens]}}."""

    version: int = 0
    seq: int = 0
    segments: dict = field(default_factory=dict)
    gone: dict = field(default_factory=dict)
    lost: dict = field(default_factory=dict)
    tokenizer: str = ""
    bucket: int = BUCKET


def postings_of(paged: DataFrame) -> DataFrame:
    """Postings rows of pages (file_id, location, bucket, tokens), in no order: several of a term and bucket where its pages were not met together."""
    return paged.select(*(F.col(c).cast("long").alias(c) for c in ("file_id", "location", "bucket")), "tokens").mapInArrow(inverted.pages, POSTINGS)


def bucket_of(pages: int) -> int:
    """File ids of a bucket of postings, for so many pages."""
    size = BUCKET
    while 2 * size <= WIDEST and pages >= 2 * size * SKIPPED:
        size *= 2
    return size


def pattern_bounds(pattern: str) -> tuple[str, str]:
    """The letters that every term of a leaf's pattern begins and ends with."""
    body = pattern.removeprefix("^").removesuffix("$")
    parts = re.split(r"\[\\p\{L\}\\p\{N\}\]\*?", body)
    return (parts[0], parts[-1]) if len(parts) > 1 else (body, body)


def after(prefix: str) -> str | None:
    """The least text that is greater than all that begin with ``prefix``, in the order of code points; none if there is none."""
    while prefix:
        last = ord(prefix[-1])
        if last < 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)
        prefix = prefix[:-1]
    return None


def _between(column: str, prefix: str) -> Column:
    high = after(prefix)
    low = F.col(column) >= prefix
    return low if high is None else low & (F.col(column) < high)


class TextIndex:
    """An index below ``path``; ``create`` begins one, ``TextIndex(spark, path)`` opens its last state."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Callable[[Column], Column] = tokens.words):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer
        self.versions = Versions(spark, f"{self.path}/state")
        self.state = self._last_state()
        name = getattr(tokenizer, "name", "")
        if self.state.version and self.state.tokenizer != name:
            raise ValueError("the index was made with another tokenizer")
        self.state.tokenizer = name
        #: Buckets read by the last search for the best pages, and buckets with any of its terms.
        self.read: tuple[int, int] | None = None

    @classmethod
    def create(cls, pages: DataFrame, path: str, tokenizer: Callable[[Column], Column] = tokens.words) -> TextIndex:
        index = cls(pages.sparkSession, path, tokenizer)
        if index.state.version:
            raise ValueError(f"{path} holds an index already")
        index.upsert(pages)
        return index

    # state

    def _last_state(self) -> State:
        _, state = self.versions.last()
        return State(**state) if state else State()

    def _commit(self, state: State) -> None:
        state.version = self.state.version + 1
        self.versions.commit(state.version, state.__dict__)
        self.state = state

    def _next(self) -> State:
        return State(**json.loads(json.dumps(self.state.__dict__)))

    def _table(self, name: str, ids: list[str], schema: str) -> DataFrame:
        """A table of all the given parts, each row with its part's ``seq``."""
        known = self.state.segments | self.state.gone
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{i}/{name}").withColumns({"segment": F.lit(i), "seq": F.lit(known[i]["seq"] if i in known else 0)}) for i in ids]
        empty = self.spark.createDataFrame([], f"{schema}, segment string, seq int")
        return reduce(DataFrame.unionByName, parts) if parts else empty

    # writing

    def _write_segment(self, pages: DataFrame, state: State, alone: bool) -> tuple[str, dict]:
        """A new segment of pages (file_id, location, body); blank ones are left out. If it will be alone, ``state`` gets the buckets that suit it."""
        name = f"segment-{uuid.uuid4().hex}"
        own = pages.where(F.trim("body") != "").select("file_id", "location", "body", F.expr(f"file_id - pmod(file_id, {BUCKET})").alias("bucket"))
        own.repartitionByRange("file_id", "location").sortWithinPartitions("file_id", "location").write.parquet(f"{self.path}/{name}/pages")
        # from what was written: texts may have come from files that are dear to read
        written = self.spark.read.schema(own.schema).parquet(f"{self.path}/{name}/pages")
        n = written.count()
        if alone:
            state.bucket = bucket_of(n)
        paged = written.withColumns({"bucket": F.expr(f"file_id - pmod(file_id, {state.bucket})"), "tokens": getattr(self.tokenizer, "joined", self.tokenizer)(F.col("body"))})
        postings_of(paged).write.options(**inverted.WRITTEN).parquet(f"{self.path}/{name}/postings")
        postings = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}/postings")
        # counted once: dealing out by ranges looks at all rows a time before
        counted = postings.groupBy("term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences")).persist(StorageLevel.MEMORY_AND_DISK)
        terms = counted.select("term", "df")
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/{name}/terms")
        ending = terms.select(F.reverse("term").alias("ending"), "term")
        ending.repartitionByRange("ending").sortWithinPartitions("ending").write.parquet(f"{self.path}/{name}/endings")
        total = counted.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
        counted.unpersist()
        return name, {"seq": state.seq, "pages": n, "tokens": total}

    def upsert(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Put the pages of changed files in the place of their old ones, and leave gone files out.

        Every page of a changed file is in ``changed``. Only those pages are tokenised and written, and the old ones of the
        same files read, to take their terms out of the counts.
        """
        state = self._next()
        state.seq += 1
        stale = [x.select("file_id") for x in (changed, gone) if x is not None]
        if state.segments and stale:
            self._delete(reduce(DataFrame.unionByName, stale).where("file_id IS NOT NULL").distinct(), state)
        if changed is not None:
            name, facts = self._write_segment(changed, state, not state.segments)
            if facts["pages"]:
                state.segments[name] = facts
        if (state.segments, state.gone) != (self.state.segments, self.state.gone):
            self._commit(state)

    def _delete(self, stale: DataFrame, state: State) -> None:
        name = f"gone-{uuid.uuid4().hex}"
        stale.write.parquet(f"{self.path}/{name}/files")
        files = self.spark.read.schema("file_id bigint").parquet(f"{self.path}/{name}/files")
        n = files.count()
        if not n:
            return
        old = self.pages().join(self._sent(files, n), "file_id", "left_semi")
        # the array of one binds the tokens to a name; a page's number of tokens goes with its first term
        terms = F.transform(F.array(self.tokenizer(F.col("body"))), lambda ts: F.transform(F.array_distinct(ts), lambda t, i: F.struct(t.alias("term"), F.when(i == 0, F.size(ts)).otherwise(0).alias("tokens"))))[0]
        each = old.select("segment", F.inline(terms)).groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tokens").alias("tokens"))
        each.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/{name}/lost")
        lost = self.spark.read.schema("segment string, tokens bigint").parquet(f"{self.path}/{name}/lost")
        lengths = dict(lost.groupBy("segment").agg(F.sum("tokens")).collect())  # a row a segment
        pages = {r[0]: [r[1], lengths.get(r[0], 0)] for r in old.groupBy("segment").agg(F.count("*")).collect()}
        if pages:
            state.gone[name] = {"seq": state.seq, "files": n}
            state.lost[name] = pages

    def compact(self, whole: bool = False) -> bool:
        """Merge the segments of a tier that is full, or all of them; whether there was anything to merge."""
        by_size = sorted(self.state.segments, key=lambda s: self.state.segments[s]["pages"])
        chosen = by_size if whole else []
        for k in range(len(by_size) - TIER + 1) if not whole else ():
            if self.state.segments[by_size[k + TIER - 1]]["pages"] <= TIER * self.state.segments[by_size[k]]["pages"]:
                chosen = by_size[k : k + TIER]
                break
        if len(chosen) < 2 and not (chosen and self.state.gone):
            return False
        state = self._next()
        # inverting the pages that count costs less than to take the postings apart and group them again
        name, facts = self._write_segment(self.pages(chosen), state, len(chosen) == len(by_size))
        for s in chosen:
            del state.segments[s]
        if facts["pages"]:
            state.segments[name] = facts
        # deletions that no older segment is left for have done their work
        oldest = min((x["seq"] for x in state.segments.values()), default=state.seq)
        state.gone = {g: x for g, x in state.gone.items() if x["seq"] > oldest}
        state.lost = {g: {s: n for s, n in state.lost[g].items() if s in state.segments} for g in state.gone}
        self._commit(state)
        return True

    # reading

    def _sent(self, small: DataFrame, n: int) -> DataFrame:
        return F.broadcast(small) if n <= SENT else small

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (file_id, seq) whose file no later commit has changed."""
        if not self.state.gone:
            return rows
        gone = self._table("files", list(self.state.gone), "file_id bigint").groupBy("file_id").agg(F.max("seq").alias("_at"))
        small = self._sent(gone, sum(x["files"] for x in self.state.gone.values())).withColumnRenamed("file_id", "_file")
        return rows.join(small, (F.col("file_id") == F.col("_file")) & (F.col("seq") < F.col("_at")), "left_anti")

    def pages(self, segments: list[str] | None = None) -> DataFrame:
        """The pages that count: file_id, location, body, bucket, segment, seq."""
        ids = list(self.state.segments) if segments is None else segments
        return self._live(self._table("pages", ids, "file_id bigint, location bigint, body string, bucket bigint"))

    def totals(self) -> tuple[int, int]:
        """Pages and tokens that count."""
        lost = [n for x in self.state.lost.values() for s, n in x.items() if s in self.state.segments]
        return tuple(sum(s[k] for s in self.state.segments.values()) - sum(x[i] for x in lost) for i, k in enumerate(("pages", "tokens")))

    def page_counts(self, terms: list[str]) -> dict[str, int]:
        """The number of pages of each term, by the dictionary."""
        if not terms:
            return {}
        held = self._table("terms", list(self.state.segments), "term string, df bigint").select("term", "df")
        if self.state.gone:
            parts = [self.spark.read.schema("segment string, term string, df bigint").parquet(f"{self.path}/{g}/lost") for g in self.state.gone]
            lost = reduce(DataFrame.unionByName, parts).where(F.col("segment").isin(list(self.state.segments)))
            held = held.unionByName(lost.select("term", (-F.col("df")).alias("df")))
        found = held.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term asked for
        return {t: 0 for t in terms} | {r["term"]: r["df"] for r in found}

    def matching_terms(self, pattern: str) -> DataFrame:
        """``term`` of the dictionary that a leaf's pattern finds: a range of terms or of endings is read, the rest is compared there.

        A pattern of a single sign stands for all terms that hold it.
        """
        ids = list(self.state.segments)
        if not pattern.startswith("^"):
            prefixed = self._table("terms", ids, "term string").where(_between("term", pattern)).select("term")
            ended = self._table("endings", ids, "ending string, term string").where(_between("ending", pattern)).select("term")
            return prefixed.unionByName(ended).distinct()  # terms of such signs are pairs
        begin, end = pattern_bounds(pattern)
        if len(begin) >= len(end):
            found = self._table("terms", ids, "term string").where(_between("term", begin) if begin else F.lit(True))
        else:
            found = self._table("endings", ids, "ending string, term string").where(_between("ending", end[::-1]))
        return found.where(F.col("term").rlike(pattern)).select("term").distinct()

    def found(self, terms: list[str], patterns: list[str], buckets: list[int] | DataFrame | None = None) -> DataFrame:
        """``file_id, location, dl, p0.., w0..`` of pages with any of the terms or patterns, of the given buckets only if any are given."""
        postings = self._table("postings", list(self.state.segments), f"term string, bucket bigint, entries {ENTRY}")
        if isinstance(buckets, list):
            postings = postings.where(F.col("bucket").isin(buckets))
        elif buckets is not None:
            postings = postings.join(buckets, "bucket", "left_semi")
        parts, marks = [postings.where(F.col("term").isin(terms)).withColumn("w", F.lit(None).cast("int"))] if terms else [], []
        for k, p in enumerate(patterns):
            matched = self.matching_terms(p)
            few = [r[0] for r in matched.limit(LITERALS + 1).collect()]
            own = postings.where(F.col("term").isin(few)) if len(few) <= LITERALS else postings.join(matched, "term", "left_semi")
            parts.append(own.withColumns({"term": F.lit(None).cast("string"), "w": F.lit(k)}))
        marks = [F.coalesce(F.max(F.col("w") == k), F.lit(False)).alias(f"w{k}") for k in range(len(patterns))]
        places = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)]
        all_ = reduce(DataFrame.unionByName, parts) if parts else postings.withColumn("w", F.lit(None).cast("int")).limit(0)
        each = self._live(all_.select("term", "w", "segment", "seq", F.inline("entries")))
        return each.groupBy("file_id", "location").agg(F.first("dl").alias("dl"), *places, *marks)

    def bounds(self, query: TextQuery, avgdl: float, idf: dict[str, float]) -> DataFrame:
        """``bucket, bound``: what no page of a bucket can score more than, from the numbers beside the postings alone."""
        parts = []
        for leaf in query.leaves():
            if leaf.pattern:
                matched = self.matching_terms(leaf.pattern)
                rows = self._table("postings", list(self.state.segments), "term string, bucket bigint").join(matched, "term", "left_semi")
                parts.append(rows.groupBy("bucket").agg(F.lit(1.0).alias("bound")))
                continue
            own = self._table("postings", list(self.state.segments), "term string, bucket bigint, most int, shortest bigint").where(F.col("term").isin(list(set(leaf.terms))))
            norm = fulltext.K1 * (1 - fulltext.B + fulltext.B * F.col("shortest") / F.lit(avgdl))
            tf = F.col("most")
            part = sum(idf[t] for t in leaf.terms) * tf * (fulltext.K1 + 1) / (tf + norm)
            # a phrase begins no oftener than its rarest word stands there; pages of one bucket may lie in several rows
            by_term = own.groupBy("bucket", "term").agg(F.max(part).alias("bound"))
            parts.append(by_term.groupBy("bucket").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).where(F.col("n") == len(set(leaf.terms))).drop("n"))
        return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.sum("bound").alias("bound"))

    def _query(self, text: str, plain: bool) -> tuple[TextQuery, float, dict[str, float]]:
        query = TextQuery(text, lambda t: fulltext.query_terms(t, self.tokenizer), plain)
        terms = list(dict.fromkeys(t for x in query.leaves() for t in x.terms))
        n, total = self.totals()
        idf = {t: log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in self.page_counts(terms).items()}
        return query, total / n if n else 1.0, idf

    def rank(self, text: str, plain: bool = False) -> DataFrame:
        """``file_id, location, score`` of all pages that match, unsorted."""
        query, avgdl, idf = self._query(text, plain)
        return self._ranked(query, avgdl, idf, None)

    def _ranked(self, query: TextQuery, avgdl: float, idf: dict[str, float], buckets: list[int] | DataFrame | None) -> DataFrame:
        terms, patterns = list(idf), [x.pattern for x in query.leaves() if x.pattern]
        found = self.found(terms, patterns, buckets)
        return fulltext.scored(found, query, terms, patterns, {t: F.lit(v) for t, v in idf.items()}, F.lit(avgdl))

    def top(self, text: str, limit: int = fulltext.TOP, plain: bool = False) -> DataFrame:
        """The best pages, as ``fulltext.top`` of ``rank``, reading only buckets that can hold one.

        The buckets of the highest bounds are read first; the score of the ``limit``-th page found so far is what a
        bucket's bound must reach for it to be read at all.
        """
        query, avgdl, idf = self._query(text, plain)
        if not query.leaves() or not self.state.segments:
            return self._ranked(query, avgdl, idf, None).limit(0)
        bounds = fulltext.kept(self.bounds(query, avgdl, idf))
        order = [F.col("bound").desc(), F.col("bucket").asc()]
        best: list = []
        floor, seen, below = float("-inf"), 0, None

        def take(buckets: list[int] | DataFrame) -> None:
            nonlocal best, floor
            # rows of three numbers, ``limit`` at most
            more = fulltext.top(self._ranked(query, avgdl, idf, buckets), limit).collect()
            best = sorted([*best, *more], key=lambda r: (-r["score"], r["file_id"], r["location"]))[:limit]
            floor = best[-1]["score"] * (1 - 1e-9) if len(best) == limit else float("-inf")

        def rest() -> DataFrame:
            """Buckets not read yet that can hold a page among the best."""
            left = bounds.where(F.col("bound") >= floor)
            if below is None:
                return left
            bound, bucket = below
            return left.where((F.col("bound") < bound) | ((F.col("bound") == bound) & (F.col("bucket") > bucket)))

        for size in ROUNDS:
            chosen = rest().orderBy(*order).limit(size).collect()
            if not chosen:
                break
            take([r["bucket"] for r in chosen])
            seen, below = seen + len(chosen), (chosen[-1]["bound"], chosen[-1]["bucket"])
        else:
            left = rest()
            n = left.count()
            if n:
                take(self._sent(left.select("bucket"), n))
                seen += n
        self.read = (seen, bounds.count())
        return self.spark.createDataFrame([tuple(r) for r in best], "file_id bigint, location bigint, score double")

    def bodies(self, best: DataFrame) -> DataFrame:
        """``file_id, location, body, score`` of ranked pages; of ``pages`` only their buckets are read."""
        buckets = [r[0] for r in best.select(F.expr(f"file_id - pmod(file_id, {BUCKET})").alias("b")).distinct().limit(LITERALS + 1).collect()]
        pages = self.pages()
        pages = pages.where(F.col("bucket").isin(buckets)) if len(buckets) <= LITERALS else pages
        return pages.select("file_id", "location", "body").join(F.broadcast(best) if len(buckets) <= LITERALS else best, ["file_id", "location"])


def refresh(spark: SparkSession, root: str, known: DataFrame, index: TextIndex) -> DataFrame:
    """Scan a folder and bring its files (path, filename, mtime, md5, file_size, file_id) and index up to date; the new table of files.

    Files are compared and numbered by path, time and fingerprint. Contents are read only of files to index, and where
    they are extracted: the files by their paths if they are few, else all met with shares of the paths, each sent to every task.
    """
    disk = page_sources.documents(spark, root)
    names = ["path", "filename", "mtime", "md5", "file_size"]
    narrow = fulltext.kept(disk.select(*names))
    todo = fulltext.kept(incremental.assign_ids(known, incremental.to_index(narrow, known)))
    n = todo.count()
    wanted = todo.select("path", "file_id")
    parts = []
    if 0 < n <= LITERALS:
        parts.append((page_sources.documents_of(spark, [r["path"] for r in wanted.collect()]).select("path", "content"), wanted))
    else:
        shares = -(-n // SENT)
        parts += [(disk.select("path", "content"), wanted.where(F.pmod(F.xxhash64("path"), F.lit(shares)) == k)) for k in range(shares)]
    texts = [page_sources.extract(files.join(F.broadcast(own.select("path")), "path", "left_semi")).where("error IS NULL").join(F.broadcast(own), "path") for files, own in parts]
    changed = reduce(DataFrame.unionByName, texts).select("file_id", "location", F.col("text").alias("body")) if texts else None
    stale = incremental.gone(known, narrow).select("file_id").unionByName(todo.select("file_id"))
    index.upsert(changed, stale)
    return known.join(stale, "file_id", "left_anti").select("file_id", *names).unionByName(todo.select("file_id", *names))
