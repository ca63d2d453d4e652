"""Full-text search over document pages (file_id, location, body).

A query is answered from a saved index (``text_index``) or, without one, in one scan
that finds the query's terms only; neither shuffles texts. Either way each page gets
the positions of every term of the query, from which matches, phrases and BM25 scores
are plain column arithmetic. Corpus statistics are one row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions import formatting, tokens
from strataseek.plans.text_query import Leaf, Node, TextQuery

K1, B = 1.2, 0.75
#: Pages that a search ranks, and ranked pages (three numbers each) that may be sent to every task.
TOP, SENT = 500, 100_000
#: Tables of queries that stay cached.
KEPT = 4
SNIPPET_BYTES, HIT_BEFORE, HIT_EXTRA = 500, 250, 500


def query_terms(text: str, tokenizer=tokens.words) -> list[str]:
    """The driver's reading of a tokenizer: a run of Han characters becomes the terms that pages hold, side by side."""
    if hasattr(tokenizer, "terms"):
        return tokenizer.terms(text)
    return tokens.words_of(text) if tokenizer is tokens.words else tokens.segment(text)


_WORDS = re.compile(r"[^\W_]+")
_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """A narrow table that is read several times: cached by the executors until ``release`` or until ``KEPT`` later ones are.

    What is lost with an executor, or read after it was let go, is computed again.
    """
    while len(_kept) >= KEPT:
        _kept.pop(0).unpersist()
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def release() -> None:
    """Drop the cached tables of all queries so far."""
    while _kept:
        _kept.pop().unpersist()


def _found_in_pages(pages: DataFrame, terms: list[str], patterns: list[str], tokenizer) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: length, places of the terms and patterns met, of every page; the rest reads that narrow table."""

    def any_like(toks: Column, pattern: str) -> Column:
        return F.exists(toks, lambda t: t.rlike(pattern))

    def wanted(toks: Column) -> Column:
        known = F.transform(toks, lambda t, i: F.struct((F.array_position(F.array(*map(F.lit, terms)), t).cast("int") - 1 if terms else F.lit(-1)).alias("k"), i.alias("i")))
        return F.struct(
            F.size(toks).cast("long").alias("dl"),
            F.filter(known, lambda x: x["k"] >= 0).alias("at"),
            *(any_like(toks, p).alias(f"w{i}") for i, p in enumerate(patterns)),
        )

    # the array of one binds the tokens to a name, so that they are made once
    seen = F.transform(F.array(tokenizer(F.col("body"))), wanted)[0]
    narrow = kept(pages.where(F.trim("body") != "").select("file_id", "location", seen.alias("x")))
    corpus = narrow.agg(F.count("*").alias("n"), F.avg("x.dl").alias("avgdl"))

    def places(i: int) -> Column:
        return F.transform(F.filter("x.at", lambda a: a["k"] == i), lambda a: a["i"])

    columns = [places(i).alias(f"p{i}") for i in range(len(terms))] + [F.col(f"x.w{i}") for i in range(len(patterns))]
    hit = reduce(lambda a, b: a | b, [F.col(f"x.w{i}") for i in range(len(patterns))], F.size("x.at") > 0)
    return narrow.where(hit).select("file_id", "location", F.col("x.dl"), *columns), corpus


def rank(pages: DataFrame, text: str, tokenizer=tokens.words, plain: bool = False) -> DataFrame:
    """``file_id, location, score`` of all pages that match the query, unsorted. The query is read by the same tokenizer as the pages."""
    query = TextQuery(text, lambda t: query_terms(t, tokenizer), plain)
    leaves = query.leaves()
    terms = list(dict.fromkeys(t for x in leaves for t in x.terms))
    patterns = [x.pattern for x in leaves if x.pattern]
    found, corpus = _found_in_pages(pages, terms, patterns, tokenizer)
    at = {t: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, t in enumerate(terms)}
    # document frequencies: one row, from the pages that hold any term
    documents = found.agg(*(F.count_if(F.size(at[t]) > 0).alias(f"df{i}") for i, t in enumerate(terms)), F.count("*").alias("_any"))
    both = found.crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(documents))  # a row each
    idf = {t: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i, t in enumerate(terms)}
    return scored(both, query, terms, patterns, idf, F.col("avgdl"))


def scored(found: DataFrame, query: TextQuery, terms: list[str], patterns: list[str], idf: dict[str, Column], avgdl: Column) -> DataFrame:
    """``file_id, location, score`` of the pages that match, from the places ``p0..`` of the terms, whether patterns ``w0..`` were met, and ``dl``."""
    at = {t: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, t in enumerate(terms)}

    def frequency(leaf: Leaf) -> Column:
        if leaf.pattern:
            return F.coalesce(F.col(f"w{patterns.index(leaf.pattern)}"), F.lit(False)).cast("int")
        first, *rest = leaf.terms
        begins = at[first]
        for k, t in enumerate(rest, 1):  # where a phrase can begin: by its first word, and by each that follows
            begins = F.array_intersect(begins, earlier(at[t], k))
        return F.size(begins)

    def earlier(places: Column, by: int) -> Column:
        return F.transform(places, lambda p: p - by)

    leaves = query.leaves()
    norm = K1 * (1 - B + B * F.col("dl") / avgdl)
    counted = found.select("*", *(frequency(x).alias(f"f{k}") for k, x in enumerate(leaves)))
    flag = {x: F.col(f"f{k}") > 0 for k, x in enumerate(leaves)}
    value = {}
    for k, x in enumerate(leaves):
        tf = F.col(f"f{k}")
        weight = F.lit(1.0) if x.pattern else reduce(lambda a, b: a + b, [idf[t] for t in x.terms]) * tf * (K1 + 1) / (tf + norm)
        value[x] = F.when(flag[x], weight).otherwise(0.0)

    def holds(x: Leaf | Node) -> Column:
        if isinstance(x, Leaf):
            return flag[x]
        out = reduce(lambda a, b: a & b, [holds(p) for p in x.must], F.lit(True))
        if x.should and not x.must:
            out = out & reduce(lambda a, b: a | b, [holds(p) for p in x.should])
        if not x.should and not x.must:
            return F.lit(False)  # a query of exclusions only finds nothing
        return reduce(lambda a, b: a & ~b, [holds(p) for p in x.must_not], out)

    def score(x: Leaf | Node) -> Column:
        if isinstance(x, Leaf):
            return value[x]
        parts = [F.when(holds(p), score(p)).otherwise(0.0) for p in (*x.must, *x.should)]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    return counted.where(holds(query.root)).select("file_id", "location", score(query.root).alias("score"))


def top(ranked: DataFrame, limit: int = TOP) -> DataFrame:
    """The best pages; equal scores by file and page."""
    return ranked.orderBy(F.col("score").desc(), "file_id", "location").limit(limit)


def keyword_count(body: Column, words: list[str]) -> Column:
    """Occurrences of the words among the body's space-separated parts; a repeated word counts again."""
    parts = F.split(body, " ")

    def count(word: str) -> Column:
        return F.size(F.filter(parts, lambda p: p == word))

    return reduce(lambda a, b: a + b, map(count, words), F.lit(0)).cast("long")


def with_hits(pages: DataFrame, words: list[str]) -> DataFrame:
    """Append ``hits`` to pages (file_id, location, body): every occurrence of each word as a substring, with the text around it, cut at whole characters.

    The body is split at the word; the parts' lengths, summed along the body, are the bytes that the occurrences begin at.
    """
    if not words:
        return pages.withColumn("hits", F.array().cast("array<struct<location: int, snippet: string, keyword: string>>"))
    key = [c for c in ("file_id", "location") if c in pages.columns]
    said = F.explode(F.array(*(F.struct(F.lit(i).alias("_word"), F.lit(w).alias("_keyword")) for i, w in enumerate(words))))
    split = pages.select(*key, "body", said.alias("_w")).select(*key, "body", "_w.*")
    # the last part ends the body and begins no occurrence
    parts = split.select(*key, "_word", "_keyword", F.posexplode(F.split("body", F.concat(F.lit("\\Q"), "_keyword", F.lit("\\E")), -1)).alias("_n", "_part"))
    width = F.octet_length("_keyword")
    before = Window.partitionBy(*key, "_word").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    begins = parts.withColumn("_at", F.sum(F.octet_length("_part") + width).over(before) - width).withColumn("_last", F.max("_n").over(Window.partitionBy(*key, "_word")))
    places = begins.where("_n < _last").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_word", "_at", "_keyword"))).alias("_places"))

    def hit(raw: Column, x: Column) -> Column:
        around = formatting.raw_slice(raw, F.greatest(x["_at"] - HIT_BEFORE, F.lit(0)).cast("int"), F.octet_length(x["_keyword"]) + HIT_EXTRA)
        return F.struct(F.col("location").cast("int").alias("location"), around.alias("snippet"), x["_keyword"].alias("keyword"))

    # the array of one binds the bytes to a name, so that they are made once
    hits = F.transform(F.array(F.encode("body", "utf-8")), lambda raw: F.transform(F.coalesce("_places", F.array()), lambda x: hit(raw, x)))[0]
    return pages.join(places, key, "left").withColumn("hits", hits).select(*pages.columns, "hits")


def snippet(body: Column, words: list[str]) -> Column:
    """The first bytes of the body with the words marked, and dots if there is more."""
    cut = formatting.byte_slice(body, F.lit(0), F.lit(SNIPPET_BYTES))
    return formatting.highlight(F.concat(cut, F.when(F.octet_length(body) > SNIPPET_BYTES, "...").otherwise("")), words)


#: Orders of results. ``compat`` of ``sort_results`` sorts names ascending under either name order.
ORDERS = ("relevance", "name_asc", "name_desc", "newest", "oldest", "frequency")


def sort_results(results: DataFrame, order: str = "relevance", compat: bool = False) -> DataFrame:
    name = F.lower("filename")
    keys = {
        "relevance": F.col("score").desc(),
        "name_asc": name.asc(),
        "name_desc": name.asc() if compat else name.desc(),
        "newest": F.col("mtime").desc(),
        "oldest": F.col("mtime").asc(),
        "frequency": F.col("keyword_count").desc(),
    }
    return results.orderBy(keys[order], F.col("score").desc(), "file_id", "location")


def _spoken(text: str, ignore_case: bool = True) -> list[str]:
    """Words to count, mark and show hits of: Han runs stay whole."""
    return _WORDS.findall(text.lower() if ignore_case else text)


def search(source, meta: DataFrame, text: str, order: str = "relevance", limit: int = TOP, hits: bool = True, plain: bool = False, ignore_case: bool = True) -> DataFrame:
    """The whole search: rank, take the best, add file data (pages of unknown files go), counts, hits and snippet, sort.

    ``source`` are pages or a ``TextIndex``. With ``ignore_case`` words are counted and shown in
    the folded body, as they are found; without it in their case (they are found in any). Only the best pages meet the tables of
    bodies and files, so those joins are against ``limit`` rows.
    """
    text = text.strip()
    words = _spoken(" ".join(w for w in text.split() if w not in ("AND", "OR", "NOT")), ignore_case)
    asked = words or "*" in text or "?" in text
    if hasattr(source, "top"):
        out = source.bodies(source.top(text if asked else "", limit, plain))
    else:
        best = top(rank(source, text, plain=plain), limit) if asked else rank(source, "x").limit(0)
        best = F.broadcast(best) if limit <= SENT else best  # rows of three numbers, limit at most
        out = source.select("file_id", "location", "body").join(best, ["file_id", "location"])
    out = out.join(meta.select("file_id", "path", "filename", "mtime", "file_size"), "file_id")
    if ignore_case:
        out = out.withColumn("body", F.lower("body"))
    out = out.withColumns({"keyword_count": keyword_count(F.col("body"), words), "snippet": snippet(F.col("body"), words)})
    if hits:
        out = with_hits(out, words)
    return sort_results(out.drop("body"), order)


def file_count(pages: DataFrame) -> DataFrame:
    """The number of files that have pages."""
    return pages.agg(F.countDistinct("file_id").alias("files"))


def by_file(ranked: DataFrame) -> DataFrame:
    """Extension: the best score and number of pages of each file."""
    return ranked.groupBy("file_id").agg(F.max("score").alias("score"), F.count("*").alias("pages"))
