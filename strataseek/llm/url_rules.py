"""URL filters by a sort-merge range join (operator 5).

A host becomes a canonical key, its labels reversed and each closed by a dot
(``www.example.com`` -> ``com.example.www.``), so a rule's host and all its
subdomains are one interval of keys, and intervals nest or are apart. Pages are
sorted by key; a sweep keeps the stack of rules whose interval is open and picks,
among those whose path begins the page's path, the longest rule (host and path
together, then the longer host).

A rule table below a checked size goes to every task, and pages are sorted where
they are. A larger one is dealt out with the pages by ranges of the key: bounds come
from a sample of the keys, a rule is copied to every range that its interval
touches, and a key that fills several ranges (one hot host) is spread over them.

A null url, or one without ``://``, has an empty host and path. Repeated urls are
judged alike, each row its own. Without a fitting rule, ``rule`` is null and the default verdict holds. A rule with a
null host, path or verdict fits nothing; of rules of equal host and path the greatest verdict counts. Urls of any length are read
whole. Only the id and url are read, whatever other columns are called; without pages the result is empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules and bytes of rules that may go to every task.
MAX_RULES, MAX_RULE_BYTES = 100_000, 16 << 20
#: Keys sampled for each range when rules are dealt out.
SAMPLE_PER_RANGE = 100

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return key_of(self.host)


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_column(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


class Sweep:
    """The stack of open rules at the current key; keys and rules must come in order."""

    def __init__(self):
        self.open: list[tuple[str, dict[str, Rule], set[int]]] = []

    def close_to(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def push(self, key: str, rule: Rule) -> None:
        self.close_to(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, set()))
        _, of_path, sizes = self.open[-1]
        of_path[rule.path] = max(rule, of_path.get(rule.path, rule))
        sizes.add(len(rule.path))

    def best(self, key: str, path: str) -> Rule | None:
        self.close_to(key)
        fits = [of_path[path[:n]] for _, of_path, sizes in self.open for n in sizes if n <= len(path) and path[:n] in of_path]  # a lookup for each length of path
        return max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict), default=None)


def swept(rows: Iterable[tuple], rules: Iterator[tuple[str, Rule]], default: str) -> Iterator[tuple[str | None, str]]:
    """Rule and verdict of each (key, path), both streams in order of key."""
    sweep, coming = Sweep(), next(rules, None)
    for key, path in rows:
        while coming and coming[0] <= key:
            sweep.push(*coming)
            coming = next(rules, None)
        best = sweep.best(key, path)
        yield (best.host + best.path, best.verdict) if best else (None, default)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """``id_col``, host, path, rule and verdict of every page; ``rules`` has host, path, verdict."""
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    keyed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = keyed.withColumn("key", key_column(F.col("host")))
    schema = T.StructType([pages.schema[id_col], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))])
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0)).alias("bytes")).first()
    if size["n"] <= max_rules and size["bytes"] <= MAX_RULE_BYTES:
        table = sorted((key_of(r["host"]), Rule(r["host"], r["path"], r["verdict"])) for r in rules.select("host", "path", "verdict").collect())
        return _near(keyed, table, id_col, default, schema)
    return _dealt(keyed, rules, id_col, default, schema)


def _batch(ids: list, rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, pa.string()) for c in columns)], names=names)


def _near(keyed: DataFrame, table: list[tuple[str, Rule]], id_col: str, default: str, schema: T.StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[pa.RecordBatch, list, list]] = []

        def rows():
            for b in batches:
                columns = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("host", "path", "key")}
                kept.append((b, columns["host"], columns["path"]))
                yield from zip(columns["key"], columns["path"], strict=True)

        answers = swept(rows(), iter(table), default)
        for first in answers:  # the first answer of a batch has read that batch
            b, hosts, paths = kept.pop()
            rest = [first, *(next(answers) for _ in range(b.num_rows - 1))]
            ids = b.column(b.schema.get_field_index(id_col))
            out = [ids, pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([r for r, _ in rest], pa.string()), pa.array([v for _, v in rest], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return keyed.sortWithinPartitions("key").mapInArrow(run, schema)


def _dealt(keyed: DataFrame, rules: DataFrame, id_col: str, default: str, schema: T.StructType) -> DataFrame:
    spark = keyed.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.xxhash64(F.col(id_col).cast("string"), F.col("path"))
    sample = sorted(r[0] for r in keyed.orderBy(salt, "key").limit(SAMPLE_PER_RANGE * ranges).select("key").collect())
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    @F.pandas_udf(T.IntegerType())
    def page_range(key, salted):  # a key that fills several ranges is spread over them
        out = []
        for k, s in zip(key, salted, strict=True):
            low, high = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(low + int(s) % (high - low + 1))
        return type(key)(out)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def rule_ranges(key):
        return type(key)([list(range(bisect_left(bounds, k), bisect_right(bounds, k[:-1] + "/") + 1)) for k in key])

    page_rows = keyed.select(page_range("key", salt).alias("range"), "key", F.lit(1).alias("page"), "host", "path", F.lit(None).cast("string").alias("verdict"), F.col(id_col).alias("id"))
    own = rules.select("host", "path", "verdict").withColumn("key", key_column(F.col("host")))
    rule_rows = own.select(F.explode(rule_ranges("key")).alias("range"), "key", F.lit(0).alias("page"), "host", "path", "verdict", F.lit(None).cast(keyed.schema[id_col].dataType).alias("id"))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, at = Sweep(), None
        for b in batches:
            ids, out = [], []
            for rng, key, page, host, path, verdict, ident in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("range", "key", "page", "host", "path", "verdict", "id")), strict=True):
                if rng != at:
                    sweep, at = Sweep(), rng
                if not page:
                    sweep.push(key, Rule(host, path, verdict))
                    continue
                best = sweep.best(key, path)
                ids.append(ident)
                out.append((host, path, best.host + best.path, best.verdict) if best else (host, path, None, default))
            yield _batch(ids, out, b.schema.field("id").type, names)

    both = page_rows.unionByName(rule_rows).repartition(ranges, "range").sortWithinPartitions("range", "key", "page")
    return both.mapInArrow(run, schema)
