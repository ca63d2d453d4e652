"""Sharding by a K-d tree over metadata (operator 9).

The law is ``bytes``: shards get nearly equal bytes. A node that is to become m
shards is cut at the weighted median (or the m/2 : m share) of its widest dimension,
again and again, until a leaf is one shard of about the target bytes. Dimensions
are the texts' length, language (of equal texts the least one that any of them has)
and bytes a character; the text's checksum orders rows of equal coordinate, so that
equal texts stand together and a cut falls between groups of them. Where that leaves the sides too uneven, the next widest
dimension is tried; a group too large for any of them is cut by document id.

Medians are found by narrowing histograms: one aggregation a round over a compact
table (no texts), for all nodes and dimensions of a level together, of a fixed number
of bins; nothing that grows with the rows reaches the driver.

Slots number a shard's rows without gaps: each input split numbers its own rows and
the splits' counts are summed up.

A null text has no bytes (its size is 1), length 0 and checksum 0; a null or
missing language sorts as the empty one. An id that is no whole number goes by its hash where a group is cut. Equal rows get slots
of their own. A very long text is read once, for its numbers, and stays whole in its shard. Only id, text and language are read, whatever other columns are called. An empty table gives an empty result.

The tree becomes nested conditions: meant for thousands of shards, not for millions. A cut that ``LOOSE`` lets pass misses by 2 % of its
node's bytes; over the levels a shard is off by some 12 % at worst, and only where groups of copies hold that much of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.common import written

BINS = 1024
#: Share of a node's bytes by which a cut between groups may miss its aim before the next dimension
#: is tried, and before the group is cut.
CLOSE, LOOSE = 0.002, 0.02
DIMENSIONS = ("length", "language", "density")
#: Coordinates are integers below this; with the checksum they make a key of 62 bits.
SCALE = 1 << 30
#: Texts of several languages that may be sent to every task, five numbers each; more are joined by a shuffle.
SENT = 500_000


@dataclass
class Cut:
    """Rows of a node with key below ``at`` go left; of those at ``at``, ids below ``id_at``."""

    dimension: str
    at: int
    id_at: int | None = None

    def left(self) -> Column:
        below = F.col(f"k_{self.dimension}") < F.lit(self.at)
        if self.id_at is None:
            return below
        return below | ((F.col(f"k_{self.dimension}") == F.lit(self.at)) & (F.col("id_key") < F.lit(self.id_at)))


def compact(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Ids, sizes, checksums, keys of the dimensions and the place in the input, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars, size = F.char_length(text), F.octet_length(text)
    crc = F.crc32(text.cast("binary"))
    named = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in df.columns else F.lit("")
    lang = F.rpad(named, 3, "\0")
    coordinate = {
        "length": F.least(chars, F.lit(SCALE - 1)),
        # three bytes give the order; six bits of a checksum tell longer names apart
        "language": F.conv(F.substring(F.hex(F.encode(lang, "utf-8")), 1, 6), 16, 10).cast("long") * 64 + F.crc32(F.encode(named, "utf-8")).bitwiseAND(63),
        "density": F.floor(size.cast("long") * 100_000 / F.greatest(chars, F.lit(1))),
    }
    number = F.col(id_col).try_cast("long")
    keys = [(F.least(F.greatest(c.cast("long"), F.lit(0)), F.lit(SCALE - 1)) * F.lit(1 << 32) + crc).alias(f"k_{n}") for n, c in coordinate.items()]
    chosen = df.select(
        F.col(id_col).alias("doc_id"),
        (size.cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        *keys,
        F.xxhash64(text).alias("digest"),
        # differences of these keys must fit in 64 bits
        F.when(number.between(-(1 << 61), 1 << 61), number).otherwise(F.shiftright(F.xxhash64(id_col), 2)).alias("id_key"),
        F.monotonically_increasing_id().alias("place"),
    )
    return written(chosen, "shards")


def together(table: DataFrame) -> DataFrame:
    """The table with one language for all rows of a text, the least of them, so that no cut along languages parts equal texts.

    Only texts of several languages are joined; a text that many rows share is a row a task in the aggregation.
    """
    same = ["digest", "text_crc32", "size"]
    mixed = table.groupBy(*same).agg(F.min("k_language").alias("least"), F.max("k_language").alias("most")).where("least < most").drop("most")
    mixed = written(mixed, "shards-languages")
    n = mixed.count()
    if not n:
        return table
    joined = table.join(F.broadcast(mixed) if n <= SENT else mixed, same, "left")
    return written(joined.withColumn("k_language", F.coalesce("least", "k_language")).select(*table.columns), "shards-together")


@dataclass
class Search:
    """The interval of keys in which a cut lies, and the bytes below it."""

    low: int
    high: int
    below: int
    aim: float
    miss: float = math.inf
    at: int | None = None
    heavy: bool = False


def narrowed(table: DataFrame, searches: dict[tuple, Search], key_of: dict[tuple, tuple[Column, Column]], close: dict[tuple, float]) -> None:
    """Narrow every search to a cut: the edge nearest its aim, exact to a single key where need be."""
    pending = dict(searches)
    while pending:
        parts = []
        for name, s in pending.items():
            step = max(1, -(-(s.high - s.low) // BINS))
            where, key = key_of[name]
            inside = where & (key >= F.lit(s.low)) & (key < F.lit(s.high))
            bin_ = F.call_function("div", key - F.lit(s.low), F.lit(step))  # of integers: exact
            parts.append(F.when(inside, F.struct(F.lit(str(name)).alias("name"), bin_.cast("int").alias("bin"))))
        exploded = table.select("size", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x"))
        counts: dict[str, dict[int, int]] = {}
        for r in exploded.groupBy("x.name", "x.bin").agg(F.sum("size").alias("bytes")).collect():
            counts.setdefault(r["name"], {})[r["bin"]] = r["bytes"]
        for name, s in list(pending.items()):
            step, running, found = max(1, -(-(s.high - s.low) // BINS)), s.below, None
            for b, size in sorted(counts.get(str(name), {}).items()):
                if running + size >= s.aim:
                    found = (b, size)
                    break
                running += size
            if found is None:
                s.at, s.miss = s.high, abs(s.aim - running)
                del pending[name]
                continue
            b, size = found
            low, high = s.low + b * step, min(s.high, s.low + (b + 1) * step)
            under, over = s.aim - running, running + size - s.aim
            if step == 1 or min(under, over) <= close[name] / 4:
                s.at, s.miss = (low, under) if under <= over else (high, over)
                s.heavy, s.below = step == 1, running
                if step == 1:
                    s.low = low
                del pending[name]
            else:
                s.low, s.high, s.below = low, high, running


def plan(table: DataFrame, shards: int) -> dict[int, tuple[Cut, int, int]]:
    """The tree: node -> (cut, left child's shards, right child's shards); node n has children 2n and 2n+1, the root is 1."""
    tree: dict[int, tuple[Cut, int, int]] = {}
    level = {1: shards}
    extent: dict[str, float] = {}
    while any(m > 1 for m in level.values()):
        node = node_column(tree)
        placed = table.withColumn("node", node)
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(f"k_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max)))).collect()}
        if not extent:
            root = stats.get(1)
            extent = {d: max(1, (root[f"max_{d}"] >> 32) - (root[f"min_{d}"] >> 32)) if root else 1 for d in DIMENSIONS}
        searches: dict[tuple, Search] = {}
        key_of, close = {}, {}
        for n, m in level.items():
            if m > 1 and n in stats:
                s, share = stats[n], (m // 2) / m
                for d in DIMENSIONS:
                    searches[n, d] = Search(s[f"min_{d}"], s[f"max_{d}"] + 1, 0, s["bytes"] * share)
                    key_of[n, d] = (F.col("node") == n, F.col(f"k_{d}"))
                    close[n, d] = CLOSE * s["bytes"]
        narrowed(placed, searches, key_of, close)
        split: dict[tuple, Search] = {}
        following: dict[int, int] = {}
        for n, m in level.items():
            if m == 1:
                continue
            following |= {2 * n: m // 2, 2 * n + 1: m - m // 2}
            if n not in stats:
                tree[n] = (Cut(DIMENSIONS[0], 0), m // 2, m - m // 2)
                continue
            s = stats[n]
            width = lambda d, s=s: ((s[f"max_{d}"] >> 32) - (s[f"min_{d}"] >> 32)) / extent[d]
            widest = sorted(DIMENSIONS, key=lambda d: (-width(d), DIMENSIONS.index(d)))
            near = [d for d in widest if searches[n, d].miss <= CLOSE * s["bytes"]]
            d = near[0] if near else min(widest, key=lambda d: searches[n, d].miss)
            found = searches[n, d]
            tree[n] = (Cut(d, found.at), m // 2, m - m // 2)
            if found.miss > LOOSE * s["bytes"] and found.heavy:  # a group too heavy for either side
                split[n, d] = found
        if split:
            ids = {}
            for (n, d), found in split.items():
                here = (F.col("node") == n) & (F.col(f"k_{d}") == F.lit(found.low))
                r = placed.where(here).agg(F.min("id_key").alias("a"), F.max("id_key").alias("b")).first()
                ids[n, d] = Search(r["a"], r["b"] + 1, found.below, found.aim)
                key_of[n, d] = (here, F.col("id_key"))
            narrowed(placed, ids, key_of, close)
            for (n, d), s in ids.items():
                tree[n] = (Cut(d, split[n, d].low, s.at), *tree[n][1:])
        level = following | {n: 1 for n, m in level.items() if m == 1}
    return tree


def node_column(tree: dict[int, tuple[Cut, int, int]], at: int = 1) -> Column:
    """The leaf, or node not yet cut, that a row falls into."""
    if at not in tree:
        return F.lit(at)
    return F.when(tree[at][0].left(), node_column(tree, 2 * at)).otherwise(node_column(tree, 2 * at + 1))


def shard_column(tree: dict[int, tuple[Cut, int, int]], at: int = 1, first: int = 0) -> Column:
    """The shard of a row, leaves numbered from the left."""
    if at not in tree:
        return F.lit(first)
    cut, left, _ = tree[at]
    return F.when(cut.left(), shard_column(tree, 2 * at, first)).otherwise(shard_column(tree, 2 * at + 1, first + left))


def shard(df: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    table = together(compact(df, id_col, text_col, lang_col))
    if target_bytes is not None:
        total = table.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    tree = plan(table, shards)
    placed = table.select("doc_id", "size", "text_crc32", shard_column(tree).cast("int").alias("shard"), "place", F.shiftright("place", 33).alias("split"))
    counts = placed.groupBy("shard", "split").agg(F.count("*").alias("n"))  # one row a shard and input split
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "split", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "split").orderBy("place"))
    numbered = placed.withColumn("rank", rank).join(offsets, ["shard", "split"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
