"""N-gram Jaccard join (operator 10).

A document's row of the incidence matrix is its set of hashed word n-grams (``gram``
words, 3 unless named); two documents link if their sets' Jaccard similarity is at
least ``percent`` hundredths (90 unless named). The matrix product (document by n-gram,
times its transpose) is never formed whole:

1. Equal rows are one class (128-bit digest of the set), so copies cost nothing more.
2. Columns are cut into blocks by hash. Rows of sizes a and b that link differ in at
   most d = (a + b) (100 - percent) / (100 + percent) columns, so all but d blocks are
   identical, and of any order of the blocks that both share, the first d + 1 hold an
   identical one: a row's keys are its d + 1 blocks of most n-grams. Rows that agree in
   none are discarded unseen. The number of blocks depends on the size, so rows are
   sorted into levels of size; a row also enters those above in which a partner may be.
   A block of fewer than two n-grams says little and is cut again by a second hash.
3. Rows that share a key form groups (components). A group of up to
   ``ROWS`` rows is multiplied at once: the sparse product adds up overlaps over blocks of
   columns, and after each, pairs whose overlap can't reach the bound any more are discarded.
   A larger group is cut into blocks of rows, each by itself; then one row of each
   component found is dealt into new blocks, as long as that joins many. In groups that
   still aren't one component, rows meet in the keys they share,
   those outside the largest component there against all; a group's size alone costs nothing.
4. Links leave a task as a forest, never as all pairs; components follow from them. Rows go by
   128-bit keys and digests, classes by numbers of their own.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with words, but fewer than ``gram``,
has that sequence as its one n-gram; an empty or null text has none and links with nothing
(its component is itself). Rows with a null id take part, but name no component; a
component without any id has a null one. Repeated rows get equal results, each its own. A very long
text is one row of the matrix, made in a batch by itself. An empty table gives no rows. Only the id and
text are read for the sets, whatever other columns are called; ``keep_one`` passes all of them on.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.llm.common import map_batches, texts, unused, written_clean
from strataseek.llm.components import components

#: Where a caller names none: similarity (100 * intersection >= PERCENT * union) and words of an n-gram.
PERCENT = 90
GRAM = 3
#: Rows of a block of rows, and entries (on average) of a block of columns, of the sparse product.
ROWS, ENTRIES = 256, 1 << 15
#: A column of up to so many entries adds its pairs one by one; denser ones go through a tile of so many columns.
FEW, COLUMNS = 24, 4096
#: Rows whose n-grams a task holds at once where it computes them, and bytes of their texts.
HELD, HELD_BYTES = 1024, 2 << 20
#: Rows of five numbers that may be sent to every task (some 100 MB) in place of a shuffle of the texts.
SMALL = 2_000_000

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_32 = np.uint64(32)


@cache
def _levels(percent: int) -> list[int]:
    """Smallest sizes of the levels; sets below the first link only when equal."""
    out = [-(-percent // max(1, 100 - percent))]
    while out[-1] < 1 << 40:
        out.append(2 * out[-1])
    return out


def differing(total: int, percent: int = PERCENT) -> int:
    """Columns in which two linked rows of ``total`` n-grams together may differ."""
    return (100 - percent) * total // (100 + percent)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, gram: int = GRAM) -> np.ndarray:
    """Distinct hashed n-grams of a text, ascending."""
    words = text.encode().lower().split()
    n = len(words)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if not n:
        return codes
    m = max(1, n - gram + 1)
    out = np.full(m, n if n < gram else 0, np.uint64)
    for i in range(min(n, gram)):
        out = out * _K[0] + codes[i : i + m]
    return np.unique(mixed(out))


def _blocks(row: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block of columns, the row's n-grams in it: how many, and the sum of their hashes."""
    edges = np.searchsorted(((row >> _32) * np.uint64(parts)) >> _32, np.arange(parts + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(row + _K[3]))])[edges]
    return np.diff(edges), np.diff(sums)


def agreement_keys(row: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of which two rows that link, and aren't equal, share at least one."""
    n, levels = len(row), _levels(percent)
    if n < levels[0]:
        return np.empty(0, np.uint64)
    most = 100 * n // percent  # n-grams of a partner
    again = np.sort(mixed(row ^ _K[2]))
    out = []
    level = bisect_right(levels, n) - 1
    while levels[level] <= most:
        top = levels[level + 1] - 1
        differ = differing(2 * top, percent)
        parts = max(8, differ + 1 + differ // 4)
        taken = differing(n + min(top, most), percent) + 1

        def first(row: np.ndarray, parts: int = parts, taken: int = taken, level: int = level) -> tuple:
            """Number, place and hash of the blocks that come first: those of most n-grams."""
            count, total = _blocks(row, parts)
            at = np.argsort(-count, kind="stable")[:taken]
            return count[at], at.astype(np.uint64) + np.uint64(level << 40), total[at]

        count, place, total = first(row)
        keys = mixed(total * _K[0] + place * _K[1] + count.astype(np.uint64))
        out.append(keys[count >= 2])
        weak = keys[count < 2]
        if len(weak):
            count, place, total = first(again)
            out.append(mixed(weak[:, None] + mixed(total * _K[1] + place * _K[2] + count.astype(np.uint64))).ravel())
        level += 1
    return np.concatenate(out)


def linked(rows: list[np.ndarray], split: int | None = None, labels: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links among ``rows``: pairs of positions, by the blocked sparse product.

    A block holds the columns of one range of hashes, ``ENTRIES`` entries on average. With ``split``, only links between
    rows before and from that position count; rows of equal label are joined already.
    """
    k = len(rows)
    sizes = np.array([len(r) for r in rows])
    alive = np.tri(k, k, -1, dtype=bool).T & (100 * sizes[:, None] >= percent * sizes[None, :]) & (100 * sizes[None, :] >= percent * sizes[:, None])
    if split is not None:
        alive[:split, :split] = alive[split:, split:] = False
    if labels is not None:
        group = np.array(labels)
        alive &= group[:, None] != group[None, :]
    both = sizes[:, None] + sizes[None, :]
    overlap = np.zeros((k, k), np.int64)
    blocks = max(1, -(-int(sizes.sum()) // ENTRIES))
    bounds = np.array([(b << 64) // blocks for b in range(1, blocks)], np.uint64)
    edges = np.array([[0, *np.searchsorted(r, bounds), len(r)] for r in rows])
    for b in range(blocks):
        if not alive.any():
            break
        owner = np.repeat(np.arange(k), edges[:, b + 1] - edges[:, b])
        overlap += _product(owner, np.concatenate([r[e[b] : e[b + 1]] for r, e in zip(rows, edges, strict=True)]), k)
        left = sizes - edges[:, b + 1]
        alive &= (100 + percent) * (overlap + np.minimum(left[:, None], left[None, :])) >= percent * both
    out = []
    root = list(range(k))
    for i, j in zip(*(x.tolist() for x in np.nonzero(alive)), strict=True):
        a, b = _find(root, i), _find(root, j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _find(root: list[int] | dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _joined(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The smallest member of the component of each number in ``pairs``, for those that aren't it."""
    root: dict[int, int] = {}
    for x, y in pairs:
        root.setdefault(x, x)
        root.setdefault(y, y)
        a, b = _find(root, x), _find(root, y)
        root[max(a, b)] = min(a, b)
    return {x: r for x in root if (r := _find(root, x)) != x}


def _product(owner: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Overlaps (upper triangle) of ``k`` rows in one block of columns, from its entries, ordered by owner.

    A column adds one to every pair of its owners: listed where it has few, by a dense tile where it has many.
    """
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(column)))
    out = np.zeros((k, k), np.int64)
    pairs = []
    for n in np.unique(count[(count > 1) & (count <= FEW)]).tolist():
        owners = owner[first[count == n][:, None] + np.arange(n)]
        a, b = np.triu_indices(n, 1)
        pairs.append((owners[:, a] * k + owners[:, b]).ravel())
    if pairs:
        out += np.bincount(np.concatenate(pairs), minlength=k * k).reshape(k, k)
    many = np.flatnonzero(count > FEW)
    for at in range(0, len(many), COLUMNS):
        part = many[at : at + COLUMNS]
        tile = np.zeros((k, len(part)), np.float32)
        for c, m in enumerate(part.tolist()):
            tile[owner[first[m] : first[m] + count[m]], c] = 1
        out += np.rint(tile @ tile.T).astype(np.int64)
    return out


def _offsets(lists: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))


def _listed(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(rows), pa.array(np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)))


#: A row's key, of 128 bits: it finds the row again in a second reading of the table.
KEY = ("row_high", "row_low")


def row_key(id_col: str, text_col: str, names: tuple[str, str] = KEY) -> list[Column]:
    return [F.xxhash64(F.lit(i), F.col(id_col), F.col(text_col)).alias(n) for i, n in enumerate(names)]


def incidence(df: DataFrame, id_col: str, text_col: str, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``id_col``, the row's key, n_shingles, the digest of the set (high, low) and its agreement keys; written once."""
    fields = [("n_shingles", T.LongType()), ("high", T.LongType()), ("low", T.LongType()), ("keys", T.ArrayType(T.LongType()))]

    def make():
        def fn(batch):
            rows = [shingles(t, gram) for t in texts(batch, text_col)]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in rows), np.int64).reshape(-1, 2)
            keys = _listed([agreement_keys(r, percent) for r in rows])
            return [[len(r) for r in rows], pa.array(digests[:, 0]), pa.array(digests[:, 1]), keys]

        return fn

    keyed = df.select(F.col(id_col), F.col(text_col), *row_key(id_col, text_col))
    return written_clean(map_batches(keyed, make, fields, [id_col, *KEY], HELD, HELD_BYTES), "incidence")


def classes_of(table: DataFrame, id_col: str) -> DataFrame:
    """The classes of equal sets: digest, a number of its own (``node``), the smallest id and the key of a row that stands for it; written once."""
    found = table.where("n_shingles > 0").groupBy("high", "low").agg(F.min(id_col).alias("least"), *(F.first(k).alias(k) for k in KEY))
    return written_clean(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def agreeing(table: DataFrame) -> DataFrame:
    """``key, low, first``: the keys that classes share, with each class that has one and the first of them; written once.

    A class goes by the low half of its digest here; two that share it only have both's keys.
    """
    held = table.select(F.explode("keys").alias("key"), "low")
    ends = held.groupBy("key").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last")
    met = written_clean(ends.select("key", "first"), "met")  # read back, so that the join shuffles either side and a hot key's partition can be split
    return written_clean(held.join(met, "key"), "agreeing")


def _products(units: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of labels that links join in a unit of work (``unit, i, j``): each with the smallest of its component there. Rows have side, node, label, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple]) -> pa.RecordBatch:
            rows = sorted({(side, node): (side, node, label, s) for side, node, label, s in rows}.values(), key=lambda r: r[:2])
            split = sum(r[0] == 0 for r in rows)
            pairs = linked([r[3] for r in rows], split if split < len(rows) else None, [r[2] for r in rows], percent) if len(rows) > 1 else []
            root = _joined((rows[i][2], rows[j][2]) for i, j in pairs)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(root), list(root.values()))], names=["u", "v"])

        at, rows = None, []
        for b in batches:
            columns = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("unit", "i", "j", "side", "node", "label")]
            sets = b.column(b.schema.get_field_index("shingles"))
            for k, (unit, i, j, side, node, label) in enumerate(zip(*columns, strict=True)):
                if (unit, i, j) != at:
                    if rows:
                        yield result(rows)
                    at, rows = (unit, i, j), []
                rows.append((side, node, label, sets[k].values.to_numpy().view(np.uint64)))
        if rows:
            yield result(rows)

    dealt = units.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return dealt.mapInArrow(run, "u long, v long")


def _block(*of: Column | str) -> Column:
    """A row's block among as many as the last argument says."""
    return F.pmod(F.xxhash64(*of[:-1]), of[-1]).cast("int")


def _blocks_of(rows: Column) -> Column:
    return F.ceil(rows / ROWS).cast("int")


def links(df: DataFrame, table: DataFrame, classes: DataFrame, id_col: str, text_col: str, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``node, root`` of the classes that agree with others."""
    agreed = agreeing(table)
    star = agreed.where("low <> first").select(F.col("low").alias("u"), F.col("first").alias("v"))
    groups = written_clean(components(star), "groups").select(F.col("node").alias("low"), F.col("root").alias("unit"))
    large = groups.groupBy("unit").agg(F.count("*").alias("members"))
    # one row of each class stands for it; its n-grams are computed again from its text
    wanted = classes.join(groups, "low").join(large, "unit").select(*KEY, "low", "node", "unit", _blocks_of(F.col("members")).alias("blocks"))
    wanted = written_clean(wanted, "wanted")
    found = df.select(F.col(text_col), *row_key(id_col, text_col)).join(_sent(wanted), list(KEY))

    def make():
        def fn(batch):
            rows = [shingles(t, gram) for t in texts(batch, text_col)]
            return [_listed(rows)]

        return fn

    sets = written_clean(map_batches(found, make, [("shingles", T.ArrayType(T.LongType()))], ["node", "unit", "blocks"], HELD, HELD_BYTES), "sets")
    once = [F.lit(0).alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("label"), "shingles"]
    first = sets.select("unit", _block("node", F.col("blocks")).alias("i"), *once)
    labels = _relabelled(wanted.select("low", "node", "unit", F.col("node").alias("label"), "blocks"), _products(first, percent))
    several = labels.where("blocks > 1").drop("blocks")
    rows = several.count()
    for turn in range(1, 64 if rows else 1):
        # groups of several blocks: one row stands for each component found so far, and is dealt anew, as long as that joins many
        heads = several.where("node = label")
        many = heads.groupBy("unit").agg(F.count("*").alias("heads")).where("heads > 1")  # the groups that are not one component yet
        open_ = written_clean(heads.join(many, "unit").select("node", "unit", _blocks_of(F.col("heads")).alias("blocks")), "open")
        before, rows = rows, open_.count()
        if not rows or 2 * rows > before:
            break
        again = sets.select("node", "shingles").join(_sent(open_), "node").select("unit", _block("node", F.lit(turn), F.col("blocks")).alias("i"), *once)
        several = _relabelled(several, _products(again, percent))
    if rows:
        # what is left: rows that share a key, or where that sends fewer rows, of a group, those outside the largest component there against all
        rest = several.join(open_.select("unit").distinct(), "unit").select("low", "unit", "node", "label")
        held = written_clean(agreed.join(rest, "low").select("unit", "key", "node", "label").distinct(), "held")
        by_key, whole = written_clean(_tally(held, "unit", "key"), "tally"), _tally(rest, "unit")
        sent = by_key.groupBy("unit").agg(F.sum("cost").alias("by_key"))
        whole = written_clean(whole.join(sent, "unit").where("cost < by_key").select("unit", "major", "of_few", "of_all"), "whole")
        parts = held.join(by_key.join(whole, "unit", "left_anti"), ["unit", "key"])
        parts = parts.select(F.xxhash64("unit", "key").alias("unit"), "node", "label", "major", "of_few", "of_all")
        met = written_clean(parts.unionByName(rest.drop("low").join(whole, "unit")), "met")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        few = met.where("label <> major").select("unit", _block("node", F.lit(0), F.col("of_few")).alias("i"), each("of_all").alias("j"), F.lit(0).alias("side"), "node", "label")
        every = met.select("unit", each("of_few").alias("i"), _block("node", F.col("of_all")).alias("j"), F.lit(1).alias("side"), "node", "label")
        crossed = sets.select("node", "shingles").join(_sent(written_clean(few.unionByName(every), "crossed")), "node")
        several = _relabelled(several, _products(crossed, percent))
    one = labels.where("blocks = 1").select("node", F.col("label").alias("root"))
    return one.unionByName(several.select("node", F.col("label").alias("root")))


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, to be sent to every task where they are few; else the join shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _tally(rows: DataFrame, *by: str) -> DataFrame:
    """For sets of rows of several labels: the label of most rows, the blocks of the others and of all, and the rows to send to multiply the others by all."""
    n = rows.groupBy(*by, "label").agg(F.count("*").alias("n"))
    n = n.groupBy(*by).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", "n").alias("major")).where("most < n")
    few, of_few, of_all = F.col("n") - F.col("most"), _blocks_of(F.col("n") - F.col("most")), _blocks_of(F.col("n"))
    return n.select(*by, "major", of_few.alias("of_few"), of_all.alias("of_all"), (F.col("n") * of_few + few * of_all).alias("cost"))


def _relabelled(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` with their labels joined by pairs of labels; written once."""
    joined = components(pairs).select(F.col("node").alias("label"), F.col("root").alias("to"))
    found = rows.join(joined, "label", "left").withColumn("label", F.coalesce("to", "label"))
    return written_clean(found.select(*rows.columns), "labels")


def _rooted(df: DataFrame, id_col: str, text_col: str, gram: int, percent: int) -> DataFrame:
    """``id_col``, n_shingles, component_id of every row, the row's key, and ``root``, which tells components without an id or of equal ids apart."""
    table = incidence(df, id_col, text_col, gram, percent)
    classes = classes_of(table, id_col)
    joined = links(df, table, classes, id_col, text_col, gram, percent)
    rooted = classes.select("high", "low", "least", "node").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.select("high", "low", "root").join(named, "root").select("high", "low", "root", "component_id")
    rows = table.select(id_col, *KEY, "n_shingles", "high", "low")
    full = rows.where("n_shingles > 0").join(of_class, ["high", "low"]).select(id_col, "n_shingles", "component_id", *KEY, "root")
    empty = rows.where("n_shingles = 0").select(id_col, "n_shingles", F.col(id_col).alias("component_id"), *KEY, F.lit(None).cast("long").alias("root"))
    return full.unionByName(empty)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles, component_id of every row."""
    return _rooted(df, id_col, text_col, gram, percent).select(id_col, "n_shingles", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each component: the one with the smallest id, or of the smallest key where ids are equal or all null. Rows without words all stay."""
    found = _rooted(df, id_col, text_col, gram, percent).where("n_shingles > 0")
    least = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *KEY)).alias("least")
    own = [unused(df, f"_{k}") for k in KEY]
    first = found.groupBy("root").agg(least).select(*(F.col(f"least.{k}").alias(o) for k, o in zip(KEY, own, strict=True)), F.lit(True).alias("first"))
    times = found.groupBy(*KEY).agg(F.count("*").alias("times")).toDF(*own, "times")
    judged = written_clean(times.join(first, own, "left").select(*own, F.coalesce("first", F.lit(False)).alias("first"), "times"), "judged")
    keyed = df.withColumns(dict(zip(own, row_key(id_col, text_col, own), strict=True)))
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # the texts stay where they are read: the keys of the rows that stay, or of the others, are sent, whichever are fewer
    stay = F.col("first") & (F.col("times") == 1)
    few, how = min(((judged.where(side), how) for side, how in ((stay, "left_semi"), (~stay, "left_anti"))), key=lambda x: x[0].count())
    one = keyed.where(words).join(_sent(few.select(*own)), own, how)
    twice = judged.where("first AND times > 1").select(*own)
    if not twice.isEmpty():  # rows that the table repeats whole
        one = one.unionByName(keyed.where(words).join(twice, own).dropDuplicates(own))
    return one.select(*df.columns).unionByName(df.where(~words))
