"""What five filters remove in every order, by a Walsh-Hadamard transform.

A document's failures are a mask of five bits. Per part and label the documents are
summed up as 32 signed parities - for every set of filters, how many fail an even
number of it less how many fail an odd number - and nothing else. The transform is
its own inverse but for a factor of 32, so the parities give back the exact number of
documents of each mask, and from those 32 cells every order, step and Shapley sum
follows by arithmetic: a document that fails k filters is removed by each of them in
120 / k of the 120 orders.

Everything is built-in functions. Texts are reduced to a mask and a digest where they
are read; equal texts meet as one row for each part and label.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200


def failures(text: Column) -> Column:
    """The mask of the filters A to D, which look at one text."""
    # the array of one binds the words to a name, so that they are made once
    words = F.array(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    few_or_same = F.transform(words, lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0))[0]
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return few_or_same + F.when(100 * capitals > 2 * F.char_length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _odd(mask: Column, subset: int) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(subset))).cast("int").bitwiseAND(F.lit(1))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, mask, n``: failures of all documents, those of the fifth filter found over the whole table.

    Rows of one text are first counted by id, so that the least id's own rows can be told from the later ones; a
    text that a third of the table shares is then a row for each task, part and label.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"), F.sha2(text, 256).alias("digest"))
    # rows without an id are dealt out by their text
    seen = seen.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("long")))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    both = seen.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    kinds = ["digest", "part", "good", "toxic", "mask"]
    by_id = both.groupBy("doc_id", "salt", *kinds).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    by_text = by_id.groupBy(*kinds).agg(first, F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("least", least).withColumn("fresh", fresh)
    cells = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    return split.select("part", "good", "toxic", F.inline(cells)).where("n > 0")


def parities(cells: DataFrame) -> DataFrame:
    """``part, good, toxic, w``: the 32 signed parity sums of each part and label."""
    sums = [F.sum(F.col("n") * (1 - 2 * _odd(F.col("mask"), s))).alias(f"w{s}") for s in range(MASKS)]
    return cells.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*(f"w{s}" for s in range(MASKS))).alias("w"))


def inverted(w: Column) -> Column:
    """The number of documents of each mask, from the parity sums."""
    signed = lambda m: F.transform(w, lambda x, s: x * (1 - 2 * F.bit_count(s.bitwiseAND(m)).cast("int").bitwiseAND(F.lit(1))))
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: (F.aggregate(signed(m), F.lit(0).cast("long"), lambda a, x: a + x) / MASKS).cast("long"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Defined results: a null text counts as empty, a null source is the part ''; rows without id have no label and are
    never later copies, nor make others so; a label holds if any of the id's rows in ``labels`` says 1; repeated rows
    count each, and rows of one id and text are no copies of each other. An empty table gives no rows. Other columns
    are not read. A very long text is one row's work; nothing but its digest leaves the task.
    """
    each = parities(counted(docs, labels)).select("part", "good", "toxic", inverted(F.col("w")).alias("cell"))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    totals = [F.array(*(F.coalesce(F.sum(F.when(holds, F.col("cell")[m])), F.lit(0)) for m in range(MASKS))).alias(k) for k, holds in kinds.items()]
    cells = each.groupBy("part").agg(*totals)
    # the orders as one literal: 120 rows for each part, then five steps for each
    steps = cells.select("*", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    before = F.expr(f"aggregate(sequence(0, 4), 0, (a, i) -> a + CASE WHEN i + 1 < step THEN shiftleft(1, locate(substring(filter_order, i + 1, 1), '{FILTERS}') - 1) ELSE 0 END)")
    own = F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{FILTERS}') - 1)")
    steps = steps.withColumns({"before": before, "own": own})

    def over(cell: str, condition: str, weight: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (a, m) -> a + CASE WHEN {condition} THEN {weight} * {cell}[m] ELSE 0L END)")

    fails, gone = "m & own <> 0", "m & before <> 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        over("all", "m & (before | own) = 0").alias("kept"),
        over("all", f"{fails} AND NOT {gone}").alias("removed"),
        over("all", f"{fails} AND {gone}").alias("redundant"),
        over("all", "m = own").alias("unique_fails"),
        over("good", f"{fails} AND NOT {gone}").alias("good_lost"),
        over("toxic", f"{fails} AND NOT {gone}").alias("toxic_lost"),
        over("all", fails, f"({len(ORDERS)} div bit_count(m))").alias("shapley"),
    )
