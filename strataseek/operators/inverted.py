"""Inversion of rows of terms where they are read, a portion of rows at a time: a row for each term and group of ids, not for each term of a row.

A helper of the saved indexes; it runs in ``mapInArrow``. What comes of a portion is sorted; Spark deals the rows out and writes
the portions one after the other, so that a task's memory is that of a portion, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that are inverted at once, which bounds a task's memory; a row of more comes by itself. Rows that are handed back at once.
PORTION, HANDED = 4_000_000, 50_000
#: Trigrams of names that are inverted at once: a name has many, and its index gains nothing from more.
NAMED = 1_000_000
#: How to write what comes of portions: pages of so few rows that a lookup reads a term's place in each portion.
WRITTEN = {"parquet.page.row.count.limit": "2000"}


def portions(batches: Iterator[pa.RecordBatch], lists: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of up to ``PORTION`` elements (``most``, if that is less) of the column ``lists``: large batches cut, small ones put together."""
    held, n, most = [], 0, min(most or PORTION, PORTION)
    for batch in batches:
        ends, at = np.cumsum(_sizes(batch.column(lists))), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, most - n + before, side="right"))
            if upto <= at:
                if held:
                    yield _joined(held)
                    held, n = [], 0
                    continue
                upto = at + 1
            held.append(batch.slice(at, upto - at))
            n, at = n + int(ends[upto - 1]) - before, upto
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _handed(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    made = pa.RecordBatch.from_pydict(columns)
    for at in range(0, made.num_rows, HANDED):
        yield made.slice(at, HANDED)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _cut(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _by_term(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms, and of each term of the lists, by terms: its number, its row, its place in the row."""
    sizes, flat = _sizes(lists), lists.flatten()
    encoded = flat.dictionary_encode("encode")
    order = pc.sort_indices(encoded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    # number and place in one integer: sorted faster than by an order of places
    keys = np.sort((rank[encoded.indices.to_numpy(zero_copy_only=False)] << 32) | np.arange(len(flat)))
    at = keys & 0xFFFFFFFF
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    return encoded.dictionary.take(order), keys >> 32, row, at - (np.cumsum(sizes) - sizes)[row]


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers that tell a column's values, nulls too, apart."""
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with lists of tokens, where each row's came as one text with spaces between them."""
    at = batch.schema.get_field_index("tokens")
    if not pa.types.is_string(batch.schema.field(at).type):
        return batch
    texts = pc.ascii_trim(batch.column(at), " ")
    lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts), " ")
    return batch.set_column(at, "tokens", lists)


def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of pages (file_id, location, bucket, tokens: a list, or a text with spaces between them): term, bucket, n, most, shortest, occurrences, entries by file and page."""
    for batch in portions(map(_listed, batches), "tokens"):
        batch = batch.take(pc.sort_indices(batch, [("file_id", "ascending"), ("location", "ascending")], null_placement="at_start"))
        words, term, page, place = _by_term(batch.column("tokens"))
        if not len(term):
            continue
        first = _starts(term, page)
        times, term, page = np.diff(np.append(first, len(term))), term[first], page[first]
        dl = _sizes(batch.column("tokens"))[page]
        rows = _starts(term, _numbers(batch.column("bucket"))[page])
        own = [batch.column(c).take(pa.array(page)) for c in ("file_id", "location")]
        entries = pa.StructArray.from_arrays([*own, pa.array(dl), _cut(first, pa.array(place, pa.int32()))], ["file_id", "location", "dl", "positions"])
        made = {
            "term": words.take(pa.array(term[rows])),
            "bucket": batch.column("bucket").take(pa.array(page[rows])),
            "n": pa.array(np.diff(np.append(rows, len(term)))),
            "most": pa.array(np.maximum.reduceat(times, rows), pa.int32()),
            "shortest": pa.array(np.minimum.reduceat(dl, rows)),
            "occurrences": pa.array(np.add.reduceat(times, rows)),
            "entries": _cut(rows, entries),
        }
        yield from _handed(made)


def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (file_ord, block, grams), grams different in each row: gram, block, piece, rows (sorted). A row's grams are of one piece, named by its least row."""
    for batch in portions(batches, "grams", NAMED):
        batch = batch.take(pc.sort_indices(batch, [("file_ord", "ascending")]))
        words, gram, row, _ = _by_term(batch.column("grams"))
        if not len(gram):
            continue
        ids = batch.column("file_ord")
        first = _starts(gram, _numbers(batch.column("block"))[row])
        made = {
            "gram": words.take(pa.array(gram[first])),
            "block": batch.column("block").take(pa.array(row[first])),
            "piece": ids.take(pa.array(np.zeros(len(first), np.int64))),
            "rows": _cut(first, ids.take(pa.array(row))),
        }
        yield from _handed(made)
