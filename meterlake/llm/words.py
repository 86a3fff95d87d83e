"""Words, shingles and 64-bit hashes of whole Arrow text columns, vectorised.

A word is a run of bytes outside ``\x20`` and ``\x09-\x0D``; in UTF-8 that equals the same run of characters.
Equal byte strings have equal hashes; different ones collide with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_HASH = np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=U64)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
#: Bytes of text that are hashed at once, unless one document is longer.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    return bounds, np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)


@dataclass
class Words:
    """Words of some consecutive rows of a column."""

    row: int  #: first row
    rows: int
    data: np.ndarray
    bounds: np.ndarray  #: of the rows in data
    doc: np.ndarray  #: of each word, from 0 to rows - 1
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def per_row(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)


def chunks(bounds: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, side="right")) - 1)
        yield low, high
        low = high


def split(column: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Iterator[Words]:
    """Words of every row of ``column``; ``lower`` turns A-Z into a-z first, ``space`` marks the bytes between words."""
    bounds, data = text_bytes(column)
    powers = inverses = np.ones(0, U64)
    for low, high in chunks(bounds):
        part = data[bounds[low] : bounds[high]]
        part = LOWER[part] if lower else part
        own = bounds[low : high + 1] - bounds[low]
        n = len(part)
        if len(powers) < n:
            powers, inverses = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, x, U64)])) for x in (BASE, BASE_INVERSE))
        inside = ~space[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = own[1:] > own[:-1]
        begins, ends = own[:-1][filled], own[1:][filled] - 1
        first[begins], last[ends] = inside[begins], inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_HASH[part] * powers[:n], out=sums[1:])
        doc = np.searchsorted(own, start, side="right") - 1
        yield Words(low, high - low, part, own, doc, start, end, mixed((sums[end] - sums[start]) * inverses[start]))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``size`` words inside one row."""
    n = len(words.doc) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    value = np.full(len(first), size, U64)
    for k in range(size):
        value = value * BASE + words.hash[first + k]
    return first, mixed(value)


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, sorted; fewer words than ``size`` make one shingle."""
    first, value = windows(words, size)
    docs, values = [words.doc[first]], [value]
    counts = words.per_row()
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    for few in range(1, size):
        rows = np.flatnonzero(counts == few)
        value = np.full(len(rows), few, U64)
        for k in range(few):
            value = value * BASE + words.hash[begins[rows] + k]
        docs.append(rows)
        values.append(mixed(value))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id's text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def first_by_hash(rows: DataFrame, group: str, place: str, count: int, groups: int = 1_000) -> DataFrame:
    """Of each group the ``count`` rows that come first by ``place``, a 64-bit hash; equal hashes count once.

    A threshold from the number of distinct hashes leaves some four times as many rows before anything is shuffled,
    so no group meets in one task as a whole. Null groups are left out. The driver gets one number a group, and deals
    them out again; more than ``groups`` groups are an error, as none is ever dropped.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.approx_count_distinct(place).alias("__n"))
    found = sizes.limit(groups + 1).collect()
    if len(found) > groups:
        raise ValueError(f"more than {groups} values of {group}")
    share = F.least(F.lit(1.0), F.lit(4.0 * (count + 25)) / F.greatest(F.lit(1), F.col("__n")))
    counted = rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, sizes.schema)), group)
    others = [c for c in rows.columns if c not in (group, place)]
    kept = counted.where(F.col(place) / 2.0**64 + 0.5 <= share)
    one = kept.groupBy(group, place).agg(*([F.min(F.struct(*others)).alias("row")] if others else []))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(place))).where(F.col("rank") <= count)
    return ranked.select(group, place, *(f"row.{c}" for c in others))


def with_columns(docs: DataFrame, text: str, fields: str, carry: list[str] | None, make: Callable[[], Callable]) -> DataFrame:
    """Appends columns computed from a text column, batch by batch.

    ``make()`` runs once a task and returns a function from an Arrow text column to one Arrow array for each of
    ``fields``. ``carry``: columns to keep (None: all). A kept column that has the name of a new one gives way.
    """
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([f for f in source.schema.fields[:-1]] + new.fields)

    def run(batches):
        compute = make()
        for batch in batches:
            columns = [batch.column(k) for k in range(len(kept))] + list(compute(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
