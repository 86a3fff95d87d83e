"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt into shards of bounded size, which are packed independently, so that work and memory of a task
stay the same at any scale. A shard's pieces are placed largest first, each into the open bin that it fills best. If
none has room, the bin size is opened that costs least per word it can hope to hold; at the end every bin shrinks to
the least costly permitted length that holds its contents. Several limits on the size opened are tried together and
the cheapest packing of the shard stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm.mixing import n_words
from meterlake.llm.scratch import Scratch
from meterlake.llm.words import text_bytes

CAPACITIES = (512, 1024, 2048, 4096)
#: Words of a shard; a shard has at most SHARD_ROWS documents on average.
SHARD_WORDS, SHARD_ROWS = 4_000_000, 8_192
#: Bytes of text of a shard where the sequences themselves are built.
SHARD_BYTES = 8_000_000
#: Bytes of sequences that leave a task at once.
BATCH_BYTES = 1_000_000
#: Between the pieces of a training sequence.
SEPARATOR = "\n\n"
FIELDS = "doc_id bigint, row bigint, piece int, start bigint, words bigint, bin_id bigint, bin_words bigint, capacity bigint, bin_offset bigint"


def sequence_cost(capacity: int) -> float:
    """Cost of one training sequence: linear layers, and attention that equals them at 8,192 words."""
    return capacity * (1 + capacity / 8192)


def _best_fit(sizes: list[int], capacities: tuple[int, ...], cost: Callable[[int], float], limit: int) -> tuple[list[int], list[int], float]:
    """(bin of each piece, contents of each bin, total cost after downsizing) for pieces in decreasing order.

    Sizes over ``limit`` are opened only for pieces that need them.
    """
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    held: list[int] = []
    bins, left = [], sum(sizes)
    for size in sizes:
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, at = rooms.pop(k)
        else:
            fit = [c for c in capacities if c >= size]
            room = min([c for c in fit if c <= limit] or fit, key=lambda c: (cost(c) / min(c, left), -c))
            at = len(held)
            held.append(0)
        bins.append(at)
        held[at] += size
        left -= size
        if room > size:
            insort(rooms, (room - size, at))
    return bins, held, sum(cost(_downsized(x, capacities, cost)) for x in held)


def _downsized(contents: int, capacities: tuple[int, ...], cost: Callable[[int], float]) -> int:
    return min((c for c in capacities if c >= contents), key=lambda c: (cost(c), c))


def pack_shard(sizes: list[int], capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin); ``sizes`` in decreasing order, none above the largest capacity."""
    ways = [(*_best_fit(sizes, capacities, cost, limit), -limit) for limit in capacities]
    bins, held, *_ = min(ways, key=lambda w: w[2:])
    return bins, [_downsized(x, capacities, cost) for x in held]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """One row per piece: doc_id, row, piece, start, words, bin_id, bin_words, capacity, bin_offset.

    A piece is ``words`` words of a text from word ``start`` on, at ``bin_offset`` of bin ``bin_id``, whose permitted
    length is ``capacity`` and whose contents are ``bin_words``. Texts over the largest capacity are cut into full
    pieces and a rest. Every word of every row is in exactly one piece; null or wordless texts have none. Rows that
    repeat an id are packed each (``row`` tells them apart). An empty table gives an empty one; other columns are
    not read.
    """
    capacities = tuple(sorted(capacities))
    scratch = Scratch(docs.sparkSession, "pack")
    sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), n_words(F.col(text)).alias("size")).where("size > 0")
    sized = scratch.keep(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, -(-words // SHARD_WORDS), -(-rows // SHARD_ROWS))
    most = capacities[-1]

    def packed(key, part):
        # whole pieces of the largest capacity fill a bin each
        pieces = [(d, r, k, k * most, min(most, n - k * most)) for d, r, n in zip(part["doc_id"], part["row"], part["size"], strict=True) for k in range(-(-n // most))]
        pieces.sort(key=lambda p: (-p[4], p[1], p[2]))
        bins, sizes = pack_shard([p[4] for p in pieces], capacities, cost)
        out = pd.DataFrame(pieces, columns=["doc_id", "row", "piece", "start", "words"])
        out["bin"] = bins
        out["bin_offset"] = out.groupby("bin")["words"].cumsum() - out["words"]
        out["bin_words"] = out.groupby("bin")["words"].transform("sum")
        out["capacity"] = [sizes[b] for b in bins]
        out["bin_id"] = key[0] * 2**32 + out["bin"]
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out[["doc_id", "row", "piece", "start", "words", "bin_id", "bin_words", "capacity", "bin_offset"]]

    dealt = sized.select("doc_id", "row", "size", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(packed, FIELDS)


def _word_starts(bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where the words of texts data[bounds[k]:bounds[k + 1]] begin; none goes on into the next text."""
    word = (data != 32) & ((data < 9) | (data > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = bounds[:-1][np.diff(bounds) > 0]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    return starts[np.searchsorted(starts, bounds[0]) :]


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """The packed sequences themselves: bin_id, capacity, n_words, pieces, text; one row per bin.

    ``pieces``: doc_id, row, start, words, offset and text of each piece in order; a piece's text is cut from the
    original with all its white space, so that the texts of a row's pieces (``row`` counts within bin_id >> 32), in
    order of start, give its text again. The training text of a bin is its pieces' texts, joined by ``SEPARATOR``.
    ``text``: the words alone, joined by one space, for use with word offsets.
    Texts go to their shard once and are packed there; a task holds a shard's bytes once, beside the places of its
    words, and hands the sequences on in small batches. ``docs`` should be a stored table, so that a repeated task
    numbers its rows alike. Cases as in ``pack``.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("body")).where("body is not null")
    (size,) = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    shards = max(1, -(-size // SHARD_BYTES))

    struct = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("offset", pa.int64()), ("text", pa.string())])
    schema = pa.schema([("bin_id", pa.int64()), ("capacity", pa.int64()), ("n_words", pa.int64()), ("pieces", pa.list_(struct)), ("text", pa.string())])

    def packed(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(parts)
        ids, bodies = part["doc_id"], part["body"].combine_chunks()
        del part
        bounds, data = text_bytes(bodies)
        data = data[: bounds[-1]]
        starts = _word_starts(bounds, data)
        first = np.searchsorted(starts, bounds)
        pieces = [(min(most, n - at), row, at) for row, n in enumerate(np.diff(first).tolist()) for at in range(0, n, most)]
        pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
        bins, sizes = pack_shard([p[0] for p in pieces], capacities, cost)
        held: list[list] = [[] for _ in sizes]
        for b, piece in zip(bins, pieces, strict=True):
            held[b].append(piece)
        rows_out, bytes_out = [], 0
        for b, own in enumerate(held):
            at, out, body = 0, [], []
            for n, row, start in own:
                # white space goes with the word before it, that before the first word with that one
                low = starts[first[row] + start] if start else bounds[row]
                high = starts[first[row] + start + n] if first[row] + start + n < first[row + 1] else bounds[row + 1]
                piece = data[low:high].tobytes()
                out.append({"doc_id": ids[row].as_py(), "row": row, "start": start, "words": n, "offset": at, "text": piece.decode()})
                body += piece.split()
                at += n
                bytes_out += 2 * len(piece)
            rows_out.append({"bin_id": (key[0].as_py() << 32) + b, "capacity": sizes[b], "n_words": at, "pieces": out, "text": b" ".join(body).decode()})
            if bytes_out >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows_out, schema)
                rows_out, bytes_out = [], 0
        yield pa.RecordBatch.from_pylist(rows_out, schema)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(packed, "bin_id bigint, capacity bigint, n_words bigint, pieces array<struct<doc_id bigint, row bigint, start bigint, words bigint, offset bigint, text string>>, text string")
