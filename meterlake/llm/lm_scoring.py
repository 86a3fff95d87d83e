"""Language-model scoring with a weighted backoff automaton over word n-grams up to three, counted in the whole corpus.

The automaton's states are the empty history, every word and every word pair of the training texts. State ``u v`` has
an arc for each training trigram ``u v w``, with the log of its smoothed probability, and a failure arc to state ``v``,
with the log of the mass that smoothing keeps for unseen words; ``v`` has arcs for its bigrams and a failure arc to the
empty state, which has an arc for each training word and one for all others. Smoothing is interpolation with a prior:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(v w) + PRIOR[0] * p(w)) / (c(v) + PRIOR[0])           failure arc: PRIOR[0] / (c(v) + PRIOR[0])
    p(w | u v) = (c(u v w) + PRIOR[1] * p(w | v)) / (c(u v) + PRIOR[1])   failure arc: PRIOR[1] / (c(u v) + PRIOR[1])

Each sums to one over the training words and one unknown word. The automaton of a large corpus fits no single
machine, so blocks of documents fetch the part they walk through: each block sends its distinct words and n-grams, as
hashes in order, with its own counts, to hash buckets; the buckets add the counts of all blocks and answer each. Then
a block's texts are walked left to right. No training count is cut off or sampled.

Words go by 64-bit hashes. Hashes of n-grams have 20 bits more than it takes to number the corpus' tokens, so that a
given n-gram has another one's hash, and its count with it, with a chance of 2**-20 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W
from meterlake.llm.scratch import Scratch

#: Words of prior for bigrams and trigrams; of the pairs tried, the one whose model scores unseen texts best.
PRIOR = (50.0, 50.0)
#: Words after which a block is closed; it bounds the memory of a task.
BLOCK_WORDS = 500_000
#: Distinct words and n-grams of a bucket, on average.
BUCKET_KEYS = 1_000_000
SPARE_BITS = 20
END = np.uint64(0x5BD1E9955BD1E995)  # stands for the end of a text
PARTS = ("ids", "nulls", "held", "lengths", "vocabulary", "tokens")
BLOCK_FIELDS = "block bigint, " + ", ".join(f"{x} binary" for x in PARTS) + ", n_keys bigint, train_tokens bigint, n_tokens bigint"
RESULT_FIELDS = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
U64 = np.uint64


def squeezed(x: np.ndarray) -> bytes:
    """Integers by byte plane, so that zero bytes meet, and compressed; after their number."""
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def restored(data: bytes, kind) -> np.ndarray:
    width, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    plain = pa.decompress(data[8:], n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(sorted_keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return squeezed(np.diff(sorted_keys, prepend=U64(0)))


def climbed(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data, U64), dtype=U64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, held, body) to blocks of tokens; each text ends with END."""
    ids, nulls, held, lengths, hashes, size, made = [], [], [], [], [], 0, 0

    def block() -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        length, out = np.concatenate(lengths).astype(np.uint32), np.concatenate(held)
        # nearly all trigrams of a block are distinct; the number only sets how many buckets there are
        n_keys = len(vocabulary) + len(np.unique(tokens[:-1] * len(vocabulary) + tokens[1:])) + len(tokens)
        parts = [squeezed(x) for x in (np.concatenate(ids), np.concatenate(nulls), out, length)] + [steps(vocabulary), squeezed(tokens.astype(np.uint32))]
        # numbered by task: blocks are read back from the written table, which holds one attempt of each task
        name = (TaskContext.get().partitionId() << 32) + made
        columns = [pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in parts), *(pa.array([int(x)], pa.int64()) for x in (n_keys, length[~out].sum(), len(tokens)))]
        return pa.RecordBatch.from_arrays(columns, names=["block", *PARTS, "n_keys", "train_tokens", "n_tokens"])

    for batch in batches:
        row = 0
        for part in W.split(batch.column(2), lower=True):
            n = part.per_row()
            all_hashes = np.full(len(part.hash) + part.rows, END, U64)
            all_hashes[np.arange(len(part.hash)) + part.doc] = part.hash
            own = batch.slice(row, part.rows)
            ids.append(own.column(0).fill_null(0).to_numpy()), nulls.append(own.column(0).is_null().to_numpy(zero_copy_only=False))
            held.append(own.column(1).to_numpy(zero_copy_only=False)), lengths.append(n + 1), hashes.append(all_hashes)
            row += part.rows
            size += len(all_hashes)
            if size >= BLOCK_WORDS:
                yield block()
                made += 1
                ids, nulls, held, lengths, hashes, size = [], [], [], [], [], 0
    if size:
        yield block()


class Block:
    """A block read back: its documents, tokens, and distinct words, bigrams and trigrams in the order of their hashes."""

    def __init__(self, row: dict, bits: int):
        self.name = row["block"]
        self.ids, self.nulls, self.held = restored(row["ids"], np.int64), restored(row["nulls"], bool), restored(row["held"], bool)
        self.lengths = restored(row["lengths"], np.uint32).astype(np.int64)
        self.tokens = restored(row["tokens"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        vocabulary = climbed(row["vocabulary"])
        trained = np.repeat(~self.held, self.lengths)
        #: of each order: distinct keys, their training counts here, and the key that ends at a token, -1 without one
        self.keys, self.counts, self.at = [vocabulary], [np.bincount(self.tokens[trained], minlength=len(vocabulary))], [self.tokens]
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)
        full = hashes = vocabulary[self.tokens]
        for order in (2, 3):
            full = W.mixed(np.concatenate([np.zeros(1, U64), full[:-1]]) * W.BASE + hashes + U64(order))
            some = np.flatnonzero(place >= order - 1)
            keys, of = np.unique(full[some] >> U64(64 - bits), return_inverse=True)
            at = np.full(len(self.tokens), -1)
            at[some] = of
            self.keys.append(keys), self.counts.append(np.bincount(of[trained[some]], minlength=len(keys))), self.at.append(at)


def _requests(n_buckets: int, bits: int):
    """Blocks to (bucket, block, kind, keys, counts): a bucket is a range of hashes."""
    edges = {width: np.array([-(-(k << width) // n_buckets) for k in range(1, n_buckets)], dtype=U64) for width in (64, bits)}

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, bits)
                for kind, (keys, counts) in enumerate(zip(block.keys, block.counts, strict=True), 1):
                    cut = [0, *np.searchsorted(keys, edges[64 if kind == 1 else bits], side="left"), len(keys)]
                    chunks = [(k, steps(keys[a:b]), squeezed(counts[a:b].astype(np.uint32))) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                    if chunks:
                        bucket, packed, own = zip(*chunks, strict=True)
                        columns = [pa.array(bucket, pa.int64()), pa.array([block.name] * len(chunks), pa.int64()), pa.array([kind] * len(chunks), pa.int32()), pa.array(packed, pa.binary()), pa.array(own, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "kind", "keys", "counts"])

    return run


def _answers(key, chunks):
    """The counts of all blocks for each block's keys, and how many words of the bucket occur in training texts."""
    out = []
    for kind, part in chunks.groupby("kind"):
        keys = [climbed(x) for x in part["keys"]]
        counts = np.concatenate([restored(x, np.uint32) for x in part["counts"]])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, minlength=len(distinct)).astype(U64)
        known, low = int((total > 0).sum()) if kind == 1 else 0, 0
        for k, (name, own) in enumerate(zip(part["block"], keys, strict=True)):
            out.append((key[0], name, kind, squeezed(total[place[low : low + len(own)]]), known if k == 0 else 0))
            low += len(own)
    return pd.DataFrame(out, columns=["bucket", "block", "kind", "totals", "known"])


def walk(block: Block, totals: list[np.ndarray], n: int, v: int, prior: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each document, given the training counts of its words and n-grams.

    A walk's state after a token is the longest of its last two tokens, its last one and nothing that training has, so
    the arcs that all walks take come from the places of the tokens. The state's arc for the next token is taken if
    there is one, else the failure arc and then an arc of the state that it leads to; their logs add up left to right.
    """
    words, pairs, triples = totals
    first, second, third = block.at
    base = np.log10((words + 1.0) / (n + v + 1.0))[first]
    step, before = base, np.concatenate([[-1], first[:-1]])
    for at, counts, context, own, mass in ((second, pairs, words, before, prior[0]), (third, triples, pairs, np.concatenate([[-1], second[:-1]]), prior[1])):
        # the state of this order that a walk is in: it needs a history in this text that training has
        inside = np.flatnonzero((at >= 0) & (context[own] > 0))
        seen = counts[at[inside]]
        weight = context[own[inside]] + mass
        lower = step[inside]
        step = step.copy()
        step[inside] = np.where(seen > 0, np.log10((seen + mass * 10.0**lower) / weight), lower + np.log10(mass / weight))
    return tuple(np.add.reduceat(x, block.starts) for x in ((words[first] > 0).astype(np.int64), base, step))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, prior: tuple[float, float] = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Trained on the rows whose crc32(id as text) mod ``folds`` is not ``fold`` (a null id trains). A-Z are lower-cased;
    tokens are words and one end. ``score`` is the log10 probability of the whole text, end included; ``base_score``
    that of the smoothed words alone. Null and empty texts are just the end. Rows that repeat an id are scored each,
    and train each. An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), W.held_out(doc_id, folds, fold).alias("held"), F.col(text).cast("string").alias("body"))
    blocks = scratch.keep(source.mapInArrow(_blocks, BLOCK_FIELDS), "blocks")
    keys, n, tokens = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "train_tokens", "n_tokens"))).first()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))
    bits = min(64, int(tokens).bit_length() + SPARE_BITS)
    asked = blocks.mapInArrow(_requests(buckets, bits), "bucket bigint, block bigint, kind int, keys binary, counts binary")
    answers = scratch.keep(asked.groupBy("bucket").applyInPandas(_answers, "bucket bigint, block bigint, kind int, totals binary, known bigint"), "answers")
    v = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]

    def scored(key, own, replies):
        found = []
        for row in own.to_dict("records"):
            block = Block(row, bits)
            totals = [np.concatenate([restored(x, U64) for x in replies[replies["kind"] == kind].sort_values("bucket")["totals"]] or [np.zeros(0, U64)]).astype(np.int64) for kind in (1, 2, 3)]
            # a word that ends no bigram or trigram reads their last count, and ignores it
            known, base, score = walk(block, [np.append(x, 0) for x in totals], n, v, prior)
            found.append(pd.DataFrame({"doc_id": pd.array(block.ids, "Int64"), "held_out": block.held, "n_tokens": block.lengths, "n_known": known, "train_tokens": n, "base_score": base, "score": score}))
            found[-1].loc[block.nulls, "doc_id"] = pd.NA
        return pd.concat(found)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, RESULT_FIELDS)
