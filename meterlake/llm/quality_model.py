"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention (tanh gate times sigmoid gate) weighs the
passages, and the weighted sum is classified. Only documents have labels; the attention learns which passages carry
them. Inputs are the words of the text alone: their hashes, dealt into WORDS buckets, and their shapes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W

#: Words of a passage; the bounded sample that the model learns from: labelled documents of each label. Training and
#: scores take all passages of a text.
PASSAGE, SAMPLE = 48, 1_000
#: Passages whose derivatives are computed at once; a longer text is taken whole.
STEP = 16_384
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 12, 120, 0.03, 1e-4
#: score from which a document counts as good
CUT = 0.3
#: Byte classes of word ends: lower, upper, digit, sentence mark, other ASCII mark, not ASCII.
KIND = np.full(256, 4, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 5
KIND[list(b".,!?;:")] = 3
KINDS, SIZES, WORDS = 6, 4, 64
SHAPES = KINDS * SIZES
FEATURES = SHAPES + WORDS + KINDS + 4


def passages(column: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of the passages of ``size`` words; a row without words has one of zeros."""
    rows, found, base = [], [], 0
    for part in W.split(column):
        counts = part.per_row()
        bags = np.maximum(1, -(-counts // size))
        first = np.concatenate([[0], np.cumsum(bags)[:-1]])
        begins = np.cumsum(counts) - counts
        place = first[part.doc] + (np.arange(len(part.doc)) - begins[part.doc]) // size
        total = int(bags.sum())
        n = np.maximum(np.bincount(place, minlength=total), 1)[:, None]
        length = part.end - part.start
        shape = KIND[part.data[part.end - 1]] * SIZES + np.minimum((length - 1) // 3, SIZES - 1)
        x = np.zeros((total, FEATURES))
        x[:, :SHAPES] = np.bincount(place * SHAPES + shape, minlength=total * SHAPES).reshape(total, -1) / n
        bucket = (part.hash % np.uint64(WORDS)).astype(np.int64)
        x[:, SHAPES : SHAPES + WORDS] = np.bincount(place * WORDS + bucket, minlength=total * WORDS).reshape(total, -1) / n
        kinds = KIND[part.data]
        for k in range(KINDS):
            sums = np.concatenate([[0], np.cumsum(kinds == k)])
            own = (sums[part.end] - sums[part.start]) / np.maximum(length, 1)
            x[:, SHAPES + WORDS + k] = np.bincount(place, own, minlength=total) / n[:, 0]
        again = np.zeros(len(part.doc))
        again[1:] = (part.hash[1:] == part.hash[:-1]) & (place[1:] == place[:-1])
        order = np.lexsort((part.hash, place))
        same = (part.hash[order][1:] == part.hash[order][:-1]) & (place[order][1:] == place[order][:-1])
        x[:, -4] = np.bincount(place, again, minlength=total) / n[:, 0]
        x[:, -3] = np.bincount(place[order][1:][same], minlength=total) / n[:, 0]
        x[:, -2] = np.bincount(place, np.log1p(length), minlength=total) / n[:, 0]
        x[:, -1] = np.bincount(place, minlength=total) / size
        rows.append(base + np.repeat(np.arange(part.rows), bags)), found.append(x)
        base += part.rows
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, FEATURES))
    return np.concatenate(rows), np.concatenate(found)


class AttentionModel:
    """Encoder, gated attention and classifier, trained by Adam on whole bags."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shapes.items()}

    def _forward(self, xs: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(xs @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, xs: np.ndarray, starts: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean log loss, for scaled inputs."""
        p, f = self.p, self._forward(xs, starts, bag)
        g = (f["y"] - label) / len(label)
        dz = g[:, None] * p["c"]
        dh = f["a"][:, None] * dz[bag]
        da = (f["h"] * dz[bag]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ g, "d": g.sum(keepdims=True), "w": (f["t"] * f["s"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ ds, "W": xs.T @ dh, "b": dh.sum(axis=0)}

    def fit(self, row: np.ndarray, x: np.ndarray, label: np.ndarray) -> AttentionModel:
        """``row``: sorted bag of each passage, from 0; ``label``: 0 or 1 of each bag."""
        edges = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
        parts, low = [], 0
        while low < len(label):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + STEP, "right")) - 1)
            parts.append((low, high))
            low = high
        spans = [slice(edges[low], edges[high]) for low, high in parts]
        self.mean = sum(x[own].sum(axis=0, dtype=np.float64) for own in spans) / len(x)
        self.scale = np.sqrt(sum(((x[own] - self.mean) ** 2).sum(axis=0) for own in spans) / len(x)) + 1e-3
        p, m, v = self.p, {}, {}
        for step in range(1, EPOCHS + 1):
            grads = dict.fromkeys(p, 0.0)
            for (low, high), own in zip(parts, spans, strict=True):
                part = self.gradients((x[own] - self.mean) / self.scale, edges[low:high] - own.start, row[own] - low, label[low:high])
                grads = {k: d + part[k] * (high - low) / len(label) for k, d in grads.items()}
            for k, d in grads.items():
                d = d + DECAY * p[k]
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(row):
            return np.zeros(0)
        return self._forward((x - self.mean) / self.scale, np.flatnonzero(np.append(True, row[1:] != row[:-1])), row)["y"]


def quality_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, fold: int = 0, sample: int = SAMPLE, carry: list[str] | None = None) -> DataFrame:
    """Adds held_out, score and predicted to ``docs``; one row per input row.

    Learns from the labelled rows whose crc32(id as text) mod ``folds`` is not ``fold``: the ``sample`` ids of each
    label that come first by hash (a bounded sample), and all passages of each; the driver holds some 8 bytes a word of
    those. Null labels and ids teach nothing; an id with several labels teaches each; of rows that repeat an id, the
    text of the least hash teaches. score: near 1 if label 1 is likelier, 0.5 for all if nothing was learned; null and empty texts are
    one passage of zeros. predicted: 1 if score >= 0.3. Columns of ``carry`` (None: all) stay unless a result has
    their name. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    # the labels alone are sampled; at most 2 * sample of them meet the texts
    usable = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    usable = usable.where(~W.held_out("id", folds, fold)).withColumn("place", F.xxhash64("id"))
    picked = W.first_by_hash(usable, "label", "place", sample).select("id", "label")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("body")).join(F.broadcast(picked), "id")
    # one text for each id and label: two long hashes first, then the texts that have them
    least = texts.where("body is not null").groupBy("id", "label").agg(F.min(F.xxhash64("body")).alias("hash"))
    texts = texts.join(F.broadcast(least), ["id", "label"]).where(F.xxhash64("body") == F.col("hash")).dropDuplicates(["id", "label"])

    def features(batches):
        for batch in batches:
            row, x = passages(batch.column(1))
            ids, label = batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(row), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["id", "label", "row", "x"])

    found = texts.select("id", "body", "label").mapInArrow(features, "id bigint, label int, row bigint, x binary").toPandas()
    model = AttentionModel()
    if found["label"].nunique() == 2:
        bag = found.groupby(["id", "label"], sort=True).ngroup().to_numpy()
        order = np.argsort(bag, kind="stable")
        x = np.frombuffer(b"".join(found["x"].to_numpy()[order]), np.float32).reshape(len(found), -1)
        label_of = found["label"].to_numpy()[order][np.flatnonzero(np.append(True, np.diff(bag[order]) > 0))]
        model.fit(bag[order], x, label_of)
    else:
        model.p["c"] = np.zeros(HIDDEN)
    trained = spark.sparkContext.broadcast(model)

    def make():
        own = trained.value

        def compute(column):
            scores = []
            bounds, _ = W.text_bytes(column)
            for low, high in W.chunks(bounds, 4 * W.CHUNK):
                scores.append(own.scores(*passages(column.slice(low, high - low))))
            score = np.concatenate(scores) if scores else np.zeros(0)
            return [pa.array(score), pa.array((score >= CUT).astype(np.int32))]

        return compute

    rows = docs.withColumn("held_out", W.held_out(doc_id, folds, fold))
    return W.with_columns(rows, text, "score double, predicted int", None if carry is None else [*carry, "held_out"], make)
