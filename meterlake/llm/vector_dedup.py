"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine >= t lie within r = sqrt(2 - 2 t). Pivots split the space into cells of nearest pivots. A
vector x of cell p can have a partner in cell q only if |x - q| <= |x - p| + 2 r (triangle inequality); in Euclidean
space the distance to the plane between p and q, (x.p - x.q) / |p - q| <= r, is the sharper form, and sets which cells
get a copy of x. A link of two cells is found in the later one, which alone gets copies of the other's vectors. Cells
join independently, in pairs of blocks of bounded size. Equal vectors are one vector with a weight.

Vectors without structure go to every later cell, so a vector is sent once a cell and once a block that its cell meets.
Cells and blocks are as large as memory allows, but never so large that few tasks have all the work: the number of
copies stays the same up to PARTS * CELL vectors, and grows with the number of vectors over CELL from there on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meterlake.llm.components import components
from meterlake.llm.scratch import Scratch

#: Vectors of a cell to aim at, the most pivots (a bound of what the driver holds), and vectors of a block.
CELL, MOST_PIVOTS, BLOCK = 32_768, 512, 32_768
#: Cells that smaller tables have at least, for as many vectors of a cell.
PARTS, LEAST_CELL = 8, 1_024
#: Most bytes of a block and of a batch of copies, in double precision; products held at once; links joined at once.
BLOCK_BYTES, DEALT_BYTES, PRODUCTS, LINKS = 1 << 25, 1 << 23, 1 << 21, 1 << 20
#: Slack of a replication bound, far over the rounding of double precision.
NEAR = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square over- or underflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def single_slack(width: int) -> float:
    """Most that a product of two unit vectors errs in single precision: a rounding for each component and for each sum."""
    return (width + 8) * 2.0**-23


def pivots(sample: np.ndarray, count: int, apart: float) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample, in its order, no two within ``apart``: groups give one each."""
    chosen: list[np.ndarray] = []
    for x in sample:
        if not chosen or np.linalg.norm(np.array(chosen) - x, axis=1).min() > apart:
            chosen.append(x)
            if len(chosen) == count:
                break
    return np.array(chosen)


def cells_of(x: np.ndarray, centres: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, vector x cell: whether the cell gets the vector)."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    gap = (np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 16 else np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)))[home]
    return home, dots[np.arange(len(x)), home][:, None] - dots <= (r + NEAR) * gap + NEAR


def _roots(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Component of each of n nodes, by repeated least labels along links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[columns])
        after = label.copy()
        np.minimum.at(after, rows, low)
        np.minimum.at(after, columns, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def range_join(left: np.ndarray, right: np.ndarray, threshold: float, step: int = 256):
    """Slices of (row of left, row of right) with cosine >= threshold in double precision, for unit vectors.

    Products are made in single precision, at most PRODUCTS at once; those within its error of the threshold again.
    """
    a, b, slack = left.astype(np.float32), right.astype(np.float32), single_slack(left.shape[1])
    wide = max(1, PRODUCTS // step)
    many = max(1, PRODUCTS // (8 * left.shape[1]))
    for k in range(0, len(a), step):
        for m in range(0, len(b), wide):
            dots = a[k : k + step] @ b[m : m + wide].T
            i, j = np.nonzero(dots >= threshold - slack)
            if not len(i):
                continue
            sure = dots[i, j] >= threshold + slack
            i, j = i + k, j + m
            near = np.flatnonzero(~sure)
            for n in range(0, len(near), many):
                some = near[n : n + many]
                sure[some] = np.einsum("ij,ij->i", left[i[some]], right[j[some]]) >= threshold
            yield i[sure], j[sure]


def vector_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Rows link if their cosine in double precision is >= threshold. Null vectors, zero vectors, those with null or
    non-finite components and rows of null id link with nothing, as do vectors of unlike lengths with each other.
    n_links counts linked other rows, rows that repeat an id included; component_id is the least id reachable. An
    empty table gives an empty one; other columns are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    given = table.schema[embedding].dataType
    single = isinstance(given, T.ArrayType) and given.elementType == T.FloatType()
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = scratch.keep(rows.withColumn("ok", F.coalesce(ok, F.lit(False))), "rows")
    # ``rep`` numbers the distinct vectors, since unlike ones may share their least id
    groups = scratch.keep(rows.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "groups")
    found = []
    for (width,) in groups.select(F.size("v")).distinct().collect():
        found.append(_links(groups.where(F.size("v") == width), width, scratch, threshold, cell, block, single))
    partners = edges = None
    for links, joined in found:
        partners, edges = (links, joined) if partners is None else (partners.unionAll(links), edges.unionAll(joined))
    if partners is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    stars = components(edges, scratch).withColumnRenamed("node", "rep")
    per = partners.groupBy("rep").agg(F.sum("partners").alias("partners"))
    joined = scratch.keep(groups.join(per, "rep").join(stars, "rep", "left").select("v", "id", "partners", F.coalesce("component_id", "rep").alias("node")), "joined")
    least = joined.groupBy("node").agg(F.min("id").alias("component_id"))
    classes = scratch.keep(joined.join(least, "node").select("v", "partners", "component_id"), "classes")
    out = rows.join(classes, rows["ok"] & (rows["v"] == classes["v"]), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce(F.col("partners") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(groups: DataFrame, width: int, scratch: Scratch, threshold: float, cell: int, block: int, single: bool) -> tuple[DataFrame, DataFrame]:
    """((rep, partners) with weights and itself counted, to be summed; (u, v) that join what links).

    ``single``: the components fit single precision, in which vectors are sent then.
    """
    n, r = groups.count(), float(np.sqrt(2 - 2 * threshold))
    fair = max(LEAST_CELL, -(-n // PARTS))
    cell, block = min(cell, fair), max(1, min(block, fair, BLOCK_BYTES // (8 * width)))
    count = int(min(MOST_PIVOTS, max(1, n // cell)))
    sample = groups.orderBy(F.xxhash64("rep"), "rep").limit(8 * count).select("v").collect()
    centres = pivots(units(np.array([s["v"] for s in sample])), count, 2 * r)
    kind, rows_dealt = np.dtype(np.float32 if single else np.float64), max(1, DEALT_BYTES // (8 * width))

    def placed(batches, foreign):
        """(rows, vectors, home, vector x cell: whether the cell gets the vector) of bounded parts of ``batches``: its home
        does and, if ``foreign``, the later cells in which it can have a partner."""
        for batch in batches:
            for low in range(0, batch.num_rows, rows_dealt):
                part = batch.slice(low, rows_dealt)
                v = part.column(0).flatten().to_numpy().reshape(-1, width)
                home, gets = cells_of(units(v), centres, r)
                held = gets & (np.arange(len(centres)) > home[:, None]) if foreign else np.zeros_like(gets)
                held[np.arange(len(home)), home] = True
                yield part, v, home, held

    def measure(batches):
        own, held = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for _, _, home, gets in placed(batches, True):
            own, held = own + np.bincount(home, minlength=len(centres)), held + gets.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(own), pa.array(held)], names=["cell", "own", "held"])

    def deal(foreign):
        def run(batches):
            for part, v, home, gets in placed(batches, foreign):
                x = v.astype(kind)
                for c in np.flatnonzero(gets.any(axis=0)).tolist():
                    at = np.flatnonzero(gets[:, c])
                    rows = pa.array(at)
                    data = pa.array([x[k].tobytes() for k in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), part.column(1).take(rows), part.column(2).take(rows), pa.array(home[at] == c), data], names=["cell", "rep", "weight", "home", "x"])

        return groups.select("v", "rep", "weight").mapInArrow(run, "cell bigint, rep bigint, weight bigint, home boolean, x binary")

    sizes = groups.select("v", "rep", "weight").mapInArrow(measure, "cell bigint, own bigint, held bigint").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("held").alias("held")).where("own > 0")  # a row a pivot
    sizes = scratch.keep(sizes.select("cell", F.ceil(F.col("own") / block).cast("int").alias("lefts"), F.ceil(F.col("held") / block).cast("int").alias("rights")), "sizes")
    mix = F.xxhash64("rep")
    left = deal(False).join(F.broadcast(sizes), "cell").withColumn("i", F.pmod(mix, F.col("lefts"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    right = deal(True).join(F.broadcast(sizes), "cell").withColumn("j", F.pmod(mix, F.col("rights"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
    of = lambda side, name: side.select(F.col("cell").alias(f"{name}_cell"), F.col("i").cast("int").alias(f"{name}_i"), F.col("j").cast("int").alias(f"{name}_j"), "rep", "weight", "home", "x").groupBy(f"{name}_cell", f"{name}_i", f"{name}_j")

    def join(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "partners": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        x, y = (units(np.frombuffer(b"".join(p["x"]), kind).reshape(len(p), -1)) for p in (a, b))
        weight_a, weight_b, foreign = a["weight"].to_numpy(), b["weight"].to_numpy(), ~b["home"].to_numpy(bool)
        names, place = np.unique(np.concatenate([a["rep"], b["rep"]]), return_inverse=True)
        of_a, of_b = place[: len(a)], place[len(a) :]
        of_x, of_y, label = np.zeros(len(a)), np.zeros(len(b)), np.arange(len(names))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def linked():
            # each run keeps one link a node to what it joined so far
            rows, columns = (np.concatenate(z) for z in zip(*waiting, (np.arange(len(names)), label), strict=True))
            waiting.clear()
            return _roots(len(names), rows, columns)

        for i, j in range_join(x, y, threshold):
            of_x += np.bincount(i, weight_b[j], minlength=len(a))
            # a pair of two cells is met here alone, one of the same cell in both orders
            other = foreign[j]
            of_y += np.bincount(j[other], weight_a[i[other]], minlength=len(b))
            apart = of_a[i] != of_b[j]
            if apart.any():
                waiting.append((of_a[i[apart]], of_b[j[apart]]))
                if sum(len(w[0]) for w in waiting) >= LINKS:
                    label = linked()
        if waiting:
            label = linked()
        partners = np.bincount(of_a, of_x, minlength=len(names)).astype(np.int64) + np.bincount(of_b, of_y, minlength=len(names)).astype(np.int64)
        some = (partners > 0) | (label != np.arange(len(names)))
        return pd.DataFrame({"rep": names[some], "partners": partners[some], "root": names[label[some]]})

    met = of(left, "a").cogroup(of(right, "b")).applyInPandas(join, "rep bigint, partners bigint, root bigint")
    met = scratch.keep(met, "met")
    return met.select("rep", "partners"), met.select(F.col("rep").alias("u"), F.col("root").alias("v")).where("u != v")


#: The same rows in DuckDB, over ``embeddings``, by comparing all pairs.
SQL = """
WITH RECURSIVE valid AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a),
least AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, COALESCE(n, 0) AS n_links, LEAST(vec_id, COALESCE(low, vec_id)) AS component_id, vec_id = LEAST(vec_id, COALESCE(low, vec_id)) AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN least USING (vec_id)
"""
