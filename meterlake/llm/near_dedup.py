"""MinHash near-duplicate detection with exact confirmation.

Documents are sets of word shingles. Equal sets collapse to one representative first. Representatives get many
universal-hash minima; bands of them find candidate pairs, signatures discard unlikely ones, and full shingle sets
confirm every link that joins two components. Components come from alternating large-star and small-star.

Only links between different components matter for the result, so no bucket is expanded into all its pairs at once:
each round a bucket's members meet one leader, links merge components, and buckets whose members share a component
are finished. What then still lies in one bucket but in two components is compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W
from meterlake.llm.components import components
from meterlake.llm.scratch import Scratch

#: 64 bands of 5 minima: a pair at similarity 0.75 meets in some band but for a chance of (1 - 0.75**5)**64 = 3e-8.
BANDS, ROWS = 64, 5
#: A signature is this far below the threshold with a chance under 1e-7 (over 5 standard deviations of 320 minima).
SLACK = 0.13
#: Shingles hashed at a time, so that they stay in a core's cache.
SLICE = 1 << 15
#: Members up to which a bucket is expanded into pairs, and signatures of a block where it is larger.
SMALL, COMPARED = 24, 2_048
SET_FIELDS = "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, minima binary"


def minima(value: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` universal-hash minima, one row for each set that begins at ``starts`` in ``value``."""
    odd = np.random.default_rng(7).integers(0, 2**63, (count, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    found = np.empty((len(starts), count), np.uint32)
    ends = np.append(starts[1:], len(value))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + SLICE, side="right")))
        part, begins = value[starts[low] : ends[high - 1]], starts[low:high] - starts[low]
        for k, (a, b) in enumerate(odd):
            found[low:high, k] = np.minimum.reduceat(part * a + b, begins) >> np.uint64(32)
        low = high
    return found


def _signatures(shingle: int, bands: int, rows: int):
    def compute(column):
        n, of_set, keys, marks = [], [], [], []
        for part in W.split(column, lower=True):
            doc, value = W.shingle_sets(part, shingle)
            counts = np.bincount(doc, minlength=part.rows)
            filled = counts > 0
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[filled].astype(np.int64)
            least = minima(value, starts, bands * rows)
            sums = np.zeros((2, part.rows), np.uint64)
            key = np.zeros((part.rows, bands), np.uint64)
            mark = np.zeros((part.rows, bands * rows), np.uint8)
            if len(starts):
                for k in range(2):
                    sums[k, filled] = np.add.reduceat(W.mixed(value + np.uint64(k * 977 + 1)), starts)
                own = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(starts), bands)).copy()
                for k in range(rows):
                    own = own * W.BASE + least[:, k::rows]
                key[filled], mark[filled] = W.mixed(own), least.astype(np.uint8)
            n.append(counts), of_set.append(sums), keys.append(key), marks.append(mark)
        if not n:
            return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
        total, width = sum(map(len, n)), bands * rows
        key = pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * bands), pa.array(np.concatenate(keys).view(np.int64).ravel()))
        mark = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.arange(total + 1, dtype=np.int32) * width), pa.py_buffer(np.concatenate(marks).tobytes())])
        a, b = np.concatenate(of_set, axis=1).view(np.int64)
        return pa.array(np.concatenate(n)), pa.array(a), pa.array(b), key, mark

    return compute


def _sets(shingle: int):
    def compute(column):
        values, counts = [], [np.zeros(1, np.int64)]
        for part in W.split(column, lower=True):
            doc, value = W.shingle_sets(part, shingle)
            values.append(value), counts.append(np.bincount(doc, minlength=part.rows))
        bounds = np.cumsum(np.concatenate(counts)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)))]

    return compute


def _alike(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """(a, b, share): pairs whose signatures agree in ``least`` of their minima; compared byte by byte."""
    both = pairs.join(marks.select(F.col("rep").alias("a"), F.col("minima").alias("of_a")), "a")
    both = both.join(marks.select(F.col("rep").alias("b"), F.col("minima").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def compare(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in (2, 3)) if n else (np.zeros((0, 1)), np.zeros((0, 1)))
            share = (x == y).mean(axis=1)
            rows = share >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(rows)), batch.column(1).filter(pa.array(rows)), pa.array(share[rows])], names=["a", "b", "share"])

    return both.mapInArrow(compare, "a bigint, b bigint, share double")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row.

    Two documents are linked if 100 * intersection >= threshold * union of their sets of distinct ``shingle``-word
    shingles (A-Z lower-cased; fewer words make one shingle). component_id is the least id reachable by links.
    Null or wordless texts have the empty set and link with nothing, themselves excepted. Rows that repeat an id are
    each compared, and each has the component of its own text; an id that is the least of several sets links them. A
    null id takes part in no link. An empty table gives an empty one; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("body"))
    signed = scratch.keep(W.with_columns(source, "body", SET_FIELDS, ["id"], lambda: _signatures(shingle, bands, rows)), "signed")
    equal = ["set_a", "set_b", "n_shingles"]
    ids = scratch.keep(signed.select("id", *equal), "ids")
    linkable = "n_shingles > 0 and id is not null"
    # one representative for each distinct set: the least id; wide tables go as soon as narrower ones replace them
    # (written, so that joins with it are plain ones, whose large partitions Spark can split)
    reps = scratch.keep(ids.where(linkable).groupBy(*equal).agg(F.min("id").alias("rep")), "distinct")
    held = scratch.keep(signed.where(linkable).join(reps, equal).where("id = rep").dropDuplicates(["rep", *equal]).select("rep", "bands", "minima"), "reps")
    scratch.drop(signed)
    shared = scratch.keep(_buckets(held), "buckets")
    marks = scratch.keep(held.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "minima"), "marks")
    scratch.drop(held)
    stars = _stars(source, shared, marks, scratch, threshold, shingle)
    scratch.only(ids, reps, stars)
    classes = reps.join(stars, reps["rep"] == stars["node"], "left").select(*equal, F.coalesce("component_id", "rep").alias("component_id"))
    found = ids.join(classes, equal, "left")
    alone = F.coalesce(F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")), F.col("id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", alone.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _buckets(held: DataFrame) -> DataFrame:
    """(key, rep) of the buckets with two members at least, with each bucket's least and largest member."""
    keys = held.select(F.explode("bands").alias("key"), "rep")
    full = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    return keys.join(full, "key")


def _stars(source, shared, marks, scratch, threshold, shingle) -> DataFrame:
    """(node, component_id) of the representatives that have a link."""
    least = threshold / 100 - SLACK
    known = scratch.keep(shared.select("rep").distinct().select(F.col("rep").alias("node"), F.col("rep").alias("component_id")), "alone")
    texts = source.join(known.select(F.col("node").alias("id")), "id", "left_semi")
    steps = _Confirmation(texts, scratch, threshold, shingle)
    split = None
    for leader in ("low", "high"):
        pairs = shared.select(F.col(leader).alias("a"), F.col("rep").alias("b")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        open_pairs = scratch.keep(_alike(_apart(pairs, known), marks, least), "alike")
        known = steps.merge(known, _likeliest(open_pairs))
        split = scratch.keep(_split(shared, known).repartition("key", "rep"), "split")
        if not _any(split.where(F.col("held") > SMALL)):  # a second leader is only worth it in large buckets
            break
    # small buckets that hold two components still, pair by pair
    few = split.where(F.col("held") <= SMALL)
    other = few.select("key", F.col("rep").alias("b"), F.col("component_id").alias("of_b"))
    pairs = few.withColumnRenamed("rep", "a").join(other, "key").where("component_id < of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = steps.merge(known, _alike(pairs, marks, least))
    many = split.where(F.col("held") > SMALL)
    if not _any(many):
        return known
    # large ones in blocks, by the components of now
    many = scratch.keep(_split(many.select("key", "rep"), known).repartition("key", "rep"), "many")
    return steps.link(known, _in_blocks(many, known, marks, steps, least))


def _any(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def _split(shared: DataFrame, known: DataFrame) -> DataFrame:
    """(key, rep, component_id, first_of, held) of the buckets whose members are not all in one component."""
    of = shared.select("key", "rep").join(known.select(F.col("node").alias("rep"), "component_id"), "rep")
    split = of.groupBy("key").agg(F.min("component_id").alias("first_of"), F.max("component_id").alias("last_of"), F.count("*").alias("held")).where("first_of < last_of").select("key", "first_of", "held")
    return of.join(split, "key")


def _in_blocks(many: DataFrame, known: DataFrame, marks: DataFrame, steps: _Confirmation, least: float) -> DataFrame:
    """(u, v): components linked by documents that share large buckets.

    Components that meet in such buckets form a family. Documents outside its largest component are compared with all
    of the family, block against block: by signatures first, and then by the shingle sets of those documents alone
    that have a likely partner in the pair of blocks. No pair is a row unless it is a link.
    """
    keep = steps.scratch.keep
    families = components(many.select(F.col("component_id").alias("u"), F.col("first_of").alias("v")), steps.scratch)
    members = many.select("rep").distinct().join(known.select(F.col("node").alias("rep"), "component_id"), "rep")
    met = many.select("component_id", "rep").distinct().join(families.select(F.col("node").alias("component_id"), F.col("component_id").alias("family")), "component_id").select("rep", "family")
    members = keep(members.join(met, "rep"), "members")
    left, right = _dealt(members, marks)
    of = ["family", "i", "j"]
    # both sides come from one table: columns of their own keep them apart
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}" if c in of else c) for c in df.columns)).groupBy(*(f"{name}_{c}" for c in of))
    fields = "family bigint, i int, j int, rep bigint, component bigint, minima binary, first boolean"

    def likely(key, a, b):
        """Documents of either block that may have a partner of another component in the other one."""
        near = _near(a, b, least)
        some = [x[near.any(axis=axis)].set_axis([*of, "rep", "component", "minima"], axis=1).assign(first=axis == 1) for x, axis in ((a, 1), (b, 0))]
        return pd.concat(some)

    found = keep(side(left, "a").cogroup(side(right, "b")).applyInPandas(likely, fields), "likely")
    if not _any(found):
        return found.select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    sets = keep(steps.sets(found.select(F.col("rep").alias("id"))), "likely-sets")
    full = found.join(sets.withColumnRenamed("id", "rep"), "rep").select(*of, "component", "minima", "first", "shingles")
    threshold = steps.threshold

    def compare(key, a, b):
        links = set()
        near = _near(a, b, least)
        of_a, of_b, sets_a, sets_b = list(a["component"]), list(b["component"]), list(a["shingles"]), list(b["shingles"])
        for i, k in zip(*np.nonzero(near), strict=True) if len(a) and len(b) else ():
            if (of_a[i], of_b[k]) not in links:
                common = np.isin(sets_a[i], sets_b[k], assume_unique=True).sum()
                if 100 * common >= threshold * (len(sets_a[i]) + len(sets_b[k]) - common):
                    links.add((of_a[i], of_b[k]))
        return pd.DataFrame(sorted(links), columns=["u", "v"], dtype="int64")

    return side(full.where("first"), "a").cogroup(side(full.where("not first"), "b")).applyInPandas(compare, "u bigint, v bigint")


def _dealt(members: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, i, j, rep, component, minima) of the documents outside a family's largest component, and of all.

    Block i of the former meets block j of the latter. A signature has a copy for each COMPARED documents that it
    meets, so what is sent grows with the family while one side fits a block.
    """
    sizes = members.groupBy("family", "component_id").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("family").agg(F.max_by("component_id", F.struct("n", "component_id")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    blocks = {"rights": F.ceil(F.col("all") / COMPARED).cast("int"), "lefts": F.ceil((F.col("all") - F.col("most")) / COMPARED).cast("int")}
    placed = members.join(sizes, "family").withColumns(blocks).join(marks, "rep")
    mix = F.xxhash64("rep")
    right = placed.withColumns({"j": F.pmod(mix, F.col("rights")), "i": F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))})
    left = placed.where("component_id != main").withColumns({"i": F.pmod(mix, F.col("lefts")), "j": F.explode(F.sequence(F.lit(0), F.col("rights") - 1))})
    new = lambda df: df.select(F.col("family").alias("family"), *(F.col(c).cast("int").alias(c) for c in "ij"), F.col("rep").alias("rep"), F.col("component_id").alias("component"), F.col("minima").alias("minima"))
    return new(left), new(right)


def _near(a: pd.DataFrame, b: pd.DataFrame, least: float) -> np.ndarray:
    """(row of a, row of b): whether signatures agree in ``least`` of their minima and components differ."""
    near = np.zeros((len(a), len(b)), bool)
    if len(a) and len(b):
        y, of_b = np.frombuffer(b"".join(b["minima"]), np.uint8).reshape(len(b), -1), b["component"].to_numpy()
        for k, (own, x) in enumerate(zip(a["component"], a["minima"], strict=True)):
            near[k] = ((y == np.frombuffer(x, np.uint8)).mean(axis=1) >= least) & (of_b != own)
    return near


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a = known.select(F.col("node").alias("a"), F.col("component_id").alias("of_a"))
    b = known.select(F.col("node").alias("b"), F.col("component_id").alias("of_b"))
    return pairs.join(a, "a").join(b, "b").where("of_a != of_b").drop("of_a", "of_b")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """For each larger id the pair whose signatures agree most: enough to join most of a group."""
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a")).select("a", "b")


class _Confirmation:
    """Confirms pairs on full shingle sets and merges the components that they link."""

    def __init__(self, texts: DataFrame, scratch: Scratch, threshold: int, shingle: int):
        self.texts, self.scratch, self.threshold, self.shingle = texts, scratch, threshold, shingle

    def merge(self, known: DataFrame, pairs: DataFrame) -> DataFrame:
        keep = self.scratch.keep
        pairs = keep(pairs.select("a", "b"), "pairs")
        if not _any(pairs):
            return known
        sets = keep(self.sets(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))), "sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("n"), (F.size("x") + F.size("y")).cast("bigint").alias("m"))
        sure = both.where(f"100 * n >= {self.threshold} * (m - n)")
        a = known.select(F.col("node").alias("a"), F.col("component_id").alias("u"))
        b = known.select(F.col("node").alias("b"), F.col("component_id").alias("v"))
        after = self.link(known, sure.join(a, "a").join(b, "b").select("u", "v"))
        self.scratch.drop(sets)
        return after

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles): the full sets of some representatives."""
        shingle = self.shingle
        return W.with_columns(self.texts.join(ids.distinct(), "id", "left_semi"), "body", "shingles array<bigint>", ["id"], lambda: _sets(shingle))

    def link(self, known: DataFrame, links: DataFrame) -> DataFrame:
        """``known`` after components u and v became one, for each link."""
        joined = components(links, self.scratch)
        moved = joined.select(F.col("node").alias("component_id"), F.col("component_id").alias("to"))
        return self.scratch.keep(known.join(moved, "component_id", "left").select("node", F.coalesce("to", "component_id").alias("component_id")), "known")


#: The same rows in DuckDB, over ``documents`` with the default parameters, by joining shingles.
SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, e.b FROM reach r JOIN linked e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, LEAST(doc_id, COALESCE(low, doc_id)) AS component_id, doc_id = LEAST(doc_id, COALESCE(low, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
