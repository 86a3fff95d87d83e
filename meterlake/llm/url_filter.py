"""URL filters: host and path rules, and a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models of UTF-8 bytes are trained on all URLs that the rules allow and block. A URL
without a rule is judged by the difference of its log-likelihoods a byte, against a threshold calibrated on URLs that the models
of the calibration did not see. ``Markov``, ``Ratio`` and ``calibrated`` are the same models over lists in memory.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.llm import words as W
from meterlake.llm.scratch import Scratch

#: The rules of the query: verdict, host (with its subdomains), path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest context in bytes.
ORDER = 6
#: Joins with tables that grow with the input: files small enough for a broadcast become far larger relations, which the
#: driver collects, builds and keeps one of for each join.
GROWS = "merge"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and path; both empty for null and without `://`."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(has, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; blocks win ties. Null without one."""
    name = verdict = F.lit(None).cast("string")
    for what, of, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(of + prefix)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


START, STOP = 2, 3  # bytes before and after every text


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts between START and STOP, text of each byte, its place in the text)."""
    bounds, data = W.text_bytes(texts)
    sizes = np.diff(bounds) + 2
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
    out = np.full(len(row), START, np.uint8)
    out[ends - 1] = STOP
    out[(place > 0) & (place < sizes[row] - 1)] = data[bounds[0] : bounds[-1]]
    return out, row, place


def _contexts(data: np.ndarray, at: np.ndarray, place: np.ndarray, order: int):
    """For each context length k to ``order``: (which of ``at`` have k bytes before them, hash of those bytes)."""
    value = np.full(len(at), 1, np.uint64)
    for k in range(order + 1):
        has = place >= k
        if k:
            value = W.mixed(value * W.BASE + data[np.maximum(at - k, 0)] + np.uint64(1))
        yield has, value


class Markov:
    """Byte model that blends all context lengths up to ``order``, longer ones weighing more the more they saw.

    Contexts and their continuations are held as hashes in order, with counts, for each context length.
    """

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        data, _, place = _padded(pa.array(texts, pa.string()))
        at = np.flatnonzero(place > 0)
        self.levels = []
        for has, value in _contexts(data, at, place[at], order):
            seen, n = np.unique(value[has], return_counts=True)
            arcs, first, count = np.unique(W.mixed(value[has] * W.BASE + data[at[has]] + np.uint64(1)), return_index=True, return_counts=True)
            kinds = np.bincount(np.searchsorted(seen, value[has][first]), minlength=len(seen))
            self.levels.append((seen, n, kinds, arcs, count))

    def log_probabilities(self, data: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the bytes ``at``. Witten-Bell: a context of n bytes, t distinct, keeps t / (n + t) for the next shorter one."""
        p = np.full(len(at), 1 / 256)
        for (has, value), (seen, n, kinds, arcs, count) in zip(_contexts(data, at, place, self.order), self.levels, strict=True):
            if not len(seen):
                break
            k = np.minimum(np.searchsorted(seen, value), len(seen) - 1)
            known = np.flatnonzero(has & (seen[k] == value))
            k, arc = k[known], W.mixed(value[known] * W.BASE + data[at[known]] + np.uint64(1))
            j = np.minimum(np.searchsorted(arcs, arc), len(arcs) - 1)
            p[known] = (np.where(arcs[j] == arc, count[j], 0) + kinds[k] * p[known]) / (n[k] + kinds[k])
        return np.log(p)


class Ratio:
    """Difference of two models' log-likelihoods a byte, end included."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.order, self.accepted, self.rejected = order, Markov(accepted, order), Markov(rejected, order)

    def __call__(self, urls: pa.Array) -> np.ndarray:
        data, row, place = _padded(urls)
        at = np.flatnonzero(place > 0)
        # URLs share most of their context and byte: each such pair is looked up once
        whole = np.zeros(len(at), np.uint64)
        for has, value in _contexts(data, at, place[at], self.order):
            whole = np.where(has, value, whole)
        _, first, of = np.unique(W.mixed(whole * W.BASE + data[at] + np.uint64(1)), return_index=True, return_inverse=True)
        some = at[first]
        gain = self.accepted.log_probabilities(data, some, place[some]) - self.rejected.log_probabilities(data, some, place[some])
        return np.bincount(row[at], gain[of], minlength=len(urls)) / np.maximum(np.bincount(row[at], minlength=len(urls)), 1)


def calibrated(accepted: list[str], rejected: list[str], order: int = ORDER) -> float:
    """The threshold with the best balanced accuracy on URLs left out of training; 0 if a side has too few."""
    if min(len(accepted), len(rejected)) < 4:
        return 0.0
    ratio = Ratio(accepted[::2], rejected[::2], order)
    good, bad = (np.sort(ratio(pa.array(x[1::2], pa.string()))) for x in (accepted, rejected))
    cuts = np.unique(np.concatenate([good, bad]))
    right = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(right == right.max())
    low = best[len(best) // 2]
    return float((cuts[low] + cuts[max(0, low - 1)]) / 2)


#: A difference of logs is a whole number of these parts of one in a sum, so that sums do not depend on their order.
PARTS = float(1 << 40)
#: Models: on all URLs of a verdict, and on the half of them that the calibration does not use.
MODELS = ("allow", "block", "allow_half", "block_half")


def _grams(text: Column, order: int) -> Column:
    """Every byte of a text between START and STOP with the ``order`` bytes before it, or all of them."""
    padded = F.concat(F.lit(bytearray([START])), text.cast("binary"), F.lit(bytearray([STOP])))
    # a variable of a function, so that the text is made once
    return F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(2), F.octet_length(p)), lambda i: F.substring(p, F.greatest(i - order, F.lit(1)), F.least(i, F.lit(order + 1)))))[0]


def _suffixes(gram: str) -> Column:
    size = F.octet_length(gram)
    return F.transform(F.sequence(F.lit(1), size), lambda m: F.substring(F.col(gram), size - m + 1, m))


def _gains(scratch: Scratch, learned: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(gram, gain, half_gain): the difference of the models' logs for the last byte of each of the grams ``asked``, in
    PARTS. ``learned``: gram, and how often each of MODELS saw it.

    Counts of shorter contexts are sums of the longest ones'. The models blend a length at a time, as ``Markov`` does: a
    gram takes its suffix's probability, and a suffix has 256 longer ones at most, so no key is a busy one.
    """
    sums = [F.sum(x).alias(x) for x in MODELS]
    arcs = scratch.keep(learned.select(F.explode(_suffixes("gram")).alias("gram"), *MODELS).groupBy("gram").agg(*sums), "arcs")
    context = F.substring(F.col("gram"), F.lit(1), F.octet_length("gram") - 1).alias("context")
    contexts = arcs.select(context, *MODELS).groupBy("context").agg(*(F.sum(x).alias(f"n_{x}") for x in MODELS), *(F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for x in MODELS))
    every = asked.select(F.explode(_suffixes("gram")).alias("gram")).distinct()
    wanted = scratch.keep(every.select("gram", context).join(contexts.hint(GROWS), "context", "left").join(arcs.hint(GROWS), "gram", "left").drop("context").withColumn("size", F.octet_length("gram")), "wanted")
    levels: list[DataFrame] = []
    for size in range(1, order + 2):
        own = wanted.where(F.col("size") == size)
        if levels:
            shorter = levels[-1].select(F.col("gram").alias("suffix"), *(F.col(f"p_{x}").alias(f"q_{x}") for x in MODELS))
            # there are 65,536 grams of two bytes at most
            own = own.withColumn("suffix", F.substring(F.col("gram"), F.lit(2), F.lit(size - 1))).join(shorter.hint(GROWS) if size > 3 else shorter, "suffix")
        else:
            own = own.withColumns({f"q_{x}": F.lit(1 / 256) for x in MODELS})
        blended = lambda x: F.when(F.col(f"n_{x}") > 0, (F.coalesce(x, F.lit(0)) + F.col(f"kinds_{x}") * F.col(f"q_{x}")) / (F.col(f"n_{x}") + F.col(f"kinds_{x}"))).otherwise(F.col(f"q_{x}"))
        levels.append(scratch.keep(own.select("gram", *(blended(x).alias(f"p_{x}") for x in MODELS)), f"level{size}"))
    gain = lambda a, b: F.round((F.ln(a) - F.ln(b)) * PARTS).cast("bigint")
    return reduce(DataFrame.unionAll, levels).select("gram", gain("p_allow", "p_block").alias("gain"), gain("p_allow_half", "p_block_half").alias("half_gain"))


def best_cut(scored: DataFrame, ranges: int = 64) -> float:
    """The threshold with the best balanced accuracy over all rows (score, good), between two scores; 0 if good or bad ones
    are missing. Of equally good ones it is the middle one.

    Scores are cut into ranges, each summed up on its own; the driver gets one row a range.
    """
    counts = Scratch(scored.sparkSession, "cut").keep(scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "counts")
    edges = sorted(set(counts.approxQuantile("score", [k / ranges for k in range(1, ranges)], 0.002)))
    placed = counts.withColumn("range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("score"))) if edges else F.lit(0))
    sums = placed.groupBy("range").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"), F.max("score").alias("last")).orderBy("range").collect()
    goods, bads = sum(r["goods"] for r in sums), sum(r["bads"] for r in sums)
    if not goods or not bads:
        return 0.0
    before, good, bad, last = [], 0, 0, None
    for r in sums:
        before.append((r["range"], good, bad, last))
        good, bad, last = good + r["goods"], bad + r["bads"], r["last"]
    offsets = scored.sparkSession.createDataFrame(before, "range int, goods_before bigint, bads_before bigint, last_before double")
    inside = Window.partitionBy("range").orderBy("score")
    below = lambda c: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"{c}s_before")
    right = (goods - below("good")).cast("decimal(38,0)") * bads + below("bad").cast("decimal(38,0)") * goods
    cuts = placed.join(F.broadcast(offsets), "range").select("score", F.coalesce(F.lag("score").over(inside), "last_before", "score").alias("previous"), right.alias("right"))
    most = cuts.groupBy("right").agg(F.count("*").alias("n")).orderBy(F.desc("right")).first()
    one = cuts.where(F.col("right") == F.lit(most["right"])).orderBy("score").offset(most["n"] // 2).first()
    return (one["score"] + one["previous"]) / 2


def url_filter(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, lm_score: one row per input row.

    The rule's verdict holds; else the method's: `allow` if lm_score (log-likelihood difference a byte; 0 for
    null and empty URLs) reaches the calibrated threshold. The models learn from all distinct URLs of each verdict; the
    threshold is that of models of one half of them, by hash, on the whole other half. Counts, models and scores are
    tables, so no task holds a model. Without rules that fit anything every score is 0 and every verdict `allow`.
    Repeated rows are judged each; an empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("__u"))
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("__u")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = scratch.keep(judged.withColumns({"rule": rule, "verdict": verdict, "row": F.monotonically_increasing_id()}), "judged")
    known = judged.where("verdict is not null").groupBy("__u").agg(F.first("verdict").alias("verdict"), F.min("row").alias("row"))
    known = scratch.keep(known.select("__u", "row", (F.col("verdict") == "allow").alias("good"), (F.xxhash64("__u") % 2 == 0).alias("half")), "known")
    seen = known.select(F.explode(_grams(F.col("__u"), order)).alias("gram"), "good", "half")
    learned = seen.groupBy("gram").agg(*(F.count_if(c).alias(x) for x, c in zip(MODELS, (F.col("good"), ~F.col("good"), F.col("good") & F.col("half"), ~F.col("good") & F.col("half")), strict=True)))
    grams = judged.where("__u != ''").select("row", F.explode(_grams(F.col("__u"), order)).alias("gram"))
    gains = _gains(scratch, learned, grams.select("gram").distinct(), order)
    mean = lambda c: F.sum(c) / PARTS / F.count("*")
    scores = scratch.keep(grams.join(gains.hint(GROWS), "gram").groupBy("row").agg(mean("gain").alias("lm_score"), mean("half_gain").alias("half_score")), "scores")
    few = known.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    held = known.where(~F.col("half")).select("row", "good").join(scores.hint(GROWS), "row").select(F.col("half_score").alias("score"), "good")
    threshold = best_cut(held) if min(few) >= 4 else 0.0
    fits = F.coalesce(F.col("lm_score") >= threshold, F.lit(True))
    out = judged.join(scores.hint(GROWS), "row", "left").withColumn("verdict", F.coalesce("verdict", F.when(fits, "allow").otherwise("block")))
    return out.select("page_id", "host", "path", "rule", "verdict", F.coalesce("lm_score", F.lit(0.0)).alias("lm_score"))
