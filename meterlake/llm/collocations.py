"""Phrase collocations by prefix-free parsing: n-grams are counted once for each distinct chunk of text.

A run of OVERLAP words whose hash is a multiple of SPACING is a trigger. A chunk reaches from one trigger to the end of
the next one, so that equal passages have equal chunks wherever they stand, and neighbours share the OVERLAP words of a
trigger. The distinct chunks are the dictionary, with the number of times that each is parsed. A chunk owns the
phrases that begin before its last trigger: a phrase has OVERLAP + 1 words at most, so it lies inside the chunk that
owns it, and each occurrence is owned by one chunk. Phrases inside the dictionary's chunks, weighted, are all phrases.

Only phrases with ``least`` occurrences are wanted, and a frequent phrase has frequent parts. So lengths are counted
in turn, by 64-bit hashes, and a phrase is sent on only if a filter of bits, which has all frequent parts (and a few
others), has both parts that are a word shorter. The last pass counts the words of what is left themselves, so hashes
that meet and the filter's false hits cost rows but change no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlake.llm import words as W
from meterlake.llm.scratch import Scratch

U64 = np.uint64
#: Words of the longest phrases, of a trigger, and from a trigger to the next on average.
LONGEST = 4
OVERLAP = LONGEST - 1
SPACING = U64(32)
#: Words after which a chunk ends without a trigger; it bounds rows where a text repeats one word.
MOST_WORDS = 1024
#: Phrases that a task adds up before it sends them on.
BLOCK = 1 << 21
#: The filter has eight bits a phrase and 16 MB at most; beyond, it lets more phrases through.
MOST_BITS = 27
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = STOPS.copy()
BETWEEN[[0x20, 0x09]] = True


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some slices, one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, last, chunk); ``last``: the text's last chunk, which owns all its phrases."""
    for batch in batches:
        for part in W.split(batch.column(1), lower=True, space=BETWEEN):
            n = len(part.doc)
            if not n:
                continue
            trigger = np.zeros(n, bool)
            first, value = W.windows(part, OVERLAP)
            trigger[first[value % SPACING == 0]] = True
            opens = np.concatenate([[True], part.doc[1:] != part.doc[:-1]])
            begin = np.flatnonzero(trigger | opens)
            # long stretches without a trigger are cut at fixed lengths, where OVERLAP words follow at least
            pieces = np.maximum(1, -(-(np.diff(begin, append=n) - OVERLAP) // MOST_WORDS))
            place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.repeat(begin, pieces) + place * MOST_WORDS
            last = np.concatenate([part.doc[begin[1:]] != part.doc[begin[:-1]], [True]])
            end = np.append(begin[1:], n) + np.where(last, 0, OVERLAP)
            size = part.end[end - 1] - part.start[begin]
            lang = batch.column(0).take(pa.array(part.row + part.doc[begin]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(last), _strings(gathered(part.data, part.start[begin], size), size)], names=["lang", "last", "chunk"])


class Filter:
    """Bits of hashes; has all that it was made of, and others by chance."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray):
        self.mask = U64((1 << bits) - 1)
        self.words = np.zeros(1 << max(0, bits - 6), U64)
        self.words[at] = words.view(U64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & self.mask
        return (self.words[slot >> U64(6)] >> (slot & U64(63))) & U64(1) == 1


class Phrases:
    """Phrases of the chunks of a batch by order: hash at each word where one begins and is owned."""

    def __init__(self, part: W.Words, last: np.ndarray, salt: np.ndarray):
        self.part, n = part, len(part.doc)
        count = part.per_row()
        place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        self.owned = place < np.where(last, count, count - OVERLAP)[part.doc]
        stops = np.cumsum(STOPS[part.data], dtype=np.int64)
        #: a row and a piece, which phrases do not cross
        self.piece = stops[part.start] + part.doc
        self.salt, self.hashes = salt[part.doc], {}

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a phrase of ``order`` words begins at a word, its hash with the language)."""
        if order not in self.hashes:
            n = len(self.piece)
            whole = np.zeros(n, bool)
            if n >= order:
                whole[: n - order + 1] = self.piece[: n - order + 1] == self.piece[order - 1 :]
            value = np.full(n, order, U64)
            for k in range(order):
                value = value * W.BASE + np.concatenate([self.part.hash[k:], np.zeros(min(k, n), U64)])
            self.hashes[order] = whole, W.mixed(value ^ self.salt)
        return self.hashes[order]

    def wanted(self, order: int, known: Filter | None) -> np.ndarray:
        """Words where owned phrases of ``order`` words begin whose parts are known."""
        whole, _ = self.of(order)
        keep = whole & self.owned
        if known and order > 1:
            part = known.has(self.of(order - 1)[1])
            keep &= part & np.append(part[1:], False)
        return np.flatnonzero(keep)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[W.Words, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(words, last, salt, weight, lang) of each part of the dictionary's rows (lang, last, chunk, weight, salt)."""
    for batch in batches:
        lang, last, chunk, weight, salt = batch.columns
        last, weight, salt = (x.to_numpy(zero_copy_only=False) for x in (last, weight, salt))
        for part in W.split(chunk, space=BETWEEN):
            own = slice(part.row, part.row + part.rows)
            yield part, last[own], salt[own].view(U64), weight[own], lang.slice(part.row, part.rows)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums of weights, place of one of each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(weights[order], begin) if len(keys) else weights, order[begin]


def _hash_counts(orders: tuple[int, ...], filter_):
    """Dictionary rows to (gram, n): hashes of phrases of the orders, added up by block."""

    def run(batches):
        keys, weights, size = [], [], 0
        known = filter_.value if filter_ else None

        def block():
            gram, n, _ = _summed(np.concatenate(keys), np.concatenate(weights))
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for part, last, salt, weight, _ in _parts(batches):
            phrases = Phrases(part, last, salt)
            for order in orders:
                at = phrases.wanted(order, known)
                keys.append(phrases.of(order)[1][at])
                weights.append(weight[part.doc[at]])
                size += len(at)
            if size >= BLOCK:
                yield block()
                keys, weights, size = [], [], 0
        if size:
            yield block()

    return run


def _spelled(part: W.Words, at: np.ndarray, order: int) -> pa.Array:
    """The phrases of ``order`` words that begin at some words, with one space between words."""
    each = at[:, None] + np.arange(order)
    size = (part.end - part.start)[each] + (np.arange(order) < order - 1)
    text = gathered(np.append(part.data, np.uint8(32)), part.start[each].ravel(), size.ravel())
    text[(np.cumsum(size.ravel()) - 1).reshape(-1, order)[:, :-1].ravel()] = 32
    return _strings(text, size.sum(axis=1))


def _phrase_counts(filter_):
    """Dictionary rows to (lang, phrase, n): phrases of all orders that the filter has, and all words as phrase ''."""

    def run(batches):
        known, found, size = filter_.value, [], 0

        def block():
            keys, weights, langs, phrases = zip(*found, strict=True)
            _, n, one = _summed(np.concatenate(keys), np.concatenate(weights))
            one = pa.array(one)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(langs).take(one), pa.concat_arrays(phrases).take(one), pa.array(n)], names=["lang", "phrase", "n"])

        for part, last, salt, weight, lang in _parts(batches):
            phrases = Phrases(part, last, salt)
            owned = np.bincount(part.doc[phrases.owned], minlength=part.rows) * weight
            _, n, one = _summed(salt, owned)
            found.append((salt[one], n, lang.take(pa.array(one)), pa.array([""] * len(one))))
            for order in range(1, LONGEST + 1):
                at = phrases.wanted(order, known)
                hashes = phrases.of(order)[1]
                at = at[known.has(hashes[at])]
                _, n, one = _summed(hashes[at], weight[part.doc[at]])
                at = at[one]
                found.append((hashes[at], n, lang.take(pa.array(part.doc[at])), _spelled(part, at, order)))
                size += len(at)
            if size >= BLOCK // 4:
                yield block()
                found, size = [], 0
        if found:
            yield block()

    return run


def _filter(frequent: DataFrame) -> Filter:
    """The filter of a table of hashes; only its bits come to the driver, 16 MB at most."""
    bits = min(MOST_BITS, max(10, 3 + frequent.count().bit_length()))
    slot = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, cast(gram & 63 as int))")
    rows = frequent.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    return Filter(bits, rows.column("at").to_numpy(), rows.column("word").to_numpy())


def _first(rows: DataFrame, group: str, order: list, count: int) -> DataFrame:
    """The first ``count`` rows of each group, with ``rank``. Scores that are surely too low are left out first, then
    64 shares of a group are cut to ``count`` each, so that no task sorts a whole group."""
    below = Window.partitionBy(group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = rows.groupBy(group, "score").count().withColumn("better", F.coalesce(F.sum("count").over(below), F.lit(0)))
    least = levels.where(F.col("better") < count).groupBy(F.col(group).alias("of")).agg(F.min("score").alias("least"))
    near = rows.join(F.broadcast(least), F.col(group) == F.col("of")).where("score >= least").drop("of", "least")
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = near.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy(group, "share").orderBy(*order)))
    some = some.where(F.col("rank") <= count).drop("share", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= count)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, cover: int = 80, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of two to four words by score.

    A-Z are lower-cased; phrases lie within pieces of a text between ``.,;:!?`` and line ends. ``a``: occurrences,
    ``least`` or more; ``l`` and ``r``: those of the parts on both sides of the cut that scores lowest (the first of
    equal ones); ``n``: the language's words; ``score``: floor(2000000 * a / (l + r)). Phrases inside a longer one with
    ``cover`` percent of their occurrences are left out. Null languages are ``und``; null and empty texts have no
    words; rows that repeat an id count each; an empty table, or one without such phrases, gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    parsed = source.mapInArrow(_chunks, "lang string, last boolean, chunk string")
    dictionary = parsed.groupBy("lang", "last", "chunk").agg(F.count("*").alias("weight"))
    dictionary = scratch.keep(dictionary.withColumn("salt", F.xxhash64("lang")), "dictionary")

    frequent = filter_ = None
    for orders in ((1, 2), *((k,) for k in range(3, LONGEST + 1))):
        counts = dictionary.mapInArrow(_hash_counts(orders, filter_), "gram bigint, n bigint")
        found = scratch.keep(counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("gram"), f"frequent-{orders[-1]}")
        frequent = found if frequent is None else frequent.unionByName(found)
        filter_ = spark.sparkContext.broadcast(_filter(frequent))
    counts = dictionary.mapInArrow(_phrase_counts(filter_), "lang string, phrase string, n bigint")
    grams = scratch.keep(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == "")), "grams")

    words = F.split("phrase", " ")
    candidates = grams.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where(F.size("words") > 1)
    piece = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    size, k = F.size("words"), F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), k).alias("left"), piece(k + 1, size - k).alias("right"))
    part = lambda name, count: grams.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(count))
    for name, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(name, count), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(name) == F.col(f"{name}_phrase")))
    score = F.expr("2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    # every run of two words or more inside a longer candidate, with the occurrences of the longest-lived one
    begins = F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda b: F.array_join(F.slice("words", b, m), " ")))
    inside = candidates.where(size > 2).select("lang", F.col("a").alias("longer"), F.explode(F.flatten(begins)).alias("phrase"))
    covers = inside.groupBy(F.col("lang").alias("in_lang"), F.col("phrase").alias("in_phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(covers, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    kept = kept.where(F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {cover}"))
    kept = scratch.keep(kept.select("lang", "phrase", "a", "best.l", "best.r", F.col("best.score").alias("score")), "scored")
    ranked = _first(kept, "lang", [F.desc("score"), F.desc("a"), "phrase"], first)
    totals = grams.where("phrase = ''").select(F.col("lang").alias("of"), "n")
    return ranked.join(totals, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB, over ``documents``.
SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
  FROM documents),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
placed AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS b FROM pieces),
phrases AS (SELECT lang, words[b : b + m - 1] AS words FROM placed, range(1, 5) s(m) WHERE b + m - 1 <= len(words)),
grams AS (SELECT lang, words, array_to_string(words, ' ') AS phrase, count(*) AS a FROM phrases GROUP BY lang, words HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, words, a, unnest(range(1, len(words))) AS k FROM grams),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, f.a AS l, s.a AS r,
    CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(f.a AS HUGEINT) + s.a) AS BIGINT) AS score
  FROM cuts c
  JOIN grams f ON f.lang = c.lang AND f.phrase = array_to_string(c.words[: k], ' ')
  JOIN grams s ON s.lang = c.lang AND s.phrase = array_to_string(c.words[k + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[b : b + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, words, a, unnest(range(1, len(words))) AS b FROM grams WHERE len(words) > 2), range(2, 4) s(m)
  WHERE m < len(words) AND b + m - 1 <= len(words) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
