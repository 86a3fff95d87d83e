"""Line-first quality rules.

Rules look at each line by itself: punctuation, navigation and boilerplate. Lines that break one are removed; a
document that loses too much of its text, or has a base fault, is rejected. All counts are made on whole texts, over
byte arrays of many documents at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterlake.llm import words as W

#: Fixed lists of the rules.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = b"|>"
ENDINGS = ".!?:;,)\"'…»”。！？"  # of a line's last word
BOILERPLATE = (
    b"all rights reserved", b"cookie policy", b"use of cookies", b"terms of use", b"terms of service", b"privacy policy", b"click here",
    b"sign up", b"log in", b"subscribe to", b"share this", b"skip to content", b"lorem ipsum", b"enable javascript",
)
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines_removed bigint, n_words_kept bigint, base_failed boolean, kept boolean"

#: Limits of the line rules and of the document rule.
MAX_SYMBOLS = 0.1  # symbols a word
MAX_SEPARATORS = 0.1  # separators a word
MAX_UPPER = 0.6  # of the ASCII letters, in lines of some words
MAX_REPEATED = 0.3  # words equal to the one before
SHORT_LINE = 3  # words up to which a line without end mark is navigation
BOILERPLATE_WORDS = 20  # words up to which a line with a stock phrase is boilerplate
MAX_LOST = 0.5  # share of a document's words in removed lines


def _mask(of: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(of)] = True
    return found


IS_SYMBOL, IS_SEPARATOR = _mask(SYMBOLS), _mask(SEPARATORS)
IS_UPPER, IS_LETTER = _mask(bytes(range(65, 91))), _mask(bytes([*range(65, 91), *range(97, 123)]))
IS_ALNUM = IS_LETTER | _mask(b"0123456789")


def _ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at ``last`` is an end mark."""
    found = np.zeros(len(last), bool)
    for mark in (x.encode() for x in ENDINGS):
        fits = last >= len(mark) - 1
        for k, byte in enumerate(reversed(mark)):
            fits &= data[np.maximum(last - k, 0)] == byte
        found |= fits
    return found


def _repeated(words: W.Words, size: int = 8) -> np.ndarray:
    """Words of each row in windows of ``size`` words that its text has twice or more."""
    first, value = W.windows(words, size)
    doc = words.doc[first]
    order = np.lexsort((value, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = first[order[twice]]
    cover = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return np.bincount(words.doc[np.cumsum(cover)[:-1] > 0], minlength=words.rows)


def _lines(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row) of every line; rows without bytes have none."""
    data, bounds = words.data, words.bounds
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([bounds[filled], breaks + 1]))
    row = np.searchsorted(bounds, begin, side="right") - 1
    if not len(begin):
        return begin, begin, begin
    # a row that ends in \n has one more line, without bytes; it begins where the next row does and holds no word
    begin, keep = np.unique(begin, return_index=True)
    begin, row = begin[begin < len(data)], row[keep][begin < len(data)]
    end = np.append(begin[1:], len(data))
    return begin, end - (data[end - 1] == 10), row


def _phrase_lines(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lines that hold a stock phrase whole, with no ASCII letter or digit right before or after it in the line."""
    text, found = low.tobytes(), [np.zeros(0, np.int64)]
    for phrase in BOILERPLATE:
        hits, at = [], text.find(phrase)
        while at >= 0:
            hits.append(at)
            at = text.find(phrase, at + 1)
        first = np.array(hits, np.int64)
        last, line = first + len(phrase), np.searchsorted(begin, first, side="right") - 1
        # rows and lines lie side by side in the bytes: what is outside the hit's own line is no neighbour
        inside = last <= end[line]
        free = (first == begin[line]) | ~IS_ALNUM[low[np.maximum(first - 1, 0)]]
        free &= (last >= end[line]) | ~IS_ALNUM[low[np.minimum(last, len(low) - 1)]]
        found.append(line[inside & free])
    return np.unique(np.concatenate(found))


def _counts(words: W.Words) -> list[np.ndarray]:
    data, row_words = words.data, words.per_row()
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    between = lambda sums, low, high: sums[high] - sums[low]
    begins, ends = words.bounds[:-1], words.bounds[1:]
    chars = between(total(~W.SPACE[data] & ((data & 0xC0) != 0x80)), begins, ends)
    symbols = total(IS_SYMBOL[data])
    begin, end, row = _lines(words)
    line = np.searchsorted(begin, words.start, side="right") - 1
    in_line = np.bincount(line, minlength=len(begin))
    # earlier equal lines, by length and hash of all bytes
    powers, inverses = (np.cumprod(np.concatenate([np.ones(1, W.U64), np.full(len(data), x, W.U64)])) for x in (W.BASE, W.BASE_INVERSE))
    sums = np.concatenate([np.zeros(1, W.U64), np.cumsum(W.BYTE_HASH[data] * powers[:-1])])
    value = W.mixed((sums[end] - sums[begin]) * inverses[begin] + (end - begin).astype(W.U64))
    some = np.flatnonzero(in_line > 0)
    order = some[np.lexsort((some, value[some], row[some]))]
    again = order[1:][(row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])]
    dup_lines = np.bincount(row[again], minlength=words.rows)
    repeat_words = _repeated(words)
    # the rules, line by line
    n = np.maximum(in_line, 1)
    last = np.zeros(len(begin), np.int64)
    np.maximum.at(last, line, words.end - 1)
    ended = _ends(data, last)
    upper, letters = between(total(IS_UPPER[data]), begin, end), between(total(IS_LETTER[data]), begin, end)
    doubled = np.zeros(len(words.doc), np.int64)
    doubled[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    bad = (between(symbols, begin, end) > MAX_SYMBOLS * n) & (in_line >= 3)
    bad |= (between(total(IS_SEPARATOR[data]), begin, end) > MAX_SEPARATORS * n) & (in_line >= 3)
    bad |= (upper > MAX_UPPER * letters) & (in_line >= 5) & (letters >= 20)
    bad |= (np.bincount(line, doubled, minlength=len(begin)) > MAX_REPEATED * n) & (in_line >= 5)
    bad |= ~ended & (in_line <= SHORT_LINE)
    stock = _phrase_lines(W.LOWER[data], begin, end)
    bad[stock] |= in_line[stock] <= BOILERPLATE_WORDS
    bad &= in_line > 0
    removed = np.bincount(row[bad], minlength=words.rows)
    left = row_words - np.bincount(row[bad], in_line[bad], minlength=words.rows).astype(np.int64)
    base = (row_words < 20) | (100 * repeat_words > 30 * row_words)
    kept = ~base & (row_words - left <= MAX_LOST * row_words)
    return [row_words, chars, between(symbols, begins, ends), dup_lines, repeat_words, removed, left, base, kept]


def _compute(column):
    parts = [_counts(part) for part in W.split(column)]
    kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
    return [pa.array(np.concatenate(x) if parts else [], k) for x, k in zip(zip(*parts, strict=True) if parts else [[]] * 9, kinds, strict=True)]


def quality_rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words_kept, base_failed, kept.

    A line with a stock phrase counts as boilerplate only if the phrase stands in it as words of its own. One row per
    input row, whatever rows share its batch, with the columns of ``carry`` (None: all); one that has a result's name gives way. Null
    and empty texts have no words and fail. An empty table gives an empty one.
    """
    return W.with_columns(docs, text, FIELDS, carry, lambda: _compute)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same rows in DuckDB, over ``documents`` with doc_id carried.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i, i + 7)) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8)),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
split AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
counted AS (SELECT r, line, len(w) AS n, right(w[-1], 1) AS last, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|>]')) AS separators,
    len(regexp_extract_all(line, '[A-Z]')) AS upper, len(regexp_extract_all(line, '[A-Za-z]')) AS letters, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS doubled,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM split WHERE len(w) > 0),
judged AS (SELECT r, line, n, (symbols > {MAX_SYMBOLS} * n AND n >= 3) OR (separators > {MAX_SEPARATORS} * n AND n >= 3) OR (upper > {MAX_UPPER} * letters AND n >= 5 AND letters >= 20) OR (doubled > {MAX_REPEATED} * n AND n >= 5)
    OR (n <= {SHORT_LINE} AND last NOT IN ({", ".join(map(_quoted, ENDINGS))})) OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(low, '(^|[^a-z0-9])({"|".join(x.decode() for x in BOILERPLATE)})($|[^a-z0-9])')) AS bad FROM counted),
summed AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed, CAST(COALESCE(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS n_words_kept FROM judged GROUP BY r),
based AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words,
    COALESCE(n_lines_removed, 0) AS n_lines_removed, COALESCE(n_words_kept, 0) AS n_words_kept FROM worded LEFT JOIN repeats USING (r) LEFT JOIN summed USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_words_kept <= {MAX_LOST} * n_words AS kept FROM based
"""
