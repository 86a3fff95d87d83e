"""Token estimates, blocked words and fingerprints. Words are sought by one automaton, for all texts of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from meterlake.operators.automaton import Automaton, lowered

#: Weights of each provider.
WEIGHTS = {
    "gemini": {"word": 1.15, "number": 2.8, "cjk": 0.68, "symbol": 0.38, "math": 1.05, "url": 1.2, "at": 2.5, "emoji": 1.08, "newline": 1.15, "space": 0.2},
    "claude": {"word": 1.13, "number": 1.63, "cjk": 1.21, "symbol": 0.4, "math": 4.52, "url": 1.26, "at": 2.82, "emoji": 2.6, "newline": 0.89, "space": 0.39},
    "openai": {"word": 1.02, "number": 1.55, "cjk": 0.85, "symbol": 0.4, "math": 2.68, "url": 1.0, "at": 2.0, "emoji": 2.12, "newline": 0.5, "space": 0.42},
}
#: Characters of the classes.
MATH = "∑∫∂√∞≤≥≠≈±×÷∈∉∋∌⊂⊃⊆⊇∪∩∧∨¬∀∃∄∅∆∇∝∟∠∡∢°′″‴⁺⁻⁼⁽⁾ⁿ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎²³¹⁴⁵⁶⁷⁸⁹⁰"
URL = "/:?&=;#%"
MATH_RANGES = ((0x2200, 0x22FF), (0x2A00, 0x2AFF), (0x1D400, 0x1D7FF))
EMOJI_RANGES = ((0x1F300, 0x1F9FF), (0x2600, 0x27BF), (0x1FA00, 0x1FAFF))
CJK_RANGES = ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def provider_of(model: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains("gemini"), "gemini").when(name.contains("claude"), "claude").otherwise("openai")


def _set(*parts) -> str:
    """A pattern of one character of some ranges and letters."""
    ranges = (r for part in parts for r in (part if isinstance(part, tuple) else [(ord(c), ord(c)) for c in part]))
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"


NEWLINE, SPACE = r"[\t\n]", r"[\x0B\f\r\x{85}\p{Z}]"


def class_counts(text: Column) -> dict[str, Column]:
    """Characters of each class of WEIGHTS, runs of letters and runs of digits counting once. The first class that fits
    counts: white space, ideographs, emoji, letters and digits, mathematics, @, signs of URLs, other symbols."""
    body = F.coalesce(text, F.lit(""))
    own = _set(CJK_RANGES, EMOJI_RANGES)
    # ideographs and emoji make room for a sign without a class, so that they part runs of letters and of digits
    runs = F.regexp_replace(body, own, "\x01")
    signs = F.regexp_replace(body, rf"[{own}{NEWLINE}{SPACE}\p{{L}}\p{{N}}]", "")
    count = lambda of, pattern: F.regexp_count(of, F.lit(pattern))
    found = {
        "newline": count(body, NEWLINE), "space": count(body, SPACE), "cjk": count(body, _set(CJK_RANGES)), "emoji": count(body, _set(EMOJI_RANGES)),
        "word": count(runs, r"\p{L}+"), "number": count(runs, r"\p{N}+"), "math": count(signs, _set(MATH, MATH_RANGES)), "at": count(signs, "@"), "url": count(signs, _set(URL)),
    }
    return found | {"symbol": F.length(signs) - found["math"] - found["at"] - found["url"]}


def estimate_tokens(text: str, column: Column | str) -> Column:
    """Estimated tokens of a text for the provider named in ``column``. Null and empty texts have 0."""
    provider = F.col(column) if isinstance(column, str) else column

    def weight(kind):
        of = lambda name: F.lit(Decimal(str(WEIGHTS[name][kind])))
        return F.when(provider == "gemini", of("gemini")).when(provider == "claude", of("claude")).otherwise(of("openai")).cast("decimal(4,2)")

    total = sum((count.cast("decimal(12,0)") * weight(kind) for kind, count in class_counts(F.col(text)).items()), F.lit(0))
    return F.ceil(total).cast("bigint")


#: Bytes of texts that are walked together, and are Python's strings at once.
WALKED = 1 << 21


def _parts(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of Arrow batches in runs of about WALKED bytes: rows of a batch are bounded, their bytes are not."""
    for texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + WALKED, side="right")))
            yield texts.slice(low, high - low).to_pylist()
            low = high


def _occurrences(automaton: Automaton, texts: list[str | None]) -> tuple:
    """(data, bounds, text, begin, word): all occurrences in the lower-cased texts, in order of text and place, longer words
    first."""
    data, bounds = lowered(texts)
    text, begin, word = automaton.matches(data, bounds)
    order = np.lexsort((word, -automaton.sizes[word], begin, text))
    return data, bounds, text[order], begin[order], word[order]


def _automaton(words: list[str]) -> Automaton:
    return Automaton([w.strip().lower() for w in words])


def sensitive_words(text: str, words: list[str], first_only: bool = False) -> Column:
    """Blocked words found anywhere in the lower-cased text: each once, in order of place; or only the first."""
    automaton = _automaton(words)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _parts(batches):
            out: list[list[str]] = [[] for _ in texts]
            _, _, of, _, word = _occurrences(automaton, texts)
            _, one = np.unique(of * len(automaton.words) + word, return_index=True)
            one.sort()
            for k, w in zip(of[one].tolist(), word[one].tolist(), strict=True):
                if not first_only or not out[k]:
                    out[k].append(automaton.words[w])
            yield pa.array(out, pa.list_(pa.string()))

    return run(F.col(text))


def replace_words(text: str, words: list[str], mask: str = "**###**") -> Column:
    """struct(text, hits): leftmost longest matches in the lower-cased text, not overlapping, replaced; null stays null.

    A character that lower-cases to two (U+0130) is replaced whole if a match holds a part of it.
    """
    automaton = _automaton(words)

    def replaced(t: str, data: np.ndarray, begin: np.ndarray, word: np.ndarray) -> tuple[str, list[str]]:
        # the character of the lower-cased text that each byte belongs to, and that of the text it comes from
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        place = range(len(t)) if char[-1] + 1 == len(t) else [k for k, c in enumerate(t) for _ in c.lower()]
        out, hits, at, free = [], [], 0, 0
        for b, w in zip(begin.tolist(), word.tolist(), strict=True):
            if b >= free:  # the first one at a place is the longest
                free = b + int(automaton.sizes[w])
                out += [t[at : place[char[b]]], mask]
                hits.append(automaton.words[w])
                at = place[char[free - 1]] + 1
        return "".join([*out, t[at:]]), list(dict.fromkeys(hits))

    @F.arrow_udf("text string, hits array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _parts(batches):
            hits: list[list[str]] = [[] for _ in texts]
            data, bounds, of, begin, word = _occurrences(automaton, texts)
            for k in np.unique(of).tolist():
                own = slice(*np.searchsorted(of, [k, k + 1]))
                texts[k], hits[k] = replaced(texts[k], data[bounds[k] : bounds[k + 1]], begin[own] - bounds[k], word[own])
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.string()))], names=["text", "hits"])

    return run(F.col(text))


def scan_conversations(turns: DataFrame, words: list[str]) -> DataFrame:
    """(conv_id, flagged, first_turn, hits) of each conversation: its first turn with a blocked word."""
    found = turns.withColumn("found", sensitive_words("text", words)).select("conv_id", "turn", "found")
    hit = F.size("found") > 0
    return found.groupBy("conv_id").agg(F.max(hit).alias("flagged"), F.min(F.when(hit, F.col("turn"))).alias("first_turn"), F.count_if(hit).alias("hits"))


def fingerprint(column: str) -> Column:
    """SHA-256 of a secret without trailing space; '' stays ''."""
    secret = F.regexp_replace(F.col(column), r"\s+$", "")
    return F.when(secret == "", "").otherwise(F.sha2(secret, 256))
