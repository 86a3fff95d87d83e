"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises exactly that text's substrings. A document is parsed
greedily against each automaton into the longest phrases that occur in the language's text; a phrase of a foreign
language breaks off early. The language that needs the fewest phrases a character wins.

Text is reduced to lower-case letters, with one space for each run of anything else. The parse is that of the whole
text. To run in step it is tried in every block of BLOCK characters at once, from a short run before the block; where
a block was not entered in the state that the block before ends in, the true state is carried on until both meet.

An automaton's arcs lie packed in one array: a state's base plus the symbol is an arc's slot, and the slot names the
state that owns it. Its size follows the number of arcs, not states times symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlake.llm import words as W

#: The labelled sample of a language: passages, and characters of a passage. All labelled texts are dealt into such
#: passages from end to end, and the hash of text and place draws among all of them. All labels are learned; more than
#: LANGUAGES are an error. A language's automaton takes some 2 MB on the driver and in each task.
PASSAGES, PASSAGE, LANGUAGES = 16, 2_048, 1_000
#: Characters that are parsed in step, and those before them that lead a parse into the state of the whole text's one.
BLOCK, WARM = 512, 64
LOW = 2**32 - 1
UNKNOWN = "und"
#: Letters for which the score compares languages' phrase rates.
SHARPNESS = 64
FIELDS = "lang_pred string, score double"


def reduced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row bounds, code points) of lower-case letters with single spaces between; rows without letters are empty."""
    texts = column.fill_null("").to_pylist()
    joined = "\n".join(t.lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = int(points.max()) + 1 if len(points) else 0
    row = np.cumsum(points == 10)
    seen = np.zeros(high, bool)
    seen[points] = True
    alpha = np.zeros(high, bool)
    alpha[[c for c in np.flatnonzero(seen) if chr(c).isalpha()]] = True
    letter = alpha[points] if len(points) else np.zeros(0, bool)
    keep = letter.copy()
    # a space stays after a letter of the same row if a letter follows somewhere in the row: trailing ones go below
    keep[1:] |= ~letter[1:] & letter[:-1] & (points[1:] != 10)
    points = np.where(letter, points, 32)[keep]
    row = row[keep]
    last = np.ones(len(points), bool)
    last[:-1] = row[1:] != row[:-1]
    drop = last & (points == 32)
    return np.concatenate([[0], np.cumsum(np.bincount(row[~drop], minlength=len(texts)))]).astype(np.int64), points[~drop]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Arcs by state of the least automaton of all substrings; state 0 is empty."""
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(arcs)
        arcs.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return arcs


def packed(arcs: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base of each state, owner of each slot or -1, where its arc leads), for symbols 0 to ``alphabet``.

    States with many arcs are placed first; each round, the states that are left try random bases, and those keep
    theirs whose slots are all free and wanted by no state before them.
    """
    count = np.array([len(a) for a in arcs])
    owner_of = np.repeat(np.arange(len(arcs)), count)
    symbol = np.fromiter((c for a in arcs for c in a), np.int64, int(count.sum()))
    target = np.fromiter((t for a in arcs for t in a.values()), np.int32, int(count.sum()))
    first = np.cumsum(count) - count
    room = 3 * len(symbol) + 1
    base, owner, leads = np.zeros(len(arcs), np.int32), np.full(room + alphabet + 1, -1, np.int32), np.full(room + alphabet + 1, -1, np.int32)
    random = np.random.default_rng(1)
    left = np.argsort(-count, kind="stable")
    left = left[count[left] > 0]
    while len(left):
        # a batch of states whose arcs fill a small part of the room
        batch = left[: max(1, int(np.searchsorted(np.cumsum(count[left]), room // 16)))]
        n = count[batch]
        arc = np.repeat(first[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        state = np.repeat(np.arange(len(batch)), n)
        tried = random.integers(0, room, len(batch))
        slot = tried[state] + symbol[arc]
        taken = owner[slot] >= 0
        again = np.ones(len(slot), bool)
        again[np.unique(slot, return_index=True)[1]] = False
        lost = np.zeros(len(batch), bool)
        lost[state[taken | again]] = True
        fits = ~lost[state]
        owner[slot[fits]], leads[slot[fits]] = owner_of[arc[fits]], target[arc[fits]]
        base[batch[~lost]] = tried[~lost]
        left = np.concatenate([batch[lost], left[len(batch) :]])
    return base, owner, leads


class Model:
    """The languages, the symbols of the alphabet, and a packed automaton for each language."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.points = np.array(sorted({ord(c) for t in texts.values() for c in t}), np.uint32)
        #: the symbol after the last one stands for letters that no language has; no state has an arc for it
        width = len(self.points)
        symbol = {chr(c): k for k, c in enumerate(self.points)}
        #: of each language: base of a state; owner and target of a slot, in one number; where the root goes by symbol
        self.automata = []
        for x in self.languages:
            arcs = suffix_automaton([symbol[c] for c in texts[x]])
            base, owner, leads = packed(arcs, width)
            root = np.zeros(width + 1, np.int64)
            root[list(arcs[0])] = list(arcs[0].values())
            self.automata.append((base.astype(np.int64), owner.astype(np.int64) << 32 | np.maximum(leads, 0), root))

    def blocks(self, bounds: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, size, place in its row, symbols) of each block, symbols as (character, block)."""
        symbol_of = np.full(max(int(points.max(initial=0)), int(self.points[-1])) + 1, len(self.points), np.int32)
        symbol_of[self.points] = np.arange(len(self.points))
        sizes = np.diff(bounds)
        counts = -(-sizes // BLOCK)
        first = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(row)) - first[row]
        symbols = np.zeros(len(row) * BLOCK, np.int64)
        symbols[np.arange(len(points)) + np.repeat(first * BLOCK - bounds[:-1], sizes)] = symbol_of[points]
        return row, np.minimum(sizes[row] - place * BLOCK, BLOCK), place, np.ascontiguousarray(symbols.reshape(-1, BLOCK).T)

    def phrases(self, bounds: np.ndarray, points: np.ndarray) -> np.ndarray:
        """(row, language): phrases of the greedy parse of each row."""
        row, size, place, symbols = self.blocks(bounds, points)
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        if len(row):
            for k, automaton in enumerate(self.automata):
                total[:, k] = np.bincount(row, _parse(automaton, size, place, symbols), minlength=len(total))
        return total


def _step(automaton, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a phrase began): at the root, and where the last phrase can't go on, one does.

    A character that the language lacks is a phrase of its own, and leaves the parse at the root.
    """
    base, slots, root = automaton
    slot = slots.take(base.take(state) + symbol)
    ends = slot >> 32 != state
    return np.where(ends, root.take(symbol), slot & LOW), ends | (state == 0)


def _parse(automaton, size: np.ndarray, place: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Phrases that the parse of its row begins in each block."""
    # every block but a row's first is entered in the state of a parse that began WARM characters before
    entry = np.zeros(len(size), np.int64)
    later = np.flatnonzero(place > 0)
    state = entry[later]
    for t in range(BLOCK - WARM, BLOCK):
        state, _ = _step(automaton, state, symbols[t, later - 1])
    entry[later] = state
    # all blocks in step: state after each character, and whether a phrase began with it
    order = np.argsort(-size, kind="stable")
    sizes, ordered = size[order], np.ascontiguousarray(symbols[:, order])
    states, began = np.zeros(symbols.shape, np.int64), np.zeros(symbols.shape, bool)
    state, alive = entry[order], len(size)
    for t in range(int(sizes[0])):
        while sizes[alive - 1] <= t:
            alive -= 1
        state, began[t, :alive] = _step(automaton, state[:alive], ordered[t, :alive])
        states[t, :alive] = state
    lane = np.empty(len(order), np.int64)
    lane[order] = np.arange(len(order))
    # blocks that were not entered in the state that the block before ends in are parsed again, up to where both meet;
    # the first such block of a row is right then, and so in the end are all
    while True:
        before = states[BLOCK - 1, lane[later - 1]]
        wrong = later[entry[later] != before]
        if not len(wrong):
            return began.sum(axis=0)[lane]
        state = entry[wrong] = before[entry[later] != before]
        for t in range(BLOCK):
            own = lane[wrong]
            state, began[t, own] = _step(automaton, state, symbols[t, wrong])
            go = (state != states[t, own]) & (t + 1 < size[wrong])
            states[t, own] = state
            wrong, state = wrong[go], state[go]
            if not len(wrong):
                break


def train(docs: DataFrame, text: str, lang: str, passages: int = PASSAGES, passage: int = PASSAGE, languages: int = LANGUAGES) -> dict[str, str]:
    """Reduced training text by language: at most ``passages`` of ``passage`` characters, drawn from all labelled texts.

    A bounded sample: the driver gets at most ``passages`` * ``passage`` characters of each language, and more than
    ``languages`` labels are an error. Passages go by the hash of their text and their place in it, so the choice depends on contents
    only, and copies of a text count once.
    """
    labelled = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).cast("string").alias("of"), F.col(text).cast("string").alias("whole"), F.xxhash64(text).alias("hash"))
    dealt = labelled.withColumn("at", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(whole) - 1) div {passage} as int)"))))
    dealt = dealt.select("of", F.xxhash64("hash", "at").alias("place"), F.substring("whole", F.col("at") * passage + 1, F.lit(passage)).alias("body"))
    found: dict[str, list] = {}
    for r in W.first_by_hash(dealt, "of", "place", passages, languages).collect():
        found.setdefault(r["of"], []).append((r["place"], r["body"]))
    out = {}
    for of, bodies in found.items():
        bounds, points = reduced(pa.array([b for _, b in sorted(bodies)]))
        out[of] = " ".join("".join(map(chr, points[a:b])) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)
    return {k: v for k, v in out.items() if v}


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    bounds, _ = W.text_bytes(column)
    for low, high in W.chunks(bounds):
        yield column.slice(low, high - low)


def _predict(model: Model):
    names = np.array([*model.languages, UNKNOWN])

    def compute(column):
        best, scores = [], []
        for part in _parts(column):
            if not len(model.languages):
                best.append(np.zeros(len(part), np.int64)), scores.append(np.zeros(len(part)))
                continue
            bounds, points = reduced(part)
            size = np.diff(bounds)
            rate = model.phrases(bounds, points) / np.maximum(size, 1)[:, None]
            likely = np.exp(-SHARPNESS * (rate - rate.min(axis=1, keepdims=True)))
            none = size == 0
            best.append(np.where(none, len(model.languages), rate.argmin(axis=1)))
            scores.append(np.where(none, 0.0, (likely / likely.sum(axis=1, keepdims=True)).max(axis=1)))
        return [pa.array(names[np.concatenate(best)] if best else [], pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]

    return compute


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None, passages: int = PASSAGES, passage: int = PASSAGE, languages: int = LANGUAGES) -> DataFrame:
    """Adds lang_pred and score to ``docs``; one row per input row.

    ``training``: labelled rows with columns ``text`` and ``lang``; nulls in either teach nothing. The automata learn
    from a bounded sample of it: at most ``passages`` passages of ``passage`` characters for each label; more than
    ``languages`` labels are an error. lang_pred is one of their values, `und` for null texts, texts without a letter, and where
    nothing was learned; ties go to the first name. ``score``: share of the winner among exp(-SHARPNESS * phrases a
    letter), 0 for `und`. Texts are parsed whole. Columns of ``carry`` (None: all) stay unless a result has their
    name; repeated rows are judged each. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(train(training, text, lang, passages, passage, languages)))
    return W.with_columns(docs, text, FIELDS, carry, lambda: _predict(model.value))
