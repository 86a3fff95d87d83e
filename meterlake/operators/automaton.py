"""Many words in many texts: an automaton with failure links in arrays, walked by all texts of a batch in step."""

from __future__ import annotations

import numpy as np

#: Transitions that are tabled whole, for the states nearest to the root; the others' are hashed, with failure links.
CELLS = 1 << 22
#: Bytes that one walk covers; texts are cut into so many, and walks of one batch go in step.
STRETCH = 512
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Finds all occurrences of some words, overlapping and nested ones too, in UTF-8.

    States are numbered by depth. ``fail`` is the longest proper suffix that is a state, ``ending`` the next word on
    that chain. Bytes that no word has are alike. Its size is some 60 bytes a byte of the words, and 16 MB for tables.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(set(words) - {""})
        data = [w.encode() for w in self.words]
        self.sizes = np.array([len(w) for w in data], np.int64)
        self.longest = int(self.sizes.max()) if len(data) else 0
        self._trie(data)
        self._links()

    def _trie(self, data: list[bytes]) -> None:
        """All words go down one byte at a time; equal (state, kind of byte) pairs of a depth share a state."""
        whole = np.frombuffer(b"".join(data), np.uint8)
        own = np.unique(whole)
        #: 1, 2, ... for the bytes of words, 0 for all others
        self.kinds = np.zeros(256, np.int64)
        self.kinds[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        whole = self.kinds[whole]
        starts = np.cumsum(self.sizes) - self.sizes
        at = np.zeros(len(data), np.int64)
        keys, self.depths, count = [], [0, 1], 1
        for depth in range(self.longest):
            some = np.flatnonzero(self.sizes > depth)
            key, of = np.unique(at[some] << 8 | whole[starts[some] + depth], return_inverse=True)
            at[some] = count + of
            count += len(key)
            keys.append(key)
            self.depths.append(count)
        #: the word that ends at a state, -1 without one; the (state, kind) pairs that lead to states 1, 2, ...
        self.word = np.full(count, -1, np.int64)
        self.word[at] = np.arange(len(data))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        bits = max(4, (2 * count).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        wait = np.arange(len(self.keys))
        slot = self._slot(self.keys)
        while len(wait):  # of the keys that want a free slot one gets it, the others go on to the next slot
            free = self.slots[slot] < 0
            self.slots[slot[free]] = self.keys[wait[free]]
            left = self.slots[slot] != self.keys[wait]
            self.values[slot[~left]] = wait[~left] + 1
            wait, slot = wait[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MULTIPLIER >> self.shift).astype(np.int64)

    def _child(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The state after a byte, -1 if the trie has none."""
        keys = states << 8 | kinds
        slot = self._slot(keys)
        found = self.slots[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.slots[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def _links(self) -> None:
        count = len(self.word)
        self.fail = np.zeros(count, np.int64)
        self.ending = np.full(count, -1, np.int64)
        tabled = min(max(1, CELLS // self.width), count)
        table = np.zeros((tabled, self.width), np.int64)
        self.flat, self.tabled, every = table.ravel(), 0, np.arange(self.width)
        for low, high in zip(self.depths[:-1], self.depths[1:], strict=True):
            states = np.arange(low, high)
            if low:
                parent, kind = self.keys[states - 1] >> 8, self.keys[states - 1] & 255
                # what the parent's failure leads to; for the root's children that is the root
                self.fail[states] = np.where(parent == 0, 0, self._step(self.fail[parent], kind))
                own = self.fail[states]
                self.ending[states] = np.where(self.word[own] >= 0, own, self.ending[own])
            rows = states[states < tabled]
            if len(rows):  # a tabled row is that of its failure, but for its own children
                if low:
                    table[rows] = table[self.fail[rows]]
                own = self._child(np.repeat(rows, self.width), np.tile(every, len(rows))).reshape(len(rows), self.width)
                table[rows] = np.where(own >= 0, own, table[rows])
                self.tabled = int(rows[-1]) + 1
        self.flat = table.astype(np.int32).ravel()
        self.hit = (self.word >= 0) | (self.ending >= 0)

    def _step(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The state of each walk after a byte: failures are followed until a state has the byte, or is tabled."""
        far = states >= self.tabled
        left = np.flatnonzero(far)
        out = self.flat[np.where(far, 0, states) * self.width + kinds if len(left) else states * self.width + kinds].astype(np.int64)
        now, kind = states[left], kinds[left]
        while len(left):
            child = self._child(now, kind)
            found = child >= 0
            out[left[found]] = child[found]
            left, now, kind = left[~found], self.fail[now[~found]], kind[~found]
            near = now < self.tabled
            out[left[near]] = self.flat[now[near] * self.width + kind[near]]
            left, now, kind = left[~near], now[~near], kind[~near]
        return out

    def matches(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, word) of all occurrences in texts data[bounds[k]:bounds[k + 1]], ``begin`` as a place in data.

        A text is walked in stretches. A state depends on as many bytes as the longest word has, so a walk begins that
        many bytes before its stretch and reports what ends inside it.
        """
        if not len(self.words) or not len(data):
            return (np.zeros(0, np.int64),) * 3
        stretch = max(STRETCH, 2 * self.longest)
        sizes = np.diff(bounds)
        pieces = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), pieces)
        begin = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        end = np.minimum(begin + stretch, bounds[text + 1])
        start = np.maximum(begin - self.longest + 1, bounds[text])
        order = np.argsort(start - end, kind="stable")
        text, begin, start, length = text[order], begin[order], start[order], (end - start)[order]
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # walks that are longer than a step
        state, kinds = np.zeros(len(text), np.int64), self.kinds.astype(np.uint8)[data]
        walks, places, states = [], [], []
        for j, m in enumerate(active):
            now = self._step(state[:m], kinds[start[:m] + j].astype(np.int64))
            state[:m] = now
            hit = np.flatnonzero(self.hit[now])
            if len(hit):
                walks.append(hit)
                places.append(start[hit] + j + 1)
                states.append(now[hit])
        if not walks:
            return (np.zeros(0, np.int64),) * 3
        walk, place, now = np.concatenate(walks), np.concatenate(places), np.concatenate(states)
        inside = place > begin[walk]
        walk, place, now = walk[inside], place[inside], now[inside]
        found = []
        while len(now):
            own = self.word[now]
            here = own >= 0
            found.append((text[walk[here]], place[here] - self.sizes[own[here]], own[here]))
            now = self.ending[now]
            more = now >= 0
            walk, place, now = walk[more], place[more], now[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of lower-cased texts; null is empty."""
    data = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), bounds
