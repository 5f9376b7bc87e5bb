"""Which of many texts are like one, by ``difflib``'s ratio: bounds for all, the ratio for few.

The ratio is twice the letters in matching blocks over the letters of both texts.  Blocks
cross nowhere, so they hold no more than the longest common subsequence.  In a second
text of 200 letters or more ``difflib`` looks for blocks only from letters that are at most
a hundredth of it, so each block but one at the beginning of both texts holds such a
letter, an anchor here, and reaches no further than the texts agree around it.
"""

from __future__ import annotations

import difflib
from collections import Counter
from functools import cached_property

import numpy as np

#: From so many letters on the second text has letters that start no block.
LONG = 200
#: Letters beyond the 253 most frequent ones share a code, which can only raise a bound; marks after a known text and after the wanted one agree with nothing.
OTHER, END, OWN_END = 253, 254, 255
#: Agreement around an anchor is read eight letters at a time, so often; what agrees further counts as far as the next anchor.
DEPTH = 4
_PAD = 8 * DEPTH + 16
#: Numbers of a table at a time.
CELLS = 1 << 19
_BYTES = np.array([1] + [1 << 8 * i for i in range(1, 8)], np.uint64)
_WORD, _ALL = 63, np.uint64((1 << 63) - 1)
_SLACK = 1e-9


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _eights(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the eight letters from it on, and the eight before it from the last on;
    the nearest letter is the highest byte."""
    right, left = (np.zeros(len(codes), np.uint64) for _ in range(2))
    for d in range(8):
        shift = np.uint64(56 - 8 * d)
        right[: len(codes) - d] |= codes[d:].astype(np.uint64) << shift
        left[d + 1 :] |= codes[: len(codes) - d - 1].astype(np.uint64) << shift
    return right, left


def _subsequence(size: int, masks: list[int]) -> int:
    """The longest common subsequence, of a text of ``size`` with the one whose letters stand
    at the bits of ``masks`` in it."""
    every = left = (1 << size) - 1
    for mask in masks:
        now = left & mask
        left = left + now | left - now
    return size - (left & every).bit_count()


def _longest(x: str, y: str) -> tuple[int, int, int]:
    """Where the longest common piece begins in either text, and its size; of several the first
    in ``x``, then in ``y``."""
    width = len(y) // 8 + 1  # bytes of a row of the table of equal letters, the last bit free
    rows = {c: 0 for c in x}
    for at, c in enumerate(y):
        if c in rows:
            rows[c] |= 1 << at
    rows = {c: r.to_bytes(width, "little") for c, r in rows.items()}
    equal = int.from_bytes(b"".join([rows[c] for c in x]), "little")
    # Pairs that begin a run of 1, 2, 4 ... equal letters; then the longest run by its bits.
    down, runs = 8 * width + 1, [equal]
    while more := runs[-1] & runs[-1] >> down * (1 << len(runs) - 1):
        runs.append(more)
    now, size = runs[-1], 1 << len(runs) - 1
    for step in range(len(runs) - 2, -1, -1):
        if more := now & runs[step] >> down * size:
            now, size = more, size + (1 << step)
    a, b = divmod((now & -now).bit_length() - 1, 8 * width)
    return a, b, size


def _agreeing(difference: np.ndarray) -> np.ndarray:
    """How many of the highest bytes are zero."""
    return 8 - np.searchsorted(_BYTES, difference, "right")


class _Contexts:
    """What stands beyond anchors to the right (sign 1) or left (-1), eight letters at a time: a
    tree of nodes, the first of which begin with the letter of the anchor.  Most anchors
    of similar texts share their nodes, so a text is compared with nodes."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, letter: np.ndarray, sign: int):
        eights = _eights(codes)[sign < 0]
        self.sign, self.levels, node = sign, [], letter.astype(np.int64)
        at, above = at + (sign > 0), 256
        for depth in range(DEPTH):
            keys, key = np.unique(eights[at + sign * 8 * depth], return_inverse=True)
            nodes, node = np.unique(node * len(keys) + key, return_inverse=True)
            parent = nodes // len(keys)
            # Key and parent of each node, and where the nodes of each parent begin.
            self.levels.append((keys[nodes % len(keys)], parent, np.searchsorted(parent, np.arange(above + 1))))
            above = len(nodes)
        self.node = node.astype(np.int32)

    def reach(self, coded: np.ndarray, eights: np.ndarray) -> np.ndarray:
        """How many letters beyond an anchor of each last node agree with those beyond one of the
        places of the anchor's letter in a text; far more than all if too many."""
        above, at = coded.astype(np.int64), np.arange(len(coded)) + _PAD + (self.sign > 0)
        reach = np.zeros(256, np.int32)
        for depth, (keys, parent, begins) in enumerate(self.levels):
            reach, before = reach[parent], np.cumsum(begins[above + 1] - begins[above])
            agreed = []
            for s, e in _slices(before):  # pairs of a node and a place whose letters have agreed so far
                many = begins[above[s:e] + 1] - begins[above[s:e]]
                first = np.cumsum(many) - many
                child = np.repeat(begins[above[s:e]] - first, many) + np.arange(int(many.sum()))
                place = np.repeat(at[s:e], many)
                differ = keys[child] ^ eights[place + self.sign * 8 * depth]
                np.maximum.at(reach, child, (8 * depth + _agreeing(differ)).astype(np.int32))
                agreed.append((child[differ == 0], place[differ == 0]))
            above, at = (np.concatenate(x) for x in zip(*agreed, strict=True)) if agreed else (above[:0], at[:0])
        reach[above] = 1 << 20
        return reach


def _slices(upto: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a list of counts, given as running sums, of about ``CELLS`` each."""
    cuts = np.searchsorted(upto, np.arange(CELLS, upto[-1] if len(upto) else 0, CELLS)) + 1
    cuts = np.unique(np.concatenate([[0], cuts, [len(upto)]])).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Known:
    """Texts that others are compared with, in order of their size."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.array([len(x) for x in texts], np.int64)
        letters, n = _letters(texts), len(texts)
        often = np.bincount(letters)
        found = np.flatnonzero(often)
        found = found[np.argsort(-often[found], kind="stable")][:OTHER]
        self.table = np.full(0x110000, OTHER, np.uint8)
        self.table[found] = np.arange(len(found))
        coded, row = self.table[letters], np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        place = np.arange(len(letters), dtype=np.int32) + row + _PAD
        self.codes = np.full(len(letters) + n + 2 * _PAD, END, np.uint8)
        self.codes[place] = coded
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1 + _PAD
        counts = np.bincount(row * 256 + coded, minlength=n * 256).reshape(n, 256).astype(np.int32)
        self.used = np.flatnonzero(counts.any(axis=0))
        self.counts = np.ascontiguousarray(counts[:, self.used].T)
        # Anchors: in order of their places, and by letter.
        rare = counts <= (self.sizes // 100 + 1)[:, None]
        rare[:, OTHER] = True
        self.first_long = int(np.searchsorted(self.sizes, LONG))
        long = int(self.sizes[: self.first_long].sum())
        is_anchor = rare[row[long:], coded[long:]]
        is_anchor[self.starts[self.first_long :] - _PAD - np.arange(self.first_long, n) - long] = True
        self.at, row = place[long:][is_anchor], row[long:][is_anchor]
        self.from_row = np.searchsorted(row, np.arange(n + 1))
        # Letters between an anchor and the one before it; the first is where a text begins.
        self.before = np.diff(self.at, prepend=0) - 1
        self.before[self.from_row[self.first_long : n]] = 0
        self.ends = self.starts + self.sizes
        self.letter = self.codes[self.at]
        self.around = [_Contexts(self.codes, self.at, self.letter, sign) for sign in (1, -1)] if len(self.at) else []

    def rare(self, i: int) -> set[str]:
        """Letters of a long text that start blocks."""
        y = self.texts[i]
        return {c for c, n in Counter(y).items() if n <= len(y) // 100 + 1}


class Wanted:
    """A text and what is known of its likeness with ``known`` ones."""

    def __init__(self, text: str, known: Known):
        self.text, self.known, self.size = text, known, len(text)
        self.coded = known.table[_letters([text])]

    @cached_property
    def masks(self) -> dict[str, int]:
        """Where each letter stands, as bits."""
        out = {}
        for at, c in enumerate(self.text):
            out[c] = out.get(c, 0) | 1 << at
        return out

    @cached_property
    def eights(self) -> tuple[np.ndarray, np.ndarray]:
        marks = np.full(_PAD, OWN_END, np.uint8)
        return _eights(np.concatenate([marks, self.coded, marks]))

    def like_sizes(self, least: float) -> tuple[int, int]:
        """The known texts whose size alone allows a ratio of ``least``."""
        sizes = self.known.sizes
        return int(np.searchsorted(sizes, np.floor(self.size * least / (2 - least)) - 1)), int(np.searchsorted(sizes, np.ceil(self.size * (2 - least) / least) + 1, "right"))

    def ratio(self, letters: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 2 * letters / (self.known.sizes[rows] + self.size)

    def by_letters(self, lo: int, hi: int) -> np.ndarray:
        """At most the letters that both texts have are in blocks."""
        own = np.bincount(self.coded, minlength=256)[self.known.used].astype(np.int32)
        shared = np.zeros(hi - lo, np.int32)
        for letter, n in enumerate(own):
            if n:
                shared += np.minimum(self.known.counts[letter, lo:hi], n)
        return shared

    def by_subsequence(self, rows: np.ndarray) -> np.ndarray:
        """The longest common subsequence with each of ``rows``: a bit for each letter of the
        wanted text, all known ones letter by letter together."""
        known, words = self.known, -(-self.size // _WORD)
        out = np.empty(len(rows), np.int64)
        if not len(rows):
            return out
        order = np.argsort(-known.sizes[rows], kind="stable")
        sizes = known.sizes[rows][order]
        masks = np.zeros((words, 256), np.uint64)
        at = np.arange(self.size)
        np.bitwise_or.at(masks, (at // _WORD, self.coded), np.uint64(1) << (at % _WORD).astype(np.uint64))
        valid = np.bitwise_or.reduce(masks, axis=1)
        steps = np.arange(int(sizes[0]))
        going = len(rows) - np.searchsorted(sizes[::-1], steps, "right")
        letters = known.codes[np.minimum(known.starts[rows][order][None, :] + steps[:, None], len(known.codes) - 1)]
        left = np.full((words, len(rows)), _ALL)
        room = np.empty((2, words, len(rows)), np.uint64)
        for step, n in zip(steps.tolist(), going.tolist(), strict=True):
            now, (mask, total) = left[:, :n], room[:, :, :n]
            for w in range(words):
                masks[w].take(letters[step, :n], out=mask[w], mode="clip")
            np.bitwise_and(now, mask, out=total)
            mask ^= _ALL
            total += now
            for w in range(1, words):
                total[w] += total[w - 1] >> np.uint64(_WORD)
            total &= _ALL
            now &= mask
            now |= total
        out[order] = np.bitwise_count(~left & valid[:, None]).sum(axis=0)
        return out

    @cached_property
    def reaches(self) -> list[np.ndarray]:
        return [x.reach(self.coded, self.eights[x.sign < 0]) for x in self.known.around]

    def by_anchors(self, lo: int, hi: int) -> np.ndarray:
        """Letters of the long known texts from ``lo`` to ``hi`` that can be in blocks: anchors
        that the wanted text has, and between two of them what agrees next to either."""
        known = self.known
        a, b = known.from_row[lo], known.from_row[hi]
        right, left = (reach[x.node[a:b]] for reach, x in zip(self.reaches, known.around, strict=True))
        has = np.zeros(256, np.int32)
        has[self.coded] = 1
        left[1:] += right[:-1]
        met = has[known.letter[a:b]] + np.minimum(known.before[a:b], left)
        last = known.from_row[lo + 1 : hi + 1] - 1
        tails = np.minimum(known.ends[lo:hi] - known.at[last] - 1, right[last - a])
        return np.add.reduceat(met, known.from_row[lo:hi] - a) + tails

    def by_chains(self, i: int) -> int:
        """The longest common subsequence with a long known text of those pairs of letters only
        that agree next to each other up to an anchor."""
        y, own, rare = self.known.texts[i], self.masks, self.known.rare(i)
        anchor = [c in rare for c in y]
        anchor[0] = True
        masks, run, after = [own.get(c, 0) for c in y], 0, []
        for mask, is_anchor in zip(masks, anchor, strict=True):
            run = mask if is_anchor else mask & run << 1
            after.append(run)
        run = 0
        for at in range(len(y) - 1, -1, -1):
            run = masks[at] if anchor[at] else masks[at] & run >> 1
            masks[at] = run | after[at]
        return _subsequence(self.size, masks)

    def blocks(self, i: int, least: int) -> int:
        """Letters in matching blocks with a short known text as ``difflib`` finds them, the
        longest first and then left and right of it; fewer than ``least`` if they are
        fewer, as soon as common subsequences of what is left show that."""
        x, y = self.text, self.known.texts[i]
        own = self.masks
        most = lambda alo, ahi, blo, bhi: _subsequence(ahi - alo, [own.get(c, 0) >> alo for c in y[blo:bhi]]) if alo < ahi and blo < bhi else 0
        open_ = [(most(0, len(x), 0, len(y)), 0, len(x), 0, len(y))]
        bound = open_[0][0]
        while open_ and bound >= least:
            upto, alo, ahi, blo, bhi = open_.pop(max(range(len(open_)), key=open_.__getitem__))
            if not upto:
                break
            a, b, n = _longest(x[alo:ahi], y[blo:bhi])
            parts = [(alo, alo + a, blo, blo + b), (alo + a + n, ahi, blo + b + n, bhi)]
            parts = [(most(*p), *p) for p in parts]
            bound += n + parts[0][0] + parts[1][0] - upto
            open_ += [p for p in parts if p[0]]
        return bound

    def like(self, least: float, best: bool) -> list[tuple[int, float]]:
        """Known texts (number, ratio) whose ratio is ``least`` or more, none left out; with
        ``best`` only the likest of them."""
        found = []

        def compare(rows: np.ndarray, bounds: np.ndarray) -> None:
            nonlocal least
            order = np.argsort(-bounds, kind="stable")
            for i, bound in zip(rows[order].tolist(), bounds[order].tolist(), strict=True):
                if bound < least - _SLACK:
                    break
                y = self.known.texts[i]
                both = len(y) + self.size
                if self.text == y:
                    score = 1.0
                elif len(y) < LONG:
                    score = 2.0 * self.blocks(i, int((least - _SLACK) * both / 2)) / both
                elif 2 * self.by_chains(i) / both < least - _SLACK:
                    continue
                else:
                    score = difflib.SequenceMatcher(None, self.text, y).ratio()
                if score >= least:
                    found.append((i, score))
                    least = score if best else least

        lo, hi = self.like_sizes(least)
        middle = min(max(self.known.first_long, lo), hi)
        rows = np.arange(lo, hi)
        letters = self.ratio(self.by_letters(lo, hi), rows)
        # Short ones: in parts, those first that have most letters in common.
        near = rows[:middle - lo][letters[: middle - lo] >= least - _SLACK]
        near = near[np.argsort(-letters[near - lo], kind="stable")]
        at, many = 0, 256
        while at < len(near) and letters[near[at] - lo] >= least - _SLACK:
            part = near[at : at + many]
            part = part[letters[part - lo] >= least - _SLACK]
            compare(part, self.ratio(self.by_subsequence(part), part))
            at, many = at + many, 2048
        # Long ones.
        if middle < hi:
            bounds = np.minimum(letters[middle - lo :], self.ratio(self.by_anchors(middle, hi), rows[middle - lo :]))
            near = np.flatnonzero(bounds >= least - _SLACK)
            compare(middle + near, bounds[near])
        return [f for f in found if f[1] >= least]
