"""One-to-one pairing of two short lists of wordings by the words they share.

Each list belongs to one document, so the pairing is decided in its row. The
strongest pair is taken first, then the next that is still free, and so on, as if
all pairs were sorted; but they are never all formed. Wordings of equal word sets
pair first through a dictionary. The rest is asked level by level of overlap: with
the sizes of both sides a level fixes how many words must be shared, and so how
few of a wording's rarest words a partner must contain one of.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRING_TYPE = "struct<pairs:array<struct<l:int,r:int>>,added:array<int>,removed:array<int>>"


class Shelf:
    """Free wordings of one size, under each of their rarest words as far as a partner needs them."""

    def __init__(self, members: Iterable[int], words: list[list[str]], depth: int, taken: set[int]):
        self.words, self.taken = words, taken
        self.under: dict[str, deque[int]] = defaultdict(deque)
        for r in members:
            for word in words[r][:depth]:
                self.under[word].append(r)

    def first(self, probe: list[str], wanted: set[str], shared: int) -> int | None:
        """The first free member that shares at least so many words."""
        best = None
        for word in probe:
            queue = self.under.get(word)
            while queue and queue[0] in self.taken:
                queue.popleft()
            for r in queue or ():
                if best is not None and r >= best:
                    break
                if r not in self.taken and len(wanted.intersection(self.words[r])) >= shared:
                    best = r
                    break
        return best


def levels_of(left: Iterable[int], right: Iterable[int], at_least: float) -> dict[Fraction, dict[int, list[tuple[int, int]]]]:
    """Overlaps from the highest down: {overlap: {left size: [(right size, shared words)]}}."""
    found: dict[Fraction, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for a in left:
        for b in right:
            for shared in range(1, min(a, b) + 1):
                if shared / (a + b - shared) >= at_least:
                    found[Fraction(shared, a + b - shared)][a].append((b, shared))
    return {overlap: found[overlap] for overlap in sorted(found, reverse=True)}


def strongest_pairs(left: list[list[str]], right: list[list[str]], at_least: float) -> list[tuple[int, int]]:
    """Pairs by falling overlap, then by place on the left and on the right; sets without a word stay alone."""
    pairs, taken_left, taken_right = [], set(), set()

    def take(l: int, r: int) -> None:
        pairs.append((l, r))
        taken_left.add(l)
        taken_right.add(r)

    equal: dict[tuple[str, ...], deque[int]] = defaultdict(deque)
    for r, words in enumerate(right):
        equal[tuple(sorted(words))].append(r)
    for l, words in enumerate(left):
        partners = equal.get(tuple(sorted(words)))
        if words and partners:
            take(l, partners.popleft())

    frequency = Counter(w for side in (left, right) for words in side for w in words)
    rarest = [[sorted(words, key=lambda w: (frequency[w], w)) for words in side] for side in (left, right)]
    common = {w for i, words in enumerate(left) if i not in taken_left for w in words}
    common &= {w for i, words in enumerate(right) if i not in taken_right for w in words}
    open_left, by_size = defaultdict(list), defaultdict(list)
    for l, words in enumerate(rarest[0]):
        if words and l not in taken_left:
            open_left[len(words)].append(l)
    for r, words in enumerate(rarest[1]):
        if words and r not in taken_right:
            by_size[len(words)].append(r)
    known = {l: len(common.intersection(left[l])) for ls in open_left.values() for l in ls}

    for sizes in levels_of(open_left, by_size, at_least).values():
        shelves: dict[tuple[int, int], Shelf] = {}
        for l in sorted(l for a in sizes for l in open_left[a] if l not in taken_left):
            a = len(left[l])
            found = []
            for b, shared in sizes[a]:
                if shared > known[l]:
                    continue
                if (b, shared) not in shelves:
                    free = [r for r in by_size[b] if r not in taken_right]
                    shelves[b, shared] = Shelf(free, rarest[1], b - shared + 1, taken_right)
                found.append(shelves[b, shared].first(rarest[0][l][: a - shared + 1], set(left[l]), shared))
            partners = [r for r in found if r is not None]
            if partners:
                take(l, min(partners))
    return pairs


def pairing(left: Column, right: Column, at_least: float) -> Column:
    """``{pairs, added, removed}`` over the places of two arrays of word sets; null arrays are empty."""

    @F.pandas_udf(PAIRING_TYPE)
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def lists(value) -> list[list[str]]:
            return [] if value is None else [list(words) for words in value]

        for lefts, rights in batches:
            rows = []
            for before, after in zip(map(lists, lefts), map(lists, rights), strict=True):
                pairs = strongest_pairs(before, after, at_least)
                rows.append((
                    [{"l": l, "r": r} for l, r in pairs],
                    sorted(set(range(len(after))) - {r for _, r in pairs}),
                    sorted(set(range(len(before))) - {l for l, _ in pairs}),
                ))
            yield pd.DataFrame(rows, columns=["pairs", "added", "removed"])

    return decide(left, right)
