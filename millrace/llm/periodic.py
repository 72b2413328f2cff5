"""Periodic runs of words by maximal pairs of the LCP-interval tree.

Two places of a text are a maximal pair if the words that follow are equal for exactly L words and the words before differ.
If such a pair is q words apart and L is at least (times - 1) * q, then the L + q words from the first place on are a run of
period q that can't be extended, and every run is such a pair of its own start: nothing is left to extend.

Pairs come from the suffix array's LCP intervals, bottom-up; each interval has its places in order, classed by the word on
their left. Only intervals of at least `depth` common words matter, the least that the two conditions on a run allow, and of
these only such as have places of two classes at all: both are found by hashes of `depth` words, before anything is sorted.
Of an interval's places within L / 2 of each other, all but the first have one class (they are apart by multiples of the
period of the common words), so one look tells for all places on one side whether they differ from a place in class.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import mixed, runs_hash, word_hashes, word_slices
from .shared import slices

#: Words of several texts that are looked at together; a longer text is looked at alone, with some 100 bytes a word.
AT_ONCE = 1 << 18
#: Letters that are compared at once while common words are counted.
COMPARED = 1 << 20


def least_common(min_length: int, times: int) -> int:
    """Least number of common words of a pair whose run has at least min_length words and `times` periods."""
    return min(max(min_length - q, (times - 1) * q) for q in range(1, min_length + 1))


def _order(x: np.ndarray) -> np.ndarray:
    """Rank of each suffix of x, by doubling; x must not end within a repeat (a last letter of its own)."""
    rank, k = np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while int(rank.max()) < len(x) - 1:
        key = rank * (len(x) + 1)
        key[:-k] += rank[k:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def _common(x: np.ndarray, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """Number of equal letters of x from a and from b on, at least `known`; x's last letter is its own."""
    out, on = np.full(len(a), known, np.int64), np.arange(len(a))
    while len(on):
        block = max(1, min(4096, COMPARED // len(on)))
        at = np.arange(block)
        there = lambda s: x[np.minimum((s[on] + out[on])[:, None] + at, len(x) - 1)]  # noqa: E731, B023
        differ = there(a) != there(b)
        first = np.where(differ.any(1), differ.argmax(1), block)
        out[on] += first
        on = on[first == block]
    return out


def _merged(big: list[int], small: list[int]) -> list[int]:
    """Both lists of places in order; a few are put into the longer one."""
    if len(big) < len(small):
        big, small = small, big
    if 16 * len(small) < len(big):
        for p in small:
            insort(big, p)
        return big
    return sorted(big + small)


def _pairs(places: list[int], common: list[int], left: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    """(first place, distance, common words) of maximal pairs at most common / (times - 1) apart.

    places in the suffixes' order, common[k] words shared by places[k - 1] and places[k]; left: class of the word before each place of the text.
    """

    def joined(shared: int, one: list[int], two: list[int]) -> Iterator[tuple[int, int, int]]:
        many, few = (one, two) if len(one) >= len(two) else (two, one)
        reach = shared // (times - 1)
        for p in few:
            k = bisect_right(many, p)
            if k < len(many) and many[k] - p <= reach and left[many[k]] != left[p]:
                while k < len(many) and many[k] - p <= reach:
                    yield p, many[k] - p, shared
                    k += 1
            k = bisect_left(many, p - reach)
            if k < len(many) and many[k] < p and left[many[k]] != left[p]:
                yield many[k], p - many[k], shared

    open_: list[tuple[int, list[int]]] = []  # intervals that aren't complete: common words, places so far
    last = [places[0]]
    for k in range(1, len(places) + 1):
        here = common[k] if k < len(places) else -1
        while open_ and open_[-1][0] > here:
            shared, before = open_.pop()
            yield from joined(shared, before, last)
            last = _merged(before, last)
        if k == len(places):
            return
        if open_ and open_[-1][0] == here:
            before = open_.pop()[1]
            yield from joined(here, before, last)
            last = _merged(before, last)
        open_.append((here, last))
        last = [places[k]]


def runs_of(texts: list[np.ndarray], min_length: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each of some texts, given as word hashes, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    depth = least_common(min_length, times)
    if sizes.sum() < depth + 1:
        return found
    text = np.repeat(np.arange(len(texts)), sizes)
    x = mixed(np.concatenate(texts) + mixed(text.astype(np.uint64) + np.uint64(1)))  # a word is a letter of its own in each text: nothing is common to two
    keys = runs_hash(x, depth)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return found
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    group = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    again = np.flatnonzero(twice[group] == keys)
    left = np.r_[np.uint64(0), x[:-1]]
    by_group = again[np.argsort(group[again], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(group[by_group]) != 0])
    several = np.minimum.reduceat(left[by_group], starts) != np.maximum.reduceat(left[by_group], starts)
    if not several.any():
        return found
    wanted = np.zeros(len(twice), bool)
    wanted[group[by_group[starts[several]]]] = True
    chosen = again[wanted[group[again]]]

    keep = np.isin(text, text[chosen])  # whole texts that have an interval of two classes
    new = np.cumsum(keep) - 1
    of = lambda places: new[places[keep[places]]]
    y, left, text = np.r_[x[keep], np.uint64(0)], left[keep], text[keep]
    again, chosen, key_of = of(again), of(chosen), np.zeros(len(y), np.int64)
    key_of[:-1][again] = group[np.flatnonzero(keep)[again]] + 1
    rank = _order(y)
    order = np.empty(len(y), np.int64)
    order[rank] = np.arange(len(y))
    before = np.where(rank[again] > 0, order[rank[again] - 1], -1)  # the suffix before each in order, if it shares `depth` words
    paired = (before >= 0) & (key_of[before] == key_of[again])
    at, before = again[paired], before[paired]
    shared = np.zeros(len(y), np.int64)
    alone = left[at] != left[before]  # elsewhere the place before has one more, with the place before its own
    shared[at[alone]] = _common(y, at[alone], before[alone], depth)
    source = np.maximum.accumulate(np.where(alone, at, -1))
    shared[at] = shared[source] - (at - source)

    chosen = chosen[np.argsort(rank[chosen])]
    cuts = np.flatnonzero(np.r_[True, np.diff(key_of[chosen]) != 0])
    classes, first_word = left.tolist(), np.searchsorted(text, text)
    best: dict[tuple[int, int], int] = {}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chosen)], strict=True):
        part = chosen[a:b]
        for start, q, common in _pairs(part.tolist(), shared[part].tolist(), classes, times):
            if common + q >= min_length and q < best.get((start, common + q), q + 1):  # multiples of a run's period are pairs, too
                best[start, common + q] = q
    for (start, length), q in sorted(best.items(), key=lambda r: (r[0][0], r[1])):
        found[text[start]].append((int(start - first_word[start]), length, q))
    return found


def _collapsed(data: bytes, runs: list[tuple[int, int, int]], n: int) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    change = np.zeros(n + 1, np.int32)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    gone, kept, at = np.cumsum(change[:n]) > 0, [], 0
    for words in map(bytes.split, word_slices(data)):
        drop = gone[at : at + len(words)]
        at += len(words)
        part = [w for w, g in zip(words, drop.tolist(), strict=True) if not g] if drop.any() else words
        kept += [b" ".join(part)] if part else []
    return b" ".join(kept)


def find_runs(docs: DataFrame, min_length: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): all periodic runs of each text, and the text without their repeats.

    docs(doc_id, text): words are runs without ASCII white space. A run is a stretch of words that has smallest period
    `period`, at least `min_length` words and `times` (3 or more) periods, and that no neighbouring word extends; runs are in order of
    start, then period. collapsed joins the words that no run contains after its first period by one space. Null, empty and
    short texts have no runs; rows without doc_id are left out; repeated rows have a row each; an empty table gives an empty
    result. A text is held whole, as numbers. Words are told apart by 64-bit hashes.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't looked for")
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, words, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            runs = runs_of(words, min_length, times)
            collapsed = [_collapsed(t, r, len(w)).decode() for t, r, w in zip(texts, runs, words, strict=True)]
            dicts = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(dicts, pa.list_(struct)), pa.array(collapsed, pa.string())]
            ids.clear(), texts.clear(), words.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                ids.append(doc), texts.append(data), words.append(word_hashes(data))
                size += len(words[-1])
                if size >= AT_ONCE or len(ids) >= 2048:
                    yield out()
                    size = 0
        if ids:
            yield out()

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
