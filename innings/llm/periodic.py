"""Runs of repeated word sequences, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least ``times`` periods
and ``least`` words long, that cannot be extended on either side.

Words are appended to a suffix automaton one at a time. Its links form a tree;
the path from the root to the state of the text so far has all its suffixes.
The tree is kept as a link-cut tree whose preferred paths have one colour
each: where the strings on it ended last. *Access* to the new state walks up
the path and cuts it into segments of one colour, then the whole path takes
the new end. A segment of colour e, with longest string l, says that l words
ended at e as they do now, and no later: if the distance d of the ends is at
most l, the last l + d words have period d and hold a square. No smaller d can
hide, since equal words at a smaller distance would have ended later, so d is
their smallest period. Squares of enough periods are extended to both sides
once; later ends inside a known run of that period say nothing new.

Only stretches that can hold a run are appended. A run of period q repeats
each of its sequences of ``least // times`` words within q words, for at least
``(times - 1) * q`` words; so positions whose sequence does not recur within
the document, or not soon enough for the stretch around it, are left out. This
drops no run, and texts without repeats cost a sort.

A document is one unit of work: its words are never split over tasks, and what
is held grows with its longest repetitive stretch, some hundred bytes a word.
Documents are independent, so there is no exchange.

Defined results: null and empty texts have no words and no runs; long texts
are searched whole; equal texts have equal runs; repeated rows give repeated
results; runs of different periods may overlap and are all listed, by start,
then period; an empty table gives no rows; words are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innings.llm.words import mix, ngrams, parts, split

LEAST = 24
TIMES = 3


class Automaton:
    """Suffix automaton of a growing text; states are nodes of a link-cut tree over their links.

    Node 0 is none, node 1 the root. ``up`` is the parent within a splay tree or, at its root, the node above the
    preferred path; ``end`` counts at the root of a splay tree only.
    """

    def __init__(self) -> None:
        self.longest, self.link, self.next = [0, 0], [0, 0], [{}, {}]
        self.up, self.left, self.right, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def _state(self, longest: int, following: dict) -> int:
        self.longest.append(longest)
        self.next.append(following)
        self.link.append(0)
        for part in (self.up, self.left, self.right):
            part.append(0)
        self.end.append(-1)
        return len(self.longest) - 1

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            on_left = left[p] == x
            if not on_left and right[p] != x:
                return
            g = up[p]
            p_left, p_right = g and left[g] == p, g and right[g] == p
            if p_left or p_right:
                if p_left == on_left:  # the same side twice: the parent turns first
                    self._turn(p, g)
                else:
                    self._turn(x, p)
                self._turn(x, up[x])
            else:
                self.end[x] = self.end[p]
                self._turn(x, p)
                return
            if not (left[up[x]] == x or right[up[x]] == x):
                self.end[x] = self.end[g]

    def _turn(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def append(self, word: int) -> list[tuple[int, int]]:
        """Adds a word; ``(distance, length)`` of every square that ends at it: the words ended as much before."""
        longest, link, following = self.longest, self.link, self.next
        now = self._state(longest[self.last] + 1, {})
        p = self.last
        while p and word not in following[p]:
            following[p][word] = now
            p = link[p]
        above = 1
        if p:
            above = following[p][word]
            if longest[above] != longest[p] + 1:
                above = self._split(p, word, above)
        link[now] = self.up[now] = above
        self.last = now
        squares = self._access(now, self.size)
        self.size += 1
        return squares

    def _split(self, p: int, word: int, of: int) -> int:
        """The shorter strings of a state become a state of their own, between it and its link, on the same path."""
        link, following = self.link, self.next
        upper = self._state(self.longest[p] + 1, following[of].copy())
        link[upper] = link[of]
        while p and following[p].get(word) == of:
            following[p][word] = upper
            p = link[p]
        self._splay(of)
        above = self.left[of]
        self.left[upper] = above
        if above:
            self.up[above] = upper
        self.left[of], self.up[upper] = upper, of
        link[of] = upper
        return upper

    def _access(self, node: int, at: int) -> list[tuple[int, int]]:
        up, right, end, longest = self.up, self.right, self.end, self.longest
        squares = []
        below, x = node, up[node]
        while x:
            self._splay(x)
            last = end[x]
            if 0 <= at - last <= longest[x] and last >= 0:
                squares.append((at - last, longest[x]))
            if right[x]:
                end[right[x]] = last  # what is cut off keeps its colour
            right[x] = below
            below, x = x, up[x]
        end[below] = at
        return squares


def stretches(h: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """``[begin, end)`` of words, within documents, outside of which no run can lie; in order, apart from each other."""
    size = max(1, least // times)
    value, at = ngrams(h, first, size)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    doc = np.searchsorted(first, at, "right") - 1
    key = value ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.full(len(at), len(h), np.int64)  # words until the sequence comes again
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    on = np.flatnonzero(again < len(h))
    fewest = -(-least * (times - 1) // times) - size + 1
    while len(on):
        begin = np.flatnonzero(np.append(True, (np.diff(at[on]) != 1) | (np.diff(doc[on]) != 0)))
        length = np.diff(np.append(begin, len(on)))
        reach = (length + size - 1) // (times - 1)  # the longest period of a run in the stretch
        fit = (again[on] <= np.repeat(reach, length)) & np.repeat(length >= fewest, length)
        if fit.all():
            stop = np.minimum(at[on[begin + length - 1]] + size + reach, first[doc[on[begin]] + 1])
            found = np.stack([at[on[begin]], stop], axis=1)
            # Stretches that reach into the next one are one.
            new = np.append(True, found[1:, 0] >= np.maximum.accumulate(found[:, 1])[:-1])
            return np.stack([found[new, 0], np.maximum.reduceat(found[:, 1], np.flatnonzero(new))], axis=1)
        on = on[fit]
    return np.zeros((0, 2), np.int64)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, looking at twice as many each time."""
    n, step, b = 0, 64, b[:len(a)]
    while n < len(a):
        differ = np.flatnonzero(a[n:n + step] != b[n:n + step])
        if len(differ):
            return n + int(differ[0])
        n, step = n + step, step * 2
    return len(a)


def runs_of(words: np.ndarray, begin: int, stop: int, least: int = LEAST, times: int = TIMES) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs in words ``begin`` to ``stop`` of a text, extended over all of it."""
    automaton, known, found = Automaton(), {}, set()
    for at, word in enumerate(np.unique(words[begin:stop], return_inverse=True)[1].tolist(), begin):
        for period, length in automaton.append(word):
            if length < (times - 1) * period or length + period < least or known.get(period, -1) >= at:
                continue
            start = at - period - length + 1
            start -= _agreeing(words[:start][::-1], words[period:start + period][::-1])
            end = at + 1 + _agreeing(words[at + 1:], words[at + 1 - period:])
            known[period] = end - 1
            found.add((start, end - start, period))
    return found


def repeats(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_words, runs, collapsed``: the text without what runs repeat, joined by blanks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text")
                words = split(texts, lower=False)
                h = words.hashes()
                found: dict[int, set] = {}
                for a, z in stretches(h, words.first, least, times).tolist():
                    d = int(np.searchsorted(words.first, a, "right")) - 1
                    low, high = words.first[d], words.first[d + 1]
                    found.setdefault(d, set()).update(runs_of(h[low:high], int(a - low), int(z - low), least, times))
                runs, left = [], []
                for d, text in enumerate(texts):
                    own = (text.as_py() or "").encode().split()
                    mine = sorted(found.get(d, ()), key=lambda r: (r[0], r[2]))
                    if mine:
                        gone = np.zeros(len(own) + 1, np.int64)
                        for start, length, period in mine:
                            gone[start + period] += 1
                            gone[start + length] -= 1
                        own = [w for w, g in zip(own, (np.cumsum(gone)[:-1] > 0).tolist()) if not g]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                    left.append(b" ".join(own))
                record = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(runs, pa.list_(record)),
                    pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length over period, compared exactly; the first one of equals."""
    record = "struct<start:long,length:long,period:long>"
    return F.aggregate(runs, F.lit(None).cast(record), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a tail repeated in one of ten texts: the cases that ``op11`` asks for.

    With h the checksum of the id and g = h // 10, texts of h % 10 = 0 and n words keep their first a = g % n words
    and repeat the next 1 + (n - a) // (3 + g % 8). A null id has no checksum, its text stays.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, h in enumerate(batch.column("h").to_pylist()):
                words = (texts[i] or "").encode().split() if h is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    period = 1 + (n - a) // (3 + g % 8)
                    tail = words[a:a + period] * (-(-(n - a) // period))
                    texts[i] = b" ".join(words[:a] + tail[:n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(run, f"doc_id {kind}, text string")
