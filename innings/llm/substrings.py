"""Substring dedup by recompression.

A text is parsed in rounds. A round first names every run of one symbol, then
every pair of a left and a right symbol, where the hash of a symbol says which
side it is on. Names are hashes of what they stand for, so equal substrings
get equal names in every document without an exchange, and all rounds of a
document run where it lies. What a symbol depends on beyond its own words is
carried along, so a symbol is known to be *interior* to a window: every equal
window, wherever it lies, holds the same interior symbols.

1. Each window of ``size`` words is filed under its largest interior symbol;
   a text posts the few symbols it needs for that.
2. Spark counts the postings. Symbols of a single text leave with their
   windows: those cannot repeat.
3. Texts with shared symbols are parsed again and post the hashes of the
   windows filed under shared symbols. The smallest document per hash is known
   from a sum with map-side parts, so a passage of a third of all documents
   is one row per task.
4. Words covered by a window that a smaller document has as well are removed.

Equal texts go through steps 1 to 4 once: the copies' rows follow from the
smallest document of the text. Tables hold hashes of a text, not the text;
steps 3 and 4 fetch texts by id and hashes, and a bit set of bounded size keeps
most of the others from moving.

Windows meet by two independent names, their filing symbol (a recompression
name of 48 bits and its length) and a hash of 64 bits over all their words.

Defined results: null texts count as empty; texts of fewer words than a window
lose nothing; repeated rows give repeated results; a null id is larger than
any other; with equal ids neither text is "smaller"; long texts are parsed
whole; a window without an interior symbol (a long run of one word) is filed
under 0, which counts as shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innings.llm.tables import hashed, possible, stored
from innings.llm.words import Words, mix, ngrams, parts, split

WINDOW = 50
ROUNDS = 5
#: Stands for a null id, larger than any other.
_LAST = 2**63 - 1
#: A text, wherever only its row is needed: its smallest id and two hashes.
_TEXT = ["rep", "c1", "c2"]
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Parse:
    """Symbols with the words they stand for, and the words their naming depends on (``low`` to ``high``)."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        n = np.diff(first)
        self.name, self.doc = h, np.repeat(np.arange(len(n)), n)
        self.start, self.stop = np.arange(len(h)), np.arange(1, len(h) + 1)
        self.low, self.high = self.start, self.stop
        self.first = first

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """How far a look at the left and the right neighbour reaches; beyond the text there is one word more."""
        low, high = np.empty_like(self.low), np.empty_like(self.high)
        low[1:], high[:-1] = self.low[:-1], self.high[1:]
        edge = np.ones(len(self.doc) + 1, bool)
        edge[1:-1] = self.doc[1:] != self.doc[:-1]
        at_start, at_end = edge[:-1], edge[1:]
        low[at_start] = self.first[self.doc[at_start]] - 1
        high[at_end] = self.first[self.doc[at_end] + 1] + 1
        return low, high

    def _join(self, begin: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """New symbols from groups of old ones; ``low`` and ``high`` come per old symbol."""
        end = np.append(begin[1:], len(self.name)) - 1
        self.name, self.doc = name, self.doc[begin]
        self.start, self.stop = self.start[begin], self.stop[end]
        self.low, self.high = low[begin], high[end]

    def runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        begin = np.flatnonzero(np.append(True, ~same))
        length = np.diff(np.append(begin, len(self.name)))
        name = self.name[begin]
        many = length > 1
        name[many] = mix(name[many] * _A + length[many].astype(np.uint64))
        self._join(begin, name, *self._beside())

    def pairs(self, turn: int) -> None:
        turned = np.uint64(int(_B) * (turn + 1) % 2**64)
        left = (mix(self.name + turned) >> np.uint64(63)).astype(bool)
        joined = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])  # with the next one
        second = np.append(False, joined)
        begin = np.flatnonzero(~second)
        pair = np.append(joined, False)[begin]
        name = self.name[begin]
        name[pair] = mix(name[pair] * _A + mix(self.name[begin[pair] + 1] * _B))
        low, high = self._beside()
        # A pair depends on itself; a single left symbol has looked to the right, a right one to the left.
        single_left = left & ~np.append(joined, False)
        single_right = ~left & ~second
        self._join(begin, name, np.where(single_right, low, self.low), np.where(single_left, high, self.high))


def filing(words: Words, h: np.ndarray, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and the symbol it is filed under: span in the top 16 bits, name below."""
    room = np.repeat(words.first[1:], words.count) - np.arange(len(h))
    at = np.flatnonzero(room >= size)
    if not len(at):
        return at, np.zeros(0, np.int64)
    p = Parse(h, words.first)
    for turn in range(rounds):
        p.runs()
        p.pairs(turn)
    span = np.minimum(p.stop - p.start, 0x7FFF).astype(np.uint64)
    best = [(span << np.uint64(48)) | (p.name >> np.uint64(16))]
    # The interior symbols of a window follow each other; range maxima by doubling.
    a = np.searchsorted(p.low, at, "left")
    n = np.searchsorted(p.high, at + size, "right") - a
    while 2 ** len(best) <= max(1, n.max()):
        half = 2 ** (len(best) - 1)
        best.append(np.maximum(best[-1][:-half], best[-1][half:]))
    key = np.zeros(len(at), np.uint64)
    for level in range(len(best)):
        on = (n >= 2 ** level) & (n < 2 ** (level + 1))
        key[on] = np.maximum(best[level][a[on]], best[level][a[on] + n[on] - 2 ** level])
    return at, key.view(np.int64)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))


def _rows(docs: DataFrame) -> DataFrame:
    """``rep, c1, c2, text``: the id and two hashes of the text tell rows apart, so texts without an id do not meet."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rep"), *hashed(text, "c1", "c2"),
                       text.alias("text"))


def posted(docs: DataFrame, size: int, rounds: int) -> DataFrame:
    """``rep, c1, c2, n_words, whole, keys``: digest of all words and the symbols the windows are filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text")
                words = split(texts, lower=False)
                at, key = filing(words, words.hashes(), size, rounds)
                change = np.append(True, (np.diff(key) != 0) | np.isin(at[1:], words.first)) if len(at) else []
                at, key = at[change], key[change]  # neighbours mostly share their symbol
                doc = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in _TEXT), pa.array(words.count.astype(np.int64)),
                    pa.array([_digest((t.as_py() or "").encode().split()) for t in texts], pa.binary()),
                    _lists(key, np.bincount(doc, minlength=len(texts))),
                ], names=[*_TEXT, "n_words", "whole", "keys"])

    return _rows(docs).mapInArrow(run, "rep long, c1 long, c2 long, n_words long, whole binary, keys array<long>")


def windows(texts: DataFrame, size: int, rounds: int) -> DataFrame:
    """Texts with ``shared`` symbols to ``rep, c1, c2, starts, hashes, names`` of the windows filed under them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = split(part.column("text"), lower=False)
                h = words.hashes()
                at, key = filing(words, h, size, rounds)
                doc = np.searchsorted(words.first, at, "right") - 1
                keep = key == 0
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for d, shared in enumerate(part.column("shared")):
                    a, z = ends[d], ends[d + 1]
                    keep[a:z] |= np.isin(key[a:z], shared.values.to_numpy())
                value, _ = ngrams(h, words.first, size)
                at, doc, key, value = at[keep], doc[keep], key[keep], value[keep].view(np.int64)
                n = np.bincount(doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in _TEXT),
                    _lists((at - words.first[doc]).astype(np.int32), n), _lists(value, n), _lists(key, n),
                ], names=[*_TEXT, "starts", "hashes", "names"])

    return texts.select(*_TEXT, "text", "shared").mapInArrow(
        run, "rep long, c1 long, c2 long, starts array<int>, hashes array<long>, names array<long>")


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """Texts with ``starts`` of repeated windows to ``c1, c2, n_removed, kept`` (a digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                edge[at] += 1
                edge[at + size] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(_digest([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("c1"), batch.column("c2"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["c1", "c2", "n_removed", "kept"])

    return rows.select("c1", "c2", "text", "starts").mapInArrow(
        run, "c1 long, c2 long, n_removed long, kept binary").dropDuplicates(["c1", "c2"])


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows (by ``rep, c1, c2``) with their texts; rows of ``docs`` that are surely not wanted stay put."""
    return possible(_rows(docs), wanted, _TEXT).join(wanted, _TEXT)


def repeated_windows(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The posted rows of all documents, and ``rep, c1, c2, starts``: windows that a smaller document has too."""
    post = stored(posted(docs, size, rounds), "substring-posts")
    texts = post.where(F.col("n_words") >= size).groupBy("c1", "c2").agg(
        F.min("rep").alias("rep"), F.first("keys").alias("keys"))
    texts = stored(texts.select(*_TEXT, F.array_distinct("keys").alias("keys")), "substring-texts")
    filed = texts.select(*_TEXT, F.explode("keys").alias("key"))
    # Texts are told apart by a hash here: null ids and repeated ids are no reason to lose a symbol.
    shared = filed.groupBy("key").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).where(
        (F.col("low") < F.col("high")) | (F.col("key") == 0)).select("key")
    chosen = filed.join(shared, "key").groupBy(*_TEXT).agg(F.collect_list("key").alias("shared"))
    chosen = stored(chosen, "substring-chosen")
    parsed = stored(windows(_with_texts(docs, chosen), size, rounds), "substring-windows")
    each = parsed.select(*_TEXT, F.explode(F.arrays_zip("starts", "hashes", "names")).alias("w")).select(
        *_TEXT, F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"), F.col("w.names").alias("name"))
    smallest = each.groupBy("hash", "name").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where(
        F.col("low") < F.col("high")).select("hash", "name", "low")
    # Written, so that both sides of the join come from plain exchanges and a hot window can be split.
    smallest = stored(smallest, "substring-smallest")
    found = each.join(smallest, ["hash", "name"]).where(F.col("rep") > F.col("low"))
    return post, found.groupBy(*_TEXT).agg(F.collect_set("start").alias("starts"))


def dedup(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_words, n_removed, kept_sha256``."""
    post, found = repeated_windows(docs, size, rounds)
    cut = _cut(_with_texts(docs, stored(found, "substring-starts")), size)
    # Written like the windows' table above: copies of one text may be a third of all rows.
    least = stored(post.groupBy("c1", "c2").agg(F.min("rep").alias("least")), "substring-least")
    rows = post.select(*_TEXT, "n_words", "whole").join(least, ["c1", "c2"]).join(cut, ["c1", "c2"], "left")
    copy = (F.col("n_words") >= size) & (F.col("rep") > F.col("least"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        F.nullif("rep", F.lit(_LAST)).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.lower(F.hex(F.coalesce("kept", "whole")))).alias("kept_sha256"))
