"""Benchmark decontamination: rare pairs of neighbouring words join texts to test items, then Smith-Waterman alignment.

Pairs of neighbouring words are looked at; in a text the two words may have
one other between them. An edit breaks a few pairs only: of an item of L words
a copy with half of the item's own score keeps L/3 - 1 pairs within 2 L words,
and thirteen words copied nearly exactly keep twelve.

Seeds are an item's pairs without its commonest, by their counts in the whole
corpus: at most half as many as a copy has to keep are left out, never two
side by side. So a copy keeps the other half of its L/3 - 1 as seeds, and a
passage that scores thirteen keeps six of them within 65 words (with e edits
its e + 1 runs of words have 13 + 4 e words or more, edits counted, and a run of
r words keeps (r - 2) / 2 seeds at least). No copy is lost by the choice. An
item of three to five words may lose all its pairs by one edit; such a copy is not found.

    hits         text, word, pair    one pass over the texts, stored; common pairs of the items included
    counts       pair, n             rarity, from the hits
    seeds        pair, item          the rare ones
    candidates   text, item, words   hits joined to seeds; places with enough seeds close together
    passages     text, item, words   cut from the texts, joined to the items' words, aligned

A copy counts if its alignment has ``threshold`` of the item's own score, or
if ``passage`` words of the item, long or short, stand there nearly exactly: an edit
costs three words.

Texts and items are known by 128 bits of their content, so equal texts are
looked at once and equal items too; every row of them is reported. Nothing of the
benchmark is on the driver but a bit set of fixed size (``bits``) that keeps
words apart from the hits which are in no item; with a benchmark beyond it more
words become hits, and the joins decide. ``docs`` is read three times: give it
stored.

Words: lower-cased (A-Z), parted by ASCII punctuation and white space.
Defined results: null or empty texts match nothing; items of fewer than
``n`` words have no seed and match nothing; equal items each report their own
row; repeated rows give repeated results, null ids included; an empty
benchmark matches nothing; a very long text is one row of hits after another,
and only passages of it travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innings.llm.tables import hashed, possible, stored
from innings.llm.words import PUNCTUATION, Words, mix, parts, split


@dataclass(frozen=True)
class Settings:
    n: int = 3  # words that an item has at least
    threshold: float = 0.5  # least score, as a share of the item's own
    passage: int = 13  # so many words of an item are a leak whatever its length
    match: float = 2.0
    miss: float = 1.0
    gap: float = 1.0
    bits: int = 25  # logarithm of the size of the bit set of the items' pairs

    @property
    def strict(self) -> Settings:
        """Scores of passages: a word for a match, three for an edit."""
        return replace(self, match=1.0, miss=3.0, gap=3.0)


TEXT, ITEM = ["_d1", "_d2"], ["_t1", "_t2"]


def _split(texts: pa.Array) -> Words:
    return split(texts, gaps=PUNCTUATION)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _list(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of hash lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def item_words(items: DataFrame, s: Settings) -> DataFrame:
    """``_t1, _t2, item_words``: the hashed words of every different item text of at least ``n`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = _split(part.column("text"))
                h = words.hashes()
                rows = np.flatnonzero(words.count >= s.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)),
                     _list([h[words.first[i]:words.first[i + 1]] for i in rows])], names=[*ITEM, "item_words"])

    texts = items.where("text is not null").select(*hashed(F.col("text"), *ITEM), "text").groupBy(*ITEM).agg(
        F.first("text").alias("text"))
    return stored(texts.mapInArrow(run, "_t1 long, _t2 long, item_words array<long>"), "item-words")


def item_pairs(words: DataFrame) -> DataFrame:
    """``_t1, _t2, size, place, seed``: every pair of neighbouring words of the items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in (0, 1))
            for i, h in enumerate(_lists(batch.column(2))):
                n = len(h) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t1[i])), pa.array(np.full(n, t2[i])), pa.array(np.full(n, n + 1)),
                     pa.array(np.arange(n)), pa.array(_pairs(h[:-1], h[1:]).view(np.int64))],
                    names=[*ITEM, "size", "place", "seed"])

    return words.mapInArrow(run, "_t1 long, _t2 long, size long, place long, seed long")


def _bit_set(pairs: DataFrame, bits: int) -> np.ndarray:
    """``2**bits`` bits in words of 64, those of the pairs set: at most that many words come to the driver."""
    place = F.pmod("seed", F.lit(1 << bits))
    rows = pairs.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {1 << bits}) % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return out


def _hits(h: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words where a pair begins that may be an item's, and the pair."""
    places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for apart in (1, 2):
        pair = _pairs(h[:-apart], h[apart:])
        bit = pair & np.uint64(len(known) * 64 - 1)
        at = np.flatnonzero(known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
        at = at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + apart, "right")]  # in one document
        places.append(at)
        seeds.append(pair[at])
    return np.concatenate(places), np.concatenate(seeds)


def text_hits(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """``_d1, _d2, place, seed`` of all texts (``_d1, _d2, text``), written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = _split(part.column("text"))
                place, seed = _hits(words.hashes(), words.first, known)
                doc = np.searchsorted(words.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)),
                     pa.array((place - words.first[doc]).astype(np.int32)), pa.array(seed.view(np.int64))],
                    names=[*TEXT, "place", "seed"])

    return stored(texts.mapInArrow(run, "_d1 long, _d2 long, place int, seed long"), "seed-hits")


def rare_seeds(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``seed, _t1, _t2, size, need``: pairs of an item without its commonest; ``need`` seeds are in every copy.

    Left out are pairs commoner than both neighbours, the commonest first, up to
    half of the ``size / 3 - 1`` pairs that a copy keeps. A window holds one item.
    """
    along, item = Window.partitionBy(*ITEM).orderBy("place"), Window.partitionBy(*ITEM)
    n = F.coalesce(F.col("n"), F.lit(0))
    kept = F.greatest(F.lit(1), F.expr("size div 3 - 1"))
    return pairs.join(counts, "seed", "left").withColumn("n", n).withColumn(
        "peak", (F.col("n") > F.coalesce(F.lag("n").over(along), F.lit(-1)))
        & (F.col("n") >= F.coalesce(F.lead("n").over(along), F.lit(-1)))).withColumn(
        "rank", F.row_number().over(item.orderBy(F.desc("peak"), F.desc("n"), "place"))).withColumn(
        "out", F.floor(kept / 2)).where("not peak or rank > out").select(
        "seed", *ITEM, "size", (kept - F.col("out")).cast("int").alias("need")).distinct()


def candidates(hits: DataFrame, seeds: DataFrame, s: Settings) -> DataFrame:
    """``_d1, _d2, _t1, _t2, size, begins``: where enough seeds of an item lie close together in a text."""
    met = hits.join(seeds, "seed").groupBy(*TEXT, *ITEM, "size", "need").agg(
        F.sort_array(F.collect_set("place")).alias("at"))
    begins = F.filter("at", lambda x, i: F.coalesce(
        F.get("at", i + F.col("need") - 1) - x <= 2 * F.col("size"), F.lit(False)) | F.coalesce(
        (F.col("size") >= s.passage) & (F.get("at", i + (s.passage - 1) // 2 - 1) - x <= 5 * s.passage), F.lit(False)))
    return met.select(*TEXT, *ITEM, "size", begins.alias("begins")).where("size(begins) > 0")


def _around(begins: np.ndarray, size: int, end: int) -> list[tuple[int, int]]:
    """Ranges of words, apart from each other, in which a copy can lie whose seeds begin there."""
    a, z = np.maximum(0, begins - 2 * size), np.minimum(end, begins + 4 * size)
    apart = np.flatnonzero(a[1:] > z[:-1])
    return list(zip(a[np.append(0, apart + 1)].tolist(), z[np.append(apart, len(z) - 1)].tolist()))


def passages(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``_d1, _d2, _t1, _t2, start, words``: the passages of the candidates, cut from the texts that have any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = _split(part.column("text"))
                h, d1, d2 = words.hashes(), part.column("_d1").to_numpy(), part.column("_d2").to_numpy()
                for i in range(part.num_rows):
                    own = h[words.first[i]:words.first[i + 1]]
                    rows = [(w["_t1"], w["_t2"], a, own[a:z]) for w in part.column("wanted")[i].as_py()
                            for a, z in _around(np.array(w["begins"]), w["size"], len(own))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), d1[i])), pa.array(np.full(len(rows), d2[i])),
                         *(pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1, 2)),
                         _list([r[3] for r in rows])], names=[*TEXT, *ITEM, "start", "words"])

    wanted = found.groupBy(*TEXT).agg(F.collect_list(F.struct(*ITEM, "size", "begins")).alias("wanted"))
    once = possible(texts, found.select(*TEXT), TEXT).groupBy(*TEXT).agg(F.first("text").alias("text"))
    return once.join(wanted, TEXT).mapInArrow(
        run, "_d1 long, _d2 long, _t1 long, _t2 long, start long, words array<long>")


def align(item: np.ndarray, passage: np.ndarray, s: Settings) -> tuple[float, int]:
    """Best local alignment score and the end of its passage part. Rows are vectors; gaps run by a running maximum."""
    ramp = s.gap * np.arange(1, len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for word in item:
        step = row[:-1] + np.where(passage == word, s.match, -s.miss)
        step = np.maximum(np.maximum(step, row[1:] - s.gap), 0)
        row[1:] = np.maximum.accumulate(step + ramp) - ramp
        at = int(np.argmax(row))
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def _ranges(h: np.ndarray, target: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """The ranges of a passage with enough of all pairs of the item, common ones too."""
    own = np.unique(_pairs(target[:-1], target[1:]))
    hit = np.zeros(len(h), bool)
    for apart in (1, 2):
        if len(h) > apart:
            pair = _pairs(h[:-apart], h[apart:])
            hit[:len(pair)] |= own[np.minimum(np.searchsorted(own, pair), len(own) - 1)] == pair
    at = np.flatnonzero(hit)
    begins = _dense(at, max(1, len(target) // 3 - 1), 2 * len(target))
    if len(target) >= s.passage:
        begins = np.union1d(begins, _dense(at, s.passage - 1, 5 * s.passage))
    return _around(begins, len(target), len(h)) if len(begins) else []


def _dense(at: np.ndarray, need: int, width: int) -> np.ndarray:
    """Places that begin ``need`` of them within ``width`` words."""
    first, last = at[:max(0, len(at) - need + 1)], at[need - 1:]
    return first[last - first <= width]


def _best(h: np.ndarray, target: np.ndarray, ranges: list[tuple[int, int]], s: Settings) -> tuple[float, int, int]:
    """Best score, first and last + 1 word of its passage."""
    best = (0.0, 0, 0)
    for a, z in ranges:
        score, end = align(target, h[a:z], s)
        if score > best[0]:
            best = (score, a, a + end)
    back = h[best[1]:best[2]][::-1]
    return best[0], best[2] - (align(target[::-1], back, s)[1] if len(back) else 0), best[2]


def _scored(h: np.ndarray, target: np.ndarray, s: Settings) -> tuple[float, int, int, float, int, int] | None:
    """Share of the item's own score and its passage; score of the best nearly exact passage and that (0: too low)."""
    ranges = _ranges(h, target, s)
    if not ranges:
        return None
    best, a, z = _best(h, target, ranges, s)
    share = round(best / (s.match * len(target)), 6)
    if best >= s.threshold * s.match * len(target) or best < s.match * s.passage:  # no passage has less
        return share, a, z, 0.0, 0, 0
    return share, a, z, *_best(h, target, ranges, s.strict)


def aligned(rows: DataFrame, s: Settings) -> DataFrame:
    """``_d1, _d2, _t1, _t2, score, first_word, last_word`` of passages (with ``item_words``) that are copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, targets = _lists(batch.column("words")), _lists(batch.column("item_words"))
            start = batch.column("start").to_pylist()
            got = [(i, _scored(words[i], targets[i], s)) for i in range(batch.num_rows)]
            got = [(i, x) for i, x in got if x]
            take = pa.array([i for i, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in (*TEXT, *ITEM)),
                 pa.array([x[0] for _, x in got], pa.float64()), pa.array([x[3] for _, x in got], pa.float64()),
                 *(pa.array([x[c] + start[i] for i, x in got], pa.int64()) for c in (1, 2, 4, 5))],
                names=[*TEXT, *ITEM, "score", "exact", "a", "z", "ea", "ez"])

    each = rows.select(*TEXT, *ITEM, "start", "words", "item_words").mapInArrow(
        run, "_d1 long, _d2 long, _t1 long, _t2 long, score double, exact double, a long, z long, ea long, ez long")
    whole = F.max(F.struct("score", (-F.col("a")).alias("a"), "z"))
    part = F.max(F.struct("exact", (-F.col("ea")).alias("a"), F.col("ez").alias("z")))
    both = each.groupBy(*TEXT, *ITEM).agg(whole.alias("whole"), part.alias("part"))
    enough = F.col("whole.score") >= s.threshold
    pick = F.when(enough, F.struct("whole.a", "whole.z")).when(
        F.col("part.exact") >= s.passage, F.struct("part.a", "part.z"))
    return both.withColumn("pick", pick).where("pick is not null").select(
        *TEXT, *ITEM, "whole.score", (-F.col("pick.a")).alias("first_word"), F.col("pick.z").alias("last_word"))


def copies(texts: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Matches between the different texts (``_d1, _d2, text``) and the different items, written once."""
    words = item_words(items, s)
    pairs = item_pairs(words)
    hits = text_hits(texts, _bit_set(pairs, s.bits))
    counts = hits.groupBy("seed").agg(F.count("*").alias("n"))
    seeds = stored(rare_seeds(pairs, counts), "rare-seeds")
    found = stored(candidates(hits, seeds, s), "seed-candidates")
    return stored(aligned(passages(texts, found).join(words, ITEM), s), "item-copies")


def matches(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, text`` against ``item_id, text``: one row per document and item that it copies, whole or a passage of."""
    keyed = docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), *hashed(F.col("text"), *TEXT), "text")
    found = copies(keyed.drop("doc_id"), items, s)
    names = items.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), *hashed(F.col("text"), *ITEM))
    return possible(keyed.drop("text"), found.select(*TEXT), TEXT).join(found, TEXT).join(names, ITEM).select(
        "doc_id", "item_id", "score", "first_word", "last_word")


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without a match, every column as it is. The size of the stored matches
    decides whether rows move."""
    keyed = docs.select("*", *hashed(F.coalesce(F.col("text"), F.lit("")), *TEXT))
    found = copies(keyed.where("text is not null").select(*TEXT, "text"), items, s)
    return keyed.join(found.select(*TEXT), TEXT, "left_anti").select(*docs.columns)
