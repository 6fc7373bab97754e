"""Near-duplicate documents by a join over the coordinates of MinHash signatures.

A document's set has its distinct shingles of ``n`` words. Texts with equal
sets form a class, and only classes go on. A class posts itself under every
(coordinate, value) of its signature. Two sets of the wanted similarity agree
in at least ``least`` of the ``coordinates`` with near certainty, so each
needs to be looked up only under its ``coordinates - least + 1`` rarest
postings (prefix); pairs met there count their collisions over the whole
signature (the rest of the merge is skipped for all others), and pairs at or
above ``least`` are confirmed on the full sets.

A posting may hold a third of all classes, so pairs inside it are not all
formed. A group of a few classes forms its pairs; in a larger one every class
meets the smallest id, and confirmed links give components. Thousands of near
copies of a text are mostly one component then. Classes whose posting is still
apart meet by their sets: ordered by rarity, two similar sets share a shingle
early in both, and members of one component need not meet. This finds every
similar pair of theirs, so nothing is lost to the first step.

Defined results: a text of fewer than ``n`` words is one shingle, a text
without words (or null) has an empty set and stays alone; a row with a null
id links with nothing and is kept; repeated rows give repeated results; rows
of one id and different texts go each by its own text, but texts that have the
same smallest id count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innings.llm.components import components
from innings.llm.tables import hashed, stored
from innings.llm.words import mix, ngrams, parts, split


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80  # least similarity, intersection over union
    coordinates: int = 48
    least: int = 25  # collisions of a candidate pair
    few: int = 4  # a group of no more members has all its pairs formed
    seed: int = 1


#: The contract's setting: a pair of similarity 0.85 has fewer than 28 of 48 collisions about once in a million.
TRIPLES = Settings(shingle=3, percent=85, least=28)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = split(texts)
    h = words.hashes()
    grams, at = ngrams(h, words.first, n)
    ends = np.searchsorted(at, words.first)
    sets = []
    for d in range(len(texts)):
        own = grams[ends[d]:ends[d + 1]]
        a, z = words.first[d], words.first[d + 1]
        if not len(own) and z > a:  # fewer words than a shingle
            own = mix(np.array([int.from_bytes(blake2b(h[a:z].tobytes(), digest_size=8).digest(), "little")],
                               np.uint64))
        sets.append(np.unique(own))
    return sets


def signatures(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """One row of 32-bit minima per set; empty sets have zeros."""
    rng = np.random.default_rng(s.seed)
    times = rng.integers(0, 2**63, s.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, s.coordinates, dtype=np.uint64)
    out = np.zeros((len(sets), s.coordinates), np.int32)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        begin = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(s.coordinates):
            least = np.minimum.reduceat((every ^ flip[k]) * times[k], begin)
            out[full, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, text``: the id and two hashes of the text tell rows apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashed(F.coalesce("text", F.lit("")), "t1", "t2"),
                       "text")


def signed(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, t1, t2, n_shingles, content, signature``; content is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1 << 21):
                sets = shingle_sets(part.column("text"), s.shingle)
                sign = signatures(sets, s)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                             pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(sign.ravel()), s.coordinates).cast(
                        pa.list_(pa.int32())),
                ], names=["doc_id", "t1", "t2", "n_shingles", "content", "signature"])

    return _texts(docs).mapInArrow(
        run, "doc_id long, t1 long, t2 long, n_shingles long, content binary, signature array<int>")


def full_sets(texts: DataFrame, s: Settings) -> DataFrame:
    """``id, text`` to ``id, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1 << 21):
                sets = shingle_sets(part.column("text"), s.shingle)
                ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def prefix_postings(classes: DataFrame, s: Settings) -> DataFrame:
    """``posting, id, n`` of the rarest postings of every class, as far as another class has them too."""
    each = classes.select("id", "n", F.posexplode("signature").alias("k", "value")).select(
        "id", "n", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("value").cast("long")).alias("posting"))
    common = each.groupBy("posting").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(common, "posting")
    mine = Window.partitionBy("id")
    return shared.withColumn("rank", F.row_number().over(mine.orderBy("df", "posting"))).withColumn(
        "own", F.count("*").over(mine)).where(
        # Postings of this class alone come first in the order, and take their places of the prefix.
        F.col("rank") <= F.col("own") - s.least + 1).select("posting", "id", "n")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``a, b`` with enough collisions whose full sets are similar enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("signature").alias(f"s_{side}")), side)
    same = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    pairs = stored(pairs.where(same >= s.least).select("a", "b"), "minhash-pairs")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"g_{side}")), side)
    shared = F.size(F.array_intersect("g_a", "g_b"))
    union = F.size("g_a") + F.size("g_b") - shared
    return pairs.where(shared * 100 >= union * s.percent).select("a", "b")


def by_rare_shingles(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs ``a, b`` of ``id, component`` in different components that share a rare enough shingle.

    All sets are ordered by how many members have a shingle. If the first
    shingle that two sets share is the i-th of one and the j-th of the other,
    they share at most what follows; so a similar pair has it early in both.
    """
    each = members.join(sets, "id").select("id", "component", F.size("shingles").alias("n"),
                                           F.explode("shingles").alias("g"))
    each = stored(each, "minhash-shingles")
    common = stored(each.groupBy("g").agg(
        F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")), "minhash-df")
    order = Window.partitionBy("id").orderBy("df", "g")
    # What is left from the shingle on must reach the overlap with the smallest partner.
    left = F.col("n") - F.row_number().over(order) + 1
    least = F.ceil(F.col("n") * s.percent / 100)
    early = each.join(common, "g").withColumn("left", left).where(
        (F.col("left") * (100 + s.percent) >= (F.col("n") + least) * s.percent) & (F.col("low") < F.col("high"))
    ).select("g", "id", "component", "n", "left")
    early = stored(early, "minhash-early")
    held = early.groupBy("g", "component").agg(F.count("*").alias("m")).groupBy("g").agg(
        F.count("*").alias("parts"), F.max(F.struct("m", "component")).alias("largest")).where("parts > 1").select(
        "g", F.col("largest.component").alias("largest"))
    early = stored(early.join(stored(held, "minhash-held"), "g"), "minhash-early")
    # Members of the largest component of a shingle do not meet each other, and of two others each pair forms once.
    x, y = early.alias("x"), early.where("component <> largest").alias("y")
    reach = F.least(F.col("x.left"), F.col("y.left")) * (100 + s.percent) >= (F.col("x.n") + F.col("y.n")) * s.percent
    return x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.component") != F.col("y.component")) & reach
                  & ((F.col("x.component") == F.col("x.largest")) | (F.col("x.id") < F.col("y.id")))
                  & _sizes_allow(F.col("x.n"), F.col("y.n"), s.percent)).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def links(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Confirmed edges ``a, b`` that connect all similar classes (not every similar pair)."""
    posts = stored(prefix_postings(classes, s), "minhash-postings")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(posts.select("id").distinct(), "id", "left_semi")
    sets = stored(full_sets(texts, s).dropDuplicates(["id"]), "minhash-sets")
    heads = posts.groupBy("posting").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("hub")).where("m > 1")
    # Written, so that both sides of the join come from plain exchanges and a hot posting can be split.
    posts = stored(posts.join(stored(heads, "minhash-heads"), "posting"), "minhash-grouped")
    few, many = posts.where(F.col("m") <= s.few), posts.where(F.col("m") > s.few)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.posting") == F.col("y.posting")) & (F.col("x.id") < F.col("y.id"))).select(
        F.col("x.id").alias("a"), F.col("x.n").alias("n_a"), F.col("y.id").alias("b"), F.col("y.n").alias("n_b"))
    stars = many.select(F.col("hub.id").alias("a"), F.col("hub.n").alias("n_a"), F.col("id").alias("b"),
                        F.col("n").alias("n_b"))
    pairs = pairs.unionByName(stars).where(_sizes_allow(F.col("n_a"), F.col("n_b"), s.percent))
    found = stored(confirmed(pairs, classes, sets, s), "minhash-links")
    named = many.join(components(found), F.col("id") == F.col("node"), "left").select(
        "posting", "id", F.coalesce("component", "id").alias("component"))
    named = stored(named, "minhash-named")
    apart = stored(named.groupBy("posting").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low < high").select("posting"), "minhash-apart")
    members = named.join(apart, "posting").select("id", "component").distinct()
    return found.unionByName(confirmed(by_rare_shingles(members, sets, s), classes, sets, s))


def judged(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, t1, t2, n_shingles, component_id, kept``: what becomes of every row, told apart by id and text."""
    rows = stored(signed(docs, s), "minhash-rows")
    classes = rows.where("content is not null and doc_id is not null").groupBy("content").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes, "minhash-classes")
    found = components(links(docs, classes, s))
    named = classes.select("content", "id").join(found, F.col("id") == F.col("node"), "left").select(
        "content", F.coalesce("component", "id").alias("component"))
    whole = rows.select("doc_id", "t1", "t2", "n_shingles", "content").join(named, "content", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return whole.select("doc_id", "t1", "t2", "n_shingles", component.alias("component_id"),
                        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_shingles, component_id, kept``."""
    return judged(docs, s).drop("t1", "t2")


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group. A row goes by its own text, whatever its id has."""
    gone = judged(docs, s).where(~F.col("kept")).select(
        F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    t1, t2 = hashed(F.coalesce(docs["text"], F.lit("")), "t1", "t2")
    return docs.join(gone, (docs["doc_id"] == F.col("_id")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left_anti")
