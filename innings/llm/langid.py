"""Language of whole documents by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both ends, labels every position
with probabilities of the languages, and a document pools those of all its
positions. State begins anew at white space, and a word of more than ``piece``
bytes is read in pieces, so what a position gets depends on its piece alone:
a batch runs every distinct piece once, however often it occurs, and every
byte of every text counts.

Learning: each piece of a training document is drawn by a hash of its document
and place, with a share per language that gives ``sample`` pieces of each in
expectation; the network is trained on the driver by back-propagation through
time. Languages are those of training documents. Only text and language are
read, and only text when predicting.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or if nothing could be learned; a document of a null language teaches nothing;
of equal probabilities the first language by code point wins; repeated rows
count as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innings.llm import gru
from innings.llm.tables import remainder, stored
from innings.llm.words import Words, parts, split
from innings.operators.ordered import cumulative_by_value

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    piece: int = 24  # most bytes that the recurrence spans
    hidden: int = 16  # of each direction
    sample: int = 20_000  # pieces of each language, in expectation
    epochs: int = 3
    batch: int = 256
    rate: float = 0.01
    loss: float = 0.001  # of rightly named documents that may be below it
    seed: int = 3


def pieces(texts: pa.Array, s: Settings) -> Words:
    words = split(texts, lower=False)
    n = (words.end - words.start + s.piece - 1) // s.piece
    before = np.concatenate([[0], np.cumsum(n)])
    within = np.arange(before[-1]) - np.repeat(before[:-1], n)
    start = np.repeat(words.start, n) + within * s.piece
    end = np.minimum(start + s.piece, np.repeat(words.end, n))
    return Words(words.data, start, end, before[words.first])


class Network:
    def __init__(self, languages: list[str], s: Settings):
        self.languages, self.s = languages, s
        rng, k = np.random.default_rng(s.seed), s.hidden
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "xf": normal(256, 3 * k, scale=0.3), "xb": normal(256, 3 * k, scale=0.3),
            "uf": normal(k, 3 * k, scale=k ** -0.5), "ub": normal(k, 3 * k, scale=k ** -0.5),
            "o": normal(2 * k, len(languages), scale=0.1), "ob": np.zeros(len(languages), np.float32),
        }

    def labels(self, codes: np.ndarray) -> np.ndarray:
        """Bytes (steps, rows) to probabilities (steps, rows, languages) of every position."""
        p, (steps, rows) = self.p, codes.shape
        states = np.empty((steps, rows, 2 * self.s.hidden), np.float32)
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((rows, self.s.hidden), np.float32)
            at = slice(0, self.s.hidden) if side == "f" else slice(self.s.hidden, None)
            for t in order:
                h = gru.step(p["x" + side][codes[t]], h, p["u" + side])
                states[t, :, at] = h
        return gru.softmax(states @ p["o"] + p["ob"])

    def pooled(self, w: Words, chosen: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Sums over the positions of each chosen piece; pieces of one length go together, so nothing is padded."""
        out = np.zeros((len(chosen), len(self.languages)), np.float32)
        size = (w.end - w.start)[chosen]
        order = np.argsort(size, kind="stable")
        ends = np.searchsorted(size[order], np.arange(self.s.piece + 2))
        for length in range(1, self.s.piece + 1):
            for a in range(ends[length], ends[length + 1], rows):
                at = order[a:min(a + rows, ends[length + 1])]
                codes = w.data[w.start[chosen[at]] + np.arange(length)[:, None]]
                out[at] = self.labels(codes).sum(0)
        return out

    def train(self, texts: list[bytes], language: np.ndarray) -> None:
        """Every position of a piece is taught the language of its document."""
        p, s = self.p, self.s
        adam, rng = gru.Adam(p, s.rate), np.random.default_rng(s.seed)
        size = np.array([len(t) for t in texts])
        for epoch in range(s.epochs):
            adam.rate = s.rate * (1 - epoch / s.epochs)
            batches = []
            for length in np.unique(size):
                own = rng.permutation(np.flatnonzero(size == length))
                batches += np.array_split(own, -(-len(own) // s.batch))
            for i in rng.permutation(len(batches)):
                own = batches[i]
                codes = np.frombuffer(b"".join(texts[j] for j in own), np.uint8).reshape(len(own), -1).T
                self._step(adam, codes, language[own])

    def _step(self, adam: gru.Adam, codes: np.ndarray, target: np.ndarray) -> None:
        p, k = self.p, self.s.hidden
        zero = np.zeros((codes.shape[1], k), np.float32)
        forth, cache_f = gru.unrolled(p["xf"][codes], zero, p["uf"])
        back, cache_b = gru.unrolled(p["xb"][codes[::-1]], zero, p["ub"])
        states = np.concatenate([forth, back[::-1]], axis=2)
        d = gru.softmax(states @ p["o"] + p["ob"])
        d[:, np.arange(len(target)), target] -= 1
        d /= codes.size
        flat = d.reshape(-1, d.shape[2])
        grads = {"o": states.reshape(-1, 2 * k).T @ flat, "ob": flat.sum(0)}
        d = d @ p["o"].T
        for side, seq, ds, cache in (("f", codes, d[:, :, :k], cache_f), ("b", codes[::-1], d[::-1, :, k:], cache_b)):
            dx, grads["u" + side] = gru.backward(ds, cache, p["u" + side])
            grads["x" + side] = np.zeros_like(p["x" + side])
            np.add.at(grads["x" + side], seq.ravel(), dx.reshape(-1, 3 * k))
        adam.update(grads)


def learned(docs: DataFrame, s: Settings = Settings(), folds: int = 5) -> Network | None:
    """The network taught by documents of the folds but 0; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", folds) != 0))
    totals = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    languages = sorted(r["lang"] for r in totals if r["n"])
    if not languages:
        return None
    # About six bytes make a piece; the count of bytes saves a pass.
    share = {r["lang"]: min(1.0, 6 * s.sample / r["n"]) for r in totals if r["n"]}
    index = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.random.default_rng(s.seed).integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            texts, language, keys = [], [], []
            for part in parts(batch):
                w = pieces(part.column("text"), s)
                doc = w.document()
                names = part.column("lang").to_pylist()
                least = np.array([share.get(x, 0.0) for x in names])[doc]
                ids = np.asarray(part.column("doc_id").fill_null(-1)).view(np.uint64)
                mark = (ids[doc] * times[0] + np.arange(len(doc)).astype(np.uint64)
                        - w.first[doc].astype(np.uint64)) * times[1]
                mark = (mark ^ (mark >> np.uint64(31))) * times[0]
                for i in np.flatnonzero((mark >> np.uint64(11)) < (least * 2**53).astype(np.uint64)):
                    texts.append(w.text(i))
                    language.append(index[names[doc[i]]])
                    keys.append(int(mark[i].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.binary()), pa.array(language, pa.int32()), pa.array(keys, pa.int64())],
                names=["piece", "language", "key"])

    got = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(
        run, "piece binary, language int, key long").toPandas().sort_values(["key", "language", "piece"])
    net = Network(languages, s)
    if len(got):
        net.train(list(map(bytes, got["piece"])), got["language"].to_numpy())
    return net


def predict(texts: pa.Array, net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and its pooled probability of every text."""
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None or not len(texts):
        return out, score
    w = pieces(texts, net.s)
    _, chosen, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    each, doc = net.pooled(w, chosen), w.document()
    sums = np.stack([np.bincount(doc, each[back, k], len(texts)) for k in range(len(net.languages))], axis=1)
    shares = sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)
    for i, text in enumerate(texts):
        if _LETTER.search(text.as_py() or ""):
            best = int(np.argmax(shares[i]))
            out[i], score[i] = net.languages[best], min(1.0, float(shares[i, best]))
    return out, score


def identify(docs: DataFrame, s: Settings = Settings(), folds: int = 5) -> DataFrame:
    """``doc_id, text, lang`` to ``doc_id, held_out, lang_pred, score``."""
    net = learned(docs, s, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1 << 24):
                name, score = predict(part.column("text"), net)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(name, pa.string()),
                     pa.array(np.round(score, 6))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", folds) == 0).alias("held_out"),
                       "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def least_share(scored: DataFrame, s: Settings = Settings(), folds: int = 5) -> float:
    """The pooled probability from which on a text is accepted, from ``doc_id, text, lang, _named, _share``.

    Half, so that one language has more than all others; less if more than
    ``loss`` of the documents of the training folds that the network names
    rightly were below. All of them count, by their exact rank.
    """
    right = scored.where(F.col("text").isNotNull() & (F.col("_named") == F.col("lang"))
                         & (remainder("doc_id", folds) != 0)).select("_share")
    low = right.where("_share < 0.5")
    n, n_low = right.agg(F.count("*"), F.count_if(F.col("_share") < 0.5)).first()
    if not n:
        return 0.0
    if n_low <= int(n * s.loss):
        return 0.5
    ranked = cumulative_by_value(low, "_share", {"n": F.lit(1)})
    return ranked.where(F.col("n_below") + F.col("n") > int(n * s.loss)).agg(F.min("_share")).first()[0]


def accepted(docs: DataFrame, least: float | None = None, s: Settings = Settings(), folds: int = 5) -> DataFrame:
    """The rows whose text has a language, with a pooled probability of ``least`` or more; all columns as they are.

    Without ``least`` it is chosen by :func:`least_share`, from the stored
    probabilities of all rows: every text is read by the network once. If
    nothing could be learned, for want of labels, no text is rejected but
    those without a letter.
    """
    net = learned(docs, s, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                if net is None:
                    keep = np.array([bool(_LETTER.search(t.as_py() or "")) for t in part.column("text")])
                    yield part.filter(pa.array(keep))
                    continue
                name, score = predict(part.column("text"), net)
                yield part.append_column("_named", pa.array(name, pa.string())).append_column("_share", pa.array(score))

    if net is None:
        return docs.mapInArrow(run, docs.schema)
    scored = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("_named", T.StringType()),
                                                T.StructField("_share", T.DoubleType())]))
    if least is None:
        scored = stored(scored, "language-scored")
        least = least_share(scored, s, folds)
    return scored.where((F.col("_named") != UNKNOWN) & (F.col("_share") >= least)).select(*docs.columns)
