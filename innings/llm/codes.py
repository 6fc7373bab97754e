"""Vector code compression: product codes by rounds of nearest entries, searched by equal averages.

Components become integers, a vector four parts, and every part position has a
codebook of up to 256 entries. A round assigns each part to its nearest entry
and moves the entries to the mean of their parts.

Nearest entries are found by *equal average search*. Entries are sorted by the
sum of their components. By Cauchy's inequality a part and an entry whose sums
differ by g are at a squared distance of at least g * g / dimension, so from a
part's own sum the search goes outward on both sides and ends a side where
that bound is strictly above the best distance so far. Parts are taken in the
order of their sums, a block at a time, and entries a few at a time: a block
goes on as long as one of its parts does, and its distances are one matrix
product. Entries that a part alone would not have come to are strictly
farther, so they change nothing.

Every pass over the vectors runs where they lie. A task sends one row for
each entry and component that it has sums for; the driver holds codebooks,
which have 1,024 entries at most whatever the input.

Defined results: rows whose vector is null or holds null, NaN or infinite
components are left out; a shorter vector ends in zeros, and so do all if the
longest is not a multiple of four; a null id comes after all others; rows of
equal ids are all kept, in the order of their vectors; with fewer than 256
rows the codebooks have as many entries; equal entries never win over the one
with the lower index; an empty table gives no rows; null labels are one group.
Components so large that squared distances leave 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innings.llm.tables import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_BLOCK, _STEP = 512, 16  # parts searched together, entries looked at together


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and squared distance, for rows of integers."""
    n, dim = parts.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not dim:
        return index, distance
    top = max(int(np.abs(parts).max()), int(np.abs(entries).max()))
    if dim * 4 * top * top >= 2**63:
        raise ValueError("components are too large: squared distances leave 64 bits")
    kind = np.float64 if dim * 4 * top * top < 2**53 else np.int64  # exact either way
    of = np.argsort(entries.sum(1), kind="stable")
    e = entries[of].astype(kind)
    sums, squares = entries[of].sum(1), (e * e).sum(1)
    own = parts.sum(1)
    order = np.argsort(own, kind="stable")
    for begin in range(0, n, _BLOCK):
        rows = order[begin:begin + _BLOCK]
        x, s = parts[rows].astype(kind), own[rows]
        square = (x * x).sum(1)
        best, at = np.full(len(rows), 2**63 - 1, np.int64), np.full(len(rows), len(of), np.int64)
        middle = int(np.searchsorted(sums, s[len(s) // 2]))
        left, right = middle, middle  # entries [left, right) have been looked at
        down, up = left > 0, right < len(of)
        while down or up:
            # The side whose next sum is nearer to the block goes first.
            if up and (not down or sums[right] - s[-1] <= s[0] - sums[left - 1]):
                a, z = right, min(len(of), right + _STEP)
                right = z
            else:
                a, z = max(0, left - _STEP), left
                left = a
            d = (square[:, None] - 2 * (x @ e[a:z].T) + squares[a:z]).astype(np.int64)
            least = d.min(1)
            lowest = np.where(d == least[:, None], of[a:z], len(of)).min(1)
            won = (least < best) | ((least == best) & (lowest < at))
            best[won], at[won] = least[won], lowest[won]
            # A side ends when no part of the block can be as near to its next sum.
            limit = best.astype(np.float64) * dim * (1 + 1e-9)
            if up:
                up = right < len(of) and bool(np.any(np.maximum(sums[min(right, len(of) - 1)] - s, 0.0) ** 2 <= limit))
            if down:
                down = left > 0 and bool(np.any(np.maximum(s - sums[max(left - 1, 0)], 0.0) ** 2 <= limit))
        index[rows], distance[rows] = at, best
    return index, distance


def integers(vectors: DataFrame, vector: str, carried: tuple[str, ...]) -> DataFrame:
    """The kept rows: ``carried`` and ``v``, the components times 1024, rounded down."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(*carried, F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width``; shorter lists end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int):
    """Batch, and per part position the parts, their entries and distances."""
    dim = width // len(books)
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column("v"), width)
            yield batch, [(v[:, p * dim:(p + 1) * dim], *nearest(v[:, p * dim:(p + 1) * dim], book))
                          for p, book in enumerate(books)]


def moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after a round: means of the assigned parts, rounded down; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, found in _assigned(batches, books, width):
            for p, (part, index, _) in enumerate(found):
                by = np.argsort(index, kind="stable")
                used, first = np.unique(index[by], return_index=True)
                sums[p][used] += np.add.reduceat(part[by], first)
                counts[p] += np.bincount(index, minlength=len(books[p]))
        for p, book in enumerate(books):
            used = np.flatnonzero(counts[p])
            dim = book.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used) * dim, p, np.int32)), pa.array(np.repeat(used, dim).astype(np.int32)),
                pa.array(np.tile(np.arange(dim, dtype=np.int32), len(used))), pa.array(sums[p][used].ravel()),
                pa.array(np.repeat(counts[p][used], dim)),
            ], names=["part", "entry", "at", "total", "n"])

    schema = "part int, entry int, at int, total long, n long"
    means = rows.select("v").mapInArrow(run, schema).groupBy("part", "entry", "at").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = [b.copy() for b in books]
    for r in means.toLocalIterator():  # one row for a component of an entry
        after[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return after


def trained(rows: DataFrame, key: str, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks from the rows of the smallest keys, after ``rounds`` rounds, and the width of a vector."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    first = rows.orderBy(F.col(key).asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    start = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r["v"])] = r["v"]
    books = [np.ascontiguousarray(b) for b in np.split(start, PARTS, axis=1)]
    return (reduce(lambda b, _: moved(rows, b, width), range(rounds), books) if first and width else books), width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
               rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``key, label, code, error`` of every kept vector, and the codebooks that decode it."""
    rows = stored(integers(vectors, vector, (key, label)), "code-vectors")
    books, width = trained(rows, key, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _assigned(batches, books, width):
            indices = np.stack([index for _, index, _ in found], axis=1).astype(np.uint8)
            code = [r.tobytes().hex() for r in indices]
            error = np.sum([d for _, _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code), pa.array(error, pa.int64())],
                names=[key, label, "code", "error"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in (key, label)]
    return rows.mapInArrow(run, ", ".join([*kinds, "code string", "error long"])), books


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for, in the components' own scale."""
    return np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(code))]) / SCALE


def codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, label`` to ``vec_id, code, error, label_error, codebooks_sha256``."""
    rows, books = compressed(vectors)
    rows = stored(rows, "codes")
    # Written: one row per label, so that its real size decides the join and a hot label can be split.
    totals = stored(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-errors")
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
