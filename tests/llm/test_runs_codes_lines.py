"""Periodic runs, vector codes and line dedup against brute force, with every awkward row."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innings.llm import codes, lines, periodic
from innings.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def runs(w, least=24, times=3):
    """Every stretch of equal words q apart, the smallest q of each; quadratic."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            begin = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - begin + q >= max(least, times * q):
                found.setdefault((begin, i - begin + q), q)
            i += i == begin
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def without(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (12, 3), (6, 2), (10, 4)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    seen = 0
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 5, 30])
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * 9)[:rng.randint(1, 60)]
        h = np.array([x * 7919 + 3 for x in w], np.uint64)
        want = runs(w, least, times)
        seen += len(want)
        assert sorted(periodic.runs_of(h, 0, len(w), least, times), key=lambda r: (r[0], r[2])) == want
        got = set()
        for a, z in periodic.stretches(h, np.array([0, len(w)]), least, times).tolist():
            got |= periodic.runs_of(h, a, z, least, times)
        assert got == set(want)
    assert seen > 100


def test_squares_of_the_automaton():
    """The most recent earlier end of every suffix, found by looking at all of them."""
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(40)]
        automaton = periodic.Automaton()
        for r, x in enumerate(w):
            got = sorted(automaton.append(x))
            want = {}
            for n in range(1, r + 1):
                ends = [e for e in range(n - 1, r) if w[e - n + 1:e + 1] == w[r - n + 1:r + 1]]
                if ends:
                    want[r - ends[-1]] = n
            assert got == sorted((d, n) for d, n in want.items() if n >= d)


def texts():
    rng = random.Random(5)
    say = lambda n, k=40: [f"w{rng.randrange(k)}é" for _ in range(n)]
    rows = [None, "", " \t\n", "one", "x " * 23, "x " * 24, "A a " * 12, "ab\x0bcd " * 30, "x\x1cy " * 30]
    rows += [" ".join(say(20) + say(9) * 5 + say(3)) for _ in range(6)]
    rows += [" ".join(say(300, 3)), " ".join(say(6000, 5000)), " ".join(say(30, 900) * 3), "y" * 300_000 + " z" * 50]
    unit = say(3000, 4000)
    return rows + [" ".join(say(50, 4000) + unit * 4 + unit[:700])] + [rows[9], rows[9]] + [" ".join(say(80, 60)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i, [i]) for i, t in enumerate(texts())] + [(None, texts()[10], "x", 1, []), (9, texts()[11], "", 2, [])]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, start long, runs array<int>").repartition(4)


def test_repeats(docs):
    want = sorted((str(i), len(words(t)), str(runs(words(t))), without(words(t), runs(words(t)))) for i, t in [
        *enumerate(texts()), (None, texts()[10]), (9, texts()[11])] if len(words(t)) < 5000)
    got = periodic.repeats(docs).where("n_words < 5000").collect()
    assert sorted((str(r["doc_id"]), r["n_words"], str([tuple(x) for x in r["runs"]]), r["collapsed"]) for r in got) == want
    unit = periodic.repeats(docs).where("n_words > 10000").first()
    assert [tuple(r) for r in unit["runs"]] == [(50, 12700, 3000)]
    assert unit["collapsed"] == " ".join(texts()[unit["doc_id"]].split()[:3050])
    assert periodic.repeats(docs.limit(0)).count() == 0


def test_query_of_runs(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in [*enumerate(texts()), (None, texts()[10])]:
        w = words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if len(w) >= 5000 or i == 9:
            continue
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert got[i] == [(len(found), *best, 1000 * best[1] // best[2] if found else None,
                           sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(without(w, found)))]


def coded(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks of ``(key, vector)`` in plain loops."""
    v = [[math.floor(1024 * x) for x in vector] for _, vector in rows]
    width = -(-max(map(len, v), default=0) // parts) * parts
    v = [x + [0] * (width - len(x)) for x in v]
    dim = width // parts
    order = sorted(range(len(v)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))
    code, error, books = [""] * len(v), [0] * len(v), []
    for p in range(parts):
        piece = [x[p * dim:(p + 1) * dim] for x in v]
        book = [piece[i] for i in order[:entries]]

        def near(x, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            at = [near(x)[1] for x in piece]
            for k in set(at):
                own = [x for x, a in zip(piece, at) if a == k]
                book[k] = [sum(c) // len(own) for c in zip(*own)]
        for i, x in enumerate(piece):
            d, k = near(x)
            code[i] += f"{k:02x}"
            error[i] += d
        books.append(book)
    return code, error, sha(",".join(str(c) for b in books for e in b for c in e))


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()),
                        T.StructField("v", T.IntegerType())])


def vectors(rng, n, dim, near=0):
    points = [[float(np.float32(rng.gauss(0, 1))) for _ in range(dim)] for _ in range(near or n)]
    return [points[i] if i < len(points) else [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(points)]
            for i in range(n)]


@pytest.mark.parametrize("case", ["many", "few", "uneven"])
def test_vector_codes(spark, case):
    rng = random.Random(case)
    if case == "many":  # more rows than entries, clusters, ties, repeated and null ids
        rows = list(zip([*range(300), 5, 5, None, None], vectors(rng, 304, 8, 40)))
        rows += [(400 + i, [0.5] * 8) for i in range(20)]
    elif case == "few":
        rows = list(zip([3, 1, 2], vectors(rng, 3, 4)))
    else:  # lengths that are no multiple of four, an empty vector, components in millions
        rows = list(zip(range(60), vectors(rng, 60, 6))) + [(70, []), (71, [1.5]), (72, [3e4] * 7)]
    labels = [rng.choice([0, 1, None]) for _ in rows]
    bad = [(900, None, 1), (901, [1.0, None] * 2, 1), (902, [float("nan")] * 4, None), (903, [1.0, float("-inf")] * 2, 0)]
    table = [(i, v, n, "x", 7) for (i, v), n in zip(rows, labels)] + [(*b, "x", 7) for b in bad]
    rng.shuffle(table)
    got = codes.codes(spark.createDataFrame(table, VECTORS).repartition(3)).collect()
    code, error, books = coded(rows)
    total = {n: sum(e for e, m in zip(error, labels) if m == n) for n in set(labels)}
    assert sorted(map(str, map(tuple, got))) == sorted(
        str((i, c, e, total[n], books)) for (i, _), c, e, n in zip(rows, code, error, labels))


def test_nearest_entries():
    rng = np.random.default_rng(3)
    for n, k, dim, scale in ((2000, 256, 16, 130), (700, 256, 4, 2), (50, 3, 1, 10), (900, 200, 8, 10**8), (5, 1, 3, 4)):
        parts, entries = rng.integers(-scale, scale + 1, (n, dim)), rng.integers(-scale, scale + 1, (k, dim))
        parts[::2] = entries[rng.integers(0, k, len(parts[::2]))] + rng.integers(-1, 2, parts[::2].shape)
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        index, distance = codes.nearest(parts, entries)
        assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_vector_codes_of_no_vectors_and_round_trip(spark):
    empty = spark.createDataFrame([(1, None, 2, "", 1)], VECTORS)
    assert codes.codes(empty).count() == 0 and codes.codes(empty.limit(0)).count() == 0
    assert codes.codes(spark.createDataFrame([(1, [], None, "", 1)], VECTORS)).first()["error"] == 0
    rng = random.Random(1)
    rows = [(i, v, 1, "", 1) for i, v in enumerate(vectors(rng, 200, 8))]
    got, books = codes.compressed(spark.createDataFrame(rows, VECTORS))
    for r in got.collect():
        off = np.floor(np.array(rows[r["vec_id"]][1]) * 1024) - codes.decoded(r["code"], books) * 1024
        assert r["error"] == (off ** 2).sum()
    with pytest.raises(Exception, match="64 bits"):
        codes.codes(spark.createDataFrame([(1, [1e12] * 4, 1, "", 1)], VECTORS)).count()


LINES = [
    "a shared line of text\nonly here once\nshort\nA SHARED line of text", "short\n  a shared line of text\t\r\n\nÄ shared umlaut",
    "", None, "\n\n", "ä shared umlaut\nshort\nÄ SHARED UMLAUT\nend", "x" * 10 + "\n" + "x" * 9, "x" * 10 + "\n" + "x" * 9,
    "é" * 10, "é" * 9 + "\n" + "é" * 10, "a shared line of text", "\x0ba shared line of text\x0c\n", "é" * 400_000,
    "no end\n" * 3, "tail line here\n" * 30_000, "tail line here", "tail line here ", "Z-a shared line of text",
]


def key(line):
    return line.strip(BLANKS).translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize(("least", "documents"), [(10, 2), (1, 3)])
def test_lines(spark, least, documents):
    rows = [*enumerate(LINES), (None, "a shared line of text\nnull\nmore here now"), (None, "more here now\nother"),
            (2, "a shared line of text\nrow of a second text"), (40, LINES[0]), (40, LINES[0])]
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(math.inf if i is None else i)
    want = []
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if not (len(held.get(key(x), ())) >= documents and (
            math.inf if i is None else i) > min(held[key(x)]))]
        want.append(str((i, len(every), len(every) - len(left), "\n".join(left))))
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows],
                                  "doc_id long, text string, id int, key string, n_dropped int").repartition(5)
    got = lines.dedup(table, least, documents).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert lines.dedup(table.limit(0)).count() == 0


def test_a_line_of_every_document_is_dropped_from_all_but_the_first(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the same line everywhere\nnumber "), F.col("id"), F.lit(" is only here")).alias("text"))
    got = lines.dedup(docs.repartition(8)).agg(F.sum("n_dropped"), F.max(F.when(F.col("n_dropped") == 0, F.col("doc_id"))))
    assert tuple(got.first()) == (4999, 0)
