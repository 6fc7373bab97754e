"""Document fingerprints from spot signatures, with DataFrame operations only.

A spot begins at a common word (anchor) and holds the anchor and the next two
content words behind it, over the common words between. Its signature is a
hash; the fingerprint of a text is the sorted list of its distinct signatures.
Common words frame running text and not lists or navigation, so the spots
follow what is said.

Likeness of two fingerprints is the Jaccard index of their signatures.
:func:`similar_groups` searches all documents for likeness from a threshold
on: fingerprints are partitioned by length, so only those whose lengths allow
the threshold meet, and only by the rarest part of their signatures.

The next document of each is found without ordering all rows in one task:
ids are cut into ranges at quantiles, each range is ordered on its own, and
the first rows of the ranges are handed to the range before.

Defined results: null texts count as empty; a text with words and without a
spot has one signature of all its words; a text without words has an empty
fingerprint; two empty fingerprints are alike (1), an empty and another are
not (0). A null id comes first in order; rows with equal ids follow each other
by text; a single document is its own next one.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innings.llm.components import components
from innings.llm.minhash import Settings, by_rare_shingles
from innings.llm.tables import stored

#: Anchors, four languages; they also are what a chain skips.
COMMON = tuple(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec ce dans de des du en est et il la le les ne par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von wird zu "
    "al como con del el ella lo los las más no para pero por se sin su una y".split()
)
_MARK = "\x01"  # before a common word
_DROPPED = _MARK + ".,;:!?\"'()[]{}<>|*&%$#…«»„“”¿¡"


def _alternatives(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so that a mismatch shows after a character or two."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    optional = by_first.pop("", None) is not None
    inner = "|".join(re.escape(c) + (_alternatives(rest) if rest != [""] else "") for c, rest in sorted(by_first.items()))
    return f"(?:{inner}){'?' if optional else ''}" if inner else ""


_COMMON = rf" ({_alternatives(sorted(set(COMMON)))})(?= )"
_SKIP = rf"(?: {_MARK}[^ ]+)*+ "
_SPOT = rf" (?=({_MARK}[^ ]+{_SKIP}[^ ]+{_SKIP}[^ ]+) )"
#: So many common words in a row; from here on the way of :func:`_runs` is taken, which looks at a run once.
_LONG = rf"(?: {_MARK}[^ ]+){{64}}"
_NEXT = "\x02"  # between a content word and the one after it
_WITH_NEXT = rf" ([^ {_MARK}][^ ]*)(?={_SKIP}([^ ]+) )"
_RUN = rf"((?: {_MARK}[^ ]+)++ [^ {_MARK}{_NEXT}]+{_NEXT}[^ ]+)"
#: Ranges of ids for every shuffle partition.
RANGES = 4


def plain(text: Column) -> Column:
    """Lower-cased words without punctuation, one blank before, between and behind."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{re.escape(_DROPPED)}]+", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[\x09-\x0D ]+", " ")), F.lit(" "))


def _runs(marked: Column) -> Column:
    """The spots of a text with long runs of common words, in time linear in its length.

    Every content word first gets the next one, then a run takes both from the content word behind it, and each of its
    words is put before them.
    """
    nexts = F.regexp_replace(marked, _WITH_NEXT, f" $1{_NEXT}$2")
    ends = F.transform(F.regexp_extract_all(nexts, F.lit(_RUN), 1), lambda r: F.struct(
        F.filter(F.split(r, " "), lambda w: w.startswith(_MARK)).alias("anchors"),
        F.translate(F.substring_index(r, " ", -1), _NEXT, " ").alias("behind")))
    return F.flatten(F.transform(ends, lambda e: F.transform(e["anchors"], lambda a: F.concat_ws(" ", a, e["behind"]))))


def with_signatures(rows: DataFrame, text: str, to: str) -> DataFrame:
    """Adds the sorted distinct signatures of a text. In steps, so that no step is evaluated twice."""
    rows = rows.withColumn("_words", plain(F.col(text)))
    rows = rows.withColumn("_marked", F.regexp_replace("_words", _COMMON, f" {_MARK}$1"))
    spots = F.when(F.col("_marked").rlike(_LONG), _runs(F.col("_marked"))).otherwise(
        F.regexp_extract_all("_marked", F.lit(_SPOT), 1))
    rows = rows.withColumn("_spots", F.array_join(spots, "\n"))
    chains = F.split(F.translate(F.regexp_replace("_spots", rf"(?<= ){_MARK}[^ ]+ ", ""), _MARK, ""), "\n")
    chains = F.when(F.col("_spots") != "", chains).when(
        F.col("_words") != "  ", F.array(F.concat(F.lit("="), F.trim("_words")))).otherwise(
        F.array().cast("array<string>"))
    hashed = F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.substring(F.md5(c), 1, 8))))
    return rows.withColumn(to, hashed).drop("_words", "_marked", "_spots")


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def _range_of(order: Column, cuts: list[int]) -> Column:
    """Number of cuts up to the value, found in two steps over the sorted cuts."""
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.size(F.filter(F.lit(cuts[::step]), lambda c: c <= order))
    fine = F.slice(F.lit(cuts), (F.greatest(coarse, F.lit(1)) - 1) * step + 1, step)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda c: c <= order)))


def with_next(rows: DataFrame, order: str, tie: str, carried: dict[str, str]) -> DataFrame:
    """Adds ``carried`` (new name to column) from the next row by ``order``, ``tie``; after the last comes the first."""
    spark = rows.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_o", F.coalesce(F.col(order).cast("long"), F.lit(-2**63)))
    points = keyed.agg(F.percentile_approx("_o", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    cuts = sorted(set(points or []))
    if not cuts:
        cuts = [0]
    # One number for each range; a range that has no row has no first one.
    firsts = [r[0] for r in keyed.groupBy(_range_of(F.col("_o"), cuts)).agg(F.min("_o")).select("min(_o)").collect()]
    firsts.sort()
    if not firsts:
        firsts = [0]
    ranged = keyed.withColumn("_r", _range_of(F.col("_o"), cuts))
    before = {first: bisect_right(cuts, firsts[i - 1]) for i, first in enumerate(firsts)}
    handed = spark.createDataFrame(list(before.items()), "_first long, _to int")
    heads = keyed.join(F.broadcast(handed), F.col("_o") == F.col("_first")).withColumn("_r", F.col("_to")).drop(
        "_first", "_to")
    both = ranged.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)))
    window = Window.partitionBy("_r").orderBy("_head", "_o", tie)
    return both.withColumns({new: F.lead(old).over(window) for new, old in carried.items()}).where("_head = 0").drop(
        "_o", "_r", "_head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` to the fingerprints of each text and of its edited text, and their likeness.

    Edited: the last half of the characters (rounded down) is replaced by as
    many first ones, or all, of the next document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_signatures(rows, "text", "own")
    rows = with_next(rows, "doc_id", "text", {"next_text": "text", "next_own": "own"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = with_signatures(rows, "edited", "edited_own")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", ",").alias("fingerprint"), F.array_join("edited_own", ",").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets reach the likeness; unequal lengths are cut before the sets are compared."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    n_a, n_b = F.size("s_a"), F.size("s_b")
    pairs = pairs.where(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.where(shared * 100 >= (n_a + n_b - shared) * percent).select("a", "b")


def similar_groups(docs: DataFrame, percent: int = 80, few: int = 4) -> DataFrame:
    """``doc_id, text`` to ``doc_id, group_id``, the smallest id reached over likenesses of ``percent`` or more.

    Equal fingerprints are one class. Lanes hold neighbouring lengths; a class
    is posted in its lanes under the rarest of its signatures, as many as a
    similar one cannot all lack. A posting of a few classes forms its pairs;
    in a larger one all meet the smallest id, and what stays apart meets by
    its rarest signatures, members of one group never among themselves.
    Empty fingerprints are alone, as are rows with a null id.
    """
    rows = with_signatures(docs.select("doc_id", "text"), "text", "own").select("doc_id", "own")
    rows = stored(rows, "spot-rows")
    sets = rows.where((F.size("own") > 0) & F.col("doc_id").isNotNull()).groupBy(F.col("own").alias("shingles")).agg(
        F.min("doc_id").alias("id"))
    sets = stored(sets.groupBy("id").agg(F.min("shingles").alias("shingles")), "spot-sets")
    each = stored(sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("g")), "spot-each")
    common = stored(each.groupBy("g").agg(F.count("*").alias("df")), "spot-common")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    early = each.join(common, "g").withColumn("rank", rank).where(
        (F.col("df") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    lane = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    posts = stored(early.select("g", "id", F.explode(F.array(lane, lane + 1)).alias("lane")), "spot-posts")
    heads = stored(posts.groupBy("lane", "g").agg(F.count("*").alias("m"), F.min("id").alias("hub")).where("m > 1"),
                   "spot-heads")
    posts = stored(posts.join(heads, ["lane", "g"]), "spot-grouped")
    small, large = posts.where(F.col("m") <= few), posts.where(F.col("m") > few)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.lane") == F.col("y.lane")) & (F.col("x.g") == F.col("y.g"))
                   & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    stars = large.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    found = stored(_alike(pairs.unionByName(stars), sets, percent), "spot-links")
    named = large.join(components(found), F.col("id") == F.col("node"), "left").select(
        "lane", "g", "id", F.coalesce("component", "id").alias("component"))
    named = stored(named, "spot-named")
    apart = stored(named.groupBy("lane", "g").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                   .where("low < high").select("lane", "g"), "spot-apart")
    members = named.join(apart, ["lane", "g"]).select("id", "component").distinct()
    more = _alike(by_rare_shingles(members, sets, Settings(percent=percent)), sets, percent)
    groups = components(found.unionByName(more))
    own = sets.join(groups, F.col("id") == F.col("node"), "left").select(
        F.col("shingles").alias("own"), F.coalesce("component", "id").alias("group_id"))
    return rows.join(own, "own", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id")).alias("group_id"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
_DROPPED_SQL = _DROPPED.replace("'", "''")
ORACLE = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text),
                                         first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM base),
edited AS (SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 2)
                  || substr(next_text, 1, length(text) // 2) AS edited FROM paired),
texts AS (SELECT doc_id, 0 AS k, text FROM edited UNION ALL SELECT doc_id, 1, edited FROM edited),
lists AS (SELECT doc_id, k, list_filter(string_split(translate(translate(lower(text), chr(9) || chr(10) || chr(11) ||
                 chr(12) || chr(13), '     '), '{_DROPPED_SQL}', ''), ' '), lambda x: x <> '') AS words FROM texts),
each AS (SELECT doc_id, k, unnest(words) AS w, unnest(range(len(words))) AS i FROM lists),
marked AS (SELECT doc_id, k, w, i, w IN ({_STOPS}) AS common,
                  count(*) FILTER (WHERE w NOT IN ({_STOPS})) OVER (PARTITION BY doc_id, k ORDER BY i) AS c FROM each),
chains AS (SELECT a.doc_id, a.k, a.w || ' ' || x.w || ' ' || y.w AS chain FROM marked a
           JOIN marked x ON x.doc_id = a.doc_id AND x.k = a.k AND NOT x.common AND x.c = a.c + 1
           JOIN marked y ON y.doc_id = a.doc_id AND y.k = a.k AND NOT y.common AND y.c = a.c + 2 WHERE a.common),
whole AS (SELECT * FROM chains UNION ALL
          SELECT doc_id, k, '=' || array_to_string(words, ' ') FROM lists l WHERE len(words) > 0
          AND NOT EXISTS (SELECT 1 FROM chains c WHERE c.doc_id = l.doc_id AND c.k = l.k)),
prints AS (SELECT doc_id, k, list_sort(list_distinct(list(substr(md5(chain), 1, 8)))) AS p FROM whole GROUP BY ALL),
own AS (SELECT e.doc_id, e.text, e.edited, coalesce(a.p, []) AS p, coalesce(b.p, []) AS q FROM edited e
        LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.k = 0 LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.k = 1),
nexts AS (SELECT *, coalesce(lead(p) OVER (ORDER BY doc_id, text),
                             first_value(p) OVER (ORDER BY doc_id, text)) AS r FROM own),
sizes AS (SELECT *, len(list_intersect(p, q)) AS pq, len(list_intersect(p, r)) AS pr FROM nexts)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(p, ',') AS fingerprint,
       array_to_string(q, ',') AS edited_fingerprint,
       CASE WHEN len(p) + len(q) = 0 THEN 1.0::DOUBLE ELSE pq::DOUBLE / (len(p) + len(q) - pq) END AS near_edited,
       CASE WHEN len(p) + len(r) = 0 THEN 1.0::DOUBLE ELSE pr::DOUBLE / (len(p) + len(r) - pr) END AS near_next
FROM sizes
"""
