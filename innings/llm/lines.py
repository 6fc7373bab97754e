"""Line dedup across documents, with DataFrame operations only.

Every text is cut at line feeds. A line's key has no blanks at its ends and
its ASCII letters in lower case; two hashes of the key, 128 bits together,
stand for it. A line leaves when its key is held by at least ``documents``
documents, except in the smallest of them; the others are put together again
in their order.

1. Lines with a key of ``least`` characters or more are exploded once, as
   hashes with their position: no text goes with them.
2. Pairs of hash and document are made distinct, dealt out by both, then
   counted per hash with map-side parts. A line of a third of all documents is
   one row per task there.
3. Lines meet the counts of the hashes that enough documents hold. Both sides
   are written tables, so a hot hash can be split in the join.
4. The positions that leave are gathered per row. Only there do texts move:
   once, and not at all if the positions are few enough to be sent around.

Defined results: a null text is one empty line, as is an empty one; a null id
is larger than any other; rows of one id are one document, so they never lose
lines to each other; repeated rows give repeated results; long texts are cut
whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innings.llm.tables import hashed, stored

LEAST = 10
DOCUMENTS = 2
#: Fixed: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case; ``translate`` only where other letters stand."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with what tells rows apart: the id (null as the largest one) and two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias(
        "id"), *hashed(text, "t1", "t2"))


def repeated_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """``id, t1, t2, gone``: the positions (from 0) of the lines that leave a row, for rows that lose any."""
    each = _rows(docs).select("id", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    each = each.withColumn("key", key(F.col("line"))).where(F.length("key") >= least)
    each = stored(each.select("id", "t1", "t2", "at", *hashed(F.col("key"), "h1", "h2")), "line-hashes")
    held = each.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("id").alias("low")).where(F.col("n") >= documents).select("h1", "h2", "low")
    held = stored(held, "line-counts")
    return each.join(held, ["h1", "h2"]).where(F.col("id") > F.col("low")).groupBy("id", "t1", "t2").agg(
        F.collect_set("at").alias("gone"))


def _marks(gone: Column) -> Column:
    """``gone`` positions as marks in the order of positions, up to the last one; found by sets, so linear."""
    stays = F.array_except(F.sequence(F.lit(0), F.array_max(gone)), gone)
    mark = lambda value: lambda p: F.struct(p.alias("at"), F.lit(value).alias("gone"))
    return F.array_sort(F.concat(F.transform(gone, mark(True)), F.transform(stays, mark(False))))


def dedup(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_lines, n_dropped, kept``, the text that is left."""
    found = repeated_lines(docs, least, documents)
    # Written, so that its real size decides whether texts have to move.
    found = stored(found.select("id", "t1", "t2", F.size("gone").cast("long").alias("n_dropped"),
                                _marks(F.col("gone")).alias("marks")), "line-positions")
    rows = _rows(docs).join(found, ["id", "t1", "t2"], "left")
    stays = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(
        F.get(F.col("marks"), i)["gone"], F.lit(False)))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return rows.select(
        "doc_id", (breaks + 1).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias(
            "n_dropped"),
        F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept"))
