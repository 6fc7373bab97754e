"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a key that is a hash of its id. Within a source the
documents lie in the order of their keys: ranges of keys form buckets, the
tokens of a bucket are summed first, running sums over the buckets give each
bucket its start, and a window inside a bucket adds the rest. A source takes
whole epochs and then the documents up to its exact budget, the last one in
part.

A source of n rows has about sqrt(n) buckets of sqrt(n) rows, so no window
sees more than that of a source, however large its share. Rows of the windows
hold id, key and size, never texts. Only tables with a row per source or per bucket are joined back.

Defined results: null text and null counts have size 0; a null source is a
source of its own, last in order; rows with equal ids lie by size, and null ids
have one key; :func:`mixed` tells rows apart by all their columns, so each is
repeated as often as the mix takes it and rows equal in all columns are
interchangeable; an empty table gives no rows; all sizes 0 give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innings.llm.tables import stored


def n_words(text: str | Column) -> Column:
    """Number of words of a text; the separators are squeezed rather than the words extracted."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    spaces = "\t\n\x0b\x0c\r"
    return F.size(F.array_remove(F.split(F.translate(col, spaces, " " * len(spaces)), " "), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, source_size, n_rows`` to the same with ``weight, target``.

    A source whose share is above ``most`` times its size stops there and the
    rest is shared again by weight. With sources ordered by limit over weight
    the ones that stop are the first ones, so running sums give the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1).cast("long")
    ).withColumn("most", F.col("source_size") * most)
    # All rows of this table: one per source.
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0).cast("long")
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), zero)).cast("double")
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)).cast("double"))
    found = ranked.withColumn("level", level).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level")))
                             .over(whole)["level"])
    return found.select("source", "source_size", "n_rows", "weight",
                        F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0,
        carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, text`` to ``doc_id, size, source_size, target, taken`` (and source, epochs).

    ``taken`` counts words with repeats: whole epochs of the document plus
    what the last, unfinished epoch takes of it. ``carried`` columns stay with
    their row and order rows of equal id and size.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), n_words("text").alias("size"), *carried)
    rows = rows.withColumn("key", F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"),
                                                                      F.lit(seed))), 1, 15), 16, 10).cast("long"))
    rows = stored(rows, "mixing-rows")  # a number, a name and a key per document: the texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    aims = targets(sizes, weights, most).withColumn(
        "n_buckets", F.ceil(F.sqrt("n_rows"))).withColumn(
        "budget", F.floor(F.col("target"))).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    keyed = rows.alias("a").join(aims.alias("b"), same).select(
        "doc_id", F.col("a.source"), "size", *carried, "key", "source_size", "target", "epochs", "rest",
        F.floor(F.col("key") / (F.lit(float(16 ** 15)) / F.col("n_buckets"))).alias("bucket"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carried).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("a").join(
        starts.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket"))).select("a.*", "start")
    room = F.col("rest") - F.col("start") - F.col("within")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room))
    return joined.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        "source", F.col("epochs").cast("long").alias("epochs"), *carried)


def _marks(docs: DataFrame) -> dict[str, Column]:
    """128 bits of all columns of a row. Maps, which cannot be hashed, go as JSON."""
    cols = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    # Nulls leave a hash as it is; their places tell which column was null.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in docs.columns])
    return {f"__mix_{k}": F.xxhash64(F.lit(k), nulls, *cols) for k in (0, 1)}


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row for each epoch (the one cut at the budget stays whole).

    A text without words is in no epoch. Rows equal in all columns meet in one
    row, which is repeated as often as all of them together.
    """
    marks = _marks(docs)
    marked = docs.withColumns(marks)
    extra = F.when(F.col("taken") > F.col("epochs") * F.col("size"), 1).otherwise(0)
    copies = mix(marked, **options, carried=tuple(marks)).where("taken > 0").groupBy(*marks).agg(
        F.sum(F.col("epochs") + extra).cast("int").alias("__mix_n"))
    each = marked.dropDuplicates(list(marks)).join(copies, list(marks))
    return each.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), "__mix_n"))).select(*docs.columns)
