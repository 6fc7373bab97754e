"""What the queries share: tables as they lie, and rows written once to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innings.session import stored

__all__ = ["hashed", "possible", "stored", "table", "remainder"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: str | Column, by: int) -> Column:
    """``crc32`` of the id as text, modulo ``by``: the fold of a document."""
    return F.crc32(F.coalesce(F.col(of) if isinstance(of, str) else of, F.lit(-1)).cast("string").cast("binary")) % by


def hashed(of: Column, first: str, second: str) -> list[Column]:
    """Two columns that together stand for a text: independent hashes of 64 bits."""
    return [F.xxhash64(of).alias(first), F.xxhash64(F.lit(second), of).alias(second)]


def possible(rows: DataFrame, keys: DataFrame, columns: list[str], bits: int = 27) -> DataFrame:
    """The rows whose ``columns`` may be among ``keys``, and few others: a sieve before a join that moves wide rows.

    A set of ``2**bits`` bits, 16 MB at most whatever the input, goes to all tasks in pieces of 4 KB. Beyond some ten
    million keys it lets more and more other rows pass; the join behind it decides.
    """
    def place(of: DataFrame) -> DataFrame:
        return of.withColumn("_hash", F.pmod(F.xxhash64(*columns), F.lit(1 << bits)))

    pieces = place(keys).groupBy(F.bitmap_bucket_number("_hash").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_hash")).alias("_set"))
    at = F.bitmap_bit_position("_hash")
    byte = F.conv(F.hex(F.substring("_set", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = place(rows).join(F.broadcast(pieces), F.bitmap_bucket_number("_hash") == F.col("_piece"))
    return on.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_hash", "_piece", "_set")
