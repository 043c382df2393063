"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path

#: The white space that ends words and lines, [\x20\x09-\x0D]; bytes.split() uses the same.
WHITE = b" \t\n\x0b\x0c\r"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null and empty texts have none. Each word becomes one letter, so no array of words is held."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def smallest_hashes(df: DataFrame, name: str, k: int, n: int) -> DataFrame:
    """k rows of df, which has about n, by the smallest hash of a column: the same ones in every run.

    Rows over a threshold that leaves about 3 k go first, so no more reach one task however many partitions there are.
    """
    share = min(1.0, (3 * k + 100) / max(1, n))
    h = F.xxhash64(col(name))
    return df.where(F.pmod(h, F.lit(1 << 32)) < int(share * (1 << 32))).orderBy(
        F.pmod(h, F.lit(1 << 32)), col(name),
    ).limit(k)


def bitmap_of(df: DataFrame, name: str, bits: int) -> bytes:
    """A bit for the leading `bits` bits of each hash in a column of longs; Spark builds the words, 2**bits / 64 of them at most."""
    at = df.select(F.shiftrightunsigned(col(name), 64 - bits).alias("at")).where(F.col("at").isNotNull())
    words = at.groupBy(F.shiftright(
        "at", 6,
    ).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for part in words.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.tobytes()


def in_bitmap(h: np.ndarray, bitmap: bytes, bits: int) -> np.ndarray:
    """Whether the bit of each unsigned hash is set: always for those that made the bitmap, by chance for others."""
    at = h >> np.uint64(64 - bits)
    return (np.frombuffer(
        bitmap, np.uint8,
    )[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
