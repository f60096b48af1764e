"""A blocked Bloom filter as a table: a key sets bits of one block of eight words.

Everything is built-in expressions.  The table has at most ``MOST_BLOCKS`` rows of
nine longs, whatever the number of keys, so it may be broadcast; more keys only
mean more false hits, which an exact join removes afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, MOST_BLOCKS, KEYS_PER_BLOCK = 8, 1 << 16, 32


def place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the one bit that it sets in each word of it."""
    block = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))
    bits = F.xxhash64(key, F.lit("bits"))
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def build(keys: DataFrame, key: str, expected: int) -> tuple[DataFrame, int]:
    """The filter of the non-null keys and its number of blocks, for about ``expected`` keys."""
    blocks = min(MOST_BLOCKS, 1 << max(4, (expected // KEYS_PER_BLOCK).bit_length()))
    block, bits = place(F.col("key"), blocks)
    src = keys.select(keys[key].alias("key")).where("key is not null").select(block.alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits)))
    return src.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS))), blocks


def possible(df: DataFrame, key: Column, table: DataFrame, blocks: int, how: str = "mark") -> DataFrame:
    """``df`` with only rows whose key may be among the filter's (``how="keep"``), or
    all rows and a boolean ``maybe`` (``how="mark"``); null keys are not."""
    block, bits = place(key, blocks)
    named = table.select(*(F.col(c).alias(f"_bloom_{c}") for c in table.columns))
    hit = reduce(lambda a, b: a & b, (F.col(f"_bloom_w{k}").bitwiseAND(b) != 0 for k, b in enumerate(bits)))
    if how == "keep":
        return df.join(F.broadcast(named), key.isNotNull() & (F.col("_bloom_block") == block) & hit, "left_semi")
    out = df.withColumn("_bloom_at", F.when(key.isNotNull(), block)).join(F.broadcast(named), F.col("_bloom_at") == F.col("_bloom_block"), "left")
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*df.columns, "maybe")
