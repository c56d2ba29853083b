"""The seen-filter of the crawl: bit places of a key, and filters as a table of set bits.

A filter is a table (bit BIGINT) of its set bits. It is added to by union and asked by a join, so that it may be as large
as its keys need; the places are those of the crawler's own filter, so that tables can be exchanged with it.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.config import CrawlOptions


def places(key: Column, size_bits: int = CrawlOptions.bloom_bits, hashes: int = CrawlOptions.bloom_hashes) -> Column:
    """array<bigint>: one bit place per hash; null for a null key.

    The k-th place is the 64-bit BLAKE2b digest of the UTF-8 key, salted with k in decimal padded by NULs to 16 bytes,
    read big-endian, modulo the size.
    """
    if size_bits <= 0 or hashes <= 0:
        raise ValueError("the size and the number of hashes must be positive")
    salts = [str(k).encode().ljust(16, b"\0") for k in range(hashes)]

    @F.pandas_udf("array<bigint>")
    def of(keys: pd.Series) -> pd.Series:
        def bits(key):
            if key is None:
                return None
            data = key.encode()
            return [int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=s).digest(), "big") % size_bits for s in salts]

        return keys.map(bits)

    return of(key)


def set_bits(keys: DataFrame, key: str, size_bits: int = CrawlOptions.bloom_bits, hashes: int = CrawlOptions.bloom_hashes) -> DataFrame:
    """(bit): the set bits of a filter that holds these keys. Null keys are ignored."""
    once = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return once.select(F.explode(places(F.col(key), size_bits, hashes)).alias("bit")).distinct()


def might_contain(asked: DataFrame, key: str, bits: DataFrame, size_bits: int = CrawlOptions.bloom_bits, hashes: int = CrawlOptions.bloom_hashes) -> DataFrame:
    """(key, maybe) of each distinct key: whether all of its bits are set. Never false for a key that was added."""
    once = asked.select(key).where(F.col(key).isNotNull()).distinct()
    wanted = once.select(key, F.explode(F.array_distinct(places(F.col(key), size_bits, hashes))).alias("bit"))
    held = bits.select("bit").distinct().withColumn("_set", F.lit(True))
    return wanted.join(held, "bit", "left").groupBy(key).agg((F.count("*") == F.count("_set")).alias("maybe"))
