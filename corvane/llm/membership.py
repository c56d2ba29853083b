"""Problem 5: whether a key was seen before, in bounded memory, with the measured rate of wrong answers.

Keys are hashed and spread over buckets; a task walks through a bucket in order and holds one blocked Bloom filter of
known size. Every record's key is queried first and inserted then, so that the filter answers for earlier records as
well as for the keys known before. Beside each queried key a key that can't exist is queried, too: the share of these
that the filter claims to know is the measured error. The filter has no false negatives, so only its positive answers
are verified against the stored keys. The filters can be kept as a table, one row a bucket, and loaded by the next run,
which then needs no earlier key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.urls import normalize
from corvane.llm.registry import query
from corvane.operators.skew import SALTS, heavy_keys, salted_join
from corvane.plans.registry import NUM_PAGES
from corvane.session import settle
from corvane.sources.tables import latest, table

FALSE_POSITIVES = 0.001
KEYS_PER_BUCKET = 1_000_000
BLOCK_WORDS = 8  # 512 bits, one cache line


class BlockedBloom:
    """A Bloom filter whose probes of one key all fall into one block of 512 bits."""

    def __init__(self, keys: int, wrong: float = FALSE_POSITIVES):
        bits_per_key = 1.25 * -math.log(wrong) / math.log(2) ** 2  # a quarter more, as blocks fill unevenly
        self.probes = max(1, round(-math.log2(wrong)))
        self.blocks = max(1, math.ceil(keys * bits_per_key / (64 * BLOCK_WORDS)))
        self.words = np.zeros(self.blocks * BLOCK_WORDS, dtype=np.uint64)

    def _places(self, hashes: np.ndarray):
        h = hashes.view(np.uint64)
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
            a, b = h & np.uint64(0xFFFF), (((h >> np.uint64(16)) & np.uint64(0xFFFF)) * np.uint64(2654435761) >> np.uint64(7)) | np.uint64(1)
            bit = (a[:, None] + b[:, None] * np.arange(self.probes, dtype=np.uint64)[None, :]) & np.uint64(511)
        word = block[:, None] * np.uint64(BLOCK_WORDS) + (bit >> np.uint64(6))
        return word.astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def query(self, hashes: np.ndarray) -> np.ndarray:
        word, bit = self._places(hashes)
        return ((self.words[word] & bit) != 0).all(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        word, bit = self._places(hashes)
        np.bitwise_or.at(self.words, word.ravel(), bit.ravel())


#: Kinds of rows of a bucket's walk, in the order in which they come at one place: a stored filter, a key to insert, a record that asks.
FILTER, INSERT, ASK, INSERT_AFTER = range(4)
WALKED = "bucket int, record string, key string, maybe boolean, absent_claimed boolean, filter binary"


def walk(batches, keys: int, wrong: float, keep: bool):
    """Streams rows sorted by bucket and order; answers those that ask, and with keep gives each bucket's filter at its end."""
    names = [x.split()[0] for x in WALKED.split(", ")]
    at, filt = None, None

    def end():
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), *(pa.array([None], t) for t in (pa.string(), pa.string(), pa.bool_(), pa.bool_())), pa.array([filt.words.tobytes()], pa.binary())], names=names
        )

    for batch in batches:
        bucket, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
        h, absent = batch.column("h").to_numpy(), batch.column("absent").to_numpy()
        seen, false = np.zeros(len(h), bool), np.zeros(len(h), bool)
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else []
        for lo, hi in zip(edges, [*edges[1:], len(bucket)]):
            if bucket[lo] != at:
                if keep and at is not None:
                    yield end()
                at, filt = bucket[lo], BlockedBloom(keys, wrong)
            for x in np.flatnonzero(kind[lo:hi] == FILTER) + lo:
                filt.words |= np.frombuffer(batch.column("filter")[x].as_buffer(), np.uint64)
            rows = np.flatnonzero(kind[lo:hi] != FILTER) + lo
            asks = rows[kind[rows] == ASK]
            if len(asks):
                # what the rows before in this batch insert is seen, too
                first = np.zeros(len(rows), bool)
                first[np.unique(h[rows], return_index=True)[1]] = True
                repeat = ~first[kind[rows] == ASK]
                seen[asks], false[asks] = filt.query(h[asks]) | repeat, filt.query(absent[asks])
            filt.insert(h[rows])
        asked = kind == ASK
        out = batch.filter(pa.array(asked))
        yield pa.RecordBatch.from_arrays(
            [out.column("bucket"), out.column("record"), out.column("key"), pa.array(seen[asked]), pa.array(false[asked]), pa.nulls(out.num_rows, pa.binary())], names=names
        )
    if keep and at is not None:
        yield end()


def heavy_firsts(asked: DataFrame) -> DataFrame:
    """(key, f1, f2, first) of keys that hold at least a hundredth of the records: the place and id of their first; at most a hundred rows."""
    counts = asked.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("o1", "o2", "record")).alias("f"))
    heavy = heavy_keys(counts, "key", "n")
    return settle(counts.join(F.broadcast(heavy), "key", "left_semi").select("key", F.col("f.o1").alias("f1"), F.col("f.o2").alias("f2"), F.col("f.record").alias("first")))


def ask(
    known: DataFrame, asked: DataFrame, wrong: float = FALSE_POSITIVES, per_bucket: int = KEYS_PER_BUCKET, filters: DataFrame | None = None,
    buckets: int | None = None, keys: int | None = None, keep: bool = False,
) -> DataFrame:
    """(bucket, record, key, maybe, absent_claimed, filter) for each record of `asked`: columns record, key, and the order o1, o2.

    `known` has keys, repeated or not, that count as earlier than all records. maybe is the filter's answer on the known
    keys and on the records before; absent_claimed its answer on a key that can't exist. A record's own earlier copies
    in one batch are found by comparing hashes, which says what the filter would. A bucket's filter has a fixed size: at
    twice the wanted rate the buckets would have to hold a tenth more keys than expected, which hashing rules out from
    some thousand on. The records of a key that holds a hundredth of all go, but for the first, to other buckets,
    where the key is inserted at the first one's place.

    With `keep` each bucket's last filter comes as a row with `filter`, the other columns null; such rows, given as
    `filters` with the same buckets and keys, stand for all keys of the run before.
    """
    if filters is not None and (buckets is None or keys is None):
        raise ValueError("stored filters need their number of buckets and keys")
    if buckets is None or keys is None:
        total = known.count() + asked.count()
        buckets = max(known.sparkSession.sparkContext.defaultParallelism, math.ceil(total / per_bucket))
        keys = int(total / buckets * 1.1) + 1000
    null = lambda kind: F.lit(None).cast(kind)
    place = lambda salt: F.pmod(F.xxhash64("h", F.lit(1)) + salt, F.lit(buckets)).cast("int").alias("bucket")
    row = ("bucket", "o1", "o2", "kind", "h", "absent", "record", "key", "filter")
    zero, early = F.lit(0).cast("long"), F.lit(-(1 << 62)).cast("long")
    old = known.where(F.col("key").isNotNull()).select(F.xxhash64("key").alias("h")).distinct().select(
        place(F.lit(0)), early.alias("o1"), zero.alias("o2"), F.lit(INSERT).alias("kind"), "h", zero.alias("absent"),
        null("string").alias("record"), null("string").alias("key"), null("binary").alias("filter"),
    )
    heavy = heavy_firsts(asked)
    hashed = asked.join(F.broadcast(heavy), "key", "left").withColumn("h", F.xxhash64("key"))
    salt = F.when(F.col("first").isNotNull() & (F.col("record") != F.col("first")), F.pmod(F.xxhash64("record"), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    new = hashed.select(
        place(salt), "o1", "o2", F.lit(ASK).alias("kind"), "h", F.xxhash64(F.lit("absent"), F.col("record"), F.col("key")).alias("absent"),
        F.col("record").cast("string").alias("record"), "key", null("binary").alias("filter"),
    )
    again = heavy.withColumn("h", F.xxhash64("key")).withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(SALTS)))).select(
        place(F.col("salt")), F.col("f1").alias("o1"), F.col("f2").alias("o2"), F.lit(INSERT_AFTER).alias("kind"), "h", zero.alias("absent"),
        null("string").alias("record"), null("string").alias("key"), null("binary").alias("filter"),
    )
    rows = old.unionByName(new).unionByName(again)
    if filters is not None:
        kept = filters.where(F.col("filter").isNotNull()).select(
            "bucket", early.alias("o1"), zero.alias("o2"), F.lit(FILTER).alias("kind"), zero.alias("h"), zero.alias("absent"),
            null("string").alias("record"), null("string").alias("key"), "filter",
        )
        rows = rows.unionByName(kept)
    placed = rows.select(*row).repartition(buckets, "bucket").sortWithinPartitions("bucket", "o1", "o2", "kind", "record")
    return placed.mapInArrow(lambda it: walk(it, keys, wrong, keep), WALKED)


def frontier_entries(frontier: DataFrame) -> DataFrame:
    """(entry_id, key, o1, o2): entries once each, with normalised url and the two numbers of the id."""
    once = frontier.where(F.col("entry_id").isNotNull()).groupBy("entry_id").agg(F.min("url").alias("url"))
    part = lambda i: F.coalesce(F.try_element_at(F.split("entry_id", "-"), F.lit(i)).try_cast("long"), F.lit(0))
    return once.select("entry_id", normalize("url").alias("key"), part(1).alias("o1"), part(2).alias("o2"))


def judge(pages: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The filter's answers on every entry, in order, and for the keys of positive answers what is stored: (key, first_id, known).

    Entries whose url is null, empty or not http(s) have no key and are left out. Repeated entry ids count once.
    """
    entries = settle(frontier_entries(frontier).where(F.col("key").isNotNull()).withColumnRenamed("entry_id", "record"))
    known = pages.select(F.col("url").alias("key"))
    answers = settle(ask(known, entries).select("record", "key", "maybe", "absent_claimed"))
    asked = answers.where("maybe").select("key").distinct()
    in_pages = known.join(asked, "key", "left_semi").distinct().withColumn("known", F.lit(True))
    first = entries.groupBy("key").agg(F.min(F.struct("o1", "o2", "record")).alias("f"), F.count("*").alias("n"))
    told = asked.join(first, "key").join(in_pages, "key", "left").select("key", F.col("f.record").alias("first_id"), F.coalesce("known", F.lit(False)).alias("known"), "n")
    return answers, settle(told)


def verified(answers: DataFrame, told: DataFrame) -> DataFrame:
    """answers with seen: whether a positive answer is right. Negative answers have seen = false."""
    rows = salted_join(answers, told.select("key", "first_id", "known"), "key", heavy_keys(told, "key", "n"), "left")
    return rows.withColumn("seen", F.col("maybe") & F.coalesce(F.col("known") | (F.col("record") != F.col("first_id")), F.lit(False)))


# SQL: entries with their normalised url, numbered by key.
ENTRY_KEYS = r"""WITH e AS (SELECT entry_id, min(trim(url, E' \t\n\r')) AS u FROM frontier GROUP BY 1),
    s AS (SELECT entry_id, lower(regexp_extract(u, '^([a-zA-Z]+)://([^/?#]*)', 1)) AS scheme,
        lower(regexp_replace(regexp_extract(u, '^([a-zA-Z]+)://([^/?#]*)', 2), '^.*@', '')) AS host,
        regexp_replace(regexp_replace(u, '#.*$', ''), '^[a-zA-Z]+://[^/?#]*', '') AS rest,
        split_part(entry_id, '-', 1)::BIGINT AS a, split_part(entry_id, '-', 2)::BIGINT AS b FROM e),
    k AS (SELECT entry_id, a, b, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '')
        ELSE regexp_replace(host, ':443$', '') END || CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END AS key
        FROM s WHERE scheme IN ('http', 'https') AND host <> ''),
    f AS (SELECT entry_id, key, row_number() OVER (PARTITION BY key ORDER BY a, b) AS n FROM k)"""


@query("p5_found", f"{ENTRY_KEYS} SELECT entry_id FROM f WHERE n > 1 OR key IN (SELECT url FROM pages)")
def found(spark, where):
    answers, told = judge(table(spark, where, "pages"), table(spark, where, "frontier"))
    return verified(answers.where("maybe"), told).where("seen").select(F.col("record").alias("entry_id"))


def measured(spark, where) -> DataFrame:
    """One row: entries asked, seen before, positive answers that are wrong, and positive answers on keys that can't exist."""
    rows = verified(*judge(table(spark, where, "pages"), table(spark, where, "frontier")))
    return rows.agg(
        F.count("*").alias("asked"), F.count_if("seen").alias("seen"), F.count_if(F.col("maybe") & ~F.col("seen")).alias("new_claimed"),
        F.count_if("absent_claimed").alias("absent_claimed"),
    )


@query("p5_error_rate")
def error_rate(spark, where):
    """The counts of wrong answers, and the rates that they make of the new and of the absent keys."""
    rate = lambda wrong, all_: F.round(F.col(wrong) / F.greatest(all_, F.lit(1)), 6)
    return measured(spark, where).select(
        "asked", "seen", "new_claimed", "absent_claimed", rate("new_claimed", F.col("asked") - F.col("seen")).alias("new_rate"),
        rate("absent_claimed", F.col("asked")).alias("absent_rate"), F.lit(FALSE_POSITIVES).alias("target"),
    )


@query("p5_error_bounds", f"{ENTRY_KEYS} SELECT count(*) AS asked, count(*) FILTER (n > 1 OR key IN (SELECT url FROM pages)) AS seen, true AS new_within, true AS absent_within FROM f")
def error_bounds(spark, where):
    """Entries asked and seen, none of these missed, and whether both rates keep within twice the wanted one, three wrong answers being chance."""
    within = lambda wrong, all_: F.col(wrong) <= F.greatest(F.lit(3), 2 * FALSE_POSITIVES * all_)
    return measured(spark, where).select(
        "asked", "seen", within("new_claimed", F.col("asked") - F.col("seen")).alias("new_within"), within("absent_claimed", F.col("asked")).alias("absent_within")
    )
