"""Importance resampling towards a target corpus, by hashed runs of words.

A text's features are its runs of 1 to n consecutive words, joined by one space; a feature's bucket is its CRC-32 modulo the number of
buckets. One scan of a text finds them all: a ring keeps a running CRC for each of the last n starts, and each new word
extends every one of them by a space and the word. Bucket counts of raw and target texts give each bucket's gain, a text's weight is the sum of its
features' gains, and the texts drawn are those with the highest weight plus Gumbel noise, which is sampling without replacement in
proportion to exp(weight).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.common import small_batches, written

#: A word in the bytes of lower-cased UTF-8: letters, digits and whatever is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features of a text that are gathered at once.
CHUNK = 1 << 16


def word_stream(text: bytes) -> Iterator[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (m[0] for m in WORD.finditer(text.lower()))


def ring_buckets(words: Iterator[bytes], n: int, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``n`` words, in arrays of bounded length."""
    ring: list[int] = []
    out: list[int] = []
    for word in words:
        if n > 1:
            tail = b" " + word
            ring = [crc32(tail, state) for state in ring[1 - n :]]
        else:
            ring.clear()
        ring.append(crc32(word))
        out += ring
        if len(out) >= CHUNK:
            yield np.array(out, np.int64) % buckets
            out = []
    if out:
        yield np.array(out, np.int64) % buckets


def bucket_counts(docs: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """Rows (bucket, n): how often the features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0).cast(pa.binary()):
                for part in ring_buckets(word_stream(body.as_py() or b""), n, buckets):
                    total += np.bincount(part, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket: floor of 1000 times the log ratio of the smoothed shares in target and raw texts."""
    counts = raw.withColumnsRenamed({"n": "s"}).join(target.withColumnsRenamed({"n": "t"}), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = counts.collect()  # one row a bucket at most, whatever the input
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return [floor(1000 * log((a + 1.0) * all_s / ((b + 1.0) * all_t))) for a, b in zip(t.tolist(), s.tolist())]


def weigh(docs: DataFrame, gains: list[int], n: int, key: str, text: str) -> DataFrame:
    """Rows (key, n_words, n_features, weight) of every document."""
    gain = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for body in batch.column(1).cast(pa.binary()):
                held = [0, 0, 0]

                def counted(stream: Iterator[bytes], held: list[int] = held) -> Iterator[bytes]:
                    for word in stream:
                        held[0] += 1
                        yield word

                for part in ring_buckets(counted(word_stream(body.as_py() or b"")), n, len(gain)):
                    held[1] += len(part)
                    held[2] += int(gain[part].sum())
                words.append(held[0])
                features.append(held[1])
                weights.append(held[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (words, features, weights)]], names=["key", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of a key, from the first 32 bits of sha256(seed:key)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column], tasks: int) -> DataFrame:
    """Adds rank (1, 2, ... in ``order``): rows are dealt to ranges of the order, numbered in each, and the ranges' row counts put before them.

    The ranges are written once, so that a task that is run again finds the rows it had.
    """
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33))
    dealt = written(dealt, "ranges")
    counts = dealt.groupBy("piece").agg(F.count("*").alias("held"))  # one row a range
    before = counts.select("piece", (F.sum("held").over(Window.orderBy("piece")) - F.col("held")).alias("before"))
    return dealt.join(F.broadcast(before), "piece").withColumn("rank", F.col("before") + F.col("at") + 1).drop("piece", "at", "before")


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """Draw floor(percent * N / 100) of the N documents with at least ``least_words`` words, so that they resemble the target texts.

    Rows: key, n_features, weight, score (weight plus noise, both whole thousandths), rank (1, 2, ... by score from the highest, ties to the smaller
    key; null for documents that are not drawn). Every document is a row. A null text has no words and weight 0; null keys share one noise and come after others
    of their score; rows of one key and score follow each other by weight and n_features, and are alike if these are; an empty table gives no
    rows; an empty target counts nothing; other columns are not carried.

    Each text is scanned twice where it is read, once to count and once to weigh. Only the buckets' counts meet in one place,
    at most ``buckets`` rows whatever the input. Ranks come from ranges of the score, so no task holds more than a range of rows without their texts.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        gains = bucket_gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets), buckets)
        rows = written(weigh(docs, gains, n, key, text).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "weights")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    enough = rows.where(F.col("n_words") >= least_words)
    drawn = F.lit(enough.count() * percent // 100)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    picked = ranked(enough, order, tasks).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return picked.select(*columns).unionByName(rest.select(*columns))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Keys must be unique and not null."""
    drawn = resample(docs, target, key=key, **options).where("rank is not null").select(key)
    return docs.join(drawn, key, "left_semi")
